"""The store's verbs over versioned tables: each write reads the current version and makes the next."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import TYPES, EngineConfig
from .functions.text import norm_title, parse_tags
from .operators import cluster, graph, index, recall, sessions, store, vectors
from .schema import OPS, migrate
from .sources import records
from .sources.tables import Snapshots, cut_lineage


class Engine:
    """Reads are pure and may be batches of any size; writes go one after another.

    embedder: a function from a list of texts to a matrix; without one, search is by keywords alone.
    """

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, embedder: Callable | None = None):
        self.spark, self.snapshots, self.embedder = spark, Snapshots(spark, path), embedder
        self._process, self._offered = uuid.uuid4().hex, None
        self.config = config or EngineConfig.read(conf={k: spark.conf.get(k) for k in (f"recollect.{n}" for n in EngineConfig.__dataclass_fields__) if spark.conf.get(k, None) is not None})

    def tables(self) -> dict[str, DataFrame]:
        return self.snapshots.read()

    def _now(self, at=None):
        return F.current_timestamp() if at is None else F.lit(at).cast("timestamp")

    def _counted(self, tables: dict[str, DataFrame], key: str) -> tuple[dict[str, DataFrame], int]:
        """The tables with a counter of meta raised by one, and its value."""
        meta = tables["meta"]
        row = meta.where(F.col("key") == key).first()
        value = int(row.value) + 1 if row else 1
        fresh = self.spark.createDataFrame([(key, str(value))], meta.schema)
        return tables | {"meta": meta.where(F.col("key") != key).unionByName(fresh)}, value

    # --- writes ---

    def remember(self, ops: DataFrame | list[dict], now=None) -> DataFrame:
        """Create or update rows. ops: type, title, body, and perhaps seq, tags, links, sources, at, device_id, author and
        embedding. It gives (type, title_norm, id, action) with action created, updated or consolidated.

        New rows get edges to their nearest neighbours, to their links and, as principles, to their sources. Every so
        many calls the retention sweep runs.
        """
        rows = self._ops(ops, now)
        tables = self.tables()
        after, actions = store.upsert(tables["memories"], rows)
        actions = cut_lineage(actions, "actions")
        after = cut_lineage(after, "memories")
        edges = tables["edges"]
        members = tables["session_members"]
        if self.config.consolidate:
            after, gone = store.consolidate(after, actions.where("action = 'created'").select("id"), self._now(now), self.config.dedup_threshold)
            after, gone = cut_lineage(after, "memories"), cut_lineage(gone, "gone")
            members = sessions.unprime(members, gone.select(F.col("old_id").alias("id")))
            actions = actions.join(gone.select(F.col("new_id").alias("id"), F.lit(True).alias("c")).distinct(), "id", "left").withColumn("action", F.when(F.col("c"), "consolidated").otherwise(F.col("action"))).drop("c")
        if self.config.assoc:
            touched = actions.select("id")
            live = after.where("valid_to is null and embedding is not null")
            near = vectors.semantic_edges(live.join(touched, "id", "left_semi").select("id", "embedding"), live.select("id", "embedding"), self.config.knn_k).withColumn("kind", F.lit("semantic"))
            told = graph.explicit_edges(after.join(touched, "id", "left_semi")).join(after.where("valid_to is null").select(F.col("id").alias("dst")), "dst", "left_semi").withColumn("kind", F.lit("explicit"))
            new = near.unionByName(told)
            if "sources" in rows.columns:
                keyed = rows.where(F.size("sources") > 0).select("type", norm_title(F.col("title")).alias("title_norm"), "sources").join(actions, ["type", "title_norm"])
                new = new.unionByName(graph.crystallized_edges(keyed.select("id", "sources")).withColumn("kind", F.lit("crystallized")))
            edges = graph.merge_edges(edges, new.withColumn("updated_at", self._now(now)).select(*edges.columns), self.config)
        tables, n = self._counted(tables | {"memories": after, "edges": edges, "session_members": members}, "forget_counter")
        self.snapshots.write(tables)
        if n % self.config.forget_interval == 0:
            self.sweep(now)
        return actions.select("type", "title_norm", "id", "action")

    def _ops(self, ops: DataFrame | list[dict], now) -> DataFrame:
        if isinstance(ops, list):
            keys = [*OPS.names, "sources"]
            rows = [{k: o.get(k) for k in keys} | {"seq": o.get("seq", i), "tags": o["tags"].split(",") if isinstance(o.get("tags"), str) else o.get("tags")} for i, o in enumerate(ops)]
            for o in rows:
                if o["type"] not in TYPES:
                    raise ValueError(f"type must be one of {', '.join(TYPES)}, not {o['type']}")
            schema = T.StructType([*OPS.fields, T.StructField("sources", T.ArrayType(T.LongType()))])
            ops = self.spark.createDataFrame([tuple(r[k] for k in schema.names) for r in rows], schema)
        given = set(ops.columns)
        rows = migrate(ops, OPS)
        if "sources" in given:
            rows = cut_lineage(ops.withColumn("seq", F.coalesce(F.col("seq"), F.monotonically_increasing_id())), "ops") if "seq" in given else ops.withColumn("seq", F.monotonically_increasing_id())
            rows = migrate(rows, OPS).join(rows.select(F.col("seq").cast("long").alias("seq"), "sources"), "seq")
        elif "seq" not in given:
            rows = rows.withColumn("seq", F.monotonically_increasing_id())
        rows = rows.withColumns({"tags": F.array_distinct(parse_tags(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ","))), "at": F.coalesce("at", self._now(now)), "device_id": F.coalesce("device_id", F.lit(self.config.device_id)), "author": F.coalesce("author", F.lit(self.config.author))})
        return store.with_vectors(rows, self.embedder) if self.embedder and self.config.semantic else rows

    def link(self, a: int, b: int, now=None) -> None:
        """Link two current rows; ValueError if one is not there."""
        tables = self.tables()
        pairs = self.spark.createDataFrame([(a, b)], "a long, b long")
        if a == b or not store.bad_pairs(tables["memories"], pairs).isEmpty():
            raise ValueError(f"cannot link {a} and {b}")
        new = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit("explicit").alias("kind"), F.lit(1.0).alias("weight"), self._now(now).alias("updated_at"))
        edges = graph.merge_edges(tables["edges"], new, self.config) if self.config.assoc else tables["edges"]
        self.snapshots.write({"memories": store.link(tables["memories"], pairs, self._now(now)), "edges": edges})

    def forget(self, id_: int, now=None) -> bool:
        """End a row's validity; whether it was current."""
        tables = self.tables()
        ids = self.spark.createDataFrame([(id_,)], "id long")
        if tables["memories"].where((F.col("id") == id_) & F.col("valid_to").isNull()).isEmpty():
            return False
        self.snapshots.write({"memories": store.forget(tables["memories"], ids, self._now(now)), "session_members": sessions.unprime(tables["session_members"], ids)})
        return True

    def restore(self, id_: int) -> str:
        """Make a row current again: missing, current or restored; ValueError if another current row has its key."""
        after, told = store.restore(self.tables()["memories"], self.spark.createDataFrame([(id_,)], "id long"))
        outcome = told.first().outcome
        if outcome == "clash":
            raise ValueError(f"another current row has the key of {id_}")
        if outcome == "restored":
            self.snapshots.write({"memories": after})
        return outcome

    def purge(self, id_: int) -> bool:
        """Remove a row for good, with its edges and session members; whether it was there."""
        tables = self.tables()
        if tables["memories"].where(F.col("id") == id_).isEmpty():
            return False
        self.snapshots.write(store.purge(tables, self.spark.createDataFrame([(id_,)], "id long")))
        return True

    def dismiss_cluster(self, a: int, b: int) -> bool:
        """Never offer the cluster with this peak again; refused where clusters are off."""
        if not self.config.crystallize:
            return False
        pair = self.spark.createDataFrame([(a, b)], "src long, dst long")
        self.snapshots.write({"dismissed": store.dismiss(self.tables()["dismissed"], pair)})
        return True

    def sweep(self, now=None) -> int:
        """Archive old rows that nothing uses; how many."""
        tables = self.tables()
        if not (self.config.assoc and self.config.forget):
            return 0
        ids = cut_lineage(index.sweep_candidates(tables["memories"], tables["edges"], self._now(now), self.config), "swept")
        n = ids.count()
        if n:
            self.snapshots.write({"memories": store.forget(tables["memories"], ids, self._now(now)), "session_members": sessions.unprime(tables["session_members"], ids)})
        return n

    def backfill(self, name: str) -> int:
        """Give vectors to rows that have none, and edges to their neighbours; how many were made. ``name`` tells the embedder's
        model: where it or its number of dimensions is another than at this device's last backfill, all are made anew."""
        if self.embedder is None or not self.config.semantic:
            return 0
        tables, key = self.tables(), f"embedding:{self.config.author or self.config.device_id}"
        signature = f"{name}:{len(self.embedder([''])[0])}"
        row = tables["meta"].where(F.col("key") == key).first()
        memories = tables["memories"]
        if row is None or row.value != signature:
            memories = memories.withColumn("embedding", F.lit(None).cast(memories.schema["embedding"].dataType))
        n = memories.where("embedding is null").count()
        if not n:
            return 0
        filled = cut_lineage(vectors.backfill(memories, self.embedder), "filled")
        after = {"memories": filled}
        if self.config.assoc:
            live = filled.where("valid_to is null").select("id", "embedding")
            near = vectors.semantic_edges(live, k=self.config.knn_k).select("src", "dst", F.lit("semantic").alias("kind"), "weight", F.current_timestamp().alias("updated_at"))
            after["edges"] = graph.merge_edges(tables["edges"], near.select(*tables["edges"].columns), self.config)
        meta = tables["meta"]
        after["meta"] = meta.where(F.col("key") != key).unionByName(self.spark.createDataFrame([(key, signature)], meta.schema))
        self.snapshots.write(after)
        return n

    def resolve_session(self, session: str | None = None, now=None) -> str:
        """The session that a recall belongs to: the one named, which later calls inherit, or the last one unless more than
        the gap has passed since, or a new one. Each process has its own."""
        meta = self.tables()["meta"]
        then, key = self.spark.range(1).select(F.unix_micros(self._now(now)).alias("t")).first().t, f"session:{self._process}"
        row = meta.where(F.col("key") == key).first()
        held = json.loads(row.value) if row else None
        if session is None:
            goes_on = held is not None and then - held["last"] <= self.config.session_gap_seconds * 1_000_000
            session = held["session"] if goes_on else f"{then}:{self._process}"
        fresh = self.spark.createDataFrame([(key, json.dumps({"session": session, "last": then}))], meta.schema)
        self.snapshots.write({"meta": meta.where(F.col("key") != key).unionByName(fresh)})
        return session

    def import_records(self, given: DataFrame, now=None) -> dict[str, int]:
        """Merge an export: unusable records are skipped, links follow the new ids, and those that lead nowhere are dropped."""
        good = cut_lineage(records.usable(given), "records")
        n, n_good = given.count(), good.count()
        ops = good.select(F.col("id").alias("seq"), "type", "title", "body", parse_tags(F.col("tags")).alias("tags"), "device_id", "author")
        actions = self.remember(ops, now)
        id_map = good.select(F.col("id").alias("old_id"), "type", norm_title(F.col("title")).alias("title_norm")).join(actions, ["type", "title_norm"]).select("old_id", "id")
        pairs = cut_lineage(records.remapped_links(good, id_map), "links")
        wanted = good.agg(F.sum(F.size(F.coalesce("links", F.array().cast("array<long>")))).alias("n")).first().n or 0
        linked = pairs.count()
        if linked:
            tables = self.tables()
            undirected = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
            new = undirected.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("explicit").alias("kind"), F.lit(1.0).alias("weight"), self._now(now).alias("updated_at"))
            edges = graph.merge_edges(tables["edges"], new, self.config) if self.config.assoc else tables["edges"]
            self.snapshots.write({"memories": store.link(tables["memories"], undirected, self._now(now)), "edges": edges})
        made = actions.where("action = 'created'").count()
        return {"created": made, "updated": actions.count() - made, "skipped": n - n_good, "linked": linked, "dropped_links": wanted - linked}

    # --- reads ---

    def get(self, id_: int):
        return self.tables()["memories"].where((F.col("id") == id_) & F.col("valid_to").isNull()).first()

    def recall(self, queries: DataFrame, sessions_of: DataFrame | None = None, full: bool = False, now=None, limit: int | None = None, budget: int | None = None) -> DataFrame:
        """Hits of a batch of queries (query_id, text, and perhaps type, tags, embedding), with their rows' fields. Nothing is
        learned; see learn(). A query with a blank text and tags gives the latest rows with these tags; without either,
        nothing. ``limit`` and ``budget`` stand in for the settings' for this batch; ``sessions_of`` (query_id, session_id)
        names the queries' sessions."""
        t = self.tables()
        config = replace(self.config, **{k: v for k, v in (("recall_limit", limit), ("recall_budget", budget)) if v is not None})
        if self.embedder and "embedding" not in queries.columns:
            queries = vectors.embed(queries, self.embedder)
        blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
        hits = recall.recall(t["memories"], t["edges"], queries.where(~blank), t["session_members"], sessions_of, config, now=now)
        if "tags" in queries.columns:
            tagged = recall.recall_by_tags(t["memories"], queries.where(blank), config.recall_limit)
            hits = hits.unionByName(tagged.select("*", F.lit(None).cast("double").alias("activation"), F.lit(False).alias("is_seed"), F.lit(False).alias("in_head"), F.lit(None).cast(recall.VIA).alias("via")))
        return recall.hydrate(hits, t["memories"], queries, config, full)

    def learn(self, hits: DataFrame, sessions_of: DataFrame, now=None) -> None:
        """Let sessions (query_id, session_id) learn from hits of recall(): their activation, and edges of use."""
        t = self.tables()
        folded = cut_lineage(recall.learn(hits, sessions_of, t["session_members"], self.config), "folded")
        touched = sessions_of.select("session_id").distinct()
        mine = folded.where("kind = 'member'").select("session_id", F.col("a").alias("memory_id"), F.col("value").alias("activation"), self._now(now).alias("updated_at"))
        members = t["session_members"].join(touched, "session_id", "left_anti").unionByName(mine)
        new = sessions.learned_edges(folded, self.config).select("src", "dst", F.lit("hebbian").alias("kind"), "weight", self._now(now).alias("updated_at"))
        tables, n = self._counted(t | {"session_members": members, "edges": graph.merge_edges(t["edges"], new, self.config)}, "session_sweep_counter")
        if n % self.config.session_sweep_interval == 0:
            tables["session_members"] = sessions.sweep_stale(tables["session_members"], self._now(now), self.config.session_sweep_horizon)
        self.snapshots.write(tables)

    def by_tags(self, tags: list[str], type_: str | None = None, limit: int = 20) -> DataFrame:
        return recall.by_tags(self.tables()["memories"], tags, type_, limit)

    def memory_index(self) -> str:
        t = self.tables()
        return index.index_text(index.boot_index(t["memories"], t["edges"] if self.config.assoc else None, self.config.boot_index_cap))

    def crystallization(self, fallback: bool = False) -> DataFrame:
        """Candidates for principles; none where clusters are off. While the edges, rows and dismissals are the same, what
        was found is given again."""
        t = self.tables()
        signature = (fallback, *(t[n]._folder for n in ("edges", "memories", "dismissed")))
        if self._offered is None or self._offered[0] != signature:
            found = cluster.candidates(t["edges"], t["memories"], t["dismissed"], self.config, fallback)
            self._offered = signature, cut_lineage(found, "candidates") if self.config.crystallize else found.limit(0)
        return self._offered[1]

    def status(self) -> dict:
        t = self.tables()
        return {"memories": t["memories"].where("valid_to is null").count(), "edges": t["edges"].count(), "semantic": bool(self.embedder) and self.config.semantic, "assoc": self.config.assoc, "version": self.snapshots.version()}

    def export(self, path: str) -> None:
        records.write_export(self.tables()["memories"], path)
