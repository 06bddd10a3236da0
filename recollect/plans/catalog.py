"""The library's queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import evalkit
from ..config import EngineConfig
from ..functions import scoring, text
from ..operators import cluster, fts, fusion, graph, index, recall, sessions, store, vectors
from ..sources import records
from . import adapters as A
from .adapters import EPOCH, NOW, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def seconds(c: str) -> F.Column:
    return F.unix_seconds(c)


def big(c: str | F.Column) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r6(c: str | F.Column) -> F.Column:
    return F.round(c, 6)


def csv(c: str | F.Column) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- scans, filters, text -------------------------------------------------------------------------------------


@query(sql("SELECT id, type, title, updated_s FROM cur", "mem"))
def current_scan(spark, sf):
    return A.memories(spark, sf).where("valid_to is null").select("id", "type", "title", seconds("updated_at").alias("updated_s"))


@query(sql("SELECT id, type, title, body FROM cur WHERE id = 42", "mem"))
def point_get(spark, sf):
    return A.memories(spark, sf).where("valid_to is null and id = 42").select("id", "type", "title", "body")


@query(sql("SELECT w.place, c.id, c.title FROM (VALUES (1, 40), (2, 7), (3, 34), (4, 12)) w(place, id) JOIN cur c USING (id)", "mem"))
def hydrate_ordered(spark, sf):
    wanted = spark.createDataFrame([(1, 40), (2, 7), (3, 34), (4, 12)], "place int, id long")
    return A.memories(spark, sf).where("valid_to is null").join(F.broadcast(wanted), "id").select("place", "id", "title").orderBy("place")


@query(sql("SELECT id, title FROM cur WHERE type = 'project'", "mem"))
def type_filter(spark, sf):
    return A.memories(spark, sf).where("valid_to is null").where(F.col("type") == "project").select("id", "title")


@query(sql("SELECT id, updated_s FROM cur WHERE list_contains(tags, 'fr') AND list_contains(tags, 'src3') ORDER BY updated_s DESC, id DESC LIMIT 20", "mem"))
def tag_superset_lookup(spark, sf):
    return recall.by_tags(A.memories(spark, sf), ["src3", "fr"]).select("id", seconds("updated_at").alias("updated_s"))


@query(sql("SELECT id, title_norm FROM mem", "mem"))
def norm_title(spark, sf):
    return A.memories(spark, sf).select("id", text.norm_title(F.col("title")).alias("title_norm"))


@query("SELECT doc_id AS id, array_to_string(list_filter(list_transform(string_split(lang || ' ,, ' || source || ' ,', ','), lambda t: trim(t)), lambda t: t <> ''), ',') AS tags FROM documents")
def tags_roundtrip(spark, sf):
    raw = F.concat("lang", F.lit(" ,, "), "source", F.lit(" ,"))
    return A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.tags_to_str(text.parse_tags(raw)).alias("tags"))


@query(sql("SELECT id, type, title, body, array_to_string(tags, ',') AS tags, array_to_string(links, ',') AS links, author FROM cur", "mem"))
def export_records(spark, sf):
    return records.export_records(A.memories(spark, sf)).select("id", "type", "title", "body", "tags", csv("links").alias("links"), "author")


@query(sql("SELECT (SELECT count(*) FROM cur) AS n_memories, (SELECT count(*) FROM explicit) AS n_edges, (SELECT max(updated_s) FROM cur) AS last_s", "mem", "explicit"))
def status_counts(spark, sf):
    m = A.memories(spark, sf)
    rows = m.where("valid_to is null").agg(big(F.count(F.lit(1))).alias("n_memories"), F.max(seconds("updated_at")).alias("last_s"))
    return rows.join(F.broadcast(graph.explicit_edges(m).agg(big(F.count(F.lit(1))).alias("n_edges")))).select("n_memories", "n_edges", "last_s")


EXCERPT_SQL = """
WITH q AS (SELECT id, body, length(body) AS n, [instr(lower(body), w) FOR w IN {words}] AS ats FROM cur),
p AS (SELECT *, list_min(list_filter(ats, lambda x: x > 0)) AS hit FROM q),
s AS (SELECT *, greatest(0, hit - 1 - 250) AS raw FROM p),
e AS (SELECT *, least(n, raw + 500) AS e1 FROM s),
t AS (SELECT *, greatest(0, e1 - 500) AS s1 FROM e),
u AS (SELECT *, instr(substr(body, s1 + 1, 40), ' ') AS ahead FROM t),
v AS (SELECT *, CASE WHEN s1 > 0 AND ahead > 0 THEN s1 + ahead ELSE s1 END AS s2 FROM u),
w AS (SELECT *, greatest(s2, e1 - 40) AS low FROM v),
x AS (SELECT *, instr(reverse(substr(body, low + 1, greatest(0, e1 - low))), ' ') AS back FROM w),
y AS (SELECT *, CASE WHEN e1 < n AND back > 0 THEN e1 - back ELSE e1 END AS e2 FROM x)
SELECT id, CASE WHEN n <= 500 THEN body WHEN hit IS NULL THEN regexp_replace(substr(body, 1, 500), '[\\s]+$', '') || '…'
    ELSE (CASE WHEN s2 > 0 THEN '…' ELSE '' END) || trim(regexp_replace(substr(body, s2 + 1, greatest(0, e2 - s2)), '^[\\s]+|[\\s]+$', '', 'g')) || (CASE WHEN e2 < n THEN '…' ELSE '' END) END AS excerpt,
    n > 500 AS truncated FROM y"""


def _excerpts(spark, sf, words):
    rows = A.memories(spark, sf).where("valid_to is null")
    return rows.select("id", text.excerpt(F.col("body"), F.lit(words)).alias("excerpt"), (F.length("body") > 500).alias("truncated"))


@query(sql(EXCERPT_SQL.format(words="['tion', 'eaux', 'heit']"), "mem"))
def excerpt_centered(spark, sf):
    return _excerpts(spark, sf, "tion of eaux heit")


@query(sql(EXCERPT_SQL.format(words="['qqqqq']"), "mem"))
def excerpt_head_fallback(spark, sf):
    return _excerpts(spark, sf, "qqqqq a")


# --- writes ---------------------------------------------------------------------------------------------------


def _ops(spark, sf):
    m = A.memories(spark, sf)
    return m.select(F.col("id").alias("seq"), "type", "title", "body", "tags", "links", F.col("updated_at").alias("at"), "device_id", "author", "embedding")


@query(sql("SELECT type, title_norm, arg_max(id, id) AS last_seq, arg_max(author, id) AS author, min(updated_s) AS first_s, max(updated_s) AS last_s, count(*) AS n_ops FROM mem GROUP BY type, title_norm", "mem"))
def upsert_fold_latest(spark, sf):
    folded = store.fold_upserts(_ops(spark, sf))
    return folded.select("type", "title_norm", ((seconds("last_at") - EPOCH) / 3600).cast("long").alias("last_seq"), "author", seconds("first_at").alias("first_s"), seconds("last_at").alias("last_s"), big("n_ops").alias("n_ops"))


@query(sql("SELECT type, title_norm, coalesce(array_to_string(list(l ORDER BY p) FILTER (l IS NOT NULL), ','), '') AS links FROM (SELECT type, title_norm, l, min(p) AS p FROM (SELECT type, title_norm, unnest(CASE WHEN len(links) = 0 THEN [NULL] ELSE links END) AS l, 10 * id + unnest(range(greatest(len(links), 1))) AS p FROM mem) GROUP BY ALL) GROUP BY ALL", "mem"))
def upsert_links_union(spark, sf):
    return store.fold_upserts(_ops(spark, sf)).select("type", "title_norm", csv("links").alias("links"))


@query(sql("""WITH base AS (SELECT * FROM mem WHERE id % 3 = 0), live AS (SELECT type, title_norm, max(id) AS id FROM base WHERE valid_to_s IS NULL GROUP BY ALL),
new AS (SELECT type, title_norm, min(id) AS first_id FROM mem WHERE id % 3 <> 0 GROUP BY ALL)
SELECT n.type, n.title_norm, CASE WHEN l.id IS NULL THEN 'created' ELSE 'updated' END AS action,
    CASE WHEN l.id IS NULL THEN (SELECT max(id) FROM base) + row_number() OVER (PARTITION BY l.id IS NULL ORDER BY first_id) ELSE l.id END AS id
FROM new n LEFT JOIN live l USING (type, title_norm)""", "mem"))  # fmt: skip
def upsert_batch(spark, sf):
    m = A.memories(spark, sf).where("id % 3 = 0")
    newest = Window.partitionBy("type", "title_norm", F.col("valid_to").isNull()).orderBy(F.desc("id"))
    base = m.withColumn("n", F.row_number().over(newest)).where("valid_to is not null or n = 1").drop("n")
    return store.upsert(base, _ops(spark, sf).where("seq % 3 <> 0"))[1].select("type", "title_norm", "action", big("id").alias("id"))


@query(sql("SELECT type, title_norm, count(*) AS n FROM cur GROUP BY ALL HAVING count(*) > 1", "mem"))
def dedup_conflicts(spark, sf):
    return store.duplicate_keys(A.memories(spark, sf)).select("type", "title_norm", big("n").alias("n"))


def _pairs(spark, sf):
    return A.memories(spark, sf).where("id % 10 = 1").select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"))


@query(sql(f"""WITH pr AS (SELECT id AS a, id + 3 AS b FROM mem WHERE id % 10 = 1), good AS (SELECT * FROM pr WHERE a IN (SELECT id FROM cur) AND b IN (SELECT id FROM cur)),
ends AS (SELECT a AS id, b AS other FROM good UNION ALL SELECT b, a FROM good), more AS (SELECT id, list(other) AS l FROM ends GROUP BY id)
SELECT id, array_to_string(CASE WHEN l IS NULL THEN links ELSE list_sort(list_distinct(list_concat(links, l))) END, ',') AS links, CASE WHEN l IS NULL THEN updated_s ELSE {NOW} END AS updated_s FROM mem LEFT JOIN more USING (id)""", "mem"))  # fmt: skip
def link_union(spark, sf):
    out = store.link(A.memories(spark, sf), _pairs(spark, sf), A.at(NOW))
    return out.select("id", csv("links").alias("links"), seconds("updated_at").alias("updated_s"))


@query(sql(f"SELECT id, CASE WHEN valid_to_s IS NULL AND id % 7 = 0 THEN {NOW} ELSE valid_to_s END AS valid_to_s, superseded_by FROM mem", "mem"))
def soft_delete_view(spark, sf):
    m = A.memories(spark, sf)
    return store.forget(m, m.where("id % 7 = 0").select("id"), A.at(NOW)).select("id", seconds("valid_to").alias("valid_to_s"), "superseded_by")


@query(sql("""WITH asked AS (SELECT id FROM mem WHERE id % 2 = 0 UNION SELECT max(id) + 5 FROM mem),
j AS (SELECT a.id, m.type, m.title_norm, m.valid_to_s, m.id IS NULL AS missing, EXISTS (SELECT 1 FROM cur c WHERE c.type = m.type AND c.title_norm = m.title_norm) AS taken FROM asked a LEFT JOIN mem m USING (id)),
f AS (SELECT id, row_number() OVER (PARTITION BY type, title_norm ORDER BY id) AS n FROM j WHERE NOT missing AND NOT taken)
SELECT id, CASE WHEN missing THEN 'missing' WHEN valid_to_s IS NULL THEN 'current' WHEN taken OR n > 1 THEN 'clash' ELSE 'restored' END AS outcome FROM j LEFT JOIN f USING (id)""", "mem"))  # fmt: skip
def restore_guard(spark, sf):
    m = A.memories(spark, sf)
    asked = m.where("id % 2 = 0").select("id").unionByName(m.agg((F.max("id") + 5).alias("id")))
    return store.restore(m, asked)[1]


@query(sql("""SELECT (SELECT count(*) FROM mem WHERE id % 11 <> 0) AS n_memories, (SELECT count(*) FROM edges WHERE src % 11 <> 0 AND dst % 11 <> 0) AS n_edges,
(SELECT count(*) FROM touches WHERE memory_id % 11 <> 0 OR memory_id NOT IN (SELECT id FROM mem)) AS n_members""", "mem", "edges", "touches"))  # fmt: skip
def purge_antijoin(spark, sf):
    m = A.memories(spark, sf)
    members = A.touches(spark, sf).select("session_id", "memory_id", F.lit(1.0).alias("activation"), A.at(EPOCH).alias("updated_at"))
    edges = A.graph_edges(spark, sf)
    named = m.select("id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).where("id % 11 = 0")  # edges reach beyond the rows
    left = store.purge({"memories": m, "edges": edges, "session_members": members}, named)
    count = lambda t, n: left[t].agg(big(F.count(F.lit(1))).alias(n))
    return count("memories", "n_memories").join(F.broadcast(count("edges", "n_edges"))).join(F.broadcast(count("session_members", "n_members")))


@query(sql("SELECT a.id + 1000000 AS id, b.id + 1000000 AS other FROM (SELECT id, unnest(links) AS l FROM cur) a JOIN cur b ON b.id = a.l WHERE a.id <> b.id GROUP BY ALL", "mem"))
def import_id_remap(spark, sf):
    out = records.export_records(A.memories(spark, sf))
    ids = out.select(F.col("id").alias("old_id"), (F.col("id") + 1000000).alias("id"))
    return records.remapped_links(out, ids)


@query(sql("""WITH s AS (SELECT n.id AS new_id, o.id AS old_id, list_dot_product(n.e, o.e) AS sim FROM vec n JOIN vec o ON n.type = o.type AND n.id % 5 = 0 AND o.id % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(sim, 9) DESC, old_id) AS n FROM s)
SELECT old_id, min(new_id) AS new_id, round(max(sim), 6) AS sim FROM r WHERE n = 1 AND sim >= 0.4 GROUP BY old_id""", "vec"))  # fmt: skip
def consolidate_nearest(spark, sf):
    v = A.vectors(spark, sf).withColumns({"valid_to": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("long")})
    return store.consolidate(v, v.where("id % 5 = 0").select("id"), A.at(NOW), 0.4)[1].select("old_id", "new_id", r6("sim").alias("sim"))


@query(sql("SELECT CASE WHEN valid_to_s IS NULL THEN 'current' WHEN superseded_by IS NOT NULL THEN 'superseded' ELSE 'forgotten' END AS state, count(*) AS n FROM mem GROUP BY 1", "mem"))
def lifecycle_state_counts(spark, sf):
    return store.lifecycle(A.memories(spark, sf)).select("state", big("n").alias("n"))


# --- retrieval ------------------------------------------------------------------------------------------------


@query(sql("SELECT id, CAST(length AS BIGINT) AS length, (SELECT CAST(n_rows AS BIGINT) FROM corpus) AS n_rows, (SELECT round(mean_length, 6) FROM corpus) AS mean_length FROM lens", "fields"))
def token_stats(spark, sf):
    lengths = fts.postings(A.memories(spark, sf)).groupBy("id").agg(F.sum(F.size("tokens")).alias("length"))
    whole = lengths.agg(big(F.count(F.lit(1))).alias("n_rows"), r6(F.avg("length")).alias("mean_length"))
    return lengths.join(F.broadcast(whole)).select("id", big("length").alias("length"), "n_rows", "mean_length")


def _bm25(spark, sf, *ids):
    q = A.text_queries(spark).where(F.col("query_id").isin(*ids))
    return fts.search(A.memories(spark, sf), q).select("query_id", "id", big("rank").alias("rank"), r6("score").alias("score"))


def _bm25_sql(*ids):
    return sql(f"SELECT CAST(query_id AS BIGINT) AS query_id, id, rank, round(score, 6) AS score FROM fts WHERE query_id IN ({', '.join(map(str, ids))})", "bm25")


@query(_bm25_sql(1, 3, 7, 8))
def bm25_single_term(spark, sf):
    return _bm25(spark, sf, 1, 3, 7, 8)


@query(_bm25_sql(2, 4, 6))
def bm25_and_terms(spark, sf):
    return _bm25(spark, sf, 2, 4, 6)


@query(_bm25_sql(5))
def bm25_phrase(spark, sf):
    return _bm25(spark, sf, 5)


def _top_sql(where="", floor=""):
    return sql(f"SELECT query_id, id, rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM sims {where}) WHERE rank <= 50 {floor}", "sims")


def _top(found):
    return found.select("query_id", "id", big("rank").alias("rank"), r6("sim").alias("sim"))


@query(_top_sql())
def cosine_topk(spark, sf):
    return _top(vectors.cosine_search(A.vectors(spark, sf), A.vector_queries(spark, sf).drop("type"), 50))


@query(_top_sql(floor="AND sim >= 0.35"))
def cosine_topk_floor(spark, sf):
    return _top(vectors.cosine_search(A.vectors(spark, sf), A.vector_queries(spark, sf).drop("type"), 50, 0.35))


@query(_top_sql(where="WHERE type = qtype"))
def cosine_topk_typed(spark, sf):
    return _top(vectors.cosine_search(A.vectors(spark, sf), A.vector_queries(spark, sf), 50))


def _two_lists(spark, sf):
    v, q = A.vectors(spark, sf), A.vector_queries(spark, sf)
    return [vectors.cosine_search(v, q.drop("type"), 30), vectors.cosine_search(v, q, 20)]


_LISTS_SQL = """WITH l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank, 30 AS cut FROM sims
    UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id), 20 FROM sims WHERE type = qtype),
s AS (SELECT query_id, id, sum(1.0 / (60.0 + rank)) AS score FROM l WHERE rank <= cut GROUP BY ALL)"""


@query(sql(_LISTS_SQL + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM s", "sims"))
def rrf_fuse_two_lists(spark, sf):
    return fusion.rrf_fuse(_two_lists(spark, sf)).select("query_id", "id", big("rank").alias("rank"), r6("score").alias("score"))


@query(sql("SELECT CAST(query_id AS BIGINT) AS query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY updated_s DESC, id DESC) AS rank FROM fts JOIN mem USING (id)", "bm25"))
def recency_rrf(spark, sf):
    m = A.memories(spark, sf)
    return fusion.recency(fts.search(m, A.text_queries(spark)), m).select("query_id", "id", big("rank").alias("rank"))


@query(sql(f"SELECT id, round(pow(0.5, greatest(0.0, ({NOW} - updated_s) / 86400.0) / 30.0), 9) AS decay FROM cur", "mem"))
def decay_scores(spark, sf):
    age = scoring.age_days(F.col("updated_at"), A.at(NOW))
    return A.memories(spark, sf).where("valid_to is null").select("id", F.round(scoring.decay_factor(age, 30), 9).alias("decay"))


@query(sql("SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 9) AS score FROM seeds", "seeds"))
def seed_scores_keyword(spark, sf):
    return recall.seeds(A.memories(spark, sf), A.text_queries(spark)).select("query_id", "id", F.round("score", 9).alias("score"))


def _hybrid(spark, sf):
    """Memories with vectors, and the texts with the vectors of 50, 100, ... as a batch."""
    v = A.vectors(spark, sf).select("id", "embedding")
    m = A.memories(spark, sf).drop("embedding").join(v, "id", "left")
    q = A.text_queries(spark).join(v.select((F.col("id") / 50).cast("long").alias("query_id"), "embedding", "id").where("id % 50 = 0").drop("id"), "query_id", "left")
    return m, q.drop("type")


_HYBRID_SQL = f"""WITH q AS (SELECT * FROM (VALUES {', '.join(f'({k[0]})' for k in A.QUERIES)}) t(query_id)),
kw AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, updated_s DESC, id) AS rank FROM bm25 JOIN cur USING (id)),
vs AS (SELECT q.query_id, c.id, list_dot_product(a.e, b.e) AS sim FROM q JOIN vec a ON a.id = 50 * q.query_id, vec b JOIN cur c ON c.id = b.id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM vs),
both_arms AS (SELECT query_id, id, rank FROM kw WHERE rank <= 200 UNION ALL SELECT query_id, id, rank FROM vr WHERE rank <= 200 AND sim >= 0.35),
fused AS (SELECT query_id, id, sum(1.0 / (60.0 + rank)) AS score FROM both_arms GROUP BY ALL),
s AS (SELECT query_id, id, score + 0.25 / (60.0 + row_number() OVER (PARTITION BY query_id ORDER BY updated_s DESC, id DESC)) AS score FROM fused JOIN mem USING (id))"""


@query(sql(_HYBRID_SQL + " SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 9) AS score FROM s", "bm25", "vec"))
def seed_scores_hybrid(spark, sf):
    return recall.seeds(*_hybrid(spark, sf)).select("query_id", "id", F.round("score", 9).alias("score"))


_LIMIT_SQL = "SELECT CAST(query_id AS BIGINT) AS query_id, rank, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {}) WHERE rank <= 20"


def _recalled(found):
    return found.select("query_id", big("rank").alias("rank"), "id", F.round("score", 9).alias("score"))


@query(sql(_LIMIT_SQL.format("seeds"), "seeds"))
def recall_keyword_batch(spark, sf):
    return _recalled(recall.plain_recall(A.memories(spark, sf), A.text_queries(spark)))


@query(sql(_HYBRID_SQL + " " + _LIMIT_SQL.format("s"), "bm25", "vec"))
def recall_hybrid_batch(spark, sf):
    return _recalled(recall.plain_recall(*_hybrid(spark, sf)))


@query(sql("SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 9) AS score FROM seeds JOIN mem USING (id) WHERE list_contains(tags, 'src1')", "seeds"))
def tag_filter_ranked(spark, sf):
    q = A.text_queries(spark).withColumn("tags", F.array(F.lit("src1")))
    return recall.seeds(A.memories(spark, sf), q).select("query_id", "id", F.round("score", 9).alias("score"))


# --- graph ----------------------------------------------------------------------------------------------------

_KNN_SQL = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS n FROM (SELECT a.id, b.id AS other, list_dot_product(a.e, b.e) AS sim FROM vec a JOIN vec b ON a.id <> b.id {where})),
sem AS (SELECT least(id, other) AS src, greatest(id, other) AS dst, max(sim) AS weight FROM k WHERE n <= 8 AND sim > 0 GROUP BY 1, 2)"""


@query(sql(_KNN_SQL.format(where="") + " SELECT src, dst, round(weight, 6) AS weight FROM sem", "vec"))
def knn_edges_bulk(spark, sf):
    return vectors.semantic_edges(A.vectors(spark, sf)).select("src", "dst", r6("weight").alias("weight"))


@query(sql(_KNN_SQL.format(where="AND a.id % 10 = 0") + " SELECT src, dst, round(weight, 6) AS weight FROM sem", "vec"))
def knn_edges_incremental(spark, sf):
    v = A.vectors(spark, sf)
    return vectors.semantic_edges(v.where("id % 10 = 0"), v).select("src", "dst", r6("weight").alias("weight"))


@query(sql("SELECT src, dst, weight FROM explicit", "explicit"))
def explicit_edges_from_links(spark, sf):
    return graph.explicit_edges(A.memories(spark, sf))


@query(sql("SELECT src, dst, weight FROM co_use", "co_use"))
def hebbian_capped_counts(spark, sf):
    return A.co_use(spark, sf)


@query(sql("""SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, CASE WHEN l_returnflag = 'N' THEN 'hebbian' ELSE 'semantic' END AS kind,
CASE WHEN l_returnflag = 'N' THEN least(5.0, sum(0.5)) ELSE max(l_discount) END::DOUBLE AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2, 3, l_returnflag = 'N'"""))  # fmt: skip
def edge_max_merge(spark, sf):
    hebbian = F.col("l_returnflag") == "N"
    new = A.table(spark, sf, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(hebbian, "hebbian").otherwise("semantic").alias("kind"), F.when(hebbian, 0.5).otherwise(F.col("l_discount")).alias("weight"), A.at(EPOCH).alias("updated_at"))
    return graph.merge_edges(new.limit(0), new).select("src", "dst", "kind", "weight")


@query("SELECT min(doc_id) AS src, unnest([min(doc_id) + 20, min(doc_id) + 40, min(doc_id) + 60]) AS dst, CAST(1.0 AS DOUBLE) AS weight FROM documents GROUP BY source")
def crystallized_directed(spark, sf):
    principles = A.table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("id")).select("id", F.array(F.col("id"), F.col("id") + 20, F.col("id") + 40, F.col("id") + 60).alias("sources"))
    return graph.crystallized_edges(principles)


@query(sql("SELECT id, other, round(weight, 6) AS weight, kind FROM nbr", "nbr"))
def neighbors_blended(spark, sf):
    return graph.neighbours(A.graph_edges(spark, sf), A.memories(spark, sf)).select("id", "other", r6("weight").alias("weight"), "kind")


@query(sql("SELECT id, round(degree, 6) AS degree FROM deg", "deg"))
def degree_map_behavioral(spark, sf):
    return graph.degrees(A.graph_edges(spark, sf), A.memories(spark, sf)).select("id", r6("degree").alias("degree"))


@query(sql("SELECT d.id, round(d.degree, 6) AS degree FROM deg d JOIN mem m USING (id) WHERE degree > 0 AND type = 'user'", "deg"))
def degree_map_current_only(spark, sf):
    m = A.memories(spark, sf)
    return graph.degrees(A.graph_edges(spark, sf), m).join(m.where("type = 'user'").select("id"), "id", "left_semi").where("degree > 0").select("id", r6("degree").alias("degree"))


_STARTS = [(1, 25, 1.0), (1, 40, 0.5), (2, 61, 1.0), (3, 107, 0.02), (3, 3, 0.9)]


def _start(spark):
    return spark.createDataFrame(_STARTS, "query_id long, id long, activation double")


_START_SQL = f"SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, CAST(a AS DOUBLE) AS a, NULL::VARCHAR AS wanted FROM (VALUES {', '.join(map(str, _STARTS))}) t(query_id, id, a)"


def _spread_ctes(start: str, rounds: int) -> str:
    """Rounds of spreading from (query_id, id, a, wanted), unrolled: common tables up to st<rounds>."""
    parts = [f"st0 AS (SELECT query_id, id, a, wanted, 0 AS depth, false AS fired, true AS seed, 0.0::DOUBLE AS best, NULL::BIGINT AS rfrom, NULL::VARCHAR AS rkind, NULL::DOUBLE AS rw, NULL::INT AS hops FROM ({start}))"]
    for r in range(rounds):
        parts.append(f"pk{r} AS (SELECT query_id, id, a, depth, wanted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, id) AS n FROM st{r} WHERE NOT fired AND a >= 1e-4) WHERE n = 1)")
        parts.append(f"sd{r} AS (SELECT p.query_id, p.wanted, n.other AS id, p.a * n.weight * 0.4 AS t, p.id AS f, n.kind AS k, round(n.weight, 3) AS w, p.depth + 1 AS d FROM pk{r} p JOIN nbr n ON n.id = p.id JOIN cur c ON c.id = n.other WHERE p.a * n.weight * 0.4 >= 1e-4 AND (p.wanted IS NULL OR p.wanted = c.type))")
        parts.append(
            f"st{r + 1} AS (SELECT query_id, id, coalesce(s.a, 0) + coalesce(t, 0) AS a, coalesce(s.wanted, m.wanted) AS wanted, least(coalesce(s.depth, d), coalesce(d, s.depth)) AS depth, coalesce(s.fired, false) OR EXISTS (SELECT 1 FROM pk{r} p WHERE p.query_id = query_id AND p.id = coalesce(s.id, m.id) AND p.query_id = coalesce(s.query_id, m.query_id)) AS fired, coalesce(s.seed, false) AS seed, "
            + ", ".join(f"CASE WHEN t IS NOT NULL AND NOT coalesce(s.seed, false) AND t > coalesce(s.best, 0) THEN {new} ELSE {old} END AS {name}" for name, new, old in (("best", "t", "coalesce(s.best, 0)"), ("rfrom", "f", "s.rfrom"), ("rkind", "k", "s.rkind"), ("rw", "w", "s.rw"), ("hops", "least(coalesce(s.depth, d), d)", "s.hops")))
            + f" FROM st{r} s FULL JOIN sd{r} m USING (query_id, id))"
        )
    return ", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)


def _spread_sql(rounds: int) -> str:
    return sql(f"WITH {_spread_ctes(_START_SQL, rounds)} SELECT query_id, id, round(a, 6) AS activation, CAST(depth AS BIGINT) AS depth, seed AS is_seed, rfrom AS via_from, rkind AS via_kind, round(rw, 3) AS via_w, CAST(hops AS BIGINT) AS hops FROM st{rounds}", "nbr")


def _spread(spark, sf, rounds):
    out = graph.spread(_start(spark), A.graph_edges(spark, sf), A.memories(spark, sf), budget=rounds)
    return out.select("query_id", "id", r6("activation").alias("activation"), big("depth").alias("depth"), "is_seed", F.col("receipt.from").alias("via_from"), F.col("receipt.kind").alias("via_kind"), F.col("receipt.w").alias("via_w"), big("receipt.hops").alias("hops"))


@query(_spread_sql(1))
def spread_1hop(spark, sf):
    return _spread(spark, sf, 1)


@query(_spread_sql(3))
def spread_budget_n(spark, sf):
    return _spread(spark, sf, 3)


def _associated(spark, sf):
    return recall.recall(A.memories(spark, sf), A.graph_edges(spark, sf), A.text_queries(spark))


def _associated_sql(columns: str) -> str:
    """Recall with the default settings: 8 expansions from the seeds, a head of 8 and 20 hits."""
    start = "SELECT CAST(s.query_id AS BIGINT) AS query_id, s.id, s.score AS a, n.qtype AS wanted FROM seeds s JOIN needed n ON n.query_id = s.query_id"
    return sql(
        f"""WITH {_spread_ctes(start, 8)}, hd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM seeds),
ordered AS (SELECT st8.*, place <= 8 AND place IS NOT NULL AS in_head, row_number() OVER (PARTITION BY st8.query_id ORDER BY CASE WHEN place <= 8 THEN place END NULLS LAST, round(a, 9) DESC, st8.id) AS rank FROM st8 LEFT JOIN hd ON hd.query_id = st8.query_id AND hd.id = st8.id)
SELECT {columns} FROM ordered WHERE rank <= 20""", "nbr", "seeds")  # fmt: skip


@query(_associated_sql("query_id, rank, id, round(a, 6) AS activation, seed AS is_seed, in_head"))
def recall_associative(spark, sf):
    return _associated(spark, sf).select("query_id", big("rank").alias("rank"), "id", r6("activation").alias("activation"), "is_seed", "in_head")


@query(sql("SELECT * FROM (SELECT CAST(query_id AS BIGINT) AS query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM seeds) WHERE rank <= 8", "seeds"))
def recall_protect_head(spark, sf):
    return _associated(spark, sf).where("in_head").select("query_id", "id", big("rank").alias("rank"))


@query(_associated_sql("query_id, id, CASE WHEN seed OR rfrom IS NULL THEN true END AS is_seed, CASE WHEN NOT seed THEN rfrom END AS via_from, CASE WHEN NOT seed THEN rkind END AS via_kind, CASE WHEN NOT seed THEN rw END AS via_w, CASE WHEN NOT seed THEN CAST(hops AS BIGINT) END AS hops"))
def via_receipts(spark, sf):
    step = F.col("via.path")[0]
    return _associated(spark, sf).where("rank is not null").select("query_id", "id", F.col("via.seed").alias("is_seed"), step["from"].alias("via_from"), step["kind"].alias("via_kind"), step["w"].alias("via_w"), big("via.hops").alias("hops"))


# --- sessions -------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS key, CAST(session AS BIGINT) AS session, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS end_s, count(*) AS n_events FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY 1, 2""")  # fmt: skip
def gap_sessions(spark, sf):
    events = A.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return sessions.gap_sessions(events).select("key", big("session").alias("session"), seconds("start_at").alias("start_s"), seconds("end_at").alias("end_s"), big("n_events").alias("n_events"))


_CUSTOMER_SQL = "ct AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, touch, rank, memory_id FROM touches JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS touch FROM orders) o ON CAST(o.o_orderkey AS VARCHAR) = session_id)"


@query(sql(f"WITH {_CUSTOMER_SQL}, l AS (SELECT session_id, max(touch) AS last FROM ct GROUP BY 1) SELECT session_id, memory_id, round(sum(pow(0.5, rank) * pow(0.5, last - touch)), 6) AS activation FROM ct JOIN l USING (session_id) WHERE pow(0.5, rank) >= 0.05 GROUP BY ALL", "touches"))
def session_activation_no_ttl(spark, sf):
    return sessions.session_activation_no_ttl(A.customer_touches(spark, sf)).select("session_id", "memory_id", r6("activation").alias("activation"))


_FOLD_SQL = f"""WITH {_CUSTOMER_SQL}, lists AS (SELECT session_id, memory_id, rank, dense_rank() OVER (PARTITION BY session_id ORDER BY touch) AS touch FROM ct),
l AS (SELECT session_id, max(touch) AS last FROM lists GROUP BY 1),
bumps AS (SELECT session_id, memory_id, touch, sum(pow(0.5, rank)) AS b FROM lists WHERE pow(0.5, rank) >= 0.05 GROUP BY ALL),
grid AS (SELECT session_id, memory_id, unnest(range(1, last + 1)) AS touch FROM (SELECT DISTINCT session_id, memory_id FROM bumps) JOIN l USING (session_id)),
own AS (SELECT session_id, memory_id, list(coalesce(b, 0.0) ORDER BY touch) AS bs FROM grid LEFT JOIN bumps USING (session_id, memory_id, touch) GROUP BY ALL),
states AS (SELECT session_id, memory_id, touch, list_reduce(bs[1:touch], lambda a, x: CASE WHEN a >= 0.05 THEN a * 0.5 ELSE 0.0 END + x) AS a FROM grid JOIN own USING (session_id, memory_id)),
active AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, touch ORDER BY a DESC, memory_id) AS n FROM states WHERE a >= 0.25) WHERE n <= 8)
SELECT session_id, 'member' AS kind, memory_id AS a, CAST(NULL AS BIGINT) AS b, round(a, 6) AS value FROM states JOIN l USING (session_id) WHERE touch = last AND a >= 0.05
UNION ALL SELECT x.session_id, 'pair', x.memory_id, y.memory_id, CAST(count(*) AS DOUBLE) FROM active x JOIN active y ON x.session_id = y.session_id AND x.touch = y.touch AND x.memory_id < y.memory_id GROUP BY ALL"""


@query(sql(_FOLD_SQL, "touches"))
def touch_session_fold(spark, sf):
    return sessions.touch_sessions(A.customer_touches(spark, sf)).select("session_id", "kind", "a", "b", r6("value").alias("value"))


@query(sql("""WITH b AS (SELECT DISTINCT ON (session_id, memory_id) session_id, memory_id FROM touches),
act AS (SELECT session_id, memory_id, sum(pow(0.5, rank)) AS a FROM touches WHERE rank <= 4 GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY a DESC, memory_id) AS n FROM act WHERE a >= 0.25) WHERE n <= 8)
SELECT x.memory_id AS src, y.memory_id AS dst, least(5.0, 0.5 * count(*))::DOUBLE AS weight FROM top x JOIN top y ON x.session_id = y.session_id AND x.memory_id < y.memory_id GROUP BY 1, 2""", "touches"))  # fmt: skip
def hebbian_from_sessions(spark, sf):
    return sessions.learned_edges(sessions.touch_sessions(A.touches(spark, sf)))


@query("SELECT count(*) AS n_left, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 86400000000")
def stale_session_sweep(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("memory_id"), F.col("value").alias("activation"), F.col("ts").cast("timestamp").alias("updated_at"))
    now = e.agg(F.max("updated_at").alias("now"))
    return sessions.sweep_stale(e.join(F.broadcast(now)), F.col("now")).agg(big(F.count(F.lit(1))).alias("n_left"), F.min(seconds("updated_at")).alias("first_s"))


@query(sql("""WITH m AS (SELECT memory_id, sum(pow(0.5, rank)) AS activation FROM touches WHERE session_id = '1' GROUP BY ALL)
SELECT query_id, id, round(sum(a), 9) AS activation FROM (SELECT CAST(query_id AS BIGINT) AS query_id, id, score AS a FROM seeds UNION ALL SELECT q.query_id, memory_id, 0.25 * activation FROM (VALUES (1::BIGINT), (3::BIGINT)) q(query_id), m WHERE memory_id IN (SELECT id FROM cur)) GROUP BY ALL""", "seeds", "touches"))  # fmt: skip
def priming_merge(spark, sf):
    m = A.memories(spark, sf)
    members = A.touches(spark, sf).where("session_id = '1'").groupBy("session_id", "memory_id").agg(F.sum(F.pow(F.lit(0.5), F.col("rank"))).alias("activation"))
    asked = spark.createDataFrame([(1, "1"), (3, "1")], "query_id long, session_id string")
    return sessions.primed(recall.seeds(m, A.text_queries(spark)), members, asked, m).select("query_id", "id", F.round("activation", 9).alias("activation"))


# --- index and retention --------------------------------------------------------------------------------------

_LINE = "format('[{}] #{} {}', type, id, title) AS line"


def _index(found):
    return found.select("section", big("place").alias("place"), "id", "line")


@query(sql(f"SELECT 'all' AS section, row_number() OVER (ORDER BY updated_s DESC, id DESC) AS place, id, {_LINE} FROM cur", "mem"))
def boot_index_small(spark, sf):
    return _index(index.boot_index(A.memories(spark, sf), A.graph_edges(spark, sf), 10_000_000))


@query(sql(f"""WITH res AS (SELECT id FROM cur ORDER BY updated_s DESC, id DESC LIMIT 12),
hub AS (SELECT c.id, c.type, c.title, row_number() OVER (ORDER BY round(degree, 9) DESC, updated_s DESC, c.id DESC) AS place FROM cur c JOIN deg d USING (id) WHERE degree > 0 AND c.id NOT IN (SELECT id FROM res)),
kept AS (SELECT * FROM hub WHERE place <= 38), rest AS (SELECT *, row_number() OVER (ORDER BY updated_s DESC, id DESC) AS place FROM cur WHERE id NOT IN (SELECT id FROM kept))
SELECT 'hub' AS section, place, id, {_LINE} FROM kept UNION ALL SELECT 'recent', place, id, {_LINE} FROM rest WHERE place <= 50 - (SELECT count(*) FROM kept)""", "deg"))  # fmt: skip
def boot_index_curated(spark, sf):
    return _index(index.boot_index(A.memories(spark, sf), A.graph_edges(spark, sf), 50))


@query(sql(f"SELECT 'all' AS section, place, id, {_LINE} FROM (SELECT *, row_number() OVER (ORDER BY updated_s DESC, id DESC) AS place FROM cur) WHERE place <= 50", "mem"))
def boot_index_recency_only(spark, sf):
    return _index(index.boot_index(A.memories(spark, sf), None, 50))


def _sweep_sql(max_: int) -> str:
    return sql(f"SELECT c.id FROM cur c JOIN deg d USING (id) WHERE degree = 0 AND ({NOW} - updated_s) / 86400.0 > 90 AND (SELECT count(*) FROM cur) >= 100 AND (SELECT max(degree) FROM deg) > 0 ORDER BY updated_s, c.id LIMIT {max_}", "deg")


def _sweep(spark, sf, max_):
    m = A.memories(spark, sf)
    edges = A.graph_edges(spark, sf).where("kind <> 'explicit'")  # with links every row is in use
    return index.sweep_candidates(m, edges, A.at(NOW), EngineConfig(forget_max_per_sweep=max_))


_SWEEP_EDGES = ("kind IN ('explicit', 'hebbian', 'crystallized')", "kind <> 'explicit'")


@query(_sweep_sql(1000000).replace(*_SWEEP_EDGES))
def forgetting_candidates(spark, sf):
    return _sweep(spark, sf, 1000000)


@query(_sweep_sql(10).replace(*_SWEEP_EDGES))
def forgetting_bounded(spark, sf):
    return _sweep(spark, sf, 10)


# --- clusters -------------------------------------------------------------------------------------------------


def _cluster_edges(spark, sf):
    """The whole graph, and near vectors."""
    near = vectors.semantic_edges(A.vectors(spark, sf)).select("src", "dst", "weight", F.lit("semantic").alias("kind"))
    return A.graph_edges(spark, sf).select("src", "dst", "weight", "kind").unionByName(near)


_CLUSTER_CONFIG = EngineConfig(expand_cos=0.35)
_CLUSTER_SQL = _KNN_SQL.format(where="") + """, ce AS (SELECT src, dst, weight, kind FROM edges UNION ALL SELECT src, dst, weight, 'semantic' FROM sem),
ve AS (SELECT * FROM ce WHERE src IN (SELECT id FROM cur) AND dst IN (SELECT id FROM cur)),
pk AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ve WHERE kind = 'explicit' AND weight >= 0.5),
bothp AS (SELECT src, dst FROM pk UNION SELECT dst, src FROM pk),
walk AS (SELECT src AS id, src AS root FROM bothp UNION SELECT b.dst, w.root FROM walk w JOIN bothp b ON b.src = w.id),
roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
close AS (SELECT src AS id, dst AS other FROM ve WHERE kind = 'semantic' AND weight >= 0.35 UNION SELECT dst, src FROM ve WHERE kind = 'semantic' AND weight >= 0.35),
grown AS (SELECT root, id FROM roots UNION SELECT r.root, c.other FROM roots r JOIN close c USING (id)),
bases AS (SELECT DISTINCT src AS principle, dst AS id FROM ve WHERE kind = 'crystallized'),
cov AS (SELECT DISTINCT root FROM (SELECT g.root, b.principle, count(*) AS shared FROM grown g JOIN bases b USING (id) GROUP BY ALL) JOIN (SELECT principle, count(*) AS size FROM bases GROUP BY 1) USING (principle) WHERE shared / size >= 0.6)"""


def _cluster_sql(tail: str) -> str:
    return sql(_CLUSTER_SQL + " " + tail, "vec", "mem", "edges", recursive=True)


@query(_cluster_sql("SELECT src, dst FROM pk"))
def peak_edges(spark, sf):
    return cluster.peak_edges(_cluster_edges(spark, sf), A.memories(spark, sf))


@query(sql("WITH b AS (SELECT src, dst FROM explicit UNION SELECT dst, src FROM explicit), w AS (SELECT src AS id, src AS root FROM b UNION SELECT b.dst, w.root FROM w JOIN b ON b.src = w.id) SELECT id, min(root) AS root FROM w GROUP BY id", "explicit", recursive=True))
def components_min_label(spark, sf):
    return graph.components(graph.explicit_edges(A.memories(spark, sf)))


@query(_cluster_sql("SELECT root, id FROM grown"))
def semantic_expand(spark, sf):
    edges, m = _cluster_edges(spark, sf), A.memories(spark, sf)
    return cluster.expand(graph.components(cluster.peak_edges(edges, m)), edges, m, 0.35).select("root", "id")


_CANDIDATES_TAIL = """SELECT k.src AS peak_src, k.dst AS peak_dst, array_to_string(list_sort(list(g.id)), ',') AS members FROM grown g JOIN (SELECT r.root, min(struct_pack(s := p.src, d := p.dst)).s AS src, min(struct_pack(s := p.src, d := p.dst)).d AS dst FROM pk p JOIN roots r ON r.id = p.src GROUP BY 1) k USING (root)
WHERE g.root NOT IN (SELECT root FROM cov) {gone} GROUP BY k.src, k.dst, g.root HAVING count(*) >= 3"""


def _candidates(spark, sf, dismissed=None):
    out = cluster.candidates(_cluster_edges(spark, sf), A.memories(spark, sf), dismissed, _CLUSTER_CONFIG)
    return out.select("peak_src", "peak_dst", csv("members").alias("members"))


@query(_cluster_sql(_CANDIDATES_TAIL.format(gone="")))
def cluster_candidates(spark, sf):
    return _candidates(spark, sf)


@query(_cluster_sql("SELECT root FROM cov"))
def basis_overlap(spark, sf):
    edges, m = _cluster_edges(spark, sf), A.memories(spark, sf)
    grown = cluster.expand(graph.components(cluster.peak_edges(edges, m)), edges, m, 0.35)
    return cluster.covered_roots(grown, edges, m)


@query(_cluster_sql(_CANDIDATES_TAIL.format(gone="AND k.src % 4 <> 1")))
def dismissed_suppression(spark, sf):
    gone = graph.explicit_edges(A.memories(spark, sf)).where("src % 4 = 1").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _candidates(spark, sf, gone)


@query(sql(_KNN_SQL.format(where="") + """, ve AS (SELECT * FROM sem WHERE src IN (SELECT id FROM cur) AND dst IN (SELECT id FROM cur)), s AS (SELECT id, sum(weight) AS s, count_if(weight >= 0.3) AS near FROM (SELECT unnest([src, dst]) AS id, weight FROM ve) GROUP BY id)
SELECT id FROM s WHERE s >= (SELECT avg(s) + 2 * stddev_pop(s) FROM s) AND near >= 2 AND (SELECT count(*) FROM s) >= 3""", "vec", "mem"))  # fmt: skip
def semantic_outliers(spark, sf):
    edges = vectors.semantic_edges(A.vectors(spark, sf)).select("src", "dst", "weight", F.lit("semantic").alias("kind"))
    return cluster.outliers(edges, A.memories(spark, sf), EngineConfig(expand_cos=0.3))


# --- evaluation -----------------------------------------------------------------------------------------------


def _run(spark, sf, typed=False):
    """Vector search as a run; rows with the query's label are its golds."""
    q, v = A.vector_queries(spark, sf), A.vectors(spark, sf)
    found = vectors.cosine_search(v, q if typed else q.drop("type"), 10, exclude_self=True)
    golds = q.select("query_id", "type").join(v.select("id", "type"), "type").where("id <> query_id").select("query_id", "id")
    return found, golds


_EVAL_SQL = """WITH gold AS (SELECT query_id, id FROM qv JOIN vec ON qtype = type WHERE id <> query_id),
run AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM sims WHERE id <> query_id) WHERE rank <= 10),
typed AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM sims WHERE id <> query_id AND type = qtype) WHERE rank <= 10),
asked AS (SELECT DISTINCT query_id FROM qv),
ideal AS (SELECT query_id, list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1.0 / log2(r + 1))) AS best FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1)),
nd AS (SELECT a.query_id, coalesce((SELECT sum(1.0 / log2(rank + 1)) FROM run r JOIN gold g USING (query_id, id) WHERE r.query_id = a.query_id), 0) / best AS value FROM asked a JOIN ideal USING (query_id)),
nt AS (SELECT a.query_id, coalesce((SELECT sum(1.0 / log2(rank + 1)) FROM typed r JOIN gold g USING (query_id, id) WHERE r.query_id = a.query_id), 0) / best AS value FROM asked a JOIN ideal USING (query_id))"""


def _values(df):
    return df.select("query_id", r6("value").alias("value"))


@query(sql(_EVAL_SQL + " SELECT a.query_id, CAST(count(g.id) > 0 AS DOUBLE) AS value FROM asked a LEFT JOIN run r USING (query_id) LEFT JOIN gold g ON g.query_id = r.query_id AND g.id = r.id AND r.rank <= 5 GROUP BY 1", "sims"))
def recall_at_k(spark, sf):
    return _values(evalkit.hit_at(*_run(spark, sf), k=5))


@query(sql(_EVAL_SQL + " SELECT a.query_id, round(coalesce(1.0 / min(CASE WHEN g.id IS NOT NULL THEN r.rank END), 0.0), 6) AS value FROM asked a LEFT JOIN run r USING (query_id) LEFT JOIN gold g ON g.query_id = r.query_id AND g.id = r.id GROUP BY 1", "sims"))
def mrr(spark, sf):
    return _values(evalkit.reciprocal(*_run(spark, sf)))


@query(sql(_EVAL_SQL + " SELECT query_id, round(value, 6) AS value FROM nd", "sims"))
def ndcg_at_k(spark, sf):
    return _values(evalkit.ndcg_at(*_run(spark, sf)))


def _compared(spark, sf):
    found, golds = _run(spark, sf)
    return evalkit.ndcg_at(found, golds), evalkit.ndcg_at(_run(spark, sf, True)[0], golds)


@query(sql(_EVAL_SQL + " SELECT count(*) AS n, CAST(count_if(t.value > n.value + 1e-9) AS BIGINT) AS improved, CAST(count_if(abs(t.value - n.value) <= 1e-9) AS BIGINT) AS unchanged, CAST(count_if(t.value < n.value - 1e-9) AS BIGINT) AS regressed, round(avg(n.value), 6) AS mean_before, round(avg(t.value), 6) AS mean_after FROM nd n JOIN nt t USING (query_id)", "sims"))
def outcome_distribution(spark, sf):
    d = evalkit.distribution(*_compared(spark, sf))
    return d.select(*(big(c).alias(c) for c in ("n", "improved", "unchanged", "regressed")), *(r6(c).alias(c) for c in ("mean_before", "mean_after")))


@query(sql(_EVAL_SQL + " SELECT avg(t.value) >= avg(n.value) - 0.02 AND count_if(t.value < n.value - 1e-9) = 0 AS passed FROM nd n JOIN nt t USING (query_id)", "sims"))
def no_regression_guard(spark, sf):
    return evalkit.no_regression(*_compared(spark, sf))


@query(sql(_EVAL_SQL + " SELECT query_id, id, round(sim, 6) AS sim FROM gold JOIN sims USING (query_id, id) WHERE sim >= 0.35", "sims"))
def golds_far_check(spark, sf):
    golds = _run(spark, sf)[1]
    return evalkit.golds_near(A.vector_queries(spark, sf), golds, A.vectors(spark, sf)).select("query_id", "id", r6("sim").alias("sim"))


@query("SELECT DISTINCT lower(trim(a.text)) AS text FROM conversations a JOIN conversations b ON lower(trim(a.text)) = lower(trim(b.text)) AND a.turn = 0 AND b.turn = 1")
def warmup_disjoint_check(spark, sf):
    c = A.table(spark, sf, "conversations")
    return evalkit.shared_queries(c.where("turn = 0").select("text"), c.where("turn = 1").select("text"))
