"""Recall for batches of queries: keyword and vector arms, fusion, spreading, receipts, excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import excerpt, has_tags
from ..sources.tables import cut_lineage
from .fts import search
from .fusion import seed_scores
from .graph import spread
from .sessions import primed
from .vectors import cosine_search

VIA = "struct<seed: boolean, path: array<struct<`from`: bigint, kind: string, w: double>>, hops: int>"


def by_tags(memories: DataFrame, tags: list[str], type_: str | None = None, limit: int = 20) -> DataFrame:
    """Current rows with all tags, the latest first."""
    rows = memories.where(F.col("valid_to").isNull() & has_tags(F.col("tags"), F.array(*map(F.lit, tags)).cast("array<string>")))
    rows = rows.where(F.col("type") == type_) if type_ else rows
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def recall_by_tags(memories: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, id) of queries (query_id, tags, and perhaps type) without words: the latest current rows that have
    all tags, of the type if there is one. Rows meet queries over the first tag of these."""
    type_ = F.col("type") if "type" in queries.columns else F.lit(None).cast("string")
    asked = queries.where(F.size("tags") > 0).select("query_id", F.col("tags").alias("wanted"), type_.alias("wanted_type"), F.col("tags")[0].alias("tag"))
    rows = memories.where("valid_to is null").select("id", "type", "updated_at", F.col("tags").alias("have"), F.explode(F.array_distinct("tags")).alias("tag"))
    met = rows.join(asked, "tag").where(has_tags(F.col("have"), F.col("wanted")) & (F.col("wanted_type").isNull() | (F.col("wanted_type") == F.col("type"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id")


def seeds(memories: DataFrame, queries: DataFrame, config: EngineConfig = EngineConfig(), now=None) -> DataFrame:
    """(query_id, id, score). queries: query_id, text, and perhaps type, tags and embedding; without vectors the keyword
    arm stands alone."""
    lists = [search(memories, queries, config.arm_limit)]
    if config.semantic and "embedding" in queries.columns:
        lists.append(cosine_search(memories.where("valid_to is null"), queries.select("query_id", *[c for c in ("type", "embedding") if c in queries.columns]), config.arm_limit, config.seed_floor))
    found = seed_scores(lists, memories, config, now)
    return _tagged(found, memories, queries)


def _tagged(rows: DataFrame, memories: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, id, ...) whose memory has all tags of its query."""
    if "tags" not in queries.columns:
        return rows
    wanted = queries.select("query_id", F.coalesce("tags", F.array().cast("array<string>")).alias("wanted"))
    return rows.join(memories.select("id", F.col("tags").alias("have")), "id").join(F.broadcast(wanted), "query_id").where(has_tags(F.col("have"), F.col("wanted"))).drop("have", "wanted")


def plain_recall(memories: DataFrame, queries: DataFrame, config: EngineConfig = EngineConfig(), now=None) -> DataFrame:
    """(query_id, rank, id, score): seeds in order, without a graph. The limit comes before rows are looked up."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return seeds(memories, queries, config, now).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.recall_limit).select("query_id", "rank", "id", "score")


def protected(activated: DataFrame, scores: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, rank, id, activation, is_seed, receipt, in_head): the best seeds keep their places at the head, all others
    follow by activation."""
    seed = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    head = scores.withColumn("head_rank", F.row_number().over(seed)).where(F.col("head_rank") <= config.protect_head).select("query_id", "id", "head_rank")
    is_seed = scores.select("query_id", "id", F.lit(True).alias("scored"))
    rows = activated.join(head, ["query_id", "id"], "left").join(is_seed, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("head_rank").asc_nulls_last(), F.desc(F.round("activation", 9)), "id")
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "id", "activation", F.col("scored").isNotNull().alias("is_seed"), "receipt", F.col("head_rank").isNotNull().alias("in_head"))


def via() -> F.Column:
    """How a row was reached: its receipt, or that it is a seed."""
    step = F.array(F.struct(F.col("receipt.from"), F.col("receipt.kind"), F.col("receipt.w")))
    walked = F.struct(F.lit(None).cast("boolean"), step, F.col("receipt.hops")).cast(VIA)
    return F.when(~F.col("is_seed") & F.col("receipt").isNotNull(), walked).otherwise(F.struct(F.lit(True), F.lit(None).cast("array<struct<f: bigint, k: string, w: double>>"), F.lit(None).cast("int")).cast(VIA))


def recall(memories: DataFrame, edges: DataFrame, queries: DataFrame, members: DataFrame | None = None, sessions: DataFrame | None = None, config: EngineConfig = EngineConfig(), now=None) -> DataFrame:
    """(query_id, rank, id, activation, is_seed, in_head, via): associative recall of a batch of queries.

    A query's type, if it has one, holds for its seeds, for what its session primes and for what the walk reaches. A
    query without seeds gives nothing, whatever its session holds. Rows beyond the limit are kept when they are in the
    head, with null as rank: learning uses the whole head.
    """
    if config.assoc:  # read by the walk, the head and the result: written once
        found = cut_lineage(seeds(memories, queries, config, now), "seeds")
    else:
        return plain_recall(memories, queries, config, now).withColumnRenamed("score", "activation").withColumns({"is_seed": F.lit(True), "in_head": F.lit(False), "via": F.lit(None).cast(VIA)})
    start = found.select("query_id", "id", F.col("score").alias("activation"))
    types = queries.select("query_id", "type") if "type" in queries.columns else None
    if members is not None and sessions is not None:
        start = primed(found, members, sessions, memories, config, types).join(found.select("query_id").distinct(), "query_id", "left_semi")
    walked = cut_lineage(spread(start, edges, memories, config, types=types), "walked")
    rows = protected(_tagged(walked, memories, queries), found, config)
    inside = F.col("rank") <= config.recall_limit
    return rows.where(inside | F.col("in_head")).withColumn("via", via()).withColumn("rank", F.when(inside, F.col("rank"))).drop("receipt")


def hydrate(hits: DataFrame, memories: DataFrame, queries: DataFrame, config: EngineConfig = EngineConfig(), full: bool = False) -> DataFrame:
    """Hits with their rows' fields; bodies are cut around the query unless ``full``. Rows that are no longer current
    drop out and are not replaced. truncated and body_chars are set where a body was cut."""
    rows = memories.where("valid_to is null").select("id", "type", "title", "body", "tags", "updated_at")
    joined = hits.where("rank is not null").join(rows, "id").join(F.broadcast(queries.select("query_id", "text")), "query_id")
    width = 0 if full else config.excerpt_chars
    cut = (F.length("body") > width) & F.lit(width > 0)
    return joined.withColumn("truncated", cut).withColumn("body_chars", F.when(cut, F.length("body"))).withColumn("body", excerpt(F.col("body"), F.col("text"), width, config.excerpt_snap)).drop("text")


def learn(hits: DataFrame, sessions: DataFrame, members: DataFrame, config: EngineConfig = EngineConfig()):
    """What a batch of recalls teaches: the folded sessions (see sessions.touch_sessions). Queries of one session go in
    the order of their ids, each with its whole head; reading itself changes nothing."""
    from .sessions import touch_sessions

    rows = hits.where("in_head" if config.learn_from_head else "rank is not null").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("activation", 9)), "id")) - 1)
    touches = rows.join(sessions, "query_id").select("session_id", F.col("query_id").alias("touch"), F.col("place").alias("rank"), F.col("id").alias("memory_id"))
    return touch_sessions(touches, members, config)
