"""Ranking quality: recall, reciprocal rank, nDCG, and guards over paired runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scoring import dot


def judged(results: DataFrame, golds: DataFrame) -> DataFrame:
    """(query_id, id, rank, is_gold) of results (query_id, id, rank) against golds (query_id, id)."""
    return results.select("query_id", "id", "rank").join(golds.select("query_id", "id", F.lit(True).alias("g")).distinct(), ["query_id", "id"], "left").select("query_id", "id", "rank", F.col("g").isNotNull().alias("is_gold"))


def _per_query(results: DataFrame, golds: DataFrame, value) -> DataFrame:
    asked = golds.select("query_id").unionByName(results.select("query_id")).distinct()
    return asked.join(judged(results, golds).groupBy("query_id").agg(value.alias("value")), "query_id", "left").select("query_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def hit_at(results: DataFrame, golds: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, value): 1 if a gold is among the first k, else 0."""
    return _per_query(results, golds, F.max(F.when(F.col("is_gold") & (F.col("rank") <= k), 1.0).otherwise(0.0)))


def reciprocal(results: DataFrame, golds: DataFrame) -> DataFrame:
    """(query_id, value): one over the rank of the first gold, 0 without."""
    return _per_query(results, golds, F.coalesce(F.lit(1.0) / F.min(F.when(F.col("is_gold"), F.col("rank"))), F.lit(0.0)))


def ndcg_at(results: DataFrame, golds: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, value): discounted gain of golds among the first k, over that of a perfect list; 0 without golds."""
    gain = F.sum(F.when(F.col("is_gold") & (F.col("rank") <= k), F.lit(1.0) / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    own = _per_query(results, golds, gain)
    ideal = golds.select("query_id", "id").distinct().groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    best = ideal.select("query_id", F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + 1.0)).alias("ideal"))
    return own.join(best, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.col("value") / F.col("ideal")).otherwise(0.0).alias("value"))


def distribution(before: DataFrame, after: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(n, improved, unchanged, regressed, mean_before, mean_after) of two runs' values per query."""
    both = before.select("query_id", F.col("value").alias("b")).join(after.select("query_id", F.col("value").alias("a")), "query_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.col("b") + tolerance).alias("improved"), F.count_if(F.abs(F.col("a") - F.col("b")) <= tolerance).alias("unchanged"), F.count_if(F.col("a") < F.col("b") - tolerance).alias("regressed"), F.avg("b").alias("mean_before"), F.avg("a").alias("mean_after"))


def no_regression(before: DataFrame, after: DataFrame, slack: float = 0.02) -> DataFrame:
    """(passed): the mean has not fallen by more than the slack, and no query got worse."""
    return distribution(before, after).select(((F.col("mean_after") >= F.col("mean_before") - slack) & (F.col("regressed") == 0)).alias("passed"))


def golds_near(queries: DataFrame, golds: DataFrame, vectors: DataFrame, bar: float = 0.35) -> DataFrame:
    """(query_id, id, sim) of golds that a vector search alone would find; a graph-only set has none."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    return golds.join(q, "query_id").join(vectors.select("id", "embedding"), "id").select("query_id", "id", dot(F.col("q"), F.col("embedding")).alias("sim")).where(F.col("sim") >= bar)


def shared_queries(warm: DataFrame, held: DataFrame) -> DataFrame:
    """(text): queries that are both used to warm up and to evaluate; there must be none."""
    key = F.lower(F.trim("text")).alias("text")
    return warm.select(key).distinct().join(held.select(key).distinct(), "text", "left_semi")


def wired_pairs(tasks: DataFrame, cap: float = 5.0) -> DataFrame:
    """(src, dst, weight): all pairs of each task's members (task, id) at the cap; tasks are small by nature."""
    a, b = tasks.select("task", F.col("id").alias("src")), tasks.select("task", F.col("id").alias("dst"))
    return a.join(b, "task").where("src < dst").select("src", "dst").distinct().withColumn("weight", F.lit(cap))
