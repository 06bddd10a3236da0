"""Rank fusion: reciprocal ranks of several lists, recency and decay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.scoring import age_days, decay_factor, reciprocal_rank


def rrf_scores(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, id, score) from lists (query_id, id, rank): the sum of reciprocal ranks."""
    whole = reduce(DataFrame.unionByName, [x.select("query_id", "id", reciprocal_rank(F.col("rank"), k).alias("s")) for x in lists])
    return whole.groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def rrf_fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, id, rank, score): fused order, ties to the smaller id."""
    return ranked(rrf_scores(lists, k))


def ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order))


def recency(seeds: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, id, rank) of each query's rows from the latest update, ties to the greater id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return seeds.select("query_id", "id").distinct().join(memories.select("id", "updated_at"), "id").withColumn("rank", F.row_number().over(order)).select("query_id", "id", "rank")


def seed_scores(lists: list[DataFrame], memories: DataFrame, config: EngineConfig, now=None) -> DataFrame:
    """(query_id, id, score): fused ranks, plus the recency of the fused rows, and then decay if a half-life is set."""
    order = Window.partitionBy("query_id").orderBy(F.desc("updated_at"), F.desc("id"))
    base = rrf_scores(lists, config.rrf_k).join(memories.select("id", "updated_at"), "id").withColumn("late", F.row_number().over(order))
    score = F.col("score") + reciprocal_rank(F.col("late"), config.rrf_k) * config.recency_weight
    if config.decay_half_life_days:
        now = F.current_timestamp() if now is None else now
        score = score * decay_factor(age_days(F.col("updated_at"), now), config.decay_half_life_days)
    return base.select("query_id", "id", score.alias("score"))
