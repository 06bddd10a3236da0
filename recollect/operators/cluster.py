"""Candidates for principles: groups of linked rows, grown over close ones, that no principle covers yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .graph import components, current_ids


def _valid(edges: DataFrame, memories: DataFrame) -> DataFrame:
    now = current_ids(memories)
    return edges.join(now.select(F.col("id").alias("src")), "src", "left_semi").join(now.select(F.col("id").alias("dst")), "dst", "left_semi")


def peak_edges(edges: DataFrame, memories: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(src, dst): edges that make a peak. Explicit ones count with their weight, hebbian ones with nothing."""
    peaks = edges.where((F.col("kind") == "explicit") & (F.col("weight") >= config.peak_floor))
    return _valid(peaks, memories).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def expand(groups: DataFrame, edges: DataFrame, memories: DataFrame, floor: float) -> DataFrame:
    """(root, id): members of groups and their neighbours over semantic edges of at least the floor, one step."""
    close = _valid(edges.where((F.col("kind") == "semantic") & (F.col("weight") >= floor)), memories)
    both = close.select("src", "dst").union(close.select("dst", "src")).toDF("id", "other")
    return groups.select("root", "id").unionByName(groups.join(both, "id").select("root", F.col("other").alias("id"))).distinct()


def covered_roots(members: DataFrame, edges: DataFrame, memories: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(root): groups that hold enough of the current sources of some current principle."""
    bases = _valid(edges.where("kind = 'crystallized'"), memories).select(F.col("src").alias("principle"), F.col("dst").alias("id")).distinct()
    sizes = bases.groupBy("principle").agg(F.count(F.lit(1)).alias("size"))
    shared = members.join(bases, "id").groupBy("root", "principle").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "principle")
    return shared.where(F.col("shared") / F.col("size") >= config.dedup_overlap).select("root").distinct()


def outliers(edges: DataFrame, memories: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id): nodes whose semantic strength is far above the mean, with enough close neighbours; none among fewer than three."""
    close = _valid(edges.where("kind = 'semantic'"), memories)
    ends = close.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    strength = ends.groupBy("id").agg(F.sum("weight").alias("s"), F.count_if(F.col("weight") >= config.expand_cos).alias("near"))
    bar = strength.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.count(F.lit(1)).alias("n"))
    return strength.join(F.broadcast(bar)).where((F.col("n") >= 3) & (F.col("s") >= F.col("mean") + config.fallback_z * F.col("std")) & (F.col("near") >= config.fallback_min_degree)).select("id")


def candidates(edges: DataFrame, memories: DataFrame, dismissed: DataFrame | None = None, config: EngineConfig = EngineConfig(), fallback: bool = False) -> DataFrame:
    """(peak_src, peak_dst, members, titles, why, description): groups worth a principle.

    A group is a component of peak edges with its close neighbours. It needs enough members, a smallest peak edge that
    is not dismissed, and no principle that covers it. With ``fallback`` rows of unusual strength are seeds as well, unless
    they lie in a group already given; dismissals do not count there.
    """
    peaks = peak_edges(edges, memories, config)
    roots = components(peaks)
    first = peaks.join(roots.withColumnRenamed("id", "src"), "src").groupBy("root").agg(F.min(F.struct("src", "dst")).alias("peak"))
    grown = expand(roots, edges, memories, config.expand_cos)
    kept = grown.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.min_cluster).join(first, "root").select("root", F.col("peak.src").alias("peak_src"), F.col("peak.dst").alias("peak_dst"))
    if dismissed is not None:
        gone = dismissed.select(F.least("src", "dst").alias("peak_src"), F.greatest("src", "dst").alias("peak_dst"))
        kept = kept.join(gone, ["peak_src", "peak_dst"], "left_anti")
    kept = kept.join(covered_roots(grown, edges, memories, config), "root", "left_anti").withColumn("why", F.lit("linked"))
    members = grown.join(kept, "root")
    if fallback:
        seeds = outliers(edges, memories, config).join(members.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("root"), "id")
        more = expand(seeds, edges, memories, config.expand_cos)
        taken = more.join(members.select("id").distinct(), "id", "left_semi").select("root").distinct()
        enough = more.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.min_cluster).select("root")
        more = more.join(enough, "root", "left_semi").join(taken, "root", "left_anti").join(covered_roots(more, edges, memories, config), "root", "left_anti")
        # of seeds whose groups meet, the smaller one stands
        least = more.groupBy("id").agg(F.min("root").alias("least"))
        late = more.join(least, "id").where("least < root").select("root").distinct()
        more = more.join(late, "root", "left_anti").select("root", "id", F.col("root").alias("peak_src"), F.col("root").alias("peak_dst"), F.lit("strong").alias("why"))
        members = members.select("root", "id", "peak_src", "peak_dst", "why").unionByName(more)
    own = members.join(memories.select("id", "title", "tags"), "id")
    rows = F.array_sort(F.collect_list(F.struct("id", "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))))
    out = own.groupBy("root", "peak_src", "peak_dst", "why").agg(rows.alias("r"))
    tags = F.array_sort(F.array_distinct(F.flatten("r.tags")))
    described = F.concat_ws(" | ", F.array_join("r.title", "; "), F.when(F.size(tags) > 0, F.array_join(tags, ", ")))
    return out.select("peak_src", "peak_dst", F.col("r.id").alias("members"), F.col("r.title").alias("titles"), "why", described.alias("description"))
