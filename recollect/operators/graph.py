"""The usage graph: edges of four kinds, degrees, and the spreading of activation with receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEGREE_KINDS, KIND_WEIGHT, KINDS, EngineConfig
from ..sources.tables import cut_lineage


def current_ids(memories: DataFrame) -> DataFrame:
    return memories.where("valid_to is null").select("id")


def explicit_edges(memories: DataFrame) -> DataFrame:
    """(src, dst, weight) of the links stored with rows: each pair once, none with itself."""
    pairs = memories.select("id", F.explode("links").alias("other")).where("id <> other")
    return pairs.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct().withColumn("weight", F.lit(1.0))


def crystallized_edges(principles: DataFrame) -> DataFrame:
    """(src, dst, weight) from a principle (id) to each of its sources, directed, none with itself."""
    return principles.select(F.col("id").alias("src"), F.explode("sources").alias("dst")).where("src <> dst").distinct().withColumn("weight", F.lit(1.0))


def capped_counts(pairs: DataFrame, increment: float = 0.5, cap: float = 5.0) -> DataFrame:
    """(src, dst, weight): equal increments up to a cap, so their order does not matter."""
    undirected = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst")
    return undirected.groupBy("src", "dst").agg(F.least(F.lit(cap), F.lit(increment) * F.count(F.lit(1))).alias("weight"))


def merge_edges(edges: DataFrame, new: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Add new edges (src, dst, kind, weight, updated_at): hebbian weights add up to the cap, others keep the greatest.

    Pairs are undirected except those of kind crystallized.
    """
    low = F.when(F.col("kind") == "crystallized", F.col("src")).otherwise(F.least("src", "dst"))
    high = F.when(F.col("kind") == "crystallized", F.col("dst")).otherwise(F.greatest("src", "dst"))
    both = edges.unionByName(new).select(low.alias("src"), high.alias("dst"), "kind", "weight", "updated_at")
    weight = F.when(F.col("kind") == "hebbian", F.least(F.lit(config.hebbian_cap), F.sum("weight"))).otherwise(F.max("weight"))
    return both.groupBy("src", "dst", "kind").agg(weight.alias("weight"), F.max("updated_at").alias("updated_at"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(id, other, kind, weight): every edge from either end, once per kind with its greatest weight."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e"), "kind", "weight")
    return ends.select("e.id", "e.other", "kind", "weight").groupBy("id", "other", "kind").agg(F.max("weight").alias("weight"))


def _blend(kind: Column, weight: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == k, weight * KIND_WEIGHT[k]), KINDS[1:], F.when(kind == KINDS[0], weight * KIND_WEIGHT[KINDS[0]]))


def neighbours(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, other, weight, kind, type): blended weight over all kinds and the kind that gives most of it, of pairs whose
    other end is current, and the other end's type."""
    valid = memories.where("valid_to is null").select(F.col("id").alias("other"), "type")
    own = symmetric(edges).join(valid, "other").withColumn("b", _blend(F.col("kind"), F.col("weight")))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return own.groupBy("id", "other").agg(F.sum("b").alias("weight"), F.max_by("kind", F.struct("b", -place)).alias("kind"), F.first("type").alias("type")).where("weight > 0")


def degrees(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, degree) of every current row: the weights of its edges of use to current rows; 0 without any."""
    now = current_ids(memories)
    used = edges.where(F.col("kind").isin(*DEGREE_KINDS))
    used = used.join(now.select(F.col("id").alias("src")), "src", "left_semi").join(now.select(F.col("id").alias("dst")), "dst", "left_semi")
    sums = used.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("degree"))
    return now.join(sums, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


RECEIPT = "struct<`from`: bigint, kind: string, w: double, hops: int>"


def spread(activation: DataFrame, edges: DataFrame, memories: DataFrame, config: EngineConfig = EngineConfig(), budget: int | None = None, types: DataFrame | None = None) -> DataFrame:
    """(query_id, id, activation, depth, is_seed, receipt) after at most ``budget`` expansions of each query.

    activation: (query_id, id, activation); types: (query_id, type), null for any: a query of a type reaches rows of
    that type only. All queries go in lockstep: in each round the node of each that has most activation and has not
    fired, the smaller id on ties, sends ``activation * weight * hop_decay`` to its neighbours. A node that was not
    there at first keeps a receipt of the greatest transmission it got. Queries without such a node drop out.

    A round reads its state once: rows that fire are joined with their neighbours, all others pass, and both are summed
    by node. Every fourth round is written, so that plans stay small.
    """
    budget = config.recall_budget if budget is None else budget
    if types is None:
        start = activation.withColumn("wanted", F.lit(None).cast("string"))
    else:
        start = activation.join(types.select("query_id", F.col("type").cast("string").alias("wanted")), "query_id", "left")
    state = start.select("query_id", "wanted", "id", "activation", F.lit(0).alias("depth"), F.lit(False).alias("fired"), F.lit(True).alias("is_seed"), F.lit(0.0).alias("best"), F.lit(None).cast(RECEIPT).alias("receipt"))
    if budget > 0:
        around = cut_lineage(neighbours(edges, memories), "neighbours").select(F.col("id").alias("from"), "other", "weight", "kind", "type")
    ready = (~F.col("fired")) & (F.col("activation") >= config.epsilon)
    order = Window.partitionBy("query_id").orderBy(ready.desc(), F.desc("activation"), "id")
    sent = F.col("activation") * F.col("weight") * config.hop_decay
    for step in range(max(0, budget)):
        marked = state.withColumn("fires", ready & (F.row_number().over(order) == 1))
        met = marked.join(around, (F.when(F.col("fires"), F.col("id")) == F.col("from")) & (F.col("wanted").isNull() | (F.col("wanted") == F.col("type"))), "left")
        none = F.lit(None)
        keeps = F.struct("id", F.col("activation").alias("a"), "depth", (F.col("fired") | F.col("fires")).alias("fired"), "is_seed", "best", "receipt", none.cast("double").alias("t"), none.cast(RECEIPT).alias("told"))
        told = F.struct(F.col("id").alias("from"), "kind", F.round("weight", 3).alias("w"), (F.col("depth") + 1).alias("hops")).cast(RECEIPT)
        sends = F.struct(F.col("other").alias("id"), none.cast("double").alias("a"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("fired"), F.lit(False).alias("is_seed"), F.lit(0.0).alias("best"), none.cast(RECEIPT).alias("receipt"), sent.alias("t"), told.alias("told"))
        rows = met.select("query_id", "wanted", F.explode(F.when(F.col("other").isNotNull() & (sent >= config.epsilon), F.array(keeps, sends)).otherwise(F.array(keeps))).alias("r")).select("query_id", "wanted", "r.*")
        # a node is there once, and one node of a query fires: so there is one transmission at most
        summed = rows.groupBy("query_id", "wanted", "id").agg(*(F.max(c).alias(c) for c in ("a", "fired", "is_seed", "best", "t")), F.min("depth").alias("depth"), F.max("receipt").alias("receipt"), F.max("told").alias("told"))
        better = F.col("t").isNotNull() & ~F.col("is_seed") & (F.col("t") > F.col("best"))
        zero = F.lit(0.0)
        hop = F.struct(F.col("told.from"), F.col("told.kind"), F.col("told.w"), F.least("depth", "told.hops").alias("hops")).cast(RECEIPT)
        state = summed.select(
            "query_id", "wanted", "id", (F.coalesce("a", zero) + F.coalesce("t", zero)).alias("activation"), "depth", "fired", "is_seed",
            F.when(better, F.col("t")).otherwise(F.col("best")).alias("best"), F.when(better, hop).otherwise(F.col("receipt")).alias("receipt"),
        )
        if step % 4 == 3 and step + 1 < budget:
            state = cut_lineage(state, "activation")
    return state.select("query_id", "id", "activation", "depth", "is_seed", "receipt")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the nodes of undirected edges (src, dst): the smallest id that can be reached.

    Labels fall to the least among the neighbours and then to their label's label until none changes; each round is a
    written table and only a count comes to the driver.
    """
    both = cut_lineage(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "both-ends")
    labels = cut_lineage(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root")).withColumnRenamed("src", "id"), "labels")
    while True:
        least = both.join(labels.select(F.col("id").alias("dst"), "root"), "dst").groupBy("src").agg(F.min("root").alias("near"))
        fallen = labels.join(least, labels["id"] == least["src"]).select("id", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        hop = labels.select(F.col("id").alias("new"), F.col("root").alias("further"))
        following = cut_lineage(fallen.join(hop, "new", "left").select("id", "old", F.least("new", F.coalesce("further", "new")).alias("root")), "labels")
        labels = following.select("id", "root")
        if following.where("old <> root").isEmpty():
            return labels
