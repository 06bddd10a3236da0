"""Exact deduplication by a heavy-hitter split, with DataFrame functions only.

Every text is reduced to the SHA-256 of its normalised form. A Misra-Gries summary of the digests
(``freqItems``: one fixed number of counters per task, merged pairwise) names every digest that holds more
than ``support`` of the rows. Exact counts and keepers of those few are aggregated with map-side combine and
broadcast, so that their rows, however many, are resolved where they are read and never meet in one task. All
other digests have at most ``support`` of the rows each and take ordinary shuffles: groups are counted with map-side
combine as well, and only their totals, of digests that more than one row has, meet the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage, without_ids

#: Counters of the Misra-Gries summary, and so the most rows that the winners' broadcast can have.
COUNTERS = 1024
#: Deleted before texts are compared: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when they are identical after deleting every blank of ``BLANKS``. Of equal texts the one with
    the most code points before that stays, then the one with the smallest id. Null texts count as empty, and
    empty texts are equal to each other. Rows that repeat an id and its text count towards group_size each and
    share one decision. A null id comes behind all others and is kept only where its group has no other. An empty table
    gives an empty result. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = stage(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"), F.length(text).cast("long").alias("n_points")),
        "digests",
    )
    named = digests.stat.freqItems(["text_sha256"], 1.0 / counters).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("minus_id")))
    winners = stage(
        digests.join(F.broadcast(named), "text_sha256")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("text_sha256", (-F.col("best.minus_id")).alias("keep_id"), "group_size"),
        "winners",
    )
    columns = ["doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "n_points"]
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = stage(
        rest.groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("text_sha256", (-F.col("best.minus_id")).alias("keep_id"), "group_size"),
        "groups",
    )
    rest = rest.join(groups, "text_sha256", "left").withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return heavy.select(*columns).unionByName(rest.select(*columns))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns, whatever their names.

    Ids are taken to name one text each: rows that repeat an id stay or go together, so a repeated row of the kept id
    stays as often as it is there. Null and empty texts are equal; rows without an id stay. An empty table stays empty.
    """
    gone = exact_dedup(docs, id_col, text_col, counters).where(~F.col("kept")).select("doc_id")
    return without_ids(docs, id_col, gone)
