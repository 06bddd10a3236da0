"""Full-text search for batches of queries: phrases, all of which must match, in BM25 order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrases, tokens
from ..sources.tables import cut_lineage

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("title", "body", "tags")


def postings(memories: DataFrame) -> DataFrame:
    """(id, field, tokens) of all rows, current or not: statistics are over the whole table."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), tokens(F.array_join("tags", ",") if c == "tags" else F.col(c)).alias("tokens")) for c in COLUMNS))
    return memories.select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.tokens")


def bm25(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of the rows in which every phrase of a query occurs, whatever their validity.

    queries: query_id, text. The table is read and tokenised once, to a row's length and those of its tokens that some
    query has; all else works on what that pass wrote, which grows with the rows and the matches, not with the texts.
    """
    asked = queries.select("query_id", F.posexplode(phrases(F.col("text"))).alias("phrase", "terms"))
    terms = asked.select("query_id", "phrase", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("k", "term"))
    wanted = terms.select(F.collect_set("term").alias("wanted"))  # one row: the words of a batch of queries
    lists = [tokens(F.array_join("tags", ",") if c == "tags" else F.col(c)).alias(c) for c in COLUMNS]
    hits = lambda c: F.filter(F.transform(c, lambda t, i: F.struct(F.lit(c).alias("field"), t.alias("term"), i.alias("pos"))), lambda s: F.array_contains("wanted", s["term"]))
    length = sum((F.size(c) for c in COLUMNS), F.lit(0)).cast("double")
    rows = cut_lineage(memories.select("id", *lists).join(F.broadcast(wanted)).select("id", length.alias("length"), F.concat(*map(hits, COLUMNS)).alias("hits")), "hits")
    corpus = rows.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), F.avg("length").alias("mean_length"))
    places = rows.where(F.size("hits") > 0).select("id", "length", F.explode("hits").alias("s")).select("id", "length", "s.field", "s.term", "s.pos")
    starts = places.join(F.broadcast(terms), "term").select("query_id", "phrase", "n_terms", "id", "length", "field", (F.col("pos") - F.col("k")).alias("start"), "k")
    found = starts.groupBy("query_id", "phrase", "n_terms", "id", "length", "field", "start").agg(F.countDistinct("k").alias("met")).where("met = n_terms")
    counts = cut_lineage(found.groupBy("query_id", "phrase", "id", "length").agg(F.count(F.lit(1)).cast("double").alias("f")), "counts")
    per_phrase = counts.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).cast("double").alias("n_with"))
    idf = F.log((F.col("n_rows") - F.col("n_with") + 0.5) / (F.col("n_with") + 0.5))
    weights = per_phrase.join(F.broadcast(corpus)).select("query_id", "phrase", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"), "mean_length")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = counts.join(F.broadcast(weights), ["query_id", "phrase"]).groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n"))
    needed = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    return scored.join(F.broadcast(needed), "query_id").where("n = needed").select("query_id", "id", "score")


def search(memories: DataFrame, queries: DataFrame, limit: int = 200) -> DataFrame:
    """(query_id, id, rank, score): the best current rows of each query, of its type if it names one.

    Ties go to the later update, then to the smaller id.
    """
    current = memories.where("valid_to is null").select("id", "type", "updated_at")
    q = queries.select("query_id", F.col("type").alias("wanted_type")) if "type" in queries.columns else queries.select("query_id", F.lit(None).cast("string").alias("wanted_type"))
    hits = bm25(memories, queries).join(current, "id").join(F.broadcast(q), "query_id").where("wanted_type is null or wanted_type = type")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("updated_at"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "rank", "score")
