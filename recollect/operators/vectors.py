"""Exact cosine search and nearest-neighbour edges over unit vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ship import ship
from ..sources.tables import cut_lineage

#: Query vectors that are sent to the executors at once; more are searched in several rounds.
SLICE = 4096
#: Rows of a block of the self-join.
BLOCK = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best scores of each row, rounded as ties are; ties go to the smaller id."""
    scores = np.round(scores, 9)
    if scores.shape[1] > k:
        bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(scores >= bar)
    else:
        rows, cols = np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k]


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int = 200, floor: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, rank, sim): the k nearest current vectors of each query, of its type if it names one.

    vectors: id, type, embedding; queries: query_id, embedding and perhaps type. The cut to k comes before the floor.
    Null vectors take no part, nor do queries that are zero. Each task multiplies its vectors with a slice of the
    queries and passes on k rows a query.
    """
    from pyspark.sql.types import ArrayType

    spark = vectors.sparkSession
    ship(spark)
    if "type" not in queries.columns:
        queries = queries.withColumn("type", F.lit(None).cast("string"))
    rows = queries.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("query_id", "type", "embedding")
    asked = rows.toArrow().to_pylist()
    plain = vectors.where(F.col("embedding").isNotNull()).select("id", F.col("type").cast("string").alias("type"), F.col("embedding").cast(ArrayType(vectors.schema["embedding"].dataType.elementType)).alias("embedding"))
    found = spark.createDataFrame([], "query_id long, id long, sim double")
    for s in range(0, len(asked), SLICE):
        part = asked[s : s + SLICE]
        held = spark.sparkContext.broadcast(([r["query_id"] for r in part], [r["type"] for r in part], np.array([r["embedding"] for r in part], np.float64)))

        def multiply(batches, held=held):
            ids_q, types_q, matrix = held.value
            for batch in batches:
                ids, types, own = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), _matrix(batch.column(2))
                if not len(ids):
                    continue
                sims = matrix @ own.T
                for t in set(types_q):
                    if t is not None:
                        sims[np.ix_([i for i, x in enumerate(types_q) if x == t], np.flatnonzero(types != t))] = -np.inf
                if exclude_self:
                    sims[np.array(ids_q)[:, None] == ids[None]] = -np.inf
                r, c = _best(sims, ids, k)
                keep = np.isfinite(sims[r, c])
                r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids_q, np.int64)[r]), pa.array(ids[c]), pa.array(sims[r, c])], names=["query_id", "id", "sim"])

        found = found.unionByName(plain.mapInArrow(multiply, "query_id long, id long, sim double"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if floor is not None:
        out = out.where(F.col("sim") >= floor)
    return out.select("query_id", "id", "rank", "sim")


def _blocks(vectors: DataFrame) -> DataFrame:
    """Rows packed by BLOCK: (block, ids, matrix)."""
    from pyspark import TaskContext

    def pack(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                own = batch.slice(s, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([part * 1_000_000 + made], pa.int64()), pa.array([own.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_matrix(own.column(1)).tobytes()], pa.binary())], names=["block", "ids", "matrix"])
                made += 1

    return vectors.mapInArrow(pack, "block long, ids binary, matrix binary")


def nearest(vectors: DataFrame, among: DataFrame, k: int = 8) -> DataFrame:
    """(id, other, sim, rank): for each vector its k nearest others with a positive cosine.

    Both sides are packed into blocks; every block of the one meets every block of the other once, in a task of its
    own, and passes on k rows a vector.
    """
    spark = vectors.sparkSession
    ship(spark)
    plain = lambda df: df.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), "embedding")
    packed = cut_lineage(_blocks(plain(among)), "blocks")  # written: numbers of blocks hold for one run only
    left = packed if among is vectors else cut_lineage(_blocks(plain(vectors)), "blocks")
    right = packed.select("block", F.col("ids").alias("o_ids"), F.col("matrix").alias("o_matrix"))
    numbers = packed.agg(F.collect_list("block").alias("numbers"))  # one long for each block of vectors
    left = left.drop("block").join(F.broadcast(numbers)).select("ids", "matrix", F.explode("numbers").alias("block"))

    def multiply(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                ids, own, o_ids, other = (batch.column(c)[n].as_buffer() for c in range(4))
                ids, o_ids = np.frombuffer(ids, np.int64), np.frombuffer(o_ids, np.int64)
                sims = np.frombuffer(own).reshape(len(ids), -1) @ np.frombuffer(other).reshape(len(o_ids), -1).T
                sims[ids[:, None] == o_ids[None]] = -np.inf
                r, c = _best(sims, o_ids, k)
                keep = sims[r, c] > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[r[keep]]), pa.array(o_ids[c[keep]]), pa.array(sims[r, c][keep])], names=["id", "other", "sim"])

    found = left.join(right, "block").select("ids", "matrix", "o_ids", "o_matrix").mapInArrow(multiply, "id long, other long, sim double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def semantic_edges(vectors: DataFrame, among: DataFrame | None = None, k: int = 8) -> DataFrame:
    """(src, dst, weight): the union of all rows' nearest neighbours, each pair once with its greatest cosine."""
    near = nearest(vectors, vectors if among is None else among, k)
    return near.groupBy(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).agg(F.max("sim").alias("weight"))


def embed(df: DataFrame, function, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """Add vectors made by ``function`` (a list of texts in, a matrix out), a batch of rows at a time."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        matrix = np.asarray(function(texts.fillna("").tolist()), np.float32)
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        return pd.Series(list(np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)))

    return df.withColumn(out_col, run(F.col(text_col)))


def backfill(memories: DataFrame, function, remake: bool = False) -> DataFrame:
    """Fill the vectors of rows that have none; with ``remake``, after the model changed, of all rows."""
    text = memories.withColumn("__text", F.concat_ws("\n", "title", "body"))
    if remake:
        return embed(text.drop("embedding"), function, "__text").drop("__text").select(*memories.columns)
    made = embed(text.where("embedding is null").drop("embedding"), function, "__text").drop("__text").select(*memories.columns)
    return memories.where("embedding is not null").unionByName(made)
