"""Exact top-k search by inner product over integer vectors.

Vectors are sorted by descending length and cut into blocks. An orthogonal rotation, from the singular vectors of all
rows, moves most of a vector's weight to its first coordinates. A block of queries goes through a block of candidates
in slabs, longest first: by Cauchy and Schwarz, a query is done with the block once its length times the slab's
greatest length is below its k-th best score, and a candidate is dropped when the sum over the first coordinates
plus the product of the two residual lengths is. What is left is scored exactly on the integers. Every block of
queries meets every block of candidates where files of both are read, one pair at a time in a task: nothing is
broadcast, copied to a shuffle or listed on the driver. Only the best k of each pair go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import ship, stage

#: Rows of a block of candidates and of queries, of a slab, and of the longest vectors that give first bounds.
CANDIDATES, QUERIES, SLAB, SEEDS = 8192, 1024, 1024, 2048
#: Pairs that are scored exactly at once.
PAIRS = 20_000
_EXACT = float(2**53)
_BLOCK = "block long, n long, dim long, ids binary, raw binary, bounds binary"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v, norm2) of the vectors that take part: not null, all components there and finite, as floor(scale * x)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    return whole.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, largest first. Tasks add up their rows' products; the sums have dim x dim cells."""

    def products(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "x"])

    total = np.zeros(dim * dim)
    for r in vectors.select("v").mapInArrow(products, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        total[r.cell] = r.x
    total[~np.isfinite(total)] = 0.0
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products."""
    if len(q) and np.abs(q).max() * np.abs(c).max() * q.shape[1] < _EXACT:
        return (q * c).sum(1).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)], np.int64)


def best_in_block(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, head: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): each query's best k of a block of candidates that descends by length.

    bounds: scores of which a query has k already; candidates below are of no use to it.
    """
    qr, cr = q @ turn, c @ turn
    q_len, c_len = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
    slack = 1e-9 * (q_len * (c_len.max() if len(c_len) else 0.0)) + 1e-6
    bounds = bounds.astype(np.float64).copy()
    kept: list[list[tuple[int, int]]] = [[] for _ in q_ids]  # (-score, id), sorted
    live = np.arange(len(q_ids))
    for s in range(0, len(c_ids), SLAB):
        e = min(s + SLAB, len(c_ids))
        live = live[q_len[live] * c_len[s:e].max() + slack[live] >= bounds[live]]
        if not len(live):
            break
        first = qr[live, :head] @ cr[s:e, :head].T
        may = first + np.outer(q_rest[live], c_rest[s:e]) + slack[live, None] >= bounds[live, None]
        may &= q_ids[live, None] != c_ids[None, s:e]
        if k < e - s:  # scores of the slab itself raise the bounds before exact scoring: the k-th best lower bound
            low = np.where(may, first - np.outer(q_rest[live], c_rest[s:e]), -np.inf)
            bounds[live] = np.maximum(bounds[live], np.partition(low, e - s - k, 1)[:, e - s - k] - slack[live])
            may &= first + np.outer(q_rest[live], c_rest[s:e]) + slack[live, None] >= bounds[live, None]
        rows, cols = np.nonzero(may)
        scores = np.concatenate([np.empty(0, np.int64), *(_exact(q[live[rows[i : i + PAIRS]]], c[s + cols[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS))])
        order = np.lexsort((c_ids[s + cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        for r, col, score in zip(*(x[rank < k].tolist() for x in (live[rows], s + cols, scores)), strict=True):
            kept[r].append((-score, int(c_ids[col])))
        for r in set(live[rows].tolist()):
            kept[r] = sorted(kept[r])[:k]
            if len(kept[r]) == k:
                bounds[r] = max(bounds[r], -kept[r][-1][0])
    return [(int(q_ids[r]), i, -score) for r, own in enumerate(kept) for score, i in own]


def _blocks(ordered: DataFrame, dim: int, size: int, seeds) -> DataFrame:
    """Pack a partition's rows, in their order, into blocks of at most ``size``; seeds: what first bounds come from."""
    from pyspark import TaskContext

    def pack(batches):
        part, made, ids, raw = TaskContext.get().partitionId(), 0, [], []

        def close():
            i, m = np.concatenate(ids), np.concatenate(raw)
            for s in range(0, len(i), size):
                own, rows = i[s : s + size], m[s : s + size]
                bounds = np.full(len(own), -np.inf)
                if seeds is not None:
                    s_ids, s_raw, k = seeds.value
                    if len(s_ids) > k:
                        scores = np.where(own[:, None] == s_ids[None], -np.inf, rows @ s_raw.T)
                        bounds = np.partition(scores, len(s_ids) - k, 1)[:, len(s_ids) - k]
                        bounds -= 1e-9 * np.abs(bounds) + 1e-6
                yield pa.RecordBatch.from_arrays([pa.array([part * 1_000_000 + made + s // size], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([dim], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (own, rows, bounds))], names=["block", "n", "dim", "ids", "raw", "bounds"])

        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            raw.append(_matrix(batch.column(1), dim))
            if sum(map(len, ids)) >= 4 * size:
                yield from close()
                made, ids, raw = made + -(-sum(map(len, ids)) // size), [], []
        if ids and sum(map(len, ids)):
            yield from close()

    return ordered.select("vec_id", "v").mapInArrow(pack, _BLOCK)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with every other row.

    Queries are the rows whose id is divisible by ``every``. Ties go to the smaller id. Vectors that are null or hold
    null or non-finite components take no part; shorter vectors count as ending in zeros. Of rows that repeat an id
    the one with the smallest vector counts. Scores must fit a long. Without queries, or without a second row, the
    result is empty.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = stage(integer_vectors(vectors, id_col, vector_col), "vectors")
    dim = whole.agg(F.max(F.size("v")).alias("dim")).first().dim
    schema = "query_id long, vec_id long, score long"
    if not dim or dim < 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if dim is None else _zero_dim(whole, k, every)
    turn = rotation(whole, dim)
    # keys first: a task offers SEEDS rows, and whole vectors of all tasks are too much for the driver
    keys = whole.select("norm2", "vec_id").orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).collect()
    last = keys[-1]
    longest = whole.where((F.col("norm2") > last.norm2) | ((F.col("norm2") == last.norm2) & (F.col("vec_id") <= last.vec_id))).collect()
    s_raw = np.zeros((len(longest), dim))
    for r, row in enumerate(longest):
        s_raw[r, : len(row.v)] = row.v
    seeds = spark.sparkContext.broadcast((np.array([r.vec_id for r in longest], np.int64), s_raw, k))
    held = spark.sparkContext.broadcast(turn)
    head = max(1, dim // 4)
    candidates = stage(_blocks(whole.repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id"), dim, CANDIDATES, None).drop("bounds"), "candidate-blocks")
    asked = whole.where(F.col("vec_id") % every == 0)
    asked = stage(_blocks(asked.repartitionByRange("vec_id").sortWithinPartitions("vec_id"), dim, QUERIES, seeds), "query-blocks")
    # this hint keeps the planner, which knows the compressed sizes only, from a broadcast of either side
    pairs = candidates.select(*(F.col(c).alias(f"c_{c}") for c in ("ids", "raw"))).hint("shuffle_replicate_nl").crossJoin(asked.select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "raw", "bounds"))))

    def search(batches):
        turned = held.value
        for batch in batches:
            for n in range(batch.num_rows):
                c_ids, c_raw, q_ids, q_raw, bounds = (batch.column(x)[n].as_buffer() for x in range(5))
                found = best_in_block(np.frombuffer(q_ids, np.int64), np.frombuffer(q_raw).reshape(-1, dim), np.frombuffer(bounds), np.frombuffer(c_ids, np.int64), np.frombuffer(c_raw).reshape(-1, dim), turned, k, head)
                columns = list(zip(*found, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = pairs.select("c_ids", "c_raw", "q_ids", "q_raw", "q_bounds").mapInArrow(search, schema)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _zero_dim(whole: DataFrame, k: int, every: int) -> DataFrame:
    """All vectors are empty: every score is 0, so the smallest ids win."""
    first = whole.orderBy("vec_id").limit(k + 1).select("vec_id", F.lit(0).cast("long").alias("score"), F.lit(1).alias("one"))
    asked = whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("one"))
    return _ranked(asked.join(F.broadcast(first), "one").where("query_id <> vec_id").drop("one"), k)
