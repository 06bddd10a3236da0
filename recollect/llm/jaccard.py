"""Near-duplicate join: texts whose shingle sets have a Jaccard similarity of 0.8 or more, and their components.

The document by n-gram incidence matrix is multiplied with its transpose in blocks, and only where a product can
reach its bound. By sizes alone, linked sets of sizes a and b share at least 80 % of either; so they share k of the
first ``a - ceil(0.8 a) + k`` n-grams of each, in any order common to all sets. Columns of these prefixes, rare n-grams
first (those that many sets of a task hold are found by local counts and put last; beyond a bounded list of the most
frequent, a bounded table by buckets of n-grams orders the others), tell which rows can be linked:
pairs whose sizes rule a link out are discarded at once, and pairs that share fewer columns than the sizes ask for
after that.

The rows of those pairs are dealt to blocks of rows, neighbours to the same block. Two blocks that some pair joins
meet in one group, to which each of their rows is sent once, and are multiplied whole: overlap counts are accumulated
over all blocks of columns, and pairs whose count stays below the bound that their two sizes give are discarded. What
leaves a group is a forest of the links found, not the links.

Documents with one set are one row of the matrix. Of a column of very many rows only the pairs with its first row
count at first. Where the links found leave its rows in several components, the rows outside the largest make up one
side's blocks and all its rows the other's, and the blocks that share such a column are multiplied. Pairs within a
component need no product, so no link between components is lost, and no group of near copies is expanded to its
pairs. A linked pair that shares fewer than k of the other columns shares one of these.

Sets are held as 64-bit hashes; two different n-grams, or two different sets, are taken for one with a chance of
about 2^-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ID_BUCKETS, ship, stage, trimmed, unstage, without_ids

WORDS, PERCENT = 5, 80
#: Rows of a column up to which all its pairs are candidates at once.
COLUMN = 32
#: A column counts as frequent from this sum of local counts (each of LOCAL at least), or from the least sum that so many have.
FREQUENT, LOCAL, MOST_FREQUENT = 2, 2, 1_000_000
#: Buckets of the table that orders frequent n-grams below that bar: powers of two, the least and the most.
LEAST_BITS, MOST_BITS = 10, 25
#: Columns of n-grams with such a sum are not shuffled by column; a set meets the first row of so many of them.
HOT, STARS = 64, 24
#: N-grams that a task counts together, bytes that it hashes together, classes that it remembers as sent.
CHUNK_GRAMS, CHUNK_BYTES, REMEMBERED = 2_500_000, 1_000_000, 200_000

#: Rows and n-grams of a block of the product.
BLOCK_ROWS, BLOCK_GRAMS = 1024, 1_000_000

#: A count that is enough for any pair.
_ENOUGH = 1 << 40

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Masks of the first bytes of eight, and the length from which a word is hashed by itself.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 512


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of ``data``: eight bytes at a time, with a bijective mixing after each."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = end - begin
    h = mix(left.astype(np.uint64) + _BASE)
    live = np.flatnonzero(left < LONG_WORD)
    at, rest = begin[live], left[live]
    while len(live):
        h[live] = mix(h[live] * _BASE ^ (eight[at] & _FIRST[np.minimum(rest, 8)]))
        more = rest > 8
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(left >= LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]], digest_size=8).digest(), "little")
    return h


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a text with fewer words has its whole sequence as one."""
    joined = b" ".join(texts).translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts_of = np.cumsum(sizes + 1) - sizes - 1
    inside = ~_BLANK[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = word_hashes(joined, begin, end)
    first = np.searchsorted(begin, starts_of)
    last = np.append(first[1:], len(begin))
    grams = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        grams = grams * _BASE + word[k : k + len(grams)]
    grams = mix(grams)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _BASE + w
            out.append(mix(np.array([h], np.uint64) ^ _M2))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(grams: np.ndarray) -> int:
    """The class of documents with this set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def required(size: int, percent: int = PERCENT) -> int:
    """What a linked set shares at least with one of this size."""
    return -(-percent * size // 100)


def shared(size: int) -> int:
    """How many n-grams of its prefix a set of this size has in common with a linked one's, if that asks for no fewer."""
    return min(required(size), 4 + size // 25)


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    return 100 * common >= percent * (a + b - common)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and sets, for about CHUNK_BYTES of text at once; a longer text comes alone."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if texts and size + len(data) > CHUNK_BYTES:
                yield ids, shingle_sets(texts)
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(data)
            size += len(data) + 1
    if texts:
        yield ids, shingle_sets(texts)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names.split())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch], local: int) -> Iterator[pa.RecordBatch]:
    """(0, doc, size, class) of every document, and (1, n-gram, local count, 0) of the n-grams that are frequent here."""
    held: list[np.ndarray] = []
    total = 0
    seen: set[int] = set()

    def frequent() -> Iterator[pa.RecordBatch]:
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= local
        n = int(often.sum())
        if n:
            yield _batch("kind a b c", np.ones(n, np.int64), _signed(grams[often]), counts[often], np.zeros(n, np.int64))

    for ids, sets in _chunks(batches):
        classes = [class_of(s) if len(s) else 0 for s in sets]
        yield _batch("kind a b c", np.zeros(len(ids), np.int64), ids, [len(s) for s in sets], classes)
        for c, s in zip(classes, sets, strict=True):
            if len(s) and c not in seen:
                seen.add(c)
                held.append(s)
                total += len(s)
        if len(seen) > REMEMBERED:
            seen.clear()
        if total > CHUNK_GRAMS:
            yield from frequent()
            held, total = [], 0
    if held:
        yield from frequent()


def _prefixes(frequent: np.ndarray, weight: np.ndarray, grades: np.ndarray, hot: int):
    """Emits (gram, class, size, often) of the prefix of every set that the task has not sent yet.

    N-grams that are not in the list of frequent ones come by the grades of their buckets, where there are any; the order
    depends on the n-gram alone, so it is common to all sets.

    often: 1 for the first STARS of the hot n-grams, 2 for their others, 0 for all else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _chunks(batches):
            grams, classes, sizes, often = [], [], [], []
            for s in sets:
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                n = len(s) - required(len(s)) + shared(len(s))
                rare, rest = s, np.empty(0, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    hit = frequent[at] == s
                    rare, rest = s[~hit], at[hit]
                if len(grades):
                    rare = rare[np.argsort(grades[rare & np.uint64(len(grades) - 1)], kind="stable")]
                rare = rare[:n]
                rest = rest[np.argsort(weight[rest], kind="stable")][: n - len(rare)]
                grams += [rare, frequent[rest]]
                many = weight[rest] >= hot
                often += [np.zeros(len(rare), np.int64), np.where(many, np.where(np.cumsum(many) <= STARS, 1, 2), 0)]
                classes.append(np.full(n, c, np.int64))
                sizes.append(np.full(n, len(s), np.int64))
            if len(seen) > REMEMBERED:
                seen.clear()
            if grams:
                yield _batch("gram class size often", _signed(np.concatenate(grams)), *map(np.concatenate, (classes, sizes, often)))

    return run


def _grades(below: DataFrame) -> np.ndarray:
    """A table of buckets of n-grams (a, n): eight times the logarithm of a bucket's sum of counts, 0 where there is none.

    It has eight buckets an n-gram and 2 ** MOST_BITS at most, so only so many rows of five bytes come to the driver.
    """
    total = below.count()
    if not total:
        return np.empty(0, np.uint8)
    table = np.zeros(1 << min(MOST_BITS, max(LEAST_BITS, (8 * total).bit_length())), np.uint8)
    bucket = F.col("a").bitwiseAND(F.lit(len(table) - 1)).cast("int").alias("bucket")
    # graded from -128, as a byte
    rows = below.groupBy(bucket).agg((F.least(F.floor(F.log2(F.sum("n")) * 8) + 1, F.lit(255)) - 128).cast("byte").alias("grade")).toArrow()
    table[rows.column(0).to_numpy()] = (rows.column(1).to_numpy().astype(np.int16) + 128).astype(np.uint8)
    return table


def _candidates(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by column: (a, b, n, need), the columns that a pair shares here and how many it must share in all.

    Of columns with too many rows only the pairs with their first row are given, as if they shared enough, and
    (gram, null, 0, 0).
    """
    gram, pivot, size, held, large = None, 0, 0, [], False
    out: dict[tuple[int, int | None], list[int]] = {}

    def count(a: int, b: int | None, n: int, need: int) -> None:
        own = out.get((a, b))
        if own is None:
            out[a, b] = [n, need]
        else:
            own[0] += n

    def pairs(own: list[tuple[int, int]]) -> None:
        own.sort(key=lambda r: (r[1], r[0]))
        for j, (b, nb) in enumerate(own):
            for i in range(j - 1, -1, -1):
                a, na = own[i]
                if 100 * na < PERCENT * nb:  # rows descend by size from here
                    break
                count(min(a, b), max(a, b), 1, shared(na))

    def star(c: int, n: int) -> None:
        if c != pivot and 100 * min(n, size) >= PERCENT * max(n, size):
            count(min(c, pivot), max(c, pivot), _ENOUGH, 1)

    for batch in batches:
        grams, classes, sizes = (c.to_numpy() for c in batch.columns)
        same = np.concatenate((grams[1:] == grams[:-1], [True])) if len(grams) else np.empty(0, bool)
        near = same | np.concatenate(([True], same[:-1])) if len(grams) else same  # rows that are alone in their column are skipped
        for k in np.flatnonzero(near).tolist():
            g, c, n = int(grams[k]), int(classes[k]), int(sizes[k])
            if g != gram:
                if len(held) > 1 and not large:
                    pairs(held)
                gram, pivot, size, held, large = g, c, n, [(c, n)], False
            elif large:
                star(c, n)
            elif (c, n) not in held:
                held.append((c, n))
                if len(held) > column:
                    large = True
                    count(g, None, 0, 0)
                    for row in held[1:]:
                        star(*row)
        if len(out) > 100_000:
            yield _counts_batch(out)
            out.clear()
    if len(held) > 1 and not large:
        pairs(held)
    if out:
        yield _counts_batch(out)


def _counts_batch(out: dict) -> pa.RecordBatch:
    a, b = zip(*out, strict=True)
    n, need = zip(*out.values(), strict=True)
    return _batch("a b n need", a, b, n, need)


def _shares(u: list[np.ndarray], cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows: the entries in the sorted columns ``cols``, by column, as (column, row), and how many each column has."""
    entries, of = np.concatenate(u), np.repeat(np.arange(len(u)), [len(x) for x in u])
    at = np.minimum(np.searchsorted(cols, entries), len(cols) - 1)
    here = np.flatnonzero(cols[at] == entries)
    order = here[np.argsort(at[here], kind="stable")]
    return at[order], of[order], np.bincount(at[order], minlength=len(cols))


def product(u: list[np.ndarray], v: list[np.ndarray], at_once: int = 1 << 19) -> np.ndarray:
    """Overlap counts of the rows of two blocks, accumulated over blocks of columns.

    Columns that many rows of both have are multiplied as dense blocks, the others entry by entry.
    """
    counts = np.zeros((len(u), len(v)), np.int64)
    cols = np.intersect1d(np.concatenate(u), np.concatenate(v)) if u and v else np.empty(0)
    if not len(cols):
        return counts
    (cu, ru, nu), (cv, rv, nv) = _shares(u, cols), _shares(v, cols)
    work = nu * nv
    dense = work * 256 > counts.size
    place = np.cumsum(dense) - 1
    width = max(1, at_once // (len(u) + len(v)))
    du, dv = dense[cu], dense[cv]
    for k in range(0, int(dense.sum()), width):
        sides = []
        for rows, c, r, d in ((u, cu, ru, du), (v, cv, rv, dv)):
            p = place[c[d]]
            own = (p >= k) & (p < k + width)
            side = np.zeros((len(rows), width), np.float32)
            side[r[d][own], p[own] - k] = 1
            sides.append(side)
        counts += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    # every entry of u meets the entries of v in its column
    cu, ru, first = cu[~du], ru[~du], np.cumsum(nv) - nv
    meets = nv[cu]
    ends = np.cumsum(meets)
    k = 0
    while k < len(cu):
        last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + at_once, "right")))
        n = meets[k:last]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat = np.repeat(ru[k:last], n) * len(v) + rv[np.repeat(first[cu[k:last]], n) + nth]
        counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        k = last
    return counts


def _joined(a: list[int], b: list[int], u: list[np.ndarray], v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) of the links between the rows u of classes a and v of classes b."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (u, v)]
    hits = linked(product(u, v), sizes[0][:, None], sizes[1][None, :])
    nodes, at = np.unique(np.array([*a, *b], np.int64), return_inverse=True)
    label = np.arange(len(nodes))
    ends = at[len(a) :]
    for k in np.flatnonzero(hits.any(1)).tolist():
        met = np.unique(np.append(label[ends[hits[k]]], label[at[k]]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (x, y, side, class, grams) sorted by the first three: links between the two sides of every pair of
    blocks (x, y), or within the side of a block that meets itself, which has no other."""
    held, sides = None, ([], [], [], [])

    def done() -> Iterator[pa.RecordBatch]:
        a, u, b, v = sides
        if u:
            yield _batch("a b", *(_joined(a, b, u, v) if v else _joined(a, a, u, u)))

    for batch in batches:
        x, y, side, own = (batch.column(k).to_pylist() for k in range(4))
        for k, grams in enumerate(batch.column(4)):
            if (x[k], y[k]) != held:
                yield from done()
                held, sides = (x[k], y[k]), ([], [], [], [])
            sides[2 * side[k]].append(own[k])
            sides[2 * side[k] + 1].append(np.frombuffer(grams.as_py(), np.uint64))
    yield from done()


def _blocks(nodes: DataFrame, rows: int, grams: int) -> DataFrame:
    """(class, block) of nodes (class, key, size): of about so many rows and n-grams, whole keys where they are small.

    A key of more is split by a hash of the class. Only two totals come to the driver.
    """
    cuts = lambda n, w: F.greatest(F.ceil(n / rows), F.ceil(w / grams), F.lit(1)).cast("long")
    total = nodes.agg(cuts(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).alias("n")).first().n
    keys = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).where((F.col("n") > rows // 4) | (F.col("w") > grams // 4))
    keys = keys.select("key", cuts(F.col("n"), F.col("w")).alias("parts"))
    split = F.xxhash64("key", F.pmod(F.xxhash64("class", F.lit(1)), "parts"))
    return nodes.join(keys, "key", "left").select("class", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(total))).otherwise(split).alias("block"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every component of a staged table of edges (a, b), for nodes that have an edge.

    Every round joins each node to the smallest neighbour of its neighbours, a star at a time, until all edges lead to
    roots; a round is one written table, and only counts come to the driver.
    """
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():  # an empty table, not worth deleting
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # the larger neighbours of every node go to the smallest node around it
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = stage(large, "large-star")
        # then the smaller neighbours, and the node itself, to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y"), F.col("b").alias("z"))
        small = small.select("x", F.explode(F.array("y", "z")).alias("b")).where("x <> b").select(F.col("x").alias("a"), "b").distinct()
        following = stage(small, "small-star")
        done = edges.count() == following.count() and edges.exceptAll(following).isEmpty()
        unstage(edges, large)
        if done:
            return following.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = following


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", column: int = COLUMN, hot: int = HOT, local: int = LOCAL, block: tuple[int, int] = (BLOCK_ROWS, BLOCK_GRAMS)) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class.

    Words are split at U+0020 and U+0009 to U+000D, A to Z are lower-cased. Null texts count as empty; a text without words
    has no shingles and is linked with nothing, not even with its like. Rows that repeat an id count as one document
    each, with the id they share. A row without an id has its n_shingles and no component, and links nothing. An empty
    table gives an empty result; other columns are not read, whatever their names. component_id is the smallest doc_id
    that links lead to, the own one included; ``class`` is the same for documents with equal sets. The last four
    parameters change how pairs are found, never which.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey = stage(texts.mapInArrow(trimmed(lambda batches: _survey(batches, local)), "kind long, a long, b long, c long"), "survey")
    rows = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.when((F.col("b") > 0) & F.col("a").isNotNull(), F.col("c")).alias("class"))
    texts = texts.where("doc_id is not null")

    # frequent n-grams, the most frequent last in every set's order; grades of counts give a bar that bounds their number
    often = stage(survey.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).withColumn("grade", F.floor(F.log2("n") * 64)), "local-counts")
    bar, total, below = None, 0, F.lit(False)
    for r in sorted(often.where(F.col("n") >= FREQUENT).groupBy("grade").count().collect(), reverse=True):
        if total + r["count"] > MOST_FREQUENT:
            below = F.col("grade") <= r.grade
            break
        bar, total = r.grade, total + r["count"]
    chosen = often.where((F.col("n") >= FREQUENT) & (F.col("grade") >= (F.lit(None) if bar is None else F.lit(bar)))).select("a", "n").toArrow()
    grams, weight = (chosen.column(k).to_numpy() for k in (0, 1))
    grades = _grades(often.where((F.col("n") >= FREQUENT) & below))
    unstage(often)
    order = np.argsort(grams.view(np.uint64))
    held = spark.sparkContext.broadcast((grams.view(np.uint64)[order], weight[order], grades))

    def prefixes(batches):
        yield from _prefixes(*held.value, hot)(batches)

    columns = stage(texts.mapInArrow(trimmed(prefixes), "gram long, class long, size long, often long"), "prefixes")
    # every column has its own order of rows, so that its first row is another one than its neighbour's
    draw = F.xxhash64("class", "gram")
    rare = columns.where("often = 0").select("gram", "class", "size")
    first = rare.repartition("gram").sortWithinPartitions("gram", draw).mapInArrow(trimmed(lambda batches: _candidates(batches, column)), "a long, b long, n long, need long")
    # a frequent column's rows meet its first row where they are; there are at most MOST_FREQUENT first rows
    common = columns.where("often > 0").select("gram", "class", "size", "often")
    pivots = common.groupBy("gram").agg(F.min(F.struct(draw.alias("draw"), "class", "size")).alias("p")).select("gram", "p.class", "p.size")
    allowed = lambda x, y: 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)
    second = common.where("often = 1").alias("c").join(pivots.alias("p"), "gram").where((F.col("c.class") != F.col("p.class")) & allowed(F.col("c.size"), F.col("p.size")))
    second = second.select(F.least("c.class", "p.class").alias("a"), F.greatest("c.class", "p.class").alias("b"), F.lit(_ENOUGH).alias("n"), F.lit(1).cast("long").alias("need"))
    found = first.unionByName(second).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    found = stage(found.where("n >= need").select("a", "b"), "candidates")
    large = found.where("b is null").select(F.col("a").alias("gram"))
    pairs = found.where("b is not null")
    # which columns these are, is told by a bounded list of buckets, so that the others need no shuffle
    bucket = F.pmod(F.xxhash64("gram"), F.lit(ID_BUCKETS)).alias("bucket")
    perhaps = rare.withColumn("bucket", bucket).join(F.broadcast(large.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    dense = stage(common.drop("often").unionByName(perhaps.join(large, "gram", "left_semi")).distinct(), "dense-columns")
    unstage(columns)

    # the rows of candidates, whole
    hashed = lambda c: F.xxhash64(c)
    met = pairs.select(F.col("a").alias("class"), F.least(hashed("a"), hashed("b")).alias("key")).unionByName(pairs.select(F.col("b").alias("class"), F.least(hashed("a"), hashed("b")).alias("key")))
    met = met.unionByName(dense.select("class", hashed("class").alias("key"))).groupBy("class").agg(F.min("key").alias("key"))
    reps = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.min("n_shingles").alias("size"))
    reps = stage(reps, "classes")
    wanted = stage(reps.join(met, "class").select("class", "key", "size", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).alias("bucket")), "wanted")
    buckets = wanted.select("bucket").distinct()  # ID_BUCKETS rows at most

    def whole(batches):
        for _, sets in _chunks(batches):
            own = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["class", "grams"])

    near = texts.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS))).join(F.broadcast(buckets), "bucket", "left_semi").join(wanted.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows
        near = near.dropDuplicates(["doc_id", "text"])
    matrix = stage(near.mapInArrow(trimmed(whole), "class long, grams binary"), "rows")

    def multiplied(sides: DataFrame, name: str) -> DataFrame:
        """Links of (x, y, side, class): rows of the sides of pairs of blocks."""
        groups = sides.join(matrix, "class").select("x", "y", "side", "class", "grams").repartition("x", "y").sortWithinPartitions("x", "y", "side")
        return stage(groups.mapInArrow(trimmed(_multiply), "a long, b long"), name)

    # the rows of a pair lie near each other: in blocks by the least neighbour
    placed = stage(_blocks(wanted, *block), "blocks")
    at = pairs.join(placed.withColumnsRenamed({"class": "a", "block": "x"}), "a").join(placed.withColumnsRenamed({"class": "b", "block": "y"}), "b")
    ends = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("class")), F.struct(F.lit(0).alias("side"), F.col("b").alias("class"))))
    ends = ends.otherwise(F.array(F.struct((F.col("x") > F.col("y")).cast("int").alias("side"), F.col("a").alias("class")), F.struct((F.col("x") < F.col("y")).cast("int").alias("side"), F.col("b").alias("class"))))
    sides = at.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.explode(ends).alias("e")).select("x", "y", "e.side", "e.class").distinct()
    edges = multiplied(sides, "links")
    unstage(found, wanted, placed)
    if not dense.isEmpty():
        roots = components(edges)
        own = dense.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        mixed = own.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
        own = stage(own.join(mixed, "gram", "left_semi"), "mixed-columns")
        main = own.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("gram").agg(F.max(F.struct("n", "root")).alias("m")).select("gram", F.col("m.root").alias("main"))
        others = stage(own.join(main, "gram").where("root <> main").select("gram", "class", "size"), "other-rows")
        # each side of the columns in blocks of its own, rows with the same first column near each other
        x, y = (t.join(_blocks(t.groupBy("class").agg(F.min(F.xxhash64("gram")).alias("key"), F.first("size").alias("size")), *block), "class") for t in (others, own))
        x, y = stage(x, "left-blocks"), stage(y, "right-blocks")
        # a row goes to every block that has one of its columns on the other side
        there = lambda t: t.groupBy("gram").agg(F.sort_array(F.collect_set("block")).alias("there"))
        meets = lambda t, other: t.join(there(other), "gram").groupBy("class", "block").agg(F.explode(F.array_distinct(F.flatten(F.collect_set("there")))).alias("other"))
        sides = meets(x, y).select(F.col("block").alias("x"), F.col("other").alias("y"), F.lit(0).alias("side"), "class")
        sides = sides.unionByName(meets(y, x).select(F.col("other").alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "class"))
        edges = edges.unionByName(multiplied(sides, "cross-links"))
        unstage(own, others, x, y)
    unstage(dense, matrix)
    roots = components(edges)

    # components of documents, for classes that have a link or a copy
    named = reps.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = stage(named.select("class", "doc_id", "n_docs", "root"), "class-roots")
    unstage(reps)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_classes"), F.max("n_docs").alias("most")).where("n_classes > 1 or most > 1")
    ids = stage(named.join(least.select("root", "component_id"), "root").select("class", "component_id"), "component-ids")
    unstage(named)
    return rows.join(ids, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whatever their names, of one document of each component: that with the
    smallest id.

    Texts that are null or have no words are linked with nothing and stay, as do rows without an id; rows that repeat an
    id stay or go together. An empty table stays empty.
    """
    gone = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select("doc_id")
    return without_ids(docs, id_col, gone)
