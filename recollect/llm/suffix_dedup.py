"""Removal of repeated byte strings by a distributed merge sort of suffixes that keeps track of common prefixes.

Every string of LENGTH bytes holds an anchor: the leftmost of its k-grams with the smallest hash, so equal strings have
their anchor at the same place. Only suffixes that begin at anchors are sorted, and of these only the ones whose
k-gram occurs more than once, which a first exchange of k-gram hashes finds out (tasks send each hash once).

Tasks sort their suffixes, cut to LENGTH bytes, and front-code the sorted runs: each suffix is the length of its
common prefix with the one before, and the rest. Suffixes that agree over the whole context of an anchor are settled
within the run, and only the earliest travels. Runs of a bucket are merged by a loser tree that keeps, for every
loser, its common prefix with the winner that beat it; the longer prefix wins unseen, and on equal ones comparison
starts behind them, so that no byte known to be equal is compared again. The merge yields the common prefixes of
neighbours. With the bytes before the anchors, these tell for every offset which anchors begin equal strings; all but
the earliest of them are covered.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import mix
from .staging import ship, trimmed

LENGTH, GRAM = 100, 32
#: K-grams of a string, and so the bytes that can lie before its anchor, plus one.
REACH = LENGTH - GRAM + 1
#: Anchors that a task sorts together, and k-gram hashes that it sends together.
RUN, HASHES = 150_000, 1_500_000
_BITS = 17
_PLACE = np.uint64((1 << _BITS) - 1)
_STEP = (1 << _BITS) - 2 * LENGTH


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        both = (np.uint64(b) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        _powers[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in both]
    return _powers[0], _powers[1]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text's anchors and their k-grams' hashes; a text of fewer than LENGTH bytes has none."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    found, hashes = [], []
    for begin in range(0, len(data) - LENGTH + 1, _STEP):
        part = gram_hashes(data[begin : begin + _STEP + LENGTH - 1])
        key = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)  # of equal hashes the leftmost is least
        size = 1
        while 2 * size <= REACH:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < REACH:
            key = np.minimum(key[: size - REACH], key[REACH - size :])
        place = (key & _PLACE).astype(np.int64)  # never goes back
        place = place[np.concatenate(([True], place[1:] != place[:-1]))]
        found.append(place + begin)
        hashes.append(part[place])
    positions, hashes = np.concatenate(found), np.concatenate(hashes)
    own = np.concatenate(([True], positions[1:] > np.maximum.accumulate(positions)[:-1]))
    return positions[own], hashes[own]


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of numbers, bytes of one weight together."""
    out = [struct.pack("<q", len(columns[0]))]
    for c in columns:
        out.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes())
    return b"".join(out)


def _numbers(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<q", data)[0], 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


_ROWS = "key long, kind int, doc_id long, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    key, kind, doc, data = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())], names=["key", "kind", "doc_id", "data"])


def _by_doc(docs: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of kind 1: for each document, its values."""
    if not len(docs):
        return []
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return [(int(docs[a]) % buckets, 1, int(docs[a]), values[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(docs)], strict=True)]


def _hash_rows(buckets: int):
    """Kind 0: a task's k-gram hashes of a bucket, each once; kind 1: positions that the task itself finds repeated."""

    def flush(hashes: list, docs: list, places: list) -> Iterator[pa.RecordBatch]:
        h, d, p = map(np.concatenate, (hashes, docs, places))
        order = np.argsort(h, kind="stable")
        h, d, p = h[order], d[order], p[order]
        first = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
        single = first & np.concatenate((first[1:], np.ones(min(1, len(h)), bool)))
        yield _rows(_by_doc(d[~single], p[~single], buckets))
        h, d, p = h[first], np.where(single[first], d[first], -1), np.where(single[first], p[first], 0)
        place = (h >> np.uint64(40)).astype(np.int64) * buckets >> 24
        cuts = np.searchsorted(place, np.arange(buckets + 1))
        known = single[first]
        for b in range(buckets):
            s = slice(cuts[b], cuts[b + 1])
            if cuts[b] < cuts[b + 1]:
                own = h[s]
                yield _rows([(b, 0, None, _planes(np.diff(own, prepend=np.uint64(0)), known[s].astype(np.uint8)) + _planes(d[s][known[s]], p[s][known[s]]))])

    def run(batches):
        hashes, docs, places, total = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid and doc is not None:
                    at, h = anchors(np.frombuffer(text.as_buffer(), np.uint8))
                    if len(at):
                        hashes.append(h)
                        docs.append(np.full(len(at), doc, np.int64))
                        places.append(at.astype(np.int64))
                        total += len(at)
                        if total >= HASHES:
                            yield from flush(hashes, docs, places)
                            hashes, docs, places, total = [], [], [], 0
        if total:
            yield from flush(hashes, docs, places)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[tuple[int, bytes]]]]:
    """(bucket, blobs of kind 0, documents' rows of kind 1), from rows that are sorted by bucket."""
    key, blobs, docs = None, [], []
    for batch in batches:
        for k in range(batch.num_rows):
            bucket, kind, doc, data = (c[k].as_py() for c in batch.columns)
            if bucket != key:
                if key is not None:
                    yield key, blobs, docs
                key, blobs, docs = bucket, [], []
            if kind:
                docs.append((doc, data))
            else:
                blobs.append(data)
    if key is not None:
        yield key, blobs, docs


_MARKS = "doc_id long, data binary"


def _marks(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 2000):
        doc, data = zip(*rows[k : k + 2000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "data"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, positions) of the anchors whose k-gram is there more than once."""
    for _, blobs, docs in _groups(batches):
        yield from _marks(docs)
        if len(blobs) < 2:
            continue
        hashes, ids, places = [], [], []
        for blob in blobs:
            delta, known = _numbers(blob, "u8", "u1")
            d, p = _numbers(blob[8 + 9 * len(delta) :], "i8", "i8")
            known = known.astype(bool)
            own_d, own_p = np.full(len(delta), -1, np.int64), np.zeros(len(delta), np.int64)
            own_d[known], own_p[known] = d, p
            hashes.append(np.cumsum(delta, dtype=np.uint64))
            ids.append(own_d)
            places.append(own_p)
        h, d, p = map(np.concatenate, (hashes, ids, places))
        order = np.argsort(h, kind="stable")
        h, d, p = h[order], d[order], p[order]
        same = h[1:] == h[:-1]
        twice = (np.concatenate((same, [False])) | np.concatenate(([False], same))) & (d >= 0)
        yield from _marks([(doc, data) for _, _, doc, data in _by_doc(d[twice], p[twice], 1)])


class Run:
    """A sorted run of suffixes with what lies before their anchors."""

    KINDS = ("u1", "u1", "u1", "i8", "i8")

    def __init__(self, right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray, doc: np.ndarray, pos: np.ndarray):
        self.right, self.right_len, self.left, self.left_len, self.doc, self.pos = right, right_len, left, left_len, doc, pos

    def take(self, rows: np.ndarray) -> Run:
        return Run(*(x[rows] for x in (self.right, self.right_len, self.left, self.left_len, self.doc, self.pos)))

    def common(self) -> np.ndarray:
        """Common prefix of each suffix with the one before; 0 for the first."""
        out = np.zeros(len(self.right), np.int64)
        if len(out) > 1:
            differs = self.right[1:] != self.right[:-1]
            first = np.where(differs.any(1), differs.argmax(1), LENGTH)
            out[1:] = np.minimum(first, np.minimum(self.right_len[1:], self.right_len[:-1]))
        return out

    def packed(self) -> bytes:
        """Front-coded: common prefix lengths, and the bytes behind them."""
        lcp = self.common()
        column = np.arange(LENGTH)
        rest = self.right[(column >= lcp[:, None]) & (column < self.right_len[:, None])]
        before = self.left[np.arange(REACH - 1) < self.left_len[:, None]]
        head = _planes(lcp.astype("u1"), self.right_len.astype("u1"), self.left_len.astype("u1"), self.doc, self.pos)
        return zlib.compress(struct.pack("<qq", len(head), len(rest)) + head + rest.tobytes() + before.tobytes(), 1)

    @classmethod
    def unpacked(cls, blob: bytes) -> tuple[Run, np.ndarray]:
        data = zlib.decompress(blob)
        size, n_rest = struct.unpack_from("<qq", data)
        lcp, right_len, left_len, doc, pos = _numbers(data[16 : 16 + size], *cls.KINDS)
        rest = np.frombuffer(data, np.uint8, n_rest, 16 + size)
        before = np.frombuffer(data, np.uint8, -1, 16 + size + n_rest)
        n = len(lcp)
        right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, REACH - 1), np.uint8)
        column = np.arange(LENGTH)
        own = (column >= lcp[:, None]) & (column < right_len[:, None])
        right[own] = rest
        # bytes within the common prefix come from the nearest row above that has its own there
        source = np.where(own | (column >= right_len[:, None]), np.arange(n)[:, None], -1)
        source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), 0)
        inside = column < right_len[:, None]
        right = np.where(inside, right[source, column], 0).astype(np.uint8)
        left[np.arange(REACH - 1) < left_len[:, None]] = before
        return cls(right, right_len.astype(np.int64), left, left_len.astype(np.int64), doc, pos), lcp.astype(np.int64)


def sort_run(run: Run) -> Run:
    """By suffix, shorter first, then by document and position."""
    words = np.zeros((len(run.right), 104), np.uint8)
    words[:, :LENGTH] = run.right
    words = words.view(">u8").astype(np.uint64)
    return run.take(np.lexsort((run.pos, run.doc, run.right_len, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))))


def settle(run: Run) -> tuple[Run, np.ndarray, np.ndarray]:
    """Of rows of a sorted run that agree over the whole context, keep the earliest; (documents, intervals) of the others."""
    if not len(run.doc):
        return run, np.empty(0, np.int64), np.empty((0, 2), np.int64)
    words = np.zeros((len(run.left), 72), np.uint8)
    words[:, : REACH - 1] = run.left
    words = words.view(np.uint64)
    lcp = run.common()
    suffix = np.cumsum((lcp < run.right_len) | np.concatenate(([True], run.right_len[1:] != run.right_len[:-1])))
    order = np.lexsort((run.pos, run.doc, run.left_len, *words.T, suffix))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (suffix[a] == suffix[b]) & (run.left_len[a] == run.left_len[b]) & (words[a] == words[b]).all(1)
    place = np.arange(len(order))
    head = order[np.maximum.accumulate(np.where(same, 0, place))]
    again = same & ((run.doc[order] != run.doc[head]) | (run.pos[order] != run.pos[head]))
    gone = order[again & (run.left_len[order] + run.right_len[order] >= LENGTH)]
    least = np.maximum(0, LENGTH - run.right_len[gone])
    spans = np.stack((run.pos[gone] - run.left_len[gone], run.pos[gone] - least + LENGTH), 1)
    return run.take(np.sort(order[~same])), run.doc[gone], spans


def _run_rows(buckets: int):
    """Kind 0: front-coded runs of a bucket; kind 1: intervals that the task itself settles."""

    def flush(held: list[Run]) -> Iterator[pa.RecordBatch]:
        whole = Run(*(np.concatenate([getattr(r, n) for r in held]) for n in ("right", "right_len", "left", "left_len", "doc", "pos")))
        whole, docs, spans = settle(sort_run(whole))
        yield _rows(_by_doc(docs, spans, buckets))
        whole = whole.take(np.flatnonzero(whole.left_len + whole.right_len >= LENGTH))
        gram = mix(np.ascontiguousarray(whole.right[:, :GRAM]).view(np.uint64))
        gram = mix((gram * np.array([3, 5, 7, 9], np.uint64)).sum(1, dtype=np.uint64))
        bucket = ((gram >> np.uint64(40)).astype(np.int64) * buckets) >> 24
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                yield _rows([(b, 0, None, whole.take(order[cuts[b] : cuts[b + 1]]).packed())])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                if not batch.column(2)[k].is_valid:
                    continue
                doc = batch.column(0)[k].as_py()
                data = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint8)
                marks = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)[k].values]))
                marks = marks[marks + GRAM <= len(data)]
                padded = np.concatenate((np.zeros(REACH - 1, np.uint8), data, np.zeros(LENGTH, np.uint8)))
                for s in range(0, len(marks), RUN):
                    own = marks[s : s + RUN]
                    around = padded[own[:, None] + np.arange(REACH - 1 + LENGTH)]
                    held.append(Run(around[:, REACH - 1 :], np.minimum(LENGTH, len(data) - own), around[:, REACH - 2 :: -1], np.minimum(REACH - 1, own), np.full(len(own), doc, np.int64), own))
                    total += len(own)
                    if total >= RUN:
                        yield from flush(held)
                        held, total = [], 0
        if total:
            yield from flush(held)

    return run


def merge(runs: list[list[bytes]], lcps: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the one before) of all suffixes in order.

    A tree of losers: a node keeps the stream that lost there and its common prefix with the winner. All prefixes on
    the path of the last output refer to it, so streams whose prefixes differ are decided without a look.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    at = [0] * k

    def meet(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix."""
        x, y = head[a], head[b]
        if y is None:
            return a, ha, b, 0
        if x is None:
            return b, hb, a, 0
        if ha != hb:
            return (a, ha, b, hb) if ha > hb else (b, hb, a, ha)
        p, q = x[ha:], y[ha:]
        if p == q:
            return (a, ha, b, len(x)) if a < b else (b, ha, a, len(x))
        n = min(len(p), len(q))
        u, v = p[:n], q[:n]
        common = ha + n if u == v else ha + n - (((int.from_bytes(u, "big") ^ int.from_bytes(v, "big")).bit_length() + 7) >> 3)
        return (a, ha, b, common) if p < q else (b, ha, a, common)

    loser, prefix = [0] * k, [0] * k
    level = [(s, 0) for s in range(k)]
    width = k
    while width > 1:
        width //= 2
        following = []
        for n in range(width):
            w, hw, lo, hl = meet(*level[2 * n], *level[2 * n + 1])
            loser[width + n], prefix[width + n] = lo, hl
            following.append((w, hw))
        level = following
    winner, common = level[0]
    while head[winner] is not None:
        index = at[winner]
        yield winner, index, common
        index += 1
        at[winner] = index
        own = runs[winner]
        if index < len(own):
            head[winner], common = own[index], lcps[winner][index]
        else:
            head[winner], common = None, 0
        node = (k + winner) >> 1
        while node:
            lo = loser[node]
            x, y = head[winner], head[lo]
            if y is not None:
                if x is None or prefix[node] > common:
                    loser[node], prefix[node], winner, common = winner, common, lo, prefix[node]
                elif prefix[node] == common:
                    winner, common, loser[node], prefix[node] = meet(winner, common, lo, common)
            node >>= 1


def covered(run: Run, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, intervals) of the anchors of a merged bucket that begin, at some offset, a string that an earlier one begins."""
    n = len(run.doc)
    order = np.lexsort((run.pos, run.doc))
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], (run.doc[order][1:] != run.doc[order][:-1]) | (run.pos[order][1:] != run.pos[order][:-1])))
    rank[order] = np.cumsum(new)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    live = np.arange(n)
    before = np.cumsum(lcp < GRAM)  # classes of equal bytes before the anchor, within equal k-grams
    for offset in range(REACH):
        if offset:
            inside = run.left_len[live] >= offset
            live = live[inside]
            key = before[inside] * 256 + run.left[live, offset - 1]
            _, before = np.unique(key, return_inverse=True)
        several = np.bincount(before, minlength=1)[before] > 1 if len(live) else np.empty(0, bool)
        live, before = live[several], before[several]
        if not len(live):
            break
        suffix = np.cumsum(lcp < LENGTH - offset)[live]
        fits = run.right_len[live] >= LENGTH - offset
        own = live[fits]
        if not len(own):
            continue
        _, group = np.unique(suffix[fits] * (int(before.max()) + 1) + before[fits], return_inverse=True)
        first = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, group, rank[own])
        hit = own[rank[own] > first[group]]
        least[hit] = np.where(least[hit] < 0, offset, least[hit])
        most[hit] = offset
    rows = np.flatnonzero(most >= 0)
    return run.doc[rows], np.stack((run.pos[rows] - most[rows], run.pos[rows] - least[rows] + LENGTH), 1)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, intervals) of what the runs of each bucket show to be repeated."""
    for _, blobs, docs in _groups(batches):
        yield from _marks(docs)
        if not blobs:
            continue
        runs, lcps = zip(*map(Run.unpacked, blobs), strict=True)
        suffixes = []
        for r in runs:
            flat, sizes = r.right.tobytes(), r.right_len.tolist()
            suffixes.append([flat[LENGTH * i : LENGTH * i + s] for i, s in enumerate(sizes)])
        begins = np.cumsum([0, *map(len, suffixes)])
        places = [(int(begins[r]) + i, common) for r, i, common in merge(suffixes, [x.tolist() for x in lcps])]
        order, lcp = map(np.array, zip(*places, strict=True))
        whole = Run(*(np.concatenate([getattr(r, n) for r in runs]) for n in ("right", "right_len", "left", "left_len", "doc", "pos"))).take(order)
        ids, spans = covered(whole, lcp)
        yield from _marks([(doc, data) for _, _, doc, data in _by_doc(ids, spans, 1)])


def union_of(spans: np.ndarray) -> np.ndarray:
    """Maximal intervals covered by intervals; those that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    starts = np.flatnonzero(first)
    return np.stack((spans[starts, 0], reach[np.append(starts[1:] - 1, len(spans) - 1)]), 1)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, data): per row some intervals, as pairs of longs, of bytes of (doc_id, text) to remove."""
    spark = texts.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(buckets, "key").sortWithinPartitions("key")
    marks = dealt(texts.mapInArrow(trimmed(_hash_rows(buckets)), _ROWS)).mapInArrow(trimmed(_repeated), _MARKS)
    marks = marks.groupBy("doc_id").agg(F.collect_list("data").alias("marks"))
    # an outer join here and in suffix_dedup, so that both read one shuffle of the texts
    around = texts.join(marks, "doc_id", "left").select("doc_id", "text", "marks")
    return dealt(around.mapInArrow(trimmed(_run_rows(buckets)), _ROWS)).mapInArrow(trimmed(_merged), _MARKS)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, and kept, the remaining bytes, if wanted.

    Texts count as UTF-8; null as empty. Every byte is removed that lies in a string of LENGTH bytes which also begins
    earlier: in a document with a smaller id, or before in the same one. Strings never cross documents. Rows that
    repeat an id and its text are one document, and each gets its result. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(texts).groupBy("doc_id").agg(F.collect_list("data").alias("spans"))

    def cut(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                doc, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_buffer().to_pybytes()
                own = batch.column(2)[k]
                found = union_of(np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in own.values])) if own.is_valid else np.empty((0, 2), np.int64)
                kept, at = [], 0
                for a, b in found.tolist():
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), found.ravel().tolist(), kept if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    joined = texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
    return out if with_text else out.drop("kept")
