"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages. Every passage of it is encoded from its bytes; a gated attention, learned from labels
of whole documents only, weighs the passages; the weighted mean of their encodings is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ship, trimmed

#: Bytes of a passage; texts are cut into passages that cover them wholly.
PASSAGE = 512
#: Buckets of a passage's byte pairs, sizes of the encoding and of the attention.
PAIRS, HIDDEN, GATE = 512, 32, 16
FEATURES = 256 + PAIRS + 2
#: The training sample: labelled documents of each class at most, and bytes of all their texts at most. Every passage of
#: every document of it is used.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1500, 200_000_000
THRESHOLD = 0.3
_SLAB = 2048  # passages that are encoded at once


def features(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of passages that lie in ``data`` one after another: square roots of the shares of bytes and byte
    pairs, how many different pairs there are, and how full the passage is."""
    n = len(lengths)
    own = np.repeat(np.arange(n, dtype=np.int64), lengths)
    single = np.bincount(own * 256 + data, minlength=n * 256).reshape(n, 256)
    pair = data.astype(np.int64)
    pair = ((pair[:-1] * 40503 + pair[1:] * 2654435) >> 4) & (PAIRS - 1)
    inside = own[:-1] == own[1:]
    double = np.bincount((own[:-1] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    size = np.maximum(lengths, 1).astype(np.float32)[:, None]
    out = np.empty((n, FEATURES), np.float32)
    out[:, :256] = np.sqrt(single / size)
    out[:, 256:-2] = np.sqrt(double / size)
    out[:, -2:-1] = np.sqrt((double > 0).sum(1, keepdims=True) / size)
    out[:, -1:] = size / PASSAGE
    return out


def passage_lengths(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the passages of texts of so many bytes, and passages per text; an empty text has an empty one."""
    counts = np.maximum(1, -(-sizes // PASSAGE))
    lengths = np.full(int(counts.sum()), PASSAGE, np.int64)
    last = np.cumsum(counts) - 1
    lengths[last] = sizes - (counts - 1) * PASSAGE
    return lengths, counts


def feature_slabs(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Features of all passages of whole texts, _SLAB passages at a time."""
    lengths, _ = passage_lengths(np.array([len(t) for t in texts], np.int64))
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lengths)
    for k in range(0, len(lengths), _SLAB):
        last = min(k + _SLAB, len(lengths))
        yield features(data[ends[k] - lengths[k] : ends[last - 1]], lengths[k:last])


class AttentionModel:
    """Passage encoder, gated attention and scorer, with their gradients."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        g = lambda *s: (draw.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": g(FEATURES, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"] + self.p["b"])

    def attention(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of the gated attention, with the two factors that make them."""
        t, s = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        return (t * s) @ self.p["w"], t, s

    def pooled(self, h: np.ndarray, counts: np.ndarray):
        """Attention weights of the passages, and each bag's weighted mean; counts: passages of each bag."""
        begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
        logits, t, s = self.attention(h)
        weight = np.exp(logits - np.repeat(np.maximum.reduceat(logits, begins), counts))
        weight /= np.repeat(np.add.reduceat(weight, begins), counts)
        return weight, np.add.reduceat(weight[:, None] * h, begins), t, s, begins

    def score(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _sigmoid((self.pooled(h, counts)[1] @ self.p["c"] + self.p["d"][0]).astype(np.float64))

    def gradients(self, slabs: Callable[[], Iterable[np.ndarray]], counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss over whole bags; slabs: gives the features of all their passages, some at a time."""
        p = self.p
        h = np.concatenate([self.encode(x) for x in slabs()])
        weight, z, t, s, begins = self.pooled(h, counts)
        out = _sigmoid(z @ p["c"] + p["d"][0])
        do = (out - labels).astype(np.float32) / len(labels)
        dz = np.repeat(do[:, None] * p["c"], counts, 0)
        dweight = (dz * h).sum(1)
        dlogit = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, begins), counts))
        dts = dlogit[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (weight[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        dw, at = np.zeros_like(p["W"]), 0
        for x in slabs():
            dw += x.T @ dh[at : at + len(x)]
            at += len(x)
        return {"W": dw, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dlogit, "c": z.T @ do, "d": do.sum(keepdims=True)}

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 96, rate: float = 0.004, decay: float = 1e-4, seed: int = 11) -> AttentionModel:
        """Adam on batches of whole texts, as many of either class."""
        draw = np.random.default_rng(seed)
        of = [np.flatnonzero(labels == k) for k in (0, 1)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            bags = np.concatenate([draw.choice(o, batch // 2) for o in of])
            own = [texts[b] for b in bags]
            counts = passage_lengths(np.array([len(t) for t in own], np.int64))[1]
            few = list(feature_slabs(own)) if counts.sum() <= 4 * _SLAB else None  # made once where that is little
            for k, g in self.gradients((lambda few=few: few) if few else (lambda own=own: feature_slabs(own)), counts, labels[bags]).items():
                g = g + decay * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                pace = rate * min(1.0, 2 * (1 - step / steps) + 0.05)
                self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def score_texts(model: AttentionModel | float, texts: list[bytes]) -> np.ndarray:
    """Scores of whole texts. In place of a model, a number is everyone's score."""
    if isinstance(model, float):
        return np.full(len(texts), model)
    counts = passage_lengths(np.array([len(t) for t in texts], np.int64))[1]
    return model.score(np.concatenate([model.encode(x) for x in feature_slabs(texts)]), counts)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> AttentionModel | float:
    """Fit on whole texts of at most ``per_class`` labelled documents of each class, chosen by a hash of their ids among
    those that are not held out; a document that would bring the texts beyond ``most_bytes`` is left out.

    Null texts count as empty. Rows that repeat an id give a text each. Labels without an id or other than 0 and 1 are
    passed over; of several for an id the least counts. Without rows of both classes it gives the one class seen, or
    0.5, as everyone's score.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    wanted = {r.doc_id: r.label for p in picked for r in p.collect()}
    if not wanted:
        return 0.5
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    of = lambda ids: texts.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")
    sizes = of(sorted(wanted)).groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"), F.xxhash64("doc_id").alias("place")).collect()
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        if total + r.n <= most_bytes:
            chosen.append(r.doc_id)
            total += r.n
    if not chosen:
        return 0.5
    rows = sorted(((r.doc_id, r.text.encode("utf-8", "surrogatepass")) for r in of(sorted(chosen)).collect()))
    marks = np.array([wanted[i] for i, _ in rows], np.float32)
    if marks.min() == marks.max():
        return float(marks[0])
    return AttentionModel().fit([t for _, t in rows], marks)


def score_quality(docs: DataFrame, model: AttentionModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Every passage of every whole text is scored. Null texts count as empty, and an empty text is one empty passage.
    Rows are independent, so repeated ones repeat their result; an empty table gives an empty one. A null id stays, with
    null as held_out. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = np.concatenate([*scored(batch.column(1), held.value), np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(trimmed(run), "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def scored(texts: pa.Array, model: AttentionModel | float, most: int = 2_000_000) -> Iterator[np.ndarray]:
    """Scores of a column of texts, computed for about ``most`` bytes at once."""
    held, size = [], 0
    for t in texts:
        data = (t.as_py() or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > most:
            yield score_texts(model, held)
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield score_texts(model, held)


def keep_good(docs: DataFrame, model: AttentionModel | float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns, whatever their names.

    Null texts count as empty; equal texts share their fate, rows without an id are judged like others, and an empty
    table stays empty.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = np.concatenate([*scored(batch.column(place), held.value), np.empty(0)])
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(trimmed(run), docs.schema)
