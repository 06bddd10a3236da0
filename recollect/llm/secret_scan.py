"""Secrets in texts: fixed patterns, and tokens that look random to a pair of character Markov models.

One model is trained on random strings, the other on ordinary identifiers, both from labelled samples. A token
is taken for a secret when the log-likelihood ratio of the two, per character, is above a threshold that the
samples' held-out part sets between the two kinds.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Span, in_order, joined, sha256
from .staging import ship, trimmed

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens that the models judge, and their least length: shorter ones are too short for a ratio to tell.
SHORTEST = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SAMPLES, SEED = 4000, 20240501

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans: leftmost, without overlaps within a kind; a match that fails its test is dropped."""
    out: list[Span] = []
    if "=" in text or ":" in text:  # an assignment has one of the two
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def labelled_samples(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, bool]]:
    """Tokens, each with whether it is a random string."""
    draw = random.Random(seed)
    syllables = "the and ing ion ent for ver ter con pro dis ment able sch ung keit lich heit ein aux eau que ouv ción mente ado qué ar ie da to in er on".replace("ó", "o").replace("é", "e").split()
    nouns = "get set user name file path list item value index count page node tree data load save read write config server client request response handler factory manager table column row query batch event stream first last next".split()
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    out: list[tuple[str, bool]] = []
    for _ in range(n):
        size = draw.randint(20, 64)
        chars = draw.choice((ALPHABET[:62], ALPHABET[:64], ALPHABET[:52] + ALPHABET[52:62] + "_-", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62]))
        out.append(("".join(draw.choice(chars) for _ in range(size)), True))
    while len(out) < 2 * n:
        kind = draw.randrange(8)
        pick = [draw.choice(nouns) if draw.random() < 0.5 else word() for _ in range(draw.randint(3, 8))]
        if kind == 0:
            t = "_".join(pick)
        elif kind == 1:
            t = pick[0] + "".join(p.capitalize() for p in pick[1:])
        elif kind == 2:
            t = "/".join(pick) + draw.choice(("", f"/{draw.randint(1, 3000)}"))
        elif kind == 3:
            t = "-".join(pick) + draw.choice(("", f"-{draw.randint(1, 2030)}"))
        elif kind == 4:
            t = "".join(word() for _ in range(6))
        elif kind == 5:
            t = "_".join(p.upper() for p in pick) + draw.choice(("", f"_{draw.randint(1, 64)}"))
        elif kind == 6:
            t = (draw.choice("-=_+") if draw.random() < 0.3 else draw.choice((word(), draw.choice(nouns)))) * draw.randint(5, 30)
        else:
            t = "".join(str(draw.randint(0, 9)) for _ in range(draw.randint(20, 30)))
        if len(t) >= 20:
            out.append((t[:120], False))
    return out


class RandomnessModel:
    """Two first-order Markov models over ``ALPHABET`` and the threshold between their samples."""

    def __init__(self, samples: list[tuple[str, bool]]):
        self.code = np.full(128, len(ALPHABET), np.int64)
        self.code[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
        size = len(ALPHABET) + 1
        counts = {True: np.full((size, size), 0.5), False: np.full((size, size), 0.5)}
        fit, held = samples[::2] + samples[1::4], samples[3::4]
        for token, is_random in fit:
            x = self.codes(token)
            np.add.at(counts[is_random], (x[:-1], x[1:]), 1.0)
        log = {k: np.log(c / c.sum(1, keepdims=True)) for k, c in counts.items()}
        self.ratio = log[True] - log[False]
        scores = {k: sorted(self.score(t) for t, is_random in held if is_random == k) for k in (True, False)}
        low, high = scores[False][int(0.999 * len(scores[False]))], scores[True][int(0.01 * len(scores[True]))]
        #: Between all but a thousandth of the ordinary tokens and all but a hundredth of the random ones.
        self.threshold = max(0.0, (low + high) / 2)

    def codes(self, token: str) -> np.ndarray:
        return self.code[np.frombuffer(token.encode("ascii"), np.uint8)]

    def score(self, token: str) -> float:
        x = self.codes(token)
        return float(self.ratio[x[:-1], x[1:]].mean()) if len(x) > 1 else 0.0

    def is_random(self, token: str) -> bool:
        return self.score(token) > self.threshold


@lru_cache(maxsize=1)
def model() -> RandomnessModel:
    """Fitted once per process from the same samples, so alike everywhere."""
    return RandomnessModel(labelled_samples())


def _apart(spans: list[Span], a: int, b: int, at: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of a to b that no span touches, of spans by start from place ``at`` on; and the place for later ones."""
    out = []
    while at < len(spans) and spans[at][2] <= a:
        at += 1
    k = at
    while k < len(spans) and spans[k][1] < b:
        if spans[k][1] > a:
            out.append((a, spans[k][1]))
        a = max(a, spans[k][2])
        k += 1
    if a < b:
        out.append((a, b))
    return out, at


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans of a text, in one sweep; the models judge what base spans leave of tokens."""
    base = in_order(base_spans(text), KINDS)
    more: list[Span] = []
    judge, at = model(), 0
    # of spans that hold others the inner ones say nothing
    outer = [s for k, s in enumerate(base) if not k or s[2] > max_end[k - 1]] if (max_end := list(accumulate((s[2] for s in base), max))) else []
    for m in TOKEN.finditer(text):
        parts, at = _apart(outer, *m.span(), at)
        more += [("random", a, b) for a, b in parts if b - a >= SHORTEST and judge.is_random(text[a:b])]
    return base, in_order(base + more, KINDS) if more else base


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Positions are code points, ends exclusive; spans go by start, then kind. Null texts count as empty and have no
    spans. Rows are independent: repeated rows repeat their result, null ids stay, an empty table gives an empty one, and
    other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, every = find_secrets(text.as_py() or "")
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((doc, *counts, sha256(joined(base)), joined(every), len(every) - len(base)))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(trimmed(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


MASK = "[secret]"


def masked(text: str) -> str:
    """The text with every secret's span replaced by ``MASK``; overlapping spans are masked as one."""
    out, at, last = [], 0, -1
    for _, a, b in sorted(find_secrets(text)[1], key=lambda s: s[1:]):
        if a >= last:
            out += [text[at:a], MASK]
        at = last = max(last, b)
    return "".join(out) + text[at:] if out else text


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text_col`` masked. Its length in n_chars, if there, follows.

    A null or empty text stays as it is; every row, repeated or without an id, is masked by itself; an empty table stays
    empty. Other columns, whatever their names, are passed on.
    """
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else masked(t) for t in (x.as_py() for x in batch.column(place))]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    done = docs.mapInArrow(trimmed(run), docs.schema)
    return done.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
