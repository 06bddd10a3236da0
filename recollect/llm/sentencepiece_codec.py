"""Exact encoding and decoding for merge-type SentencePiece models.

Encoding is by backtracking instead of a merge queue. From a position, the longest piece that starts there
(Aho-Corasick) is tried first. It may follow the piece before it only if merging their text afresh would leave
the border between the two alone; ``compatible`` decides this by undoing the two pieces' merges from the latest
to the earliest and looking for a merge across the border that would have come first. When nothing fits, the
position is marked in a bitfield and the previous piece gives way to the next shorter one. A sequence whose
neighbours are all compatible is the one the merges give, so the first that reaches the end is the answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ship

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Encoded words that a worker keeps in each of two generations, and compatible pairs.
CACHE_WORDS, CACHE_PAIRS = 300_000, 1_000_000
_FAR = 1 << 60


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type model")
        if normaliser.get(1, b"") != b"identity" or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or trainer.get(24, 0):
            raise ValueError("only models with the identity normaliser, a leading space and kept blanks are supported")
        if USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces are not supported")


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, data: bytes):
        import ahocorasick

        model = Model(data)
        self.pieces = model.pieces
        self.bytes_ids = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        if len(self.bytes_ids) != 256:
            raise ValueError("the model has no byte fallback")
        normal = [i for i, k in enumerate(model.kinds) if k in (NORMAL, UNUSED) and model.pieces[i]]
        runs = {len(model.pieces[i]): i for i in normal if len(model.pieces[i]) > 1 and set(model.pieces[i]) == {SPACE}}
        self.runs = runs
        for i in normal:
            if SPACE in model.pieces[i].lstrip(SPACE) or (model.pieces[i].startswith(SPACE * 2) and i not in runs.values()):
                raise ValueError("pieces with inner spaces are not supported")
        real = [i for i in normal if i not in set(runs.values())]
        if runs and (len({model.scores[i] for i in runs.values()}) > 1 or max(model.scores[i] for i in runs.values()) >= min((model.scores[i] for i in real if len(model.pieces[i]) > 1), default=0.0)):
            raise ValueError("runs of spaces must all merge last, with one score")
        #: Pieces by rank: single characters, then the others in the order in which they merge.
        chars = [i for i in real if len(model.pieces[i]) == 1]
        longer = sorted((i for i in real if len(model.pieces[i]) > 1), key=lambda i: (-model.scores[i], i))
        if len({model.scores[i] for i in longer}) < len(longer):
            raise ValueError("pieces must have scores of their own")
        self.ids = chars + longer
        self.text = [model.pieces[i] for i in self.ids]
        self.length = [len(t) for t in self.text]
        self.rank = {t: r for r, t in enumerate(self.text)}
        self.alphabet = frozenset(t for t in self.text if len(t) == 1)
        self.n_chars = len(chars)
        n = len(self.text)
        #: The two pieces that a piece was merged from; -1 for those that no merging reaches.
        self.left, self.right = [-1] * n, [-1] * n
        for r in range(self.n_chars, n):
            halves = self._last_merge(r)
            if halves:
                self.left[r], self.right[r] = halves
        live = [r for r in range(n) if r < self.n_chars or self.left[r] >= 0]
        known = {self.text[r]: r for r in live}
        #: The next shorter piece that starts as a piece does.
        self.shorter = [-1] * n
        for r in live:
            t = self.text[r]
            self.shorter[r] = next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1)
        self.automaton = ahocorasick.Automaton()
        for r in live:
            self.automaton.add_word(self.text[r], r)
        self.automaton.make_automaton()
        #: Neighbours of characters in pieces: text can be cut between any others.
        self.joined = frozenset(t[k : k + 2] for t in known for k in range(len(t) - 1))
        self._pairs: dict[tuple[int, int], bool] = {}
        self.space_id = self.ids[self.rank[SPACE]] if SPACE in self.rank else None
        self.words = _Words(self, SPACE)
        self.tails = _Words(self, "")
        self.decoded = [self._decoded(i, k) for i, k in enumerate(model.kinds)]
        self.byte_of = {i: b for b, i in self.bytes_ids.items()}
        self.digits = [str(i) for i in range(len(model.pieces))]

    def _last_merge(self, r: int) -> tuple[int, int] | None:
        """The last merge that makes piece r from its characters, by plain merging of its own text."""
        symbols = [self.rank.get(c, -1) for c in self.text[r]]
        if -1 in symbols:
            return None
        while len(symbols) > 2:
            best, where = None, -1
            for k in range(len(symbols) - 1):
                m = self.rank.get(self.text[symbols[k]] + self.text[symbols[k + 1]])
                if m is not None and (best is None or m < best):
                    best, where = m, k
            if best is None:
                return None
            symbols[where : where + 2] = [best]
        return (symbols[0], symbols[1]) if len(symbols) == 2 else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b afresh leaves their border alone."""
        answer = self._pairs.get((a, b))
        if answer is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            answer = self._pairs[a, b] = self._remerged(a, b)
        return answer

    def _remerged(self, a: int, b: int) -> bool:
        before = _FAR  # merges across the border must come before this rank to matter
        while True:
            across = self.rank.get(self.text[a] + self.text[b])
            if across is not None and across < before:
                return False
            if a > b and a >= self.n_chars:  # a was made last
                before, a = a, self.right[a]
            elif b >= self.n_chars:  # of equal merges the left one comes first, so one across the border wins a tie with b
                before, b = b + 1, self.left[b]
            else:
                return True

    def _backtrack(self, text: str) -> list[int]:
        """Ranks of the pieces of a text that has known characters only."""
        n, length, pairs = len(text), self.length, self._pairs
        longest = [0] * n
        for end, r in self.automaton.iter(text):  # ends grow, so the longest match of each start is written last
            longest[end + 1 - length[r]] = r
        piece = longest[0]
        out = [piece]
        at = length[piece]
        while at < n:  # as long as the longest matches fit
            following = longest[at]
            fits = pairs.get((piece, following))
            if not (self.compatible(piece, following) if fits is None else fits):
                break
            out.append(following)
            piece = following
            at += length[piece]
        if at == n:
            return out
        failed = bytearray((n >> 3) + 1)
        piece = longest[at]
        while at < n:
            last = out[-1] if out else -1
            while piece >= 0:
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or self.compatible(last, piece)):
                    break
                piece = self.shorter[piece]
            if piece >= 0:
                out.append(piece)
                at = end
                piece = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()  # tried again, it finds its end marked and gives way
                at -= length[piece]
        return out

    def segment(self, text: str) -> list[int]:
        """Ids of a stretch of text without runs of spaces; unknown characters become their bytes."""
        ids = self.ids
        if self.alphabet.issuperset(text):
            return [ids[r] for r in self._backtrack(text)] if text else []
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.alphabet:
                if k > start:
                    out += [ids[r] for r in self._backtrack(text[start:k])]
                out += [self.bytes_ids[x] for x in c.encode("utf-8", "surrogatepass")]
                start = k + 1
        if start < len(text):
            out += [ids[r] for r in self._backtrack(text[start:])]
        return out

    def _run(self, count: int) -> list[int]:
        """Ids of spaces that no word takes. Their pieces have one score, so the leftmost pair that can merges first."""
        lengths: list[int] = []
        for _ in range(count):
            lengths.append(1)
            while len(lengths) > 1 and lengths[-2] + lengths[-1] in self.runs:
                lengths[-2:] = [lengths[-2] + lengths[-1]]
        return [self.space_id if n == 1 else self.runs[n] for n in lengths]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return list(chain.from_iterable(map(self.words.__getitem__, parts)))
        out: list[int] = []
        spaces = 0
        for part in parts:
            spaces += 1
            if part:
                own = self.words[part]
                if spaces > 1:
                    if own[0] == self.space_id:  # the word leaves its space to the run
                        out += self._run(spaces)
                        own = own[1:]
                    else:
                        out += self._run(spaces - 1)
                out += own
                spaces = 0
        if spaces:
            out += self._run(spaces)
        return out

    def _decoded(self, i: int, kind: int) -> str:
        if kind == CONTROL:
            return ""
        return " ⁇ " if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes joined to characters, spaces restored, the leading one dropped."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.decoded.__getitem__, ids))
        else:
            out: list[str] = []
            pending = bytearray()
            byte_of = self.byte_of
            for i in ids:
                b = byte_of.get(i)
                if b is None:
                    if pending:
                        out.append(_characters(pending))
                        pending = bytearray()
                    out.append(self.decoded[i])
                else:
                    pending.append(b)
            if pending:
                out.append(_characters(pending))
            text = "".join(out)
        first = next((i for i in ids if self.decoded[i]), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


def _characters(data: bytearray) -> str:
    """UTF-8 text; each byte that starts no character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(data[at : at + size]).decode())
                    break
                except UnicodeDecodeError:
                    size = 0
            if not size:
                out.append("�")
            at += size or 1
        return "".join(out)


class _Words(dict):
    """Ids of words, encoded when first met. Of a full cache, the words that are met again live on."""

    def __init__(self, codec: Codec, prefix: str):
        super().__init__()
        self.codec, self.prefix, self.older = codec, prefix, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        codec = self.codec
        if "\n" in word and "\n" not in codec.alphabet:  # lines meet here: what stands on either side is met again elsewhere
            first, *others = word.split("\n")
            newline = (codec.bytes_ids[10],)
            ids = codec.words[first] if self.prefix and first else (codec.space_id,) if self.prefix else codec.tails[first] if first else ()
            for other in others:
                ids += newline + (codec.tails[other] if other else ())
            return ids
        ids = self.older.get(word)
        if ids is None:
            if len(word) > 1 and word[-1] in ".,;:!?)" and word[-2].isalnum() and word[-2:] not in codec.joined:
                ids = self[word[:-1]] + codec.tails[word[-1]]
            else:
                ids = tuple(codec.segment(self.prefix + word))
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


_codecs: dict[bytes, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """The codec of a model's bytes, made once per process."""
    key = hashlib.sha256(data).digest()
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def sentencepiece_roundtrip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, ids (if wanted), n_tokens, ids_sha256, decoded, decoded_sha256.

    No begin or end ids, no sampling. Null texts count as empty; an empty text has no ids. Rows are independent,
    so repeated rows give repeated results and an empty table an empty one. The model is read by the driver
    and sent to the executors, which need not see its path.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_of(model.value)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")}
            digits = codec.digits.__getitem__
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = codec.encode(text.as_py() or "")
                back = codec.decode(own)
                out["doc_id"].append(doc)
                out["ids"].append(own if ids else None)
                out["n_tokens"].append(len(own))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(digits, own)).encode()).hexdigest())
                out["decoded"].append(back if ids else None)
                out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["n_tokens"], pa.int64()), *(pa.array(out[k], pa.string()) for k in ("ids_sha256", "decoded", "decoded_sha256"))],
                names=list(out),
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    result = plain.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string")
    return result if ids else result.drop("ids", "decoded")
