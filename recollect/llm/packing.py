"""Concatenate and cut: token ids of all documents as one stream, cut into sequences of a fixed length.

The first pass turns every text into ids and writes them, with each document's offset within its partition. The
partitions' totals, one number each, are summed on the driver to the offsets at which partitions begin. The second
pass knows every document's place in the stream and cuts it at the multiples of the sequence length.

Ids are the tokenizer library's. Where a tokenizer's file is of the kind that ``Pieces`` knows, its words are merged by
rank, which gives the same ids; any other tokenizer, and any stretch of text with other characters than those of
``Pieces``, goes through the library itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ship, stage, trimmed

WINDOW, END_ID = 2048, 1
#: Entries of each of the two generations of a worker's cache of pieces' ids, and the longest piece that is kept.
CACHE_PIECES, CACHE_LENGTH = 65_536, 48
#: Characters of a text that are handled at once, and documents that are passed on at once.
SLICE, ROWS = 1 << 18, 256

#: The splitting and normalising that ``Pieces`` repeats; fixed values of the file format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

#: Characters that need no composing and whose lower case is one character: ASCII and the Latin letters behind it.
PLAIN = [c for c in map(chr, [*range(0x1C), *range(0x20, 0x80), *range(0xA1, 0x180)]) if len(c.lower()) == 1]
_class = lambda kind: "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)
_BLANKS = r"\x20\x09-\x0d"
_OTHER_CHARACTER = re.compile(f"[^{''.join(map(re.escape, PLAIN))}]")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_BLANKS}{_class('L')}{_class('N')}]+")
_CUT = re.compile(f"[{_BLANKS}]")
_STRETCH = re.compile(f"[^{_BLANKS}]+")


def rank_table(data: bytes) -> dict[bytes, int] | None:
    """Tokens of a tokenizer's file as bytes, an end of word as 0xFF, if merging by rank gives the library's ids.

    Ids must be the bytes, the bytes at a word's end and then the merges in their order, and every token must be what
    its own merges lead to: then two neighbours that make up a token are that token's pair.
    """
    file = json.loads(data)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = {"add_prefix_space": False, "trim_offsets": True, "use_regex": False, "type": "ByteLevel"}
    known = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, plain]
    if (file.get("normalizer") or {}).get("normalizers") != NORMALIZERS or split.get("pretokenizers") != known or file.get("post_processor"):
        return None
    if model.get("type") != "BPE" or model.get("dropout") or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix"):
        return None
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocabulary = model["vocab"]
    if len(vocabulary) != 512 + len(merges) or any(vocabulary.get(a + b) != 512 + k for k, (a, b) in enumerate(merges)):
        return None
    if any(vocabulary.get(c, 256) > 255 or vocabulary.get(c + "</w>") != vocabulary[c] + 256 for c in byte_of):
        return None
    rank = {pair: k for k, pair in enumerate(merges)}
    for a, b in merges:
        whole = a + b
        parts = [*whole.removesuffix("</w>")]
        if whole.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            best, at = min((rank.get(pair, len(rank)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(rank):
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    out = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): k for t, k in vocabulary.items()}
    return out if len(out) == len(vocabulary) else None


class Pieces(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of the pieces into which the tokenizer splits lower-case text.

    A piece that no cache has is merged by rank. Of a full cache, the pieces that are met again live on.
    """

    def __init__(self, ranks: dict[bytes, int]):
        from tiktoken import Encoding

        super().__init__()
        self.older: dict[str, bytes] = {}
        #: A byte of its own has its id; 0xFF is in no text and only marks ends.
        self.merge = Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.asarray(self.merge(piece.encode() + b"\xff"), "<u4").tobytes()
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PIECE.findall(text.lower())))


class TextIds:
    """Ids of whole texts as the library gives them, special tokens' strings as ordinary text if ``literal``, else, as
    is the library's default, as those tokens."""

    def __init__(self, data: bytes, ranks: dict[bytes, int] | None, literal: bool = False):
        self.data, self.literal = data, literal
        self.pieces = None if ranks is None else Pieces(ranks)
        special = [t["content"] for t in json.loads(data).get("added_tokens", ())]
        self.special = [] if literal else special
        self.cuttable = self.pieces is not None and not any(_CUT.search(t) for t in special)

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, made when the first text needs it."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(self.data)
        made.encode_special_tokens = self.literal
        return made

    def library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def stretch(self, text: str) -> bytes:
        if _OTHER_CHARACTER.search(text) or any(t in text for t in self.special):
            return self.library(text)
        return self.pieces.encode(text)

    def __call__(self, text: str) -> bytes:
        """The tokenizer drops white space and merges only within what white space parts, so texts can be cut there."""
        if not self.cuttable:
            return self.library(text)
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                cut = _CUT.search(text, at + SLICE)
                end = cut.start() if cut else end
            part = text[at:end]
            if _OTHER_CHARACTER.search(part) or any(t in part for t in self.special):
                out += map(self.stretch, _STRETCH.findall(part))
            else:
                out.append(self.pieces.encode(part))
            at = end
        return b"".join(out)


_encoders: dict[tuple[bytes, bool], TextIds] = {}


def encoder(data: bytes, ranks: dict[bytes, int] | None, literal: bool = False) -> TextIds:
    """The encoder of a tokenizer's file, made once per process."""
    key = hashlib.sha256(data).digest(), literal
    if key not in _encoders:
        _encoders[key] = TextIds(data, ranks, literal)
    return _encoders[key]


@lru_cache(maxsize=2)
def tokenizer_file(path: str) -> tuple[bytes, dict[bytes, int] | None]:
    with open(path, "rb") as f:
        data = f.read()
    return data, rank_table(data)


def padded_length(tokens: np.ndarray | int, window: int = WINDOW):
    """A sequence is padded to the window, except where its length is a power of two."""
    return np.where(np.asarray(tokens) & (np.asarray(tokens) - 1) == 0, tokens, window)


def _pieces_of(part: pa.RecordBatch, first: dict[int, int], total: int, window: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces into which some documents' ids are cut: columns (part, at, doc_id, doc_tokens, ids) give ``PIECE``."""
    parts, at, count = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
    place = at + np.array([first[p] for p in parts.tolist()], np.int64)
    pieces = (place + count - 1) // window - place // window + 1
    row = np.repeat(np.arange(len(place)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sequence = place[row] // window + nth
    begin = np.maximum(place[row], sequence * window)
    start, length = begin - place[row], np.minimum(place[row] + count[row], (sequence + 1) * window) - begin
    ids = [x.as_buffer() for x in part.column(4)]
    own = [memoryview(ids[r])[4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
    size = np.minimum(window, total - sequence * window)
    numbers = {
        "doc_id": part.column(2).take(pa.array(row)), "start": start, "length": length, "ids_crc32": np.array([zlib.crc32(x) for x in own], np.int64), "doc_tokens": count[row],
        "sequence_id": sequence, "offset": begin - sequence * window, "sequence_tokens": size, "padded_tokens": padded_length(size, window),
    }
    arrays = [pa.array([bytes(x) for x in own] if with_ids else [None] * len(own), pa.binary()) if n == "ids" else pa.array(numbers[n], pa.int64()) for n in PIECE]
    return pa.RecordBatch.from_arrays(arrays, names=PIECE)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids, sequence_tokens, padded_tokens.

    A document is its ids followed by ``end_id``; null texts count as empty, so every row has a piece at least. A row
    whose id is null is packed like any other and keeps the null. Repeated rows are packed each. Only the last sequence
    can be shorter than ``window``. An empty table has no pieces. Other columns of ``docs`` are not read, whatever their
    names. ids are the piece's ids as little-endian unsigned 32-bit bytes, null unless ``with_ids``. They are the
    library's own, with special tokens neither added nor, where a text has their strings, taken apart.
    """
    spark = docs.sparkSession
    ship(spark)
    file = spark.sparkContext.broadcast(tokenizer_file(tokenizer_path))
    end = int(end_id).to_bytes(4, "little")

    def tokenise(batches):
        encode = encoder(*file.value)
        task, at = TaskContext.get().partitionId(), 0
        for batch in _few(batches):
            ids = [encode(t.as_py() or "") + end for t in batch.column(1)]
            counts = [len(x) // 4 for x in ids]
            begins = [at, *(at + n for n in accumulate(counts))]
            at = begins.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(ids), pa.int64()), pa.array(begins, pa.int64()), batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "at", "doc_id", "doc_tokens", "ids"],
            )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = stage(plain.mapInArrow(trimmed(tokenise), "part long, at long, doc_id long, doc_tokens long, ids binary"), "tokens")
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total")).collect())
    begins = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))
    total = sum(n for _, n in totals)
    base = spark.sparkContext.broadcast(begins)

    def cut(batches):
        for few in _few(batches):
            yield _pieces_of(few, base.value, total, window, with_ids)

    return tokens.mapInArrow(trimmed(cut), ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in PIECE))


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "sequence_tokens", "padded_tokens"]
