"""Byte-pair encoding and decoding with a contiguous rank array.

A short word is held as its parts and the ranks of adjacent parts, both contiguous. The
smallest rank is found by a scan, the boundary under it is deleted and the two ranks beside it
are looked up again, until no adjacent pair can be merged. Words beyond ``LONG_WORD`` bytes,
for which repeated scans would be quadratic, use a heap over the same ranks and give the same
parts. Words repeat, so each worker remembers a bounded number of them: those met since the
memory last filled up, and those met in the period before.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_text, map_arrow, non_empty

#: Longest word, in bytes, for which repeated scans are used.
LONG_WORD = 96
#: Words that a worker remembers of each of two periods.
REMEMBERED = 200_000
#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """The decimal ids of words, joined by commas, made when a word is first asked for."""

    def __init__(self, merge):
        self.merge = merge
        self.before: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        ids = self.before.get(word)
        if ids is None:
            ids = ",".join(map(str, self.merge(word.encode())))
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    def turn(self) -> None:
        """Begin a new period if this one is full."""
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = {name: bytes(alphabet[c] for c in name) for name in vocab}
        self.bytes_of = {i: raw[name] for name, i in vocab.items()}
        self.first = [0] * 256
        for name, i in vocab.items():
            if len(raw[name]) == 1:
                self.first[raw[name][0]] = i
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.named = {str(i): b for i, b in self.bytes_of.items()}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen = Memo(self.merge)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [*map(self.first.__getitem__, word)]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        get, merged = self.ranks.get, self.merged
        ranks = [*map(get, zip(parts, parts[1:]), repeat(NONE))]
        while ranks and (least := min(ranks)) != NONE:
            at = ranks.index(least)
            parts[at] = here = merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], here), NONE)
            if at < len(ranks):
                ranks[at] = get((here, parts[at + 1]), NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, in the same order, from a heap over linked parts."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, at, pair = heapq.heappop(heap)
            right = after[at]
            if right >= n or (parts[at], parts[right]) != pair:
                continue
            parts[at], parts[right] = self.merged[rank], -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (p := (parts[left], parts[after[left]])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], left, p))
        return [p for p in parts if p >= 0]

    def _named_words(self, text: str) -> str:
        """Decimal ids of a text without special tokens, joined by commas."""
        self.seen.turn()
        return ",".join(map(self.seen.__getitem__, self.words.findall(text)))

    def encode_named(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if self.split is None or not any(s in text for s in self.special):
            return self._named_words(text)
        return ",".join(str(self.special[x]) if x in self.special else self._named_words(x) for x in self.split.split(text) if x)

    def encode(self, text: str) -> list[int]:
        named = self.encode_named(text)
        return list(map(int, named.split(","))) if named else []

    def decode_named(self, named: str) -> bytes:
        return b"".join(map(self.named.__getitem__, named.split(","))) if named else b""

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(key: str, content) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content.value)
    return _CODECS[key]


def _shared(df: DataFrame, path: str | None):
    content = Path(path or default_vocabulary()).read_bytes()
    return hashlib.sha256(content).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens long, ids array<int>) of every text, one row per input row, no shuffle.

    Null and empty texts have no ids (0, empty array). Null ids stay null, repeated rows are
    repeated, an empty table gives no rows, other columns are ignored. Whole texts are encoded;
    the vocabulary file (its size bounds it) is read on the driver and broadcast.
    """
    key, content = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, content)
        for batch in non_empty(batches):
            ids = [codec.encode(t) for t in as_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "n_tokens", "ids"])

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, text) from arrays of ids; null arrays and null ids give the empty text and nothing."""
    key, content = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, content)
        for batch in non_empty(batches):
            texts = [codec.decode([i for i in x or () if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return map_arrow(df.select(id_col, ids_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, and digest both.

    The same edge cases as ``encode_column``; the arrays themselves are not returned, which
    keeps a check of a large corpus from moving them.
    """
    key, content = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, content)
        for batch in non_empty(batches):
            rows = []
            for text in as_text(batch.column(1)):
                named = codec.encode_named(text)
                decoded = codec.decode_named(named).decode("utf-8", "replace").encode()
                rows.append((named.count(",") + 1 if named else 0, hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            count, ids, decoded = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids), pa.array(decoded)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
