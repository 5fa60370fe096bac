"""Passages that repeat anywhere in a corpus, found by suffix arrays and taken out byte for byte.

A byte goes if it lies in a string of ``length`` bytes that starts at any other place too, in
the same text or another; strings do not cross texts. No task holds a suffix array of the
corpus. Each window of ``length`` bytes is dealt to a bucket by its least hash of ``GRAM``
bytes, which equal windows share, so equal windows meet wherever they lie. Neighbouring windows
with the same least hash make one piece of text. Buckets with a single piece hold nothing that
repeats, and only hashes are shuffled to see that. The pieces of the others, each different one
once, are fetched, and each task sorts the suffixes of its pieces in two stages: those smaller
than their successors directly, the rest by scans of the buckets of first bytes. Windows whose
common prefix with a neighbour has ``length`` bytes repeat.

A bucket with more than ``MOST_PIECES`` different pieces, such as one of a common line, is cut:
its windows are dealt anew by where their least hash lies in them and by the bytes that windows
of that class share, in finer classes until every bucket is small. No link is lost by that.

Nulls and texts below ``length`` bytes lose nothing. Repeated rows are texts of their own, so
each takes the other out. A null id is kept. A text of any length is worked in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, scratch_folder
from .common import MIX_A, MIX_B, as_bytes, map_arrow
from .components import BROADCAST_ROWS, ID_BITS, MOST_ID_BITS, joined, maybe_in

#: Bytes of the hashes that deal windows to buckets.
GRAM = 64
#: Windows of a stretch of text, and bytes of a buffer of stretches; positions in it need ``PLACE_BITS`` bits.
STRETCH, PLACE_BITS = 1 << 19, 20
#: Different pieces of a bucket that one suffix array takes, and bytes of pieces in one array.
MOST_PIECES, ARRAY_BYTES = 1024, 2_000_000
#: Offsets of a class of windows when a bucket is cut for the first time; a quarter of that each time after.
CLASS_WIDTH = 16

_BELOW = np.uint64((1 << PLACE_BITS) - 1)
_LETTERS = np.random.default_rng(12).integers(0, 2**64, 256, np.uint64)
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64, made once a worker."""
    if not _powers:
        for base in (int(MIX_A), pow(int(MIX_A), -1, 1 << 64)):
            _powers.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(1 << PLACE_BITS, base, np.uint64)])))
    return _powers


def least_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ``GRAM`` bytes at each place, and for each window of ``length`` bytes where its least one lies.

    Of equal hashes in a window the first counts, so equal windows agree. data: up to 2^20 bytes.
    """
    up, down = _power_tables()
    gram = max(min(GRAM, length), length - 255)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= MIX_B
    hashes ^= hashes >> np.uint64(29)
    # least of each run of `span` values: the tail of one block and the head of the next
    span, placed = length - gram + 1, (hashes & ~_BELOW) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.concatenate([placed, np.full(-len(placed) % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    return hashes, (np.minimum(tails[:n], heads[span - 1 : span - 1 + n]) & _BELOW).astype(np.int64)


def _stretches(texts: list[bytes], length: int, stretch: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, start, bytes) in lists that fill a buffer; every window lies in one stretch."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, stretch):
            part = text[start : start + stretch + length - 1]
            if size + len(part) > 1 << PLACE_BITS:
                yield held
                held, size = [], 0
            held.append((i, start, part))
            size += len(part)
    if held:
        yield held


def pieces_of(texts: list[bytes], length: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, piece, place) of the pieces: key is the least hash, piece a hash of the bytes.

    place is 256 times the first window, plus the windows less one; a piece has 256 at most.
    """
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    for held in _stretches(texts, length, stretch):
        body = b"".join(part for _, _, part in held)
        hashes, least = least_hashes(np.frombuffer(body, np.uint8), length)
        sizes = np.array([len(part) for _, _, part in held])
        begins = np.cumsum(sizes) - sizes
        firsts, lasts = [], []
        for begin, size in zip(begins.tolist(), sizes.tolist()):
            cuts = np.flatnonzero(np.diff(least[begin : begin + size - length + 1])) + begin + 1
            firsts.append(np.concatenate([[begin], cuts]))
            lasts.append(np.concatenate([cuts - 1, [begin + size - length]]))
        of = np.repeat(np.arange(len(held)), [len(x) for x in firsts])
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        digest = xxhash.xxh3_64_intdigest
        out[0].append(np.array([i for i, _, _ in held])[of])
        out[1].append(hashes[least[first]])
        out[2].append(np.fromiter((digest(body[a : b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first)))
        out[3].append((first - begins[of] + np.array([start for _, start, _ in held])[of]) * 256 + (last - first))
    return tuple(np.concatenate(x) for x in out)


class _Words:
    """The eight bytes at each of some places, as numbers that order like them."""

    def __init__(self, data: np.ndarray, length: int):
        padded = np.concatenate([data, np.full(length + 8, 255, np.uint8)])
        self.rows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.rows[places].view(">u8").ravel().astype(np.uint64)


def _sorted_directly(words: _Words, places: np.ndarray) -> np.ndarray:
    """Places ordered by ``length`` bytes. Eight bytes a round, only for places that are tied and differ there."""
    if not len(places):
        return places
    first = words.at(places)
    order = np.argsort(first, kind="stable")
    places, first = places[order], first[order]
    slots = np.arange(len(places))
    group = np.concatenate([[0], np.cumsum(first[1:] != first[:-1])])
    for offset in words.offsets[1:]:
        tied = np.concatenate([[False], group[1:] == group[:-1]])
        tied[:-1] |= tied[1:]
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break
        word = words.at(places[slots] + offset)
        apart = (group[1:] == group[:-1]) & (word[1:] != word[:-1])
        if apart.any():
            mixed = np.flatnonzero(np.isin(group, group[1:][apart]))
            turned = mixed[np.lexsort((word[mixed], group[mixed]))]
            places[slots[mixed]], word[mixed] = places[slots[turned]], word[turned]
            group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (word[1:] != word[:-1]))])
    return places


def suffix_order(data: np.ndarray, wanted: np.ndarray, smaller: np.ndarray, words: _Words) -> np.ndarray:
    """The wanted places in the order of their first ``length`` bytes, by two-stage sorting.

    smaller: whether the suffix at a place is smaller than its successor. wanted must hold, with
    a place that is not smaller, the place after it. Buckets are scanned by first byte: a suffix
    that is not smaller starts with a byte no less than that of its successor, so the scan of a
    bucket hands each such predecessor to a bucket that is still open, in the right order.
    """
    seeds = _sorted_directly(words, np.flatnonzero(wanted & smaller))
    induced = wanted & ~smaller
    ends = np.searchsorted(data[seeds], np.arange(257, dtype=np.int64))
    open_buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def hand_on(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[induced[before]]
        firsts = data[before]
        order = np.argsort(firsts, kind="stable")
        before, firsts = before[order], firsts[order]
        cuts = np.flatnonzero(firsts[1:] != firsts[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else ():
            open_buckets[data[part[0]]].append(part)

    for byte in range(256):
        arrived = open_buckets[byte]
        while arrived:  # equal bytes in a row hand suffixes to the bucket that is being scanned
            open_buckets[byte] = []
            scanned = np.concatenate(arrived)
            out.append(scanned)
            hand_on(scanned)
            arrived = open_buckets[byte]
        seeded = seeds[ends[byte] : ends[byte + 1]]
        if len(seeded):
            out.append(seeded)
            hand_on(seeded)
    return np.concatenate(out) if out else seeds


def repeated_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, whether each of its windows equals another window of these pieces."""
    sizes = np.array([len(b) + 1 for b in bodies])
    begins = np.cumsum(sizes) - sizes
    # no byte of UTF-8 is 255, so it ends a piece and is above all others
    data = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)
    change = np.flatnonzero(data[1:] != data[:-1])
    to = np.append(change, len(data) - 1)[np.searchsorted(change, np.arange(len(data)))]
    smaller = np.append(data, 255)[to + 1] > data
    # the windows of each piece, and what follows them up to the first smaller suffix
    seeds = np.append(np.flatnonzero(smaller), len(data))
    last = begins + sizes - 1 - length
    until = seeds[np.searchsorted(seeds, last)]
    marks = np.zeros((2, len(data) + 1), np.int8)
    for row, stop in ((0, last), (1, until)):
        np.add.at(marks[row], begins, 1)
        np.add.at(marks[row], stop + 1, -1)
    windows, wanted = (np.cumsum(m[:-1]).astype(bool) for m in marks)
    words = _Words(data, length)
    order = suffix_order(data, wanted, smaller, words)
    order = order[windows[order]]
    # adjacent common prefixes, as far as they are alike
    pairs = np.arange(len(order) - 1)
    for offset in words.offsets:
        pairs = pairs[words.at(order[pairs] + offset) == words.at(order[pairs + 1] + offset)]
    found = np.zeros(len(data), bool)
    found[order[pairs]] = found[order[pairs + 1]] = True
    return [found[a : b + 1] for a, b in zip(begins.tolist(), last.tolist())]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of true values."""
    steps = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return steps[::2], steps[1::2]


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values).astype(np.uint64).view(np.int64))


_PIECE = "key long, piece long, n long, body binary"


def _judged(length: int):
    """Rows (key, piece, n, body), a bucket together, to (key, piece, a, b): windows a to b of a piece repeat."""

    def decide(held: list[dict]) -> pa.RecordBatch:
        keys, pieces, firsts, ends = [], [], [], []
        for row, flags in zip(held, repeated_windows([r["body"] for r in held], length)):
            for a, b in zip(*_runs(flags if row["n"] == 1 else np.ones(len(flags), bool))):
                keys.append(row["key"]), pieces.append(row["piece"]), firsts.append(a), ends.append(b)
        return pa.record_batch({"key": pa.array(keys, pa.int64()), "piece": pa.array(pieces, pa.int64()), "a": pa.array(firsts, pa.int64()), "b": pa.array(ends, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size > ARRAY_BYTES and row["key"] != held[-1]["key"]:
                    yield decide(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["body"])
        if held:
            yield decide(held)

    return run


def _cut(length: int, width: int):
    """Pieces of large buckets to smaller ones (key, piece, n, body) with the piece (of_key, of_piece) and window they are from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "piece", "n", "body", "of_key", "of_piece", "at")}
            for row in batch.to_pylist():
                body, n = row["body"], len(row["body"]) - length + 1
                anchor = int(least_hashes(np.frombuffer(body, np.uint8), length)[1][0])
                for k in range((anchor - n + 1) // width, anchor // width + 1):
                    # windows that hold their least hash at k * width up to the next class
                    lo, hi = max(0, anchor - k * width - width + 1), min(n - 1, anchor - k * width)
                    core = body[anchor - k * width : anchor - k * width - width + 1 + length]
                    part = body[lo : hi + length]
                    values = (xxhash.xxh3_64_intdigest(core, seed=k), xxhash.xxh3_64_intdigest(part, seed=k), row["n"], part, row["key"], row["piece"], lo)
                    for name, value in zip(out, values):
                        out[name].append(value)
            yield pa.record_batch({k: pa.array(v, pa.binary()) if k == "body" else _longs(v) if k in ("key", "piece") else pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def judge(pieces: DataFrame, length: int, width: int = CLASS_WIDTH, most: int = MOST_PIECES, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(key, piece, a, b): the windows a to b, b not included, of each piece that repeat.

    pieces: (key, piece, n, body), each different piece of a bucket once, n how often it occurs.
    """
    sizes = durable(pieces.groupBy("key").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1"))
    large = sizes.where(F.col("kinds") > most)
    hot = large.count()
    small = pieces
    if hot:
        small = joined(pieces, large.select("key"), "key", hot, "left_anti", limit=limit)
    ordered = small.select("key", "piece", "n", "body").repartition("key").sortWithinPartitions("key", "piece")
    found = map_arrow(ordered, _judged(length), "key long, piece long, a long, b long")
    if not hot:
        return found
    cut = durable(map_arrow(joined(pieces, large.select("key"), "key", hot, "left_semi", limit=limit).select("key", "piece", "n", "body"), _cut(length, width), f"{_PIECE}, of_key long, of_piece long, at long"))
    parts = durable(cut.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.first("body").alias("body")))
    shared = parts.groupBy("key").agg(F.sum("n").alias("_all")).where("_all > 1").select("key")
    inner = durable(judge(durable(joined(parts, shared, "key", limit + 1, "left_semi", limit=limit)), length, max(1, width // 4), most, limit))
    back = joined(cut.select("key", "piece", "of_key", "of_piece", "at"), inner, ["key", "piece"], inner.count(), limit=limit)
    return found.unionByName(back.select(F.col("of_key").alias("key"), F.col("of_piece").alias("piece"), (F.col("a") + F.col("at")).alias("a"), (F.col("b") + F.col("at")).alias("b")))


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 200, most: int = MOST_PIECES, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(digest, spans): for each different text with bytes that repeat, the spans (s, e) of bytes to take out.

    digest is the first half of the SHA-256 of the text. Spans overlap and are in no order. The
    result is written to the checkpoint folder. At most ``limit`` rows are broadcast.
    """
    if length < 8:
        raise ValueError("repeated strings have 8 bytes at least")
    spark = docs.sparkSession
    texts = docs.where(F.octet_length(text_col) >= length).select(_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, *values = pieces_of(as_bytes(batch["text"]), length)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]), pa.int32())
            lists = {name: pa.ListArray.from_arrays(offsets, _longs(v)) for name, v in zip(("keys", "pieces", "places"), values)}
            yield pa.record_batch({"digest": batch["digest"], **lists})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x["key"], x["piece"], x["n"], text[x["place"] >> 8 : (x["place"] >> 8) + (x["place"] & 255) + length]) for text, asked in zip(as_bytes(batch["text"]), batch["asked"].to_pylist()) for x in asked]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "piece", "n", "body"])

    with scratch_folder(spark, "pieces") as folder:
        map_arrow(texts, mark, "digest binary, keys array<long>, pieces array<long>, places array<long>").write.parquet(folder)
        marks = spark.read.parquet(folder)
        shared = durable(marks.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
        count = shared.count()
        each = marks.select("digest", F.explode(F.arrays_zip("keys", "pieces", "places")).alias("m")).select("digest", F.col("m.keys").alias("key"), F.col("m.pieces").alias("piece"), F.col("m.places").alias("place"))
        # a map of the keys lets few others through; where it would be too full, the keys themselves decide
        spots = maybe_in(each, "key", shared, count) if count <= MOST_ID_BITS // ID_BITS else joined(each, shared, "key", count, "left_semi", limit=limit)
        kinds = durable(spots.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "place")).alias("at")))
        kinds = joined(kinds, shared, "key", count, "left_semi", limit=limit)
        asked = durable(kinds.groupBy("at.digest").agg(F.collect_list(F.struct("key", "piece", "n", "at.place")).alias("asked")))
        number = asked.count()
        code = F.xxhash64("digest")
        one = maybe_in(texts.withColumn("code", code), "code", asked.select(code.alias("code")), number).groupBy("digest").agg(F.first("text").alias("text"))
        pieces = durable(map_arrow(one.join(asked, "digest").select("text", "asked"), fetch, _PIECE))
        found = durable(judge(pieces, length, most=most, limit=limit))
        start = F.expr("place div 256")
        spans = joined(spots, found, ["key", "piece"], found.count(), limit=limit).select("digest", F.struct((start + F.col("a")).alias("s"), (start + F.col("b") + length - 1).alias("e")).alias("span"))
        return durable(spans.groupBy("digest").agg(F.collect_set("span").alias("spans")))


def _kept(text: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The text without the spans, and the number of runs taken out."""
    parts, end, runs = [], 0, 0
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        runs += s > end or end == 0
        parts.append(text[end:s])
        end = max(end, e)
    parts.append(text[end:])
    return b"".join(parts), runs


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, most: int = MOST_PIECES, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row: kept holds the bytes that stay, joined.

    n_spans counts the runs of bytes that go. kept is binary, since a run may begin or end
    inside a character. Null texts are empty. Texts that nothing is taken from, by a map of the
    digests, are not shuffled.
    """
    spans = repeated_spans(docs, text_col, length, most, limit)
    number, code = spans.count(), F.xxhash64("digest")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("digest", _digest(F.col("text"))).withColumn("code", code)
    codes = spans.select(code.alias("code"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    whole = maybe_in(rows, "code", codes, number, outside=True).select("id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("kept"))

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            done = [_kept(t, x or []) for t, x in zip(texts, batch["spans"].to_pylist())]
            yield pa.record_batch({"id": batch["id"], "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array((len(t) - len(k) for t, (k, _) in zip(texts, done)), pa.int64()), "n_spans": pa.array((n for _, n in done), pa.int64()), "kept": pa.array((k for k, _ in done), pa.binary())})

    touched = maybe_in(rows, "code", codes, number).select("id", "text", "digest").join(spans, "digest", "left").select("id", "text", "spans")
    types = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return whole.unionByName(map_arrow(touched, take_out, types)).withColumnRenamed("id", id_col)
