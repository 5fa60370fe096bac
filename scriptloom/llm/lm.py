"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

The count c of a unigram or bigram is stored as its level 1 + floor(log2 c): the pairs
(n-gram, 1) to (n-gram, level) are members of a Bloom filter. The level is read back by
repeated membership probes, one level after the other until one fails, and stands for the mean
count of its range. Bigram and unigram counts so read are interpolated.

Counting. Tokens are hashed to 64 bits. Workers count n-grams of about a million positions at
a time and send them on by hash segment as packed arrays; one group for each segment adds them
up and builds the segment's bits of the filter. The number of segments grows with the bytes of
the corpus, so a segment stays small at any size, and a frequent n-gram is one entry of each
array.

Scoring goes by stretches of about ``POSITIONS`` positions, in which every n-gram is looked up
once. A filter of at most ``PART_BYTES`` is broadcast and probed where the text is read. A
larger one never leaves its segments: the distinct n-grams of a stretch go there, are probed,
and their levels return. The commonest words and pairs, which every stretch would ask for and
which would meet in one segment, are broadcast with their levels instead. Both ways give the same
levels.

The base score needs exact counts of all tokens. Tokens with at least 1/``HEAVY`` of all
occurrences, of which there cannot be more than ``HEAVY``, are broadcast, and so are pairs that
occur once or more in each 1/``HEAVY`` of the bytes of text, of which there are as few. The others are sent,
once for each stretch that has them, to their segment and meet their counts there. So a token
that no training text has, however often it occurs, is one entry of a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import MIX_A, MIX_B, MIX_C, as_bytes, ascii_words, hash_tokens, map_arrow, non_empty

#: The end of a text as a token; no word holds a space.
END = b" "
#: Bytes of text for each segment.
SEGMENT_BYTES = 8 << 20
MIN_SEGMENTS = 64
#: Segments that a task of the scoring pass handles, one after the other.
SEGMENTS_A_TASK = 16
#: Most tasks of a shuffle by segment; beyond it a task takes several segments, one after the other.
MOST_TASKS = 20_000
#: At most so many tokens are broadcast with exact counts.
HEAVY = 1 << 21
#: Largest filter that is broadcast.
PART_BYTES = 256 << 20
BITS_PER_ENTRY = 8
HASHES = 5
#: Positions that a worker handles at once.
POSITIONS = 400_000
#: Weight of the bigram estimate.
LAMBDA = 0.6
LOW = np.uint64((1 << 40) - 1)


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of token pairs."""
    key = (left ^ (left >> np.uint64(29))) * MIX_A + right * MIX_C
    key ^= key >> np.uint64(32)
    return key * MIX_B


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key in five bytes; with the segment they identify an n-gram."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(content: bytes) -> np.ndarray:
    out = np.zeros((len(content) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(content, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]


def count_at(level: np.ndarray) -> np.ndarray:
    """Mean of the counts of a level, 0 at level 0."""
    return np.where(level > 0, (2.0 ** (level - 1) + 2.0**level - 1) / 2, 0.0)


def _walk(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the places of (key, level)."""
    seed = (keys ^ np.uint64(0x51ED270B * level & 0xFFFFFFFFFFFFFFFF)) * MIX_A
    seed ^= seed >> np.uint64(31)
    return seed, (seed * MIX_B) | np.uint64(1)


def _place(seed: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
    return ((seed >> np.uint64(32)) * size) >> np.uint64(32)


def filter_of(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of a segment, ``BITS_PER_ENTRY`` for each pair of n-gram and level."""
    levels = level_of(counts)
    size = max(8, -(-int(levels.sum()) * BITS_PER_ENTRY // 8) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        seed, step = _walk(keys[levels >= level], level)
        for _ in range(HASHES):
            seed = seed + step
            bits[_place(seed, np.uint64(size))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def levels_in(bits: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key, by repeated probes of the ``size`` bits that begin at byte ``start``."""
    out = np.zeros(len(keys), np.int64)
    active = np.flatnonzero(size > 0)
    level = 1
    while len(active):
        left = active
        seed, step = _walk(keys[left], level)
        for _ in range(HASHES):
            seed = seed + step
            place = _place(seed, size[left].astype(np.uint64)).astype(np.int64)
            held = (bits[start[left] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
            left, seed, step = left[held], seed[held], step[held]
        out[left] = level
        active, level = left, level + 1
    return out


def levels_of(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The levels of keys in the bits of one segment, as bytes."""
    return levels_in(bits, np.zeros(len(keys), np.int64), np.full(len(keys), 8 * len(bits)), keys).astype(np.uint8)


class LevelFilter:
    """The whole filter: segments side by side; segments that are absent hold nothing."""

    def __init__(self, segments: int, parts: dict[int, bytes]):
        self.segments = segments
        self.bits = np.frombuffer(b"".join(parts[s] for s in sorted(parts)) or bytes(1), np.uint8)
        sizes = np.array([len(parts.get(s, b"")) for s in range(segments)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size = sizes * 8

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram hash."""
        segment = segment_of(hashes, self.segments)
        return levels_in(self.bits, self.start[segment], self.size[segment], hashes & LOW)


def text_hashes(text: bytes) -> np.ndarray:
    """Hashes of the tokens of a text, the end included."""
    words = ascii_words(text)
    words.append(END)
    return hash_tokens(words)


def histories(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each; the end before the first of a text. starts: of the texts."""
    before = np.roll(tokens, 1)
    before[starts] = hash_tokens([END])[0]
    return before


def count_ngrams(training: DataFrame, segments: int, heavy_pair: int) -> DataFrame:
    """(segment, words, word_counts, n_tokens, n_words, bits, pairs, pair_levels) by segment, from texts.

    pairs: those that occur at least ``heavy_pair`` times, with their levels in the filter. Null and
    empty texts are an end each; repeated texts count as often as they come. No rows give none.
    """

    def out(tokens: list[np.ndarray], pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for kind, found in enumerate((tokens, pairs)):
            codes, keys = pd.factorize(np.concatenate(found))
            counts = np.bincount(codes)
            segment = segment_of(keys, segments)
            order = np.lexsort((counts > 1, segment))
            keys, counts, segment = keys[order], counts[order], segment[order]
            edges = np.searchsorted(segment, np.arange(segments + 1))
            rows = []
            for s in np.flatnonzero(edges[1:] > edges[:-1]):
                k, c = keys[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
                pack = (lambda x: x.tobytes()) if kind == 0 else packed
                rows.append((int(s), kind, pack(k[c == 1]), pack(k[c > 1]), c[c > 1].astype(np.int32).tobytes()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["segment", "kind", "ones", "many", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs, held = [], [], 0
        for batch in non_empty(batches):
            for text in as_bytes(batch.column(0)):
                h = text_hashes(text)
                tokens.append(h)
                pairs.append(mix(histories(h, np.array([0])), h))
                held += len(h)
                if held >= 2 * POSITIONS:
                    yield from out(tokens, pairs)
                    tokens, pairs, held = [], [], 0
        if held:
            yield from out(tokens, pairs)

    def add(table):
        kinds = table["kind"].to_numpy()
        found = []
        for kind, read in ((0, lambda x: np.frombuffer(x, np.uint64)), (1, unpacked)):
            rows = table.filter(pa.array(kinds == kind))
            ones, many, counts = (b"".join(rows[c].to_pylist()) for c in ("ones", "many", "counts"))
            single, other = read(ones), read(many)
            found.append(added_up(np.concatenate([single, other]), np.concatenate([np.ones(len(single), np.int64), np.frombuffer(counts, np.int32).astype(np.int64)])))
        (words, n), (pairs, m) = found
        bits = filter_of(np.concatenate([words & LOW, pairs]), np.concatenate([n, m]))
        heavy = pairs[m >= heavy_pair]
        levels = levels_of(np.frombuffer(bits, np.uint8), heavy)
        return pa.table({"segment": table["segment"].slice(0, 1).combine_chunks(), "words": pa.array([words.tobytes()], pa.binary()), "word_counts": pa.array([n.tobytes()], pa.binary()), "n_tokens": pa.array([int(n.sum())], pa.int64()), "n_words": pa.array([len(n)], pa.int64()), "bits": pa.array([bits], pa.binary()), "pairs": pa.array([packed(heavy)], pa.binary()), "pair_levels": pa.array([levels.tobytes()], pa.binary())})

    counted = map_arrow(training, run, "segment int, kind int, ones binary, many binary, counts binary")
    return counted.repartition(min(segments, MOST_TASKS), "segment").groupBy("segment").applyInArrow(add, "segment int, words binary, word_counts binary, n_tokens long, n_words long, bits binary, pairs binary, pair_levels binary")


def heavy_words(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, counts and levels of the tokens that occur at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in non_empty(batches):
            for words, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
                k, c = np.frombuffer(words, np.uint64), np.frombuffer(n, np.int64)
                keep = c >= least
                found = k[keep].tobytes(), c[keep].tobytes(), levels_of(np.frombuffer(bits, np.uint8), k[keep] & LOW).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in found], names=["k", "c", "l"])

    rows = map_arrow(counts.select("words", "word_counts", "bits"), run, "k binary, c binary, l binary").collect()
    keys, found, levels = (np.frombuffer(b"".join(r[name] for r in rows), kind) for name, kind in (("k", np.uint64), ("c", np.int64), ("l", np.uint8)))
    order = np.argsort(keys)
    return keys[order], found[order], levels[order]


def heavy_pairs(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, of segment and low bits, and levels of the pairs that ``count_ngrams`` names."""
    rows = counts.select("segment", "pairs", "pair_levels").where(F.length("pairs") > 0).collect()
    keys = np.concatenate([unpacked(r["pairs"]) | np.uint64(r["segment"] << 40) for r in rows] or [np.empty(0, np.uint64)])
    levels = np.frombuffer(b"".join(r["pair_levels"] for r in rows), np.uint8)
    order = np.argsort(keys)
    return keys[order], levels[order]


def looked_up(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of keys in a sorted table, 0 where it lacks them."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and token hashes of consecutive texts, of about ``POSITIONS`` tokens together."""
    ids, found, held = [], [], 0
    for batch in non_empty(batches):
        begin = 0
        for end, text in enumerate(as_bytes(batch.column(1)), 1):
            h = text_hashes(text)
            found.append(h)
            held += len(h)
            if held >= POSITIONS or end == batch.num_rows:
                ids.append(batch.column(0).slice(begin, end - begin))
                begin = end
            if held >= POSITIONS:
                yield pa.concat_arrays(ids), found
                ids, found, held = [], [], 0
    if found:
        yield pa.concat_arrays(ids), found


class Stretch:
    """Consecutive texts with their distinct words and pairs, each numbered in the order of its segment."""

    def __init__(self, hashes: list[np.ndarray], segments: int):
        self.lengths = np.array([len(h) for h in hashes])
        self.starts = np.cumsum([0, *self.lengths[:-1]])
        tokens = np.concatenate(hashes)
        self.codes, self.words, self.word_edges = _numbered(tokens, segments)
        before = histories(tokens, self.starts)
        self.pair_codes, self.pairs, self.pair_edges = _numbered(mix(before, tokens), segments)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of values by position, by text."""
        return np.add.reduceat(values, self.starts)


def _numbered(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code by position, distinct keys by code, edges of the segments in these)."""
    codes, distinct = pd.factorize(keys)
    segment = segment_of(distinct, segments)
    order = np.argsort(segment, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[codes], distinct[order], np.searchsorted(segment[order], np.arange(segments + 1))


def log_probabilities(codes: np.ndarray, pair_codes: np.ndarray, starts: np.ndarray, word_levels: np.ndarray, pair_levels: np.ndarray, n_tokens: int, n_words: int) -> np.ndarray:
    """log10 P(token | history) by position, from the levels of distinct words and pairs."""
    count, of_pair = count_at(word_levels), count_at(pair_levels)[pair_codes]
    unigram = ((count + 0.5) / (n_tokens + 0.5 * (n_words + 1)))[codes]
    of_history = np.roll(count[codes], 1)
    of_history[starts] = count[codes[-1]]  # the last token is an end, as is the history of a first token
    bigram = np.minimum(of_pair, of_history) / np.maximum(of_history, 1)
    return np.log10(np.where(of_history > 0, LAMBDA * bigram + (1 - LAMBDA) * unigram, unigram))


#: place: of the stretch. Questions: segment, words, pairs. Texts: the others, with segment to spread them.
STRETCH = "place long, segment int, words binary, pairs binary, texts binary, rare binary, codes binary, pair_codes binary, word_known binary, pair_known binary"
#: For a level that is asked.
ASKED = 255


def _rows(place: int, ids: pa.Array, hashes: list[np.ndarray], segments: int, known: tuple[np.ndarray, np.ndarray], denominator: float, whole: LevelFilter | None, n_tokens: int, n_words: int, levels: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows of one stretch: its texts with what is known so far, then its questions by segment.

    Questions are the words without a broadcast count. Without the whole filter at hand they are
    also the pairs without a broadcast level, and the codes by position go along to score the
    answers. levels: of the known words, then keys and levels of the known pairs.
    """
    stretch = Stretch(hashes, segments)
    c = looked_up(stretch.words, *known)
    rare = c == 0
    logs = np.where(rare, 0.0, np.log10((c + 0.5) / denominator))
    base, heavy = stretch.sums(logs[stretch.codes]), stretch.sums((~rare)[stretch.codes].astype(np.int64))
    if whole is not None:
        score = stretch.sums(log_probabilities(stretch.codes, stretch.pair_codes, stretch.starts, whole.levels(stretch.words), whole.levels(stretch.pairs), n_tokens, n_words))
    else:
        score = np.zeros(len(ids))
    texts = pa.RecordBatch.from_arrays([ids, pa.array(stretch.lengths, pa.int64()), pa.array(heavy), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "base", "score"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema) as writer:
        writer.write_batch(texts)
    # what the texts ask: (text, word) once, with the times it occurs
    asked = np.flatnonzero(rare)
    number = np.full(len(stretch.words), -1, np.int64)
    number[asked] = np.arange(len(asked))
    at = np.flatnonzero(rare[stretch.codes])
    owner = np.repeat(np.arange(len(ids), dtype=np.int64), stretch.lengths)[at]
    pairs, times = np.unique(owner * max(1, len(asked)) + number[stretch.codes[at]], return_counts=True)
    rare_rows = np.stack([pairs // max(1, len(asked)), pairs % max(1, len(asked)), times]).astype(np.int32)
    word_edges = np.searchsorted(asked, stretch.word_edges)
    pairs_asked, pair_known, word_known = np.empty(0, np.int64), b"", b""
    if whole is None:
        key = (segment_of(stretch.pairs, segments).astype(np.uint64) << np.uint64(40)) | (stretch.pairs & LOW)
        held = [looked_up(stretch.words, known[0], levels[0]), looked_up(key, levels[1], levels[2])]
        pairs_asked = np.flatnonzero(held[1] == 0)
        word_known, pair_known = (np.where(x == 0, ASKED, x).astype(np.uint8).tobytes() for x in held)
    pair_edges = np.searchsorted(pairs_asked, stretch.pair_edges)
    some = np.flatnonzero((word_edges[1:] > word_edges[:-1]) | (pair_edges[1:] > pair_edges[:-1]))
    words, some_pairs = stretch.words[asked], stretch.pairs[pairs_asked]
    empty = [None] * len(some)
    away = whole is None
    home = ((place * int(MIX_A) & (1 << 64) - 1) >> 40) % segments
    return pa.RecordBatch.from_arrays(
        [
            pa.array([place] * (1 + len(some)), pa.int64()),
            pa.array([home, *some.tolist()], pa.int32()),
            pa.array([None, *(words[word_edges[s] : word_edges[s + 1]].tobytes() for s in some)], pa.binary()),
            pa.array([None, *(packed(some_pairs[pair_edges[s] : pair_edges[s + 1]]) for s in some)], pa.binary()),
            pa.array([sink.getvalue().to_pybytes(), *empty], pa.binary()),
            pa.array([rare_rows.tobytes(), *empty], pa.binary()),
            pa.array([stretch.codes.tobytes() if away else b"", *empty], pa.binary()),
            pa.array([stretch.pair_codes.tobytes() if away else b"", *empty], pa.binary()),
            pa.array([word_known, *empty], pa.binary()),
            pa.array([pair_known, *empty], pa.binary()),
        ],
        names=[c.split()[0] for c in STRETCH.split(", ")],
    )


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, part_bytes: int = PART_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    ``train`` marks the rows from which counts are learned. Tokens are words after ASCII
    folding, then one end. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) with exact
    counts; score is the model's log10 probability. Null and empty texts are the end alone.
    Without training rows N and V are 0 and nothing is known. Null ids stay null, repeated
    rows are repeated, an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    segments = max(MIN_SEGMENTS, -(-size // segment_bytes))
    counts = durable(count_ngrams(docs.where(train).select(text_col), segments, max(2, -(-size // heavy))))
    total = counts.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum(F.length("bits"))).first()
    n_tokens, n_words, n_bytes = (x or 0 for x in total)
    denominator = n_tokens + 0.5 * (n_words + 1)
    away = n_bytes > part_bytes
    words, found, word_levels = heavy_words(counts, max(1, -(-n_tokens // heavy)))
    known = spark.sparkContext.broadcast((words, found))
    levels = spark.sparkContext.broadcast((word_levels, *heavy_pairs(counts)) if away else None)
    whole = None if away else spark.sparkContext.broadcast(LevelFilter(segments, {r["segment"]: bytes(r["bits"]) for r in counts.select("segment", "bits").toLocalIterator()}))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for ids, hashes in _stretches(batches):
            yield _rows(place, ids, hashes, segments, known.value, denominator, None if whole is None else whole.value, n_tokens, n_words, levels.value)
            place += 1

    return _answered(map_arrow(texts, run, STRETCH), counts, segments, denominator, n_tokens, n_words, away, texts.schema["id"].dataType.simpleString(), id_col)


ANSWERED = "place long, segment int, counts binary, word_levels binary, pair_levels binary, texts binary, rare binary, codes binary, pair_codes binary, word_known binary, pair_known binary"


def _answered(rows: DataFrame, counts: DataFrame, segments: int, denominator: float, n_tokens: int, n_words: int, away: bool, id_type: str, id_col: str) -> DataFrame:
    """Questions meet counts and filter by segment; the answers return to their stretch.

    Tasks are as many as segments allow, so what one of them reads does not grow with the corpus.
    """
    through = ("texts", "rare", "codes", "pair_codes", "word_known", "pair_known")

    def meet(left, right):
        some = right.num_rows > 0
        words = np.frombuffer(right["words"][0].as_py(), np.uint64) if some else np.empty(0, np.uint64)
        n = np.frombuffer(right["word_counts"][0].as_py(), np.int64) if some else np.empty(0, np.int64)
        bits = np.frombuffer(right["bits"][0].as_py(), np.uint8) if some and away else np.empty(0, np.uint8)
        levels = lambda keys: levels_of(bits, keys).tobytes()
        answers = []
        for asked, pairs in zip(left["words"].to_pylist(), left["pairs"].to_pylist()):
            if asked is None:
                answers.append((None, None, None))
                continue
            keys = np.frombuffer(asked, np.uint64)
            answers.append((looked_up(keys, words, n).tobytes(), levels(keys & LOW) if away else b"", levels(unpacked(pairs)) if away else b""))
        columns = list(zip(*answers)) or [()] * 3
        return pa.table({"place": left["place"], "segment": left["segment"]} | {c: pa.array(x, pa.binary()) for c, x in zip(("counts", "word_levels", "pair_levels"), columns)} | {c: left[c] for c in through})

    def gather(table):
        table = table.take(pa.compute.sort_indices(table["segment"]))
        said = table.filter(pa.compute.is_null(table["texts"]))
        own = table.filter(pa.compute.is_valid(table["texts"])).to_pylist()[0]
        c, word_levels, pair_levels = (np.frombuffer(b"".join(said[k].to_pylist()), kind) for k, kind in (("counts", np.int64), ("word_levels", np.uint8), ("pair_levels", np.uint8)))
        texts = pa.ipc.open_stream(own["texts"]).read_next_batch()
        base, known, score = (texts.column(k).to_numpy().copy() for k in ("base", "n_known", "score"))
        owner, word, times = np.frombuffer(own["rare"], np.int32).reshape(3, -1)
        np.add.at(base, owner, times * np.log10((c[word] + 0.5) / denominator))
        np.add.at(known, owner, times * (c[word] > 0))
        if away:
            starts = np.cumsum([0, *texts.column("n_tokens").to_pylist()[:-1]])
            codes, pair_codes = (np.frombuffer(own[k], np.int32) for k in ("codes", "pair_codes"))
            levels = [np.frombuffer(own[k], np.uint8).astype(np.int64) for k in ("word_known", "pair_known")]
            for held, answers in zip(levels, (word_levels, pair_levels)):
                held[held == ASKED] = answers
            score = np.add.reduceat(log_probabilities(codes, pair_codes, starts, *levels, n_tokens, n_words), starts)
        return pa.table({id_col: texts.column("id"), "n_tokens": texts.column("n_tokens"), "n_known": pa.array(known), "train_tokens": pa.array([n_tokens] * len(base), pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    tasks = min(MOST_TASKS, max(MIN_SEGMENTS, segments // SEGMENTS_A_TASK))
    held = counts.select("segment", "words", "word_counts", *["bits"] * away)
    met = rows.repartition(tasks, "segment").groupBy("segment").cogroup(held.repartition(tasks, "segment").groupBy("segment")).applyInArrow(meet, ANSWERED)
    return met.repartition(tasks, "place").groupBy("place").applyInArrow(gather, f"`{id_col}` {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
