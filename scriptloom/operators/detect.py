"""Layers that propose words for deletion: (stream_id, idx, layer, reason).

Every window is partitioned by recording, which bounds it by the length of one recording;
dimension tables are the lexicons of one user. Nulls: a word without text, time or index is
never proposed, and a null recording is a recording of its own. Words of a recording have
different indexes; a word that is repeated under one index is proposed once for each row by
fillers and stumbles and once by the other layers. Empty tables propose nothing. Columns
beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.distance import edit_distances
from ..functions.text import alike_by_length, bare
from ..session import ship_package


def by_stream():
    """The words of a recording in order."""
    return Window.partitionBy("stream_id").orderBy("idx")


def proposal(df: DataFrame, layer: str, reason: str | None = None) -> DataFrame:
    return df.select("stream_id", "idx", F.lit(layer).alias("layer"), F.lit(reason or layer).alias("reason"))


def silences(words: DataFrame, least_ms: int) -> DataFrame:
    """(stream_id, idx, start_ms, end_ms, gap_ms): pauses over the threshold before word idx."""
    before = F.lag("end_ms").over(by_stream())
    gaps = words.select("stream_id", "idx", before.alias("start_ms"), F.col("start_ms").alias("end_ms"))
    return gaps.withColumn("gap_ms", F.col("end_ms") - F.col("start_ms")).where(F.col("gap_ms") > least_ms)


def event_gaps(events: DataFrame, least_s: int) -> DataFrame:
    """(user_id, event_id, gap_s): whole seconds since the user's event before, over the threshold."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ts = F.col("ts").cast("timestamp")
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(order), ts)
    return events.select("user_id", "event_id", gap.alias("gap_s")).where(F.col("gap_s") > least_s)


def flagged(words: DataFrame, habits: DataFrame) -> DataFrame:
    """The words with bare, filler, protected and stumble, in one pass over each recording.

    habits: (token, rule), the lists of one user. Tokens are gathered to one row each, so a word
    meets one row at most, and are broadcast: a shuffle by the bare form would send all sayings of
    a common word to one task. A lexicon joins by the bare form,
    a stumble is a word that the next repeats.
    """
    has = lambda rule: F.max(F.coalesce(F.col("rule") == rule, F.lit(False)))
    rules = habits.where("token is not null").groupBy(F.col("token").alias("bare")).agg(has("filler").alias("filler"), has("protected").alias("protected"))
    after = F.lead("bare").over(by_stream())
    marked = words.withColumn("bare", bare(F.col("text"))).withColumn("stumble", F.coalesce((F.col("bare") == after) & (F.col("bare") != ""), F.lit(False)))
    none = F.lit(False)
    return marked.join(F.broadcast(rules), "bare", "left").withColumns({"filler": F.coalesce("filler", none), "protected": F.coalesce("protected", none)})


def fillers(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words whose bare form is a token of the lexicon (a user's list, broadcast by its size)."""
    tokens = lexicon.select(F.col("token").alias("_token")).distinct()
    return proposal(words.join(tokens, bare(F.col("text")) == F.col("_token"), "left_semi"), "filler")


def stumbles(words: DataFrame) -> DataFrame:
    """The earlier of two adjacent equal words."""
    after = F.lead(bare(F.col("text"))).over(by_stream())
    mine = bare(F.col("text"))
    return proposal(words.select("stream_id", "idx", ((mine == after) & (mine != "")).alias("again")).where("again"), "stumble")


def retakes(sentences: DataFrame, least: float, ahead: int = 1) -> DataFrame:
    """(stream_id, i, by): sentences that one of the next ``ahead`` says again; the last take stays.

    sentences: (stream_id, i, line), of any length and in any script. A sentence of fewer than
    two words is no take; a null line is none either, and nothing repeats it. Pairs that null
    lines, equality or lengths do not settle go to tasks in batches, which compute their distances together.
    """
    order = Window.partitionBy("stream_id").orderBy("i")
    enough = F.size(F.split(F.trim("line"), "\\s+")) >= 2
    near = range(1, ahead + 1)
    found = sentences.select("stream_id", "i", "line", *(F.lead(c, k).over(order).alias(f"{c}{k}") for k in near for c in ("i", "line")))
    told = found.where(enough).withColumns({f"told{k}": alike_by_length(F.col("line"), F.col(f"line{k}"), least) for k in near})
    some = told.where(reduce(Column.__or__, (F.coalesce(f"told{k}", F.lit(True)) for k in near)))
    opened = some.withColumns({f"line{k}": F.when(F.col(f"told{k}").isNull(), F.col(f"line{k}")) for k in near})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = pa.nulls(len(batch), batch["i1"].type)
            for k in near:
                said, own = batch[f"told{k}"], batch[f"i{k}"]
                yes = said.fill_null(False).to_numpy(zero_copy_only=False).copy()
                at = np.flatnonzero(pc.and_(said.is_null(), by.is_null()).to_numpy(zero_copy_only=False))
                a, b = (batch[c].take(pa.array(at)).to_pylist() for c in ("line", f"line{k}"))
                longer = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
                yes[at] = 1 - edit_distances(a, b) / longer >= least
                by = pc.coalesce(by, pc.if_else(pa.array(yes), own, pa.scalar(None, own.type)))
            yield pa.record_batch([batch["stream_id"], batch["i"], by], ["stream_id", "i", "by"]).filter(by.is_valid())

    ship_package(sentences.sparkSession)
    keys = [sentences.schema[c] for c in ("stream_id", "i")]
    return opened.mapInArrow(decide, StructType([*keys, StructField("by", keys[1].dataType)]))


def retake_words(words: DataFrame, sentences: DataFrame, taken: DataFrame, layer: str = "retake") -> DataFrame:
    """Proposals for the words of sentences that are said again.

    sentences: (stream_id, i, first_idx, last_idx); taken: (stream_id, i). Indexes between the
    first and the last that no word has are not proposed.
    """
    ranges = taken.join(sentences, ["stream_id", "i"]).select("stream_id", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    return proposal(words.join(ranges, ["stream_id", "idx"], "left_semi"), layer)


def sentences_of(words: DataFrame, pause_ms: int | None = None) -> DataFrame:
    """(stream_id, i, first_idx, last_idx, line): words up to one that ends in a full stop.

    With ``pause_ms`` a pause longer than that ends a sentence too, so recordings whose
    recogniser sets no punctuation have sentences. Words without times end none by a pause.
    """
    ends = F.coalesce(F.col("text").rlike("[.!?。！？]$"), F.lit(False))
    if pause_ms is not None:
        ends = ends | F.coalesce(F.lead("start_ms").over(by_stream()) - F.col("end_ms") > pause_ms, F.lit(False))
    closed = F.coalesce(F.sum(F.col("_ends").cast("long")).over(by_stream().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    return words.withColumn("_ends", ends).withColumn("i", closed).groupBy("stream_id", "i").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), line.alias("line"))


#: Sentences in a block of a recording; pairs of blocks are what tasks compare.
BLOCK_SENTENCES = 1024


def repeats(vectors: DataFrame, least: float) -> DataFrame:
    """(stream_id, i, by): sentences whose meaning a later one of the recording repeats, and the first such.

    vectors: (stream_id, i, embedding); null, zero and empty vectors and null keys repeat
    nothing, and vectors of different lengths do not meet. The whole recording is searched.
    Its sentences are cut into blocks, a row each, and a block is compared with itself where it
    lies. Only sentences that nothing in their own block repeats are gathered into blocks again,
    and those meet the blocks after theirs: pairs of blocks are the keys of an equi-join, so a long
    recording is spread over tasks. A pair is one matrix product in double precision, of which the
    first repetition of each sentence leaves. Where few sentences are repeated, the work is the
    square of the sentences of one recording, never of the table.
    """
    spark = vectors.sparkSession
    kind, vector = vectors.schema["stream_id"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString()
    vector = vector if vector == "array<float>" else "array<double>"
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    known = vectors.where("stream_id is not null and i is not null and size(embedding) > 0").select("stream_id", F.col("i").cast("long").alias("i"), F.col("embedding").cast(vector).alias("v"), norm.alias("norm")).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    order = Window.partitionBy("stream_id").orderBy("i", "v")

    def blocks(df: DataFrame, name: str, *more: Column) -> DataFrame:
        number = F.floor((F.row_number().over(order) - 1) / BLOCK_SENTENCES)
        return df.withColumn(name, number).groupBy("stream_id", name).agg(F.collect_list(F.struct("i", "v", "norm")).alias("held"), *more)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                held = batch["held"][r].values
                by = np.full(len(held), NEVER)
                for at, places, rows in _by_length(held).values():
                    by[at] = _later(places, rows, places, rows, least)
                fixed = [pa.repeat(batch[c][r], len(held)) for c in ("stream_id", "b")]
                yield pa.record_batch([*fixed, *(held.field(c) for c in ("i", "v", "norm")), pa.array(by, mask=by == NEVER)], ["stream_id", "b", "i", "v", "norm", "by"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                sides = [_by_length(batch[c][r].values) for c in ("early", "late")]
                for size in sides[0].keys() & sides[1].keys():
                    (_, i, u), (_, j, w) = sides[0][size], sides[1][size]
                    by = _later(i, u, j, w, least)
                    hit = by < NEVER
                    yield pa.record_batch([pa.repeat(batch["stream_id"][r], int(hit.sum())), pa.array(i[hit]), pa.array(by[hit])], ["stream_id", "i", "by"])

    ship_package(spark)
    late = blocks(known, "b")
    first = late.select("stream_id", "b", "held").mapInArrow(alone, f"stream_id {kind}, b long, i long, v {vector}, norm double, by long")
    # what is open goes on from the block after that of the first sentence of its new block
    early = blocks(first.where("by is null"), "a", F.min("b").alias("own")).withColumnRenamed("held", "early")
    last = late.select("stream_id", "b").groupBy("stream_id").agg(F.max("b").alias("last"))
    many = early.select("stream_id", "a").groupBy("stream_id").agg(F.max("a").alias("many"))
    early = early.join(last, "stream_id").where("own < last").select("stream_id", "a", F.explode(F.expr("sequence(own + 1, last)")).alias("b"), "early")
    late = late.join(many, "stream_id").where("b > 0").select("stream_id", F.explode(F.expr("sequence(0L, many)")).alias("a"), "b", F.col("held").alias("late"))
    found = early.join(late, ["stream_id", "a", "b"]).select("stream_id", "early", "late").mapInArrow(across, f"stream_id {kind}, i long, by long")
    return first.where("by is not null").select("stream_id", "i", "by").unionByName(found).groupBy("stream_id", "i").agg(F.min("by").alias("by"))


NEVER = np.iinfo(np.int64).max


def _later(i: np.ndarray, u: np.ndarray, j: np.ndarray, w: np.ndarray, least: float) -> np.ndarray:
    """For each of the unit vectors u at places i the first later place of j whose vector is alike, or NEVER."""
    return np.where((u @ w.T >= least) & (i[:, None] < j[None, :]), j[None, :], NEVER).min(axis=1)


def _by_length(held: pa.StructArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, places and unit vectors of a block, by the length of the vectors."""
    places, norms = (held.field(c).to_numpy(zero_copy_only=False) for c in ("i", "norm"))
    vectors = held.field("v")
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = flat[starts[at][:, None] + np.arange(size)] / norms[at][:, None]
        out[int(size)] = at, places[at], rows
    return out


def overlapping(words: DataFrame, intervals: DataFrame) -> DataFrame:
    """(stream_id, idx): words that overlap an interval of their recording.

    Words by their end and intervals by their start are laid in one order: of the intervals that
    begin before a word ends, one reaches into it if the latest end does. So the work is a sort of
    a recording, not a comparison of all with all.
    """
    timed = "stream_id is not null and start_ms is not null and end_ms is not null"
    spans = intervals.where(timed).select("stream_id", F.col("start_ms").alias("at"), F.col("end_ms").alias("until"))
    points = words.where(timed).select("stream_id", F.col("end_ms").alias("at"), "idx", "start_ms", F.lit(True).alias("word"))
    order = Window.partitionBy("stream_id").orderBy("at", F.col("word").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = points.unionByName(spans, allowMissingColumns=True).withColumn("until", F.max("until").over(order))
    return met.where("word and until > start_ms").select("stream_id", "idx").distinct()


def non_speech(words: DataFrame, intervals: DataFrame, least: float) -> DataFrame:
    """Words under events, such as coughs, that are scored at least so high."""
    return proposal(overlapping(words, intervals.where(F.col("score") >= least)), "event")


def unvoiced(words: DataFrame, voiced: DataFrame) -> DataFrame:
    """Words that no voice activity overlaps: likely invented by the recogniser."""
    return proposal(words.join(overlapping(words, voiced), ["stream_id", "idx"], "left_anti"), "unvoiced")
