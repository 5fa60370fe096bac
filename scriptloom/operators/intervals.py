"""Algebra of time intervals, and intervals from frames of a signal.

Intervals are (stream_id, start_ms, end_ms), the end not included. Sets are worked by one sweep over
their ends: a start counts +1 or more, an end as much less, and running sums say what covers each
elementary span. So any number of sets of any overlap costs one sort of a recording's ends. Results
are disjoint, ordered and as long as can be.

Intervals with a null recording or end, and those that end before they have begun, are left out.
Repeated intervals count as often as they come in ``cover``, once elsewhere. Empty tables give empty
tables. Columns that are not named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import proposal


def _spans(sets: list[DataFrame]) -> DataFrame:
    """(stream_id, start_ms, end_ms, n0, n1, ...): elementary spans and how many intervals of each set cover them."""
    names = [f"n{k}" for k in range(len(sets))]

    def ends(df: DataFrame, k: int) -> DataFrame:
        sound = df.where("stream_id is not null and start_ms < end_ms")
        steps = [F.struct(F.col(c).cast("long").alias("at"), *(F.lit(way if i == k else 0).cast("long").alias(n) for i, n in enumerate(names))) for c, way in (("start_ms", 1), ("end_ms", -1))]
        return sound.select("stream_id", F.explode(F.array(*steps)).alias("e")).select("stream_id", "e.*")

    every = reduce(DataFrame.unionByName, (ends(df, k) for k, df in enumerate(sets)))
    order = Window.partitionBy("stream_id").orderBy("at")
    so_far = {n: F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in names}
    # of ends at one time the last one has counted them all, and it alone is followed by a later one
    return every.select("stream_id", F.col("at").alias("start_ms"), F.lead("at").over(order).alias("end_ms"), *(c.alias(n) for n, c in so_far.items())).where("start_ms < end_ms")


def _merged(spans: DataFrame, *by: str) -> DataFrame:
    """Spans that touch, with equal values of ``by``, as one.

    Only the first and the last span of each run are kept, then the first with the end of the last,
    all in the order in which the spans come.
    """
    order = Window.partitionBy("stream_id").orderBy("start_ms")
    goes_on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lag(c).over(order)) for c in by), F.coalesce(F.col("start_ms") == F.lag("end_ms").over(order), F.lit(False)))
    marked = spans.withColumn("_first", ~goes_on).withColumn("_last", F.coalesce(F.lead("_first").over(order), F.lit(True))).where("_first or _last")
    until = F.when(F.col("_last"), F.col("end_ms")).otherwise(F.lead("end_ms").over(order))
    return marked.withColumn("end_ms", until).where("_first").select("stream_id", "start_ms", "end_ms", *by)


def cover(intervals: DataFrame) -> DataFrame:
    """(stream_id, start_ms, end_ms, n): how many intervals cover each span, where any does."""
    return _merged(_spans([intervals]).where("n0 > 0").withColumnRenamed("n0", "n"), "n")


def union(*sets: DataFrame) -> DataFrame:
    """Where any set is."""
    return _merged(_spans(list(sets)).where(reduce(lambda a, b: a | b, (F.col(f"n{k}") > 0 for k in range(len(sets))))))


def intersection(*sets: DataFrame) -> DataFrame:
    """Where all sets are."""
    return _merged(_spans(list(sets)).where(reduce(lambda a, b: a & b, (F.col(f"n{k}") > 0 for k in range(len(sets))))))


def difference(intervals: DataFrame, without: DataFrame) -> DataFrame:
    """Where the first set is and the second is not."""
    return _merged(_spans([intervals, without]).where("n0 > 0 and n1 = 0"))


def silence_between(recordings: DataFrame, voiced: DataFrame, least_ms: int) -> DataFrame:
    """(stream_id, start_ms, end_ms, gap_ms): stretches of a recording of at least ``least_ms`` without voice.

    recordings: the extent of each. What is voiced outside it does not count; a recording
    without voice is silent from end to end.
    """
    quiet = difference(recordings, voiced).withColumn("gap_ms", F.col("end_ms") - F.col("start_ms"))
    return quiet.where(F.col("gap_ms") >= least_ms)


def voice_from_frames(frames: DataFrame, high: float, low: float, least_ms: int, bridge_ms: int, frame_ms: int) -> DataFrame:
    """(stream_id, start_ms, end_ms): stretches of a signal by two thresholds, without a trained model.

    frames: (stream_id, t_ms, energy). A stretch begins with a frame of ``high`` or more and goes on
    while frames are at ``low`` or more, ``frame_ms`` beyond its last frame; a pause between frames
    longer than ``bridge_ms`` ends it. Stretches at most ``bridge_ms`` apart become one, and those
    below ``least_ms`` go. Null frames are left out; of frames at one time the strongest counts.
    """
    order = Window.partitionBy("stream_id").orderBy("t_ms")
    known = frames.where("stream_id is not null and t_ms is not null and energy is not null").groupBy("stream_id", F.col("t_ms").cast("long").alias("t_ms")).agg(F.max("energy").alias("energy"))
    torn = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(order) > bridge_ms + frame_ms, F.lit(True))
    turn = F.when(F.col("energy") >= high, 1).when((F.col("energy") < low) | torn, 0)
    state = F.last("_turn", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = known.withColumn("_turn", turn).withColumn("_on", state).where("_on = 1")
    apart = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(order) > bridge_ms + frame_ms, F.lit(True))
    runs = inside.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("stream_id", "_run").agg(F.min("t_ms").alias("start_ms"), (F.max("t_ms") + frame_ms).alias("end_ms"))
    return found.where(F.col("end_ms") - F.col("start_ms") >= least_ms).select("stream_id", "start_ms", "end_ms")


def mostly_outside(words: DataFrame, voiced: DataFrame, most: float) -> DataFrame:
    """Proposals for words of which at most the share ``most`` is voiced: likely invented by the recogniser.

    Words without times, and those that take no time, are not proposed. A word that is repeated
    under its index and times is proposed once.
    """
    timed = words.where("stream_id is not null and idx is not null and start_ms < end_ms").select("stream_id", "idx", "start_ms", "end_ms").distinct()
    both = _voiced_ms(timed, union(voiced))
    return proposal(both.where(F.col("_ms") <= most * (F.col("end_ms") - F.col("start_ms"))), "unvoiced")


def _voiced_ms(words: DataFrame, voiced: DataFrame) -> DataFrame:
    """Words with _ms, how much of them is voiced: voice up to their end less voice up to their start, by one sort."""

    ends = F.array(*(F.struct(F.col(c).cast("long").alias("at"), F.lit(sign).alias("_sign")) for c, sign in (("end_ms", 1), ("start_ms", -1))))
    points = words.select(F.explode(ends).alias("p"), "stream_id", "idx", "start_ms", "end_ms").select("stream_id", "p.at", F.lit(None).cast("long").alias("_end"), "idx", "start_ms", "end_ms", "p._sign")
    empty: list[Column] = [F.lit(None).cast(words.schema[c].dataType).alias(c) for c in ("idx", "start_ms", "end_ms")]
    begun = voiced.select("stream_id", F.col("start_ms").cast("long").alias("at"), F.col("end_ms").cast("long").alias("_end"), *empty, F.lit(0).alias("_sign"))
    line = points.unionByName(begun)
    # spans of voice are disjoint: all but the last begun are over
    order = Window.partitionBy("stream_id").orderBy("at", F.abs("_sign"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.coalesce(F.sum(F.col("_end") - F.when(F.col("_end").isNotNull(), F.col("at"))).over(upto), F.lit(0))
    over = F.greatest(F.coalesce(F.last("_end", ignorenulls=True).over(upto), F.col("at")) - F.col("at"), F.lit(0))
    heard = line.withColumn("_heard", whole - over).where("_sign <> 0")
    return heard.groupBy("stream_id", "idx", "start_ms", "end_ms").agg(F.sum(F.col("_sign") * F.col("_heard")).alias("_ms"))
