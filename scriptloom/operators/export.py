"""Exports of a cut: time map, captions, transcript, edit lists, and the checks on them.

Null recordings are a recording of their own; words without index or times are left out of the
segments that need them. Empty tables give empty tables. Equal rows stay as often as they come
except where a key counts once (segments, cues). Columns beyond those named are ignored.
Texts that an export gathers are those of one recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, frames, padded, timecode
from .detect import by_stream
from .review import in_segments


def _in_spans(points: DataFrame, at: str, spans: DataFrame, start: Column, length: Column, value: Column, name: str) -> DataFrame:
    """(stream_id, at, seg, name): the span in which each point lies, and value + what it is past the start.

    Points and spans of a recording are laid in one order, in which each point meets the span
    that began last. So the work is a sort, not a comparison of points with spans.
    """
    span = F.struct("seg", start.alias("start"), length.alias("length"), value.alias("value"))
    begun = spans.where(F.col("stream_id").isNotNull() & start.isNotNull()).select("stream_id", start.alias(at), span.alias("span"))
    both = points.select("stream_id", at, F.lit(None).cast(begun.schema["span"].dataType).alias("span"), F.lit(True).alias("point")).unionByName(begun.withColumn("point", F.lit(False)))
    order = Window.partitionBy("stream_id").orderBy(at, "point", "span.length").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("span", F.last("span", ignorenulls=True).over(order)).where("point").withColumn("past", F.col(at) - F.col("span.start"))
    inside = F.col("past") < F.col("span.length")
    return met.select("stream_id", at, F.when(inside, F.col("span.seg")).alias("seg"), F.when(inside, F.col("span.value") + F.col("past")).alias(name))


def to_output_time(points: DataFrame, segs: DataFrame) -> DataFrame:
    """(stream_id, src_ms, seg, out_ms) of source times; times that were cut have null seg and out_ms.

    points: (stream_id, src_ms); null times and recordings are in no segment, repeated points
    are repeated. Segments of a recording must not overlap.
    """
    return _in_spans(points, "src_ms", segs, F.col("src_start"), F.col("src_end") - F.col("src_start"), F.col("out_start"), "out_ms")


def to_source_time(points: DataFrame, segs: DataFrame) -> DataFrame:
    """(stream_id, out_ms, seg, src_ms): the inverse on the output's times."""
    return _in_spans(points, "out_ms", segs, F.col("out_start"), F.col("src_end") - F.col("src_start"), F.col("src_start"), "src_ms")


def output_words(kept: DataFrame, gap_ms: int) -> DataFrame:
    """Kept words with seg, place in it, and times in the output."""
    placed = in_segments(kept, gap_ms)
    by_seg = Window.partitionBy("stream_id", "seg")
    placed = placed.withColumns({"src_start": F.min("start_ms").over(by_seg), "src_end": F.max("end_ms").over(by_seg), "place": F.row_number().over(by_seg.orderBy("idx")) - 1})
    # the first word of a segment adds its length; up to the segment of a word this counts that one too
    length = F.col("src_end") - F.col("src_start")
    added = F.sum(F.when(F.col("place") == 0, length).otherwise(0)).over(by_stream().rowsBetween(Window.unboundedPreceding, 0))
    shift = added - length - F.col("src_start")
    return placed.withColumn("_shift", shift).select("stream_id", "idx", "text", "seg", "place", (F.col("start_ms") + F.col("_shift")).alias("start_ms"), (F.col("end_ms") + F.col("_shift")).alias("end_ms"))


def _ordered_text(order: str, text: str, joiner: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), joiner)


def cues(kept: DataFrame, gap_ms: int, words_each: int) -> DataFrame:
    """(stream_id, cue, start_ms, end_ms, text) in output time; no cue crosses a cut."""
    grouped = output_words(kept, gap_ms).groupBy("stream_id", "seg", F.floor(F.col("place") / words_each).alias("part"))
    rows = grouped.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), _ordered_text("idx", "text", " ").alias("text"))
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("seg", "part")).cast("long")
    return rows.select("stream_id", number.alias("cue"), "start_ms", "end_ms", "text")


def srt(cue_rows: DataFrame) -> DataFrame:
    """(stream_id, body): one subtitle file for each recording."""
    block = F.concat(F.col("cue").cast("string"), F.lit("\n"), clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return cue_rows.withColumn("block", block).groupBy("stream_id").agg(_ordered_text("cue", "block", "\n").alias("body"))


def transcript(kept: DataFrame) -> DataFrame:
    """(stream_id, body): the kept words in order."""
    return kept.groupBy("stream_id").agg(_ordered_text("idx", "text", " ").alias("body"))


def edl_events(segs: DataFrame, fps: int) -> DataFrame:
    """(stream_id, event, src_in, src_out, rec_in, rec_out) in timecodes, the output without gaps."""
    n_in, n_out = frames(F.col("src_start"), fps), frames(F.col("src_end"), fps)
    placed = segs.select("stream_id", "seg", n_in.alias("f_in"), F.greatest(n_out, n_in + 1).alias("f_out"))
    before = Window.partitionBy("stream_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    rec = F.coalesce(F.sum(F.col("f_out") - F.col("f_in")).over(before), F.lit(0))
    placed = placed.withColumn("rec", rec)
    tc = lambda c: timecode(c, fps)
    return placed.select(
        "stream_id", (F.col("seg") + 1).alias("event"), tc(F.col("f_in")).alias("src_in"), tc(F.col("f_out")).alias("src_out"), tc(F.col("rec")).alias("rec_in"), tc(F.col("rec") + F.col("f_out") - F.col("f_in")).alias("rec_out")
    )


def edl(events: DataFrame) -> DataFrame:
    """(stream_id, body): a cut list with one video cut for each event, and the name of its clip."""
    line = F.concat(padded(F.col("event"), 3), F.lit("  AX       V     C        "), F.concat_ws(" ", "src_in", "src_out", "rec_in", "rec_out"), F.lit("\n* FROM CLIP NAME: "), F.col("stream_id").cast("string"), F.lit(".mp4"))
    body = F.concat(F.lit("TITLE: "), F.col("stream_id").cast("string"), F.lit("\nFCM: NON-DROP FRAME\n"), _ordered_text("event", "line", "\n"), F.lit("\n"))
    return events.withColumn("line", line).groupBy("stream_id").agg(body.alias("body"))


def fcpxml(segs: DataFrame, fps: int) -> DataFrame:
    """(stream_id, body): a timeline of clips, times as whole frames of the frame rate.

    The asset refers to ``<stream_id>.mp4`` beside the file and is as long as the last cut needs.
    """
    n_in = frames(F.col("src_start"), fps)
    length = F.greatest(frames(F.col("src_end"), fps) - n_in, F.lit(1))
    before = Window.partitionBy("stream_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    placed = segs.select("stream_id", "seg", n_in.alias("f_in"), length.alias("f_len")).withColumn("rec", F.coalesce(F.sum("f_len").over(before), F.lit(0)))
    time = lambda c: F.concat(F.col(c).cast("string"), F.lit(f"/{fps}s"))
    clip = F.concat(F.lit('<asset-clip ref="r2" offset="'), time("rec"), F.lit('" start="'), time("f_in"), F.lit('" duration="'), time("f_len"), F.lit('"/>'))
    total = F.concat(F.sum("f_len").cast("string"), F.lit(f"/{fps}s"))
    needed = F.concat(F.max(F.col("f_in") + F.col("f_len")).cast("string"), F.lit(f"/{fps}s"))
    name = F.col("stream_id").cast("string")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<fcpxml version="1.9"><resources><format id="r1" frameDuration="1/{fps}s"/><asset id="r2" name="'
    asset = F.concat(F.lit(head), name, F.lit('" start="0s" duration="'), needed, F.lit('" hasVideo="1" hasAudio="1" format="r1"><media-rep kind="original-media" src="./'), name, F.lit('.mp4"/></asset></resources><library><event><project><sequence format="r1" duration="'))
    body = F.concat(asset, total, F.lit('"><spine>'), _ordered_text("seg", "clip", ""), F.lit("</spine></sequence></project></event></library></fcpxml>\n"))
    return placed.withColumn("clip", clip).groupBy("stream_id").agg(body.alias("body"))


def timeline_map(segs: DataFrame) -> DataFrame:
    """(stream_id, body): the time map of a recording as one JSON array, by segment."""
    one = F.struct("seg", "src_start", "src_end", "out_start")
    return segs.groupBy("stream_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("body"))


def check_duration(segs: DataFrame, observed: DataFrame, tolerance_ms: int) -> DataFrame:
    """(stream_id, planned_ms, observed_ms, ok); recordings on one side alone are not ok."""
    planned = segs.groupBy("stream_id").agg(F.sum(F.col("src_end") - F.col("src_start")).alias("planned_ms"))
    both = planned.join(observed.select("stream_id", "observed_ms"), "stream_id", "full")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("planned_ms") - F.col("observed_ms")) <= tolerance_ms, F.lit(False)))


def check_words(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(stream_id, n_expected, n_observed, n_different): word for word, by position.

    Both sides: (stream_id, n, text), n counting from 0 in each recording.
    """
    a = expected.select("stream_id", "n", F.col("text").alias("a"))
    b = observed.select("stream_id", "n", F.col("text").alias("b"))
    both = a.join(b, ["stream_id", "n"], "full")
    return both.groupBy("stream_id").agg(F.count("a").alias("n_expected"), F.count("b").alias("n_observed"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"))


def numbered(kept: DataFrame) -> DataFrame:
    """(stream_id, n, text): kept words by their position in the output."""
    return kept.select("stream_id", (F.row_number().over(Window.partitionBy("stream_id").orderBy("idx")) - 1).cast("long").alias("n"), "text")
