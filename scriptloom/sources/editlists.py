"""Captions, cut lists and time maps read back from what was rendered.

Each parser takes (stream_id, body), a file a row, as ``read_rendered`` gives them from any path
that Spark reads, and returns rows. Both line ends are understood. What a parser cannot read is a
row too: its numbers are null and ``bad`` holds the text, so a malformed file is seen and never
shifts what follows. Null and empty bodies have no rows. Repeated files are read as often as they
come; null recordings stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words_of

SEGMENT = "array<struct<seg: bigint, src_start: bigint, src_end: bigint, out_start: bigint>>"
CLOCK = r"(\d+):([0-5]\d):([0-5]\d)[,.](\d{3})"
TIMECODE = r"((\d+):([0-5]\d):([0-5]\d)[:;](\d{2,3}))"


def read_rendered(spark: SparkSession, path: str) -> DataFrame:
    """(stream_id, body) of the files of a folder.

    Files in folders ``stream_id=...``, as ``sinks.write_rendered`` makes them, have that
    recording; of others the name without its ending is the recording.
    """
    files = spark.read.text(path, wholetext=True)
    if "stream_id" not in files.columns:
        files = files.withColumn("stream_id", F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+?)(?:\.[^./]*)?$", 1))
    return files.select("stream_id", F.col("value").alias("body"))


def _lines(body: str) -> Column:
    return F.regexp_replace(body, "\r\n?", "\n")


def _matched(rows: DataFrame, column: str, pattern: str, groups: int) -> tuple[DataFrame, Column, Callable[[int], Column]]:
    """The rows with what the groups of a pattern hold, whether it matches, and a group by its number.

    The pattern takes a text whole, which does not begin with a line feed; only its last group may
    hold line feeds. It is matched once a row: no filter passes a generator, so neither the columns
    read from the groups nor what a reader asks of them repeat the match.
    """
    held = F.regexp_replace(column, pattern, "".join(f"\n${k}" for k in range(1, groups + 1)))
    found = rows.withColumn("_groups", F.explode(F.array(F.split(held, "\n", groups + 1))))
    return found, F.get("_groups", F.lit(0)) == "", lambda k: F.get("_groups", F.lit(k))


def _ms(groups: list[Column]) -> Column:
    h, m, s, ms = (g.cast("long") for g in groups)
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def parse_srt(files: DataFrame) -> DataFrame:
    """(stream_id, cue, start_ms, end_ms, text, bad) of subtitle files; lines of a cue are joined by a line feed."""
    blocks = files.select("stream_id", F.explode(F.split(F.trim(_lines("body"), F.lit("\n")), r"\n[ \t]*\n\s*")).alias("block")).where("trim(block) <> ''")
    pattern = rf"^\s*(\d+)[ \t]*\n{CLOCK}[ \t]*-->[ \t]*{CLOCK}[^\n]*(?:\n([\s\S]*))?$"
    blocks, ok, group = _matched(blocks, "block", pattern, 10)
    read = {"cue": group(1).cast("long"), "start_ms": _ms([group(k) for k in range(2, 6)]), "end_ms": _ms([group(k) for k in range(6, 10)]), "text": group(10)}
    return blocks.select("stream_id", *(F.when(ok, c).alias(name) for name, c in read.items()), F.when(~ok, F.col("block")).alias("bad"))


def cue_words(cues: DataFrame) -> DataFrame:
    """(stream_id, n, text): the words of captions in order, numbered so that ``align.reconcile`` takes them."""
    each = cues.where("cue is not null").select("stream_id", "cue", F.posexplode(words_of(F.col("text"))).alias("pos", "text"))
    return each.select("stream_id", (F.col("cue") * F.lit(1 << 32) + F.col("pos")).alias("n"), "text")


def frames_of(timecode: Column, fps: int) -> Column:
    """Whole frames of HH:MM:SS:FF."""
    parts = F.split(timecode, "[:;]")
    return _frames([F.get(parts, k) for k in range(4)], fps)


def _frames(parts: list[Column], fps: int) -> Column:
    h, m, s, f = (p.try_cast("long") for p in parts)
    return ((h * 60 + m) * 60 + s) * fps + f


def parse_edl(files: DataFrame, fps: int) -> DataFrame:
    """(stream_id, event, src_in, src_out, rec_in, rec_out, src_frame, rec_frame, n_frames, bad) of cut lists.

    Titles, comments and blank lines are no events. A cut whose source and record differ in
    length, or that ends before it begins, is bad.
    """
    lines = files.select("stream_id", F.explode(F.split(_lines("body"), "\n")).alias("line")).where(r"line rlike '^\\s*\\d+\\s'")
    pattern = rf"^\s*(\d+)\s+\S+\s+\S+\s+\S+(?:\s+\d+)?\s+{TIMECODE}\s+{TIMECODE}\s+{TIMECODE}\s+{TIMECODE}\s*$[\s\S]*"
    lines, matched, group = _matched(lines, "line", pattern, 21)
    names = {"src_in": 2, "src_out": 7, "rec_in": 12, "rec_out": 17}  # a timecode is a group, its four parts are the next
    a, b, c, d = (_frames([group(k + part) for part in range(1, 5)], fps) for k in names.values())
    ok = matched & F.coalesce((b - a == d - c) & (b > a), F.lit(False))
    read = {"event": group(1).cast("long")} | {name: group(k) for name, k in names.items()} | {"src_frame": a, "rec_frame": c, "n_frames": b - a}
    return lines.select("stream_id", *(F.when(ok, x).alias(name) for name, x in read.items()), F.when(~ok, F.col("line")).alias("bad"))


def parse_timeline(files: DataFrame) -> DataFrame:
    """(stream_id, seg, src_start, src_end, out_start, bad) of time maps in JSON."""
    parsed = files.where("trim(body) <> ''").withColumn("_all", F.from_json("body", SEGMENT))
    sound = F.coalesce(F.size("_all") >= 0, F.lit(False)) & F.coalesce(F.forall("_all", lambda x: x["seg"].isNotNull() & (x["src_start"] <= x["src_end"]) & x["out_start"].isNotNull()), F.lit(False))
    rows = parsed.where(sound).select("stream_id", F.inline("_all")).withColumn("bad", F.lit(None).cast("string"))
    empty = [F.lit(None).cast("long").alias(c) for c in ("seg", "src_start", "src_end", "out_start")]
    return rows.unionByName(parsed.where(~sound).select("stream_id", *empty, F.col("body").alias("bad")))
