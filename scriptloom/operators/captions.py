"""Captions broken where they read best.

The words of a segment are cut into cues at least total cost, by dynamic programming over all
breaks. A cue pays, in whole numbers: the square of the characters it leaves of ``chars``; a price
for being there; a price if it ends in a word after which no break should stand, or, less, without
a mark at its end; and for what it shows faster than ``chars_a_second``. The last cue of a segment
pays nothing for its end. No cue has more than ``chars`` characters but one of a single longer word.
Of equally cheap ways the one with the longer first cue is taken, and so on.

A segment is one row with the list of its words, so work is its words times the words that fit a
cue. Null texts are left out; what else ``export.cues`` says of odd words holds here too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare
from ..session import ship_package
from .export import output_words


@dataclass(frozen=True)
class Reading:
    """What makes a cue readable, and what breaking these rules costs."""

    chars: int = 42
    chars_a_second: int = 17
    cue_price: int = 100
    bound_price: int = 600
    open_price: int = 150
    bound: tuple[str, ...] = ("a", "an", "and", "but", "der", "die", "et", "in", "la", "le", "of", "or", "the", "to", "und")
    marks: str = ".,;:!?。，！？"


def cue_cost(rules: Reading, chars: int, took_ms: int, bound: bool, closed: bool, last: bool) -> int:
    """Of one cue; chars is at most the limit, or the cue is one word."""
    slack = max(0, rules.chars - chars)
    end = 0 if last else rules.bound_price if bound else 0 if closed else rules.open_price
    return rules.cue_price + slack * slack + end + max(0, 1000 * chars - rules.chars_a_second * took_ms) // 100


def best_breaks(rules: Reading, words: list[tuple[int, int, int, bool, bool]]) -> list[int]:
    """Words of each cue in turn. words: (characters, start_ms, end_ms, bound, closed) of a segment."""
    n = len(words)
    best, size = [0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        chars, end, found = -1, words[i][2], None
        for j in range(i, n):
            chars += words[j][0] + 1
            if j > i and chars > rules.chars:
                break
            end = max(end, words[j][2])
            cost = cue_cost(rules, chars, end - words[i][1], words[j][3], words[j][4], j == n - 1) + best[j + 1]
            if found is None or cost <= found:
                found, size[i] = cost, j - i + 1
        best[i] = found
    out, i = [], 0
    while i < n:
        out.append(size[i])
        i += size[i]
    return out


def readable_cues(kept: DataFrame, gap_ms: int, rules: Reading = Reading()) -> DataFrame:
    """(stream_id, cue, start_ms, end_ms, text) in output time; no cue crosses a cut."""
    words = output_words(kept, gap_ms).where("text is not null")
    token = bare(F.col("text"))
    word = F.struct("place", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text", token.isin(*rules.bound).alias("bound"), F.substring("text", -1, 1).isin(*rules.marks).alias("closed"))
    segments = words.groupBy("stream_id", "seg").agg(F.array_sort(F.collect_list(word)).alias("words"))
    kind = segments.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for stream, seg, held in zip(*(batch[c].to_pylist() for c in ("stream_id", "seg", "words"))):
                at = 0
                for part, n in enumerate(best_breaks(rules, [(len(w["text"]), w["start_ms"], w["end_ms"], w["bound"], w["closed"]) for w in held])):
                    cue = held[at : at + n]
                    at += n
                    for column, value in zip(out, (stream, seg, part, min(w["start_ms"] for w in cue), max(w["end_ms"] for w in cue), " ".join(w["text"] for w in cue))):
                        column.append(value)
            types = (batch.schema.field("stream_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], ["stream_id", "seg", "part", "start_ms", "end_ms", "text"])

    ship_package(kept.sparkSession)
    rows = segments.mapInArrow(run, f"stream_id {kind}, seg long, part long, start_ms long, end_ms long, text string")
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("seg", "part")).cast("long")
    return rows.select("stream_id", number.alias("cue"), "start_ms", "end_ms", "text")
