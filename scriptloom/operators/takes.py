"""Stumbles over phrases, words cut off, and takes that were broken off and said again.

All three work on the words of a recording as numbers of places, by one sort of the recording;
what follows touches only words that are said again. Null recordings and indexes are left out,
null and bare punctuation words repeat nothing. Words that share an index are ordered by their
text. Empty tables give empty tables; columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare
from .align import numbered
from .detect import proposal


def _by_place():
    return Window.partitionBy("stream_id").orderBy("pos")


def _indexes(rows: DataFrame, side: DataFrame, places: dict[str, str]) -> DataFrame:
    """``rows`` with the index of the word at each place column, under the name that goes with it.

    The places of all columns meet the words in one join.
    """
    asked = rows.withColumn("_row", F.struct(*rows.columns)).select("stream_id", "_row", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(place).alias("pos")) for name, place in places.items()))).alias("_at"))
    met = asked.select("stream_id", "_row", F.col("_at.name").alias("_name"), F.col("_at.pos").alias("pos")).join(side.select("stream_id", "pos", "idx"), ["stream_id", "pos"])
    found = met.groupBy("_row").agg(*(F.max(F.when(F.col("_name") == name, F.col("idx"))).alias(name) for name in places))
    return found.select("_row.*", *places)


def _tandem_runs(side: DataFrame, longest: int) -> DataFrame:
    """(stream_id, s, e, period): maximal runs of places that repeat with a period, none inside one of a shorter period."""
    order = _by_place()
    hits = F.array_compact(F.array(*(F.when((F.col("w") != "") & (F.lead("w", p).over(order) == F.col("w")), F.lit(p)) for p in range(1, longest + 1))))
    each = side.select("stream_id", "pos", hits.alias("hits")).select("stream_id", "pos", F.explode("hits").alias("period"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("stream_id", "period").orderBy("pos"))
    runs = each.withColumn("_island", island).groupBy("stream_id", "period", "_island").agg(F.min("pos").alias("s"), F.count(F.lit(1)).alias("n")).where("n >= period")
    runs = runs.select("stream_id", "s", (F.col("s") + F.col("n") + F.col("period")).alias("e"), "period")
    before = Window.partitionBy("stream_id").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    if longest == 1:
        return runs
    reach = {f"_{q}": F.max(F.when(F.col("period") == q, F.col("e"))).over(before) for q in range(1, longest)}
    covered = F.exists(F.array(*(F.when(F.col("period") > q, F.col(f"_{q}") >= F.col("e")) for q in range(1, longest))), lambda x: F.coalesce(x, F.lit(False)))
    return runs.withColumns(reach).where(~covered).select("stream_id", "s", "e", "period")


def tandems(words: DataFrame, longest: int = 4) -> DataFrame:
    """(stream_id, first_idx, last_idx, period, times): phrases of up to ``longest`` words said several times on end.

    A run is as long as it goes on repeating; times counts its whole phrases. "i want i want i" is
    one run of five words, period 2, twice.
    """
    side = numbered(words, bare)
    runs = _tandem_runs(side, longest).withColumn("_last", F.col("e") - 1)
    found = _indexes(runs, side, {"first_idx": "s", "last_idx": "_last"})
    return found.select("stream_id", "first_idx", "last_idx", F.col("period").cast("long").alias("period"), F.expr("(e - s) div period").alias("times"))


def phrase_stumbles(words: DataFrame, longest: int = 4) -> DataFrame:
    """Proposals for all sayings of a phrase but the last whole one, and for words cut off."""
    side = numbered(words, bare)
    gone = _tandem_runs(side, longest).select("stream_id", F.explode(F.expr("sequence(s, s + ((e - s) div period - 1) * period - 1)")).alias("pos")).distinct()
    again = side.join(gone, ["stream_id", "pos"], "left_semi").select("stream_id", "idx")
    return proposal(again.unionByName(cut_offs(words).select("stream_id", "idx")).distinct(), "stumble")


#: Marks that recognisers put at the end of a word that was broken off.
CUT_MARKS = "-–—…"


def cut_offs(words: DataFrame) -> DataFrame:
    """(stream_id, idx, by): words that end in a mark of ``CUT_MARKS`` and begin the next word, and the index of that one."""
    side = numbered(words, F.lower)
    order = _by_place()
    stem = F.regexp_replace(F.regexp_replace("w", f"(?:\\.\\.\\.|[{CUT_MARKS}])+$", ""), "^[.,;:!?\"'()]+", "")
    marked = side.withColumns({"_stem": stem, "_next": bare(F.lead("w").over(order)), "by": F.lead("idx").over(order)})
    begun = F.col("w").rlike(f"(?:\\.\\.\\.|[{CUT_MARKS}])$") & (F.col("_stem") != "") & F.startswith("_next", "_stem") & (F.char_length("_next") > F.char_length("_stem"))
    return marked.where(begun).select("stream_id", "idx", "by")


def _said_again(words: DataFrame, gram: int, window_ms: int, gap: int, drift: int, tail: int) -> tuple[DataFrame, DataFrame]:
    """The numbered words, and (stream_id, s, e, again): places s to e go, for what begins at again."""
    timed = words.select("stream_id", F.col("idx").cast("long").alias("idx"), F.coalesce("text", F.lit("")).alias("_text"), "start_ms", "end_ms").where("stream_id is not null and idx is not null")
    pos = F.row_number().over(Window.partitionBy("stream_id").orderBy("idx", "_text")) - 1
    side = timed.select("stream_id", "idx", bare(F.col("_text")).alias("w"), pos.cast("long").alias("pos"), "start_ms", "end_ms")
    order = _by_place()
    run = side.select("stream_id", "pos", "start_ms", F.array(*(F.lead("w", k).over(order) for k in range(gram))).alias("grams"), F.lead("end_ms", gram - 1).over(order).alias("end_ms"), F.lead("w", gram - 1).over(order).alias("_last"))
    run = run.where("_last is not null and not array_contains(grams, '')")
    same = Window.partitionBy("stream_id", "grams").orderBy("pos")
    seeds = run.select("stream_id", "pos", (F.lead("pos").over(same) - F.col("pos")).alias("d"), (F.lead("start_ms").over(same) - F.col("end_ms")).alias("_wait")).where((F.col("d") >= gram) & (F.col("_wait") <= window_ms)).drop("_wait")
    # seeds of one distance that follow each other are one span of equal words
    island = F.col("pos") - F.row_number().over(Window.partitionBy("stream_id", "d").orderBy("pos"))
    spans = seeds.withColumn("_island", island).groupBy("stream_id", "d", "_island").agg(F.min("pos").alias("s"), (F.max("pos") + gram).alias("e"))
    # spans that lie close and are said again at about the same distance are one take
    near = Window.partitionBy("stream_id").orderBy("s", "d")
    new = F.coalesce((F.col("s") - F.lag("e").over(near) > gap) | (F.abs(F.col("d") - F.lag("d").over(near)) > drift), F.lit(True))
    chained = spans.withColumn("_new", new.cast("int")).withColumn("_chain", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    takes = chained.groupBy("stream_id", "_chain").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min(F.struct("s", F.col("d"))).alias("_first"))
    again = F.col("s") + F.col("_first.d")
    end = F.least("e", again)
    return side, takes.select("stream_id", "s", F.when(again - end <= tail, again).otherwise(end).alias("e"), again.alias("again"))


def aborted_takes(words: DataFrame, gram: int = 4, window_ms: int = 60_000, gap: int = 3, drift: int = 2, tail: int = 6) -> DataFrame:
    """(stream_id, first_idx, last_idx, again_idx): words that are said again, and where.

    Runs of ``gram`` words seed a take: each meets its next saying, if that begins within
    ``window_ms`` of its end. Seeds grow to spans of equal words, and spans at most ``gap`` words
    apart, whose distances to their second saying differ by ``drift`` at most, are one take. The
    earlier saying goes, with the up to ``tail`` words between it and the new start, which broke off.
    Neither full stops nor the number of sentences between play a part. Words without times seed
    nothing.
    """
    side, takes = _said_again(words, gram, window_ms, gap, drift, tail)
    found = _indexes(takes.withColumn("_last", F.col("e") - 1), side, {"first_idx": "s", "last_idx": "_last", "again_idx": "again"})
    return found.select("stream_id", "first_idx", "last_idx", "again_idx")


def aborted_words(words: DataFrame, gram: int = 4, window_ms: int = 60_000, gap: int = 3, drift: int = 2, tail: int = 6) -> DataFrame:
    """Proposals for the words of ``aborted_takes``."""
    side, takes = _said_again(words, gram, window_ms, gap, drift, tail)
    gone = takes.select("stream_id", F.explode(F.expr("sequence(s, e - 1)")).alias("pos")).distinct()
    return proposal(side.join(gone, ["stream_id", "pos"], "left_semi"), "retake")
