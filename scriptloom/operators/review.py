"""From proposals to kept words and segments: protection, union, overrides, mismatches, seams.

Null recordings and indexes meet nothing in joins: such words are neither proposed, protected
nor overridden, and are kept. Repeated proposals and decisions of a word count once; repeated
words are decided each. Empty tables give empty tables, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare, words_of
from ..session import parts_of
from .detect import by_stream

#: Characters of text in a part of stand-in words, at most and, where there are more cores than that fills, at least.
PART_CHARS, LEAST_CHARS = 1 << 19, 1 << 16


def protect(proposals: DataFrame, words: DataFrame, protected: DataFrame) -> DataFrame:
    """Proposals without those on words whose bare form must never be deleted."""
    safe = words.join(protected.select(F.col("token").alias("_token")).distinct(), bare(F.col("text")) == F.col("_token"), "left_semi").select("stream_id", "idx")
    return proposals.join(safe, ["stream_id", "idx"], "left_anti")


def union_layers(layers: dict[str, DataFrame], enabled: tuple[str, ...]) -> DataFrame:
    """Proposals of the enabled layers, one row for each layer and word.

    A layer that is off, or whose input is missing, is left out when the plan is built. At
    least one layer must be given.
    """
    chosen = [layers[k] for k in enabled if k in layers] or [next(iter(layers.values())).limit(0)]
    return reduce(DataFrame.unionByName, chosen).distinct()


def with_reasons(proposals: DataFrame) -> DataFrame:
    """(stream_id, idx, reasons, n_layers): one row for each proposed word."""
    return proposals.groupBy("stream_id", "idx").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.count_distinct("layer").alias("n_layers"))


def decided_at_once(flagged: DataFrame, enabled: tuple[str, ...], other: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """What ``protect``, ``with_reasons`` and ``decided`` give, from flagged words in one pass.

    flagged: words as ``detect.flagged`` gives them; their own layers (filler, stumble) are
    read from the row. other: proposals of further layers. The result adds layers and n_layers to that of ``decided``.
    """
    own = [F.when(F.col(layer), F.lit(layer)) for layer in ("filler", "stumble") if layer in enabled]
    layers = reasons = F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")
    asked = {}
    if other is not None:
        asked |= {"_reasons": (other, F.col("reason"), F.collect_set), "_layers": (other, F.col("layer"), F.collect_set)}
    if decisions is not None:
        asked["_user_keep"] = (decisions, F.col("keep"), F.max)
    out = _beside(flagged, asked)
    if other is not None:
        layers, reasons = (F.array_union(own_part, c) for own_part, c in ((layers, "_layers"), (reasons, "_reasons")))
    open_to = F.when(F.col("protected"), F.array().cast("array<string>"))
    out = out.withColumns({"layers": F.array_sort(F.coalesce(open_to, layers)), "reasons": F.array_sort(F.coalesce(open_to, reasons))})
    out = out.withColumn("proposed", F.size("layers") > 0).withColumns({"n_layers": F.size("layers").cast("long"), "reasons": F.when(F.col("proposed"), F.col("reasons"))})
    keep = ~F.col("proposed")
    return out.withColumn("keep", keep if decisions is None else F.coalesce("_user_keep", keep)).drop(*asked)


def _beside(words: DataFrame, asked: dict[str, tuple[DataFrame, Column, Callable[[Column], Column]]]) -> DataFrame:
    """The words with what other tables (stream_id, idx, ...) say of them: by name a table, a column of it and its aggregate.

    Rows of all tables are laid beside the words, by recording and index, which costs a sort of a
    recording. A join by both keys would shuffle all words once more. Null keys meet nothing.
    """
    rows = words.withColumn("_word", F.lit(True))
    kinds = {k: words.schema[k].dataType for k in ("stream_id", "idx")}
    for df in {id(df): df for df, _, _ in asked.values()}.values():
        said = df.select(*(F.col(k).try_cast(kind).alias(k) for k, kind in kinds.items()), *(c.alias(name) for name, (of, c, _) in asked.items() if of is df))
        rows = rows.unionByName(said.where("stream_id is not null and idx is not null"), allowMissingColumns=True)
    place = Window.partitionBy("stream_id", "idx")
    return rows.withColumns({name: f(F.col(name)).over(place) for name, (_, _, f) in asked.items()}).where("_word").drop("_word")


def decided(words: DataFrame, preselected: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """All words with proposed, reasons and keep; the user's decision wins over the proposal.

    Contradicting decisions on a word keep it.
    """
    out = words.join(preselected.select("stream_id", "idx", "reasons", F.lit(True).alias("proposed")), ["stream_id", "idx"], "left").withColumn("proposed", F.coalesce("proposed", F.lit(False)))
    if decisions is None:
        return out.withColumn("keep", ~F.col("proposed"))
    said = decisions.where("keep is not null").groupBy("stream_id", "idx").agg(F.max("keep").alias("user_keep"))
    return out.join(said, ["stream_id", "idx"], "left").withColumn("keep", F.coalesce("user_keep", ~F.col("proposed"))).drop("user_keep")


def misheard(words: DataFrame, manuscript: DataFrame) -> DataFrame:
    """(stream_id, idx, text): words whose bare form the manuscript of their recording never uses.

    Recordings without a manuscript have no suspects.
    """
    vocabulary = manuscript.select("stream_id", bare(F.col("text")).alias("_token")).distinct()
    mine = words.withColumn("_token", bare(F.col("text"))).where("_token <> ''").join(vocabulary.select("stream_id").distinct(), "stream_id", "left_semi")
    return mine.join(vocabulary, ["stream_id", "_token"], "left_anti").select("stream_id", "idx", "text")


def misheard_in_context(words: DataFrame, manuscript: DataFrame) -> DataFrame:
    """Words in no word pair, with the word before or after, that their recording's manuscript uses.

    Recordings without a manuscript have no suspects.
    """

    def pairs(df: DataFrame) -> DataFrame:
        return df.select("stream_id", "idx", "text", bare(F.col("text")).alias("a"), F.lead(bare(F.col("text"))).over(by_stream()).alias("b"))

    known = pairs(manuscript).where("b is not null").select("stream_id", "a", "b").distinct()
    held = pairs(words).where("b is not null").join(known, ["stream_id", "a", "b"], "left_semi").select("stream_id", F.explode(F.array(F.col("idx"), F.col("idx") + 1)).alias("idx")).distinct()
    mine = words.join(manuscript.select("stream_id").distinct(), "stream_id", "left_semi")
    return mine.join(held, ["stream_id", "idx"], "left_anti").select("stream_id", "idx", "text")


def in_segments(kept: DataFrame, gap_ms: int) -> DataFrame:
    """Kept words with seg: a new one begins where words are missing or the pause is too long."""
    new = F.coalesce((F.col("idx") != F.lag("idx").over(by_stream()) + 1) | (F.col("start_ms") - F.lag("end_ms").over(by_stream()) > gap_ms), F.lit(True))
    marked = kept.withColumn("_new", new.cast("long"))
    return marked.withColumn("seg", F.sum("_new").over(by_stream().rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def segments(kept: DataFrame, gap_ms: int) -> DataFrame:
    """(stream_id, seg, src_start, src_end, out_start, n_words): the cut and its time map."""
    spans = in_segments(kept, gap_ms).groupBy("stream_id", "seg").agg(F.min("start_ms").alias("src_start"), F.max("end_ms").alias("src_end"), F.count(F.lit(1)).alias("n_words"))
    before = Window.partitionBy("stream_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("out_start", F.coalesce(F.sum(F.col("src_end") - F.col("src_start")).over(before), F.lit(0))).select("stream_id", "seg", "src_start", "src_end", "out_start", "n_words")


def seams(kept: DataFrame, gap_ms: int, width: int) -> DataFrame:
    """(stream_id, seg, before, after): the words on both sides of the cut before each segment."""
    around = [F.array_join(F.array_compact(F.array(*(f("text", k).over(by_stream()) for k in order))), " ") for f, order in ((F.lag, range(width, 0, -1)), (F.lead, range(0, width)))]
    placed = in_segments(kept, gap_ms).withColumn("before", around[0]).withColumn("after", around[1])
    first = F.row_number().over(Window.partitionBy("stream_id", "seg").orderBy("idx"))
    return placed.withColumn("_n", first).where("_n = 1 and seg > 0").select("stream_id", "seg", "before", "after")


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stream_id, i, line) of texts by line."""
    return docs.select(F.col(id_col).alias("stream_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


def stand_in_words(conversations: DataFrame) -> DataFrame:
    """Timed words from conversation turns: 40 + 60 ms a character, pauses by punctuation.

    Turns are dealt by recording before they are split, so texts are shuffled, not words, and what
    follows by recording stays in these parts, whose number grows with the texts.
    """
    turns = conversations.select(F.col("conv_id").alias("stream_id"), "turn", "text").repartition(word_parts(conversations), "stream_id")
    each = turns.select("stream_id", "turn", F.posexplode(words_of(F.col("text"))).alias("pos", "text"))
    order = Window.partitionBy("stream_id").orderBy("turn", "pos")
    took = 40 + 60 * F.char_length("text")
    pause = F.when(F.col("text").endswith("."), 900).when(F.col("text").endswith(","), 250).otherwise(20)
    start = F.coalesce(F.sum(took + pause).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return each.select("stream_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "text", start.alias("start_ms"), (start + took).cast("long").alias("end_ms"))


def word_parts(conversations: DataFrame) -> int:
    """In how many parts the words of these turns are dealt."""
    return parts_of(conversations, F.char_length("text"), PART_CHARS, LEAST_CHARS)
