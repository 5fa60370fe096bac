"""What reviewers changed, and examples for the next recording.

Null keys meet nothing and stay on their side; repeated keys multiply, as in any join. Null
classes are no corrections. Empty tables give empty tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package


def differences(preselected: DataFrame, final: DataFrame, keys: list[str]) -> DataFrame:
    """keys, proposed, kept and class of every item on either side.

    preselected: keys and proposed; final: keys and kept. restored: proposed and kept; added:
    cut without a proposal; agreed: the rest. Items that a side lacks count as not proposed,
    and as kept unless proposed.
    """
    both = preselected.join(final, keys, "full").withColumn("proposed", F.coalesce("proposed", F.lit(False)))
    both = both.withColumn("kept", F.coalesce("kept", ~F.col("proposed")))
    return both.withColumn("class", _class_of("proposed", "kept"))


def _class_of(proposed: str, kept: str) -> Column:
    both = F.col(proposed), F.col(kept)
    return F.when(both[0] & both[1], "restored").when(~both[0] & ~both[1], "added").otherwise("agreed")


def of_decided(whole: DataFrame) -> DataFrame:
    """The records of words that ``decided`` has decided, with reasons and text, without a join."""
    return whole.select("stream_id", "idx", "proposed", F.col("keep").alias("kept"), _class_of("proposed", "keep").alias("class"), "reasons", "text")


def summary(records: DataFrame, by: list[str]) -> DataFrame:
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def examples(history: DataFrame, per_reason: int) -> DataFrame:
    """(reason, rank, class, text, n): the commonest corrections for each reason.

    history: (class, reasons, text). Equal texts are counted before they are ranked, so a
    common correction is one row; ties go by class and text. Corrections without a reason have
    the reason ''.
    """
    reason = F.explode(F.when(F.coalesce(F.size("reasons"), F.lit(0)) > 0, F.col("reasons")).otherwise(F.array(F.lit(""))))
    counted = history.where("class <> 'agreed'").select(reason.alias("reason"), "class", "text").groupBy("reason", "class", "text").agg(F.count(F.lit(1)).alias("n"))
    return _ranked(counted, per_reason)


def _ranked(counted: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("n"), "class", "text"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select("reason", "rank", "class", "text", "n")


#: Corrections of a reason among which examples are chosen: its commonest.
CANDIDATES = 1000


def pick(candidates: list[tuple[int, str, str]], most: int) -> list[int]:
    """Places of up to ``most`` of (n, class, text), one after the other by n times the words not yet shown.

    Ties go by n, class and text; what shows no new word comes after all that does.
    """
    words = [frozenset((text or "").lower().split()) for _, _, text in candidates]
    left, shown, out = set(range(len(candidates))), set(), []
    while left and len(out) < most:
        best = min(left, key=lambda k: (-candidates[k][0] * len(words[k] - shown), -candidates[k][0], candidates[k][1], candidates[k][2] or ""))
        left.remove(best)
        shown |= words[best]
        out.append(best)
    return out


def varied_examples(history: DataFrame, per_reason: int) -> DataFrame:
    """(reason, rank, class, text, n): corrections for each reason that differ from each other.

    Chosen greedily, as ``pick`` says, among the ``CANDIDATES`` commonest of a reason, as
    ``examples`` counts them; a reason has no more than these in one group.
    """
    found = examples(history, CANDIDATES)

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        places = pick(list(zip(*(table[c].to_pylist() for c in ("n", "class", "text")))), per_reason)
        chosen = table.take(places)
        return chosen.set_column(chosen.schema.get_field_index("rank"), "rank", pa.array(range(1, len(places) + 1), pa.int32()))

    ship_package(history.sparkSession)
    return found.groupBy("reason").applyInArrow(choose, "reason string, rank int, class string, text string, n long")
