"""What was heard against what was meant, word by word.

Two word tables of the same recordings are aligned: every word of either side is in one row of the
result, (stream_id, idx, m_idx, op). same: both say it; replaced: they differ there; inserted: only
heard, m_idx is null; deleted: only meant, idx is null.

Runs of ``gram`` words that each side of a recording has once are anchors. The longest chain of
anchors that goes forward on both sides splits a recording into stretches, so a recording of hours
is not aligned as a whole. Both sides lie in one order by recording, and anchors are met in it, so
words are dealt once; the words of a recording are one group of numbers. In a stretch the edit
distance is least. Short stretches fill all cells; in longer ones the band of cells around the
diagonal is doubled until the distance fits into it, and a path that leaves a band as wide as its
cost costs more than that. Of equally cheap ways the one is taken that, from the end on, pairs words
where it can, then drops a heard one, then a meant one. Without anchors a recording is one stretch,
and its work the product of its words and the distance.

Words of null recordings or indexes are left out, null texts are empty words. Words that share an
index stay, ordered by their text. Empty tables give empty tables; recordings of one side alone are
all inserted or all deleted. Columns that are not named are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare
from ..session import ship_package

#: Half the width of the first band, cells for which directions are held at once, and cells of a stretch that are all filled.
BAND, CELLS, SMALL = 16, 1 << 25, 1 << 13


def _row(cost: np.ndarray, differs: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next row of costs in a band, and whether each cell is reached by a pair (0), a heard (1) or a meant word (2).

    Cell k of row i is column i + k - band. A pair comes from the same cell of the row above, a heard
    word from the next one, a meant word from the cell before.
    """
    steps = np.arange(len(cost))
    pair, heard = cost + differs, np.append(cost[1:], outside[0]) + 1
    best = np.minimum(pair, heard)
    best[outside[1:].astype(bool)] = outside[0]
    out = np.minimum.accumulate(best - steps) + steps
    out[outside[1:].astype(bool)] = outside[0]
    return out, np.where(pair == out, 0, np.where(heard == out, 1, 2)).astype(np.uint8)


def edits(heard: np.ndarray, meant: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of a cheapest alignment in order; -1 stands for no word on that side.

    heard, meant: numbers that are equal where the words are.
    """
    tail: list[tuple[int, int]] = []
    n, m = len(heard), len(meant)
    while n and m and heard[n - 1] == meant[m - 1]:  # a pair at the end is always among the cheapest
        n, m = n - 1, m - 1
        tail.append((n, m))
    if not n or not m:
        tail += [(i, -1) for i in range(n - 1, -1, -1)] + [(-1, j) for j in range(m - 1, -1, -1)]
        return tail[::-1]
    if n * m <= SMALL:
        return _all_cells(heard[:n].tolist(), meant[:m].tolist(), n, m) + tail[::-1]
    band, far = max(BAND, abs(n - m)), np.int64(1 << 40)
    while True:
        width = 2 * band + 1
        step = max(1, CELLS // width)
        columns = np.arange(width) - band
        cost = np.where((columns >= 0) & (columns <= m), columns, far)
        held = [cost]

        def row(cost: np.ndarray, i: int, columns=columns) -> tuple[np.ndarray, np.ndarray]:
            j = columns + i
            inside = (j >= 0) & (j <= m)
            word = meant[np.clip(j - 1, 0, m - 1)]
            differs = np.where(j >= 1, (word != heard[i - 1]).astype(np.int64), far)
            return _row(cost, differs, np.append(far, ~inside))

        for i in range(1, n + 1):
            cost, _ = row(cost, i)
            if i % step == 0:
                held.append(cost)
        if cost[m - n + band] <= band:
            break
        band *= 2
    i, j = n, m
    while i or j:
        # directions of the rows since the last held one; the rest of the path goes through them
        first = max(0, (i - 1) // step * step)
        cost, ways = held[first // step], []
        for r in range(first + 1, i + 1):
            cost, way = row(cost, r)
            ways.append(way)
        while i > first or (i == 0 and j):
            way = 2 if i == 0 else ways[i - first - 1][j - i + band]
            tail.append((-1 if way == 2 else i - 1, -1 if way == 1 else j - 1))
            i, j = i - (way != 2), j - (way != 1)
    return tail[::-1]


def _all_cells(heard: list[int], meant: list[int], n: int, m: int) -> list[tuple[int, int]]:
    """What ``edits`` gives, by all cells: for short lists a row of a band costs more than these."""
    costs = [list(range(m + 1))]
    for i, word in enumerate(heard, 1):
        above, here, left = costs[-1], [i], i
        for j, other in enumerate(meant):
            left = min(above[j] + (word != other), above[j + 1] + 1, left + 1)
            here.append(left)
        costs.append(here)
    out = []
    while n and m:
        cost = costs[n][m]
        if cost == costs[n - 1][m - 1] + (heard[n - 1] != meant[m - 1]):
            n, m = n - 1, m - 1
            out.append((n, m))
        elif cost == costs[n - 1][m] + 1:
            n -= 1
            out.append((n, -1))
        else:
            m -= 1
            out.append((-1, m))
    out += [(i, -1) for i in range(n - 1, -1, -1)] + [(-1, j) for j in range(m - 1, -1, -1)]
    return out[::-1]


def longest_chain(places: np.ndarray) -> np.ndarray:
    """Positions of a longest increasing run of different numbers; of those the one that is last, from the end on."""
    ends: list[int] = []
    length = np.empty(len(places), np.int64)
    for k, p in enumerate(places.tolist()):
        at = bisect_left(ends, p) if ends and p <= ends[-1] else len(ends)
        ends[at : at + 1] = [p]
        length[k] = at + 1
    chosen, need, below = [], len(ends), None
    for k in range(len(places) - 1, -1, -1):
        if length[k] == need and (below is None or places[k] < below):
            chosen.append(k)
            need, below = need - 1, places[k]
    return np.array(chosen[::-1], np.int64)


def numbered(words: DataFrame, form: Callable[[Column], Column]) -> DataFrame:
    """(stream_id, idx, w, pos): compared forms of the words, counted from 0 in each recording."""
    known = words.where("stream_id is not null and idx is not null").select("stream_id", F.col("idx").cast("long").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    pos = F.row_number().over(Window.partitionBy("stream_id").orderBy("idx", "text")) - 1
    return known.select("stream_id", "idx", form(F.col("text")).alias("w"), pos.cast("long").alias("pos"))


def _laid(heard: DataFrame, meant: DataFrame, gram: int) -> DataFrame:
    """(stream_id, side, pos, idx, w, m_pos): both sides (0 heard, 1 meant), and where the run that begins at a heard word is meant, if each side has it once."""
    both = heard.withColumn("side", F.lit(0)).unionByName(meant.withColumn("side", F.lit(1)))
    order = Window.partitionBy("stream_id", "side").orderBy("pos")
    runs = both.withColumns({"grams": F.array(*(F.lead("w", k).over(order) for k in range(gram))), "_last": F.lead("w", gram - 1).over(order)})
    same = Window.partitionBy("_hash", "stream_id", "grams")  # the hash alone orders nearly all runs
    mine, there = F.col("side") == 0, F.col("side") == 1
    once = F.col("_last").isNotNull() & (F.count_if(mine).over(same) == 1) & (F.count_if(there).over(same) == 1)
    return runs.withColumn("_hash", F.xxhash64("stream_id", "grams")).withColumn("m_pos", F.when(once & mine, F.max(F.when(there, F.col("pos"))).over(same))).select("stream_id", "side", "pos", "idx", "w", "m_pos")


def _paired(heard: np.ndarray, meant: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of one recording, of which -1 is none. places: where the run at each heard word is meant, or -1."""
    met = np.flatnonzero(places >= 0)
    chosen = met[longest_chain(places[met])]
    pairs = [(chosen, places[chosen])]
    ends = [np.append(chosen, len(heard)), np.append(places[chosen], len(meant))]
    starts = [np.append(0, e[:-1] + 1) for e in ends]
    for i, k, j, m in zip(*(x[np.flatnonzero((ends[0] > starts[0]) | (ends[1] > starts[1]))].tolist() for x in (starts[0], ends[0], starts[1], ends[1]))):
        if i == k or j == m:
            pairs.append((np.append(np.arange(i, k), np.full(m - j, -1)), np.append(np.full(k - i, -1), np.arange(j, m))))
        else:
            found = np.array(edits(heard[i:k], meant[j:m]), np.int64)
            pairs.append(tuple(np.where(found < 0, -1, found + [i, j]).T))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*pairs))


def align(heard: DataFrame, meant: DataFrame, gram: int = 3, form: Callable[[Column], Column] = bare) -> DataFrame:
    """(stream_id, idx, m_idx, op) from two tables (stream_id, idx, text). ``form`` gives what is compared of a word."""
    spark = heard.sparkSession
    both = _laid(numbered(heard, form), numbered(meant, form), gram)
    kind = both.schema["stream_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("pos", "ascending")])
        n = int(np.count_nonzero(table["side"].to_numpy() == 0))
        words = table["w"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        at = table["idx"].to_numpy()
        i, j = _paired(words[:n], words[n:], table["m_pos"].fill_null(-1).to_numpy()[:n])
        equal = (i >= 0) & (j >= 0)
        equal[equal] = words[:n][i[equal]] == words[n:][j[equal]]
        ops = pa.array(["deleted", "inserted", "same", "replaced"]).take(pa.array(np.where(i < 0, 0, np.where(j < 0, 1, np.where(equal, 2, 3)))))
        idx, m_idx = (pa.array(at[np.where(k < 0, 0, k + first)], pa.int64(), mask=k < 0) for k, first in ((i, 0), (j, n)))
        stream = pa.repeat(table["stream_id"][0], len(i))
        return pa.table([stream, idx, m_idx, ops], ["stream_id", "idx", "m_idx", "op"])

    ship_package(spark)
    return both.groupBy("stream_id").applyInArrow(run, f"stream_id {kind}, idx long, m_idx long, op string")


def suspects(words: DataFrame, manuscript: DataFrame, gram: int = 3) -> DataFrame:
    """(stream_id, idx, text, meant): heard words that the manuscript of their recording lacks there, and its word if it has one.

    Recordings without a manuscript have no suspects. Words without letters are never suspects;
    words that share an index are suspects together.
    """
    have = manuscript.where("stream_id is not null").select("stream_id").distinct()
    mine = words.join(have, "stream_id", "left_semi")
    odd = align(mine, manuscript, gram).where("op in ('replaced', 'inserted')").select("stream_id", "idx", "m_idx")
    said = odd.join(mine.select("stream_id", "idx", "text").where(bare(F.col("text")) != ""), ["stream_id", "idx"])
    return said.join(manuscript.select("stream_id", F.col("idx").cast("long").alias("m_idx"), F.col("text").alias("meant")), ["stream_id", "m_idx"], "left").select("stream_id", "idx", "text", "meant")


def reconcile(expected: DataFrame, observed: DataFrame, gram: int = 3) -> DataFrame:
    """(stream_id, n_expected, n_observed, n_lost, n_added, n_changed): word for word, by alignment of the exact texts.

    Both sides: (stream_id, n, text). A word that is lost is one difference, not one for each
    word after it. Recordings of one side alone are all lost or all added.
    """
    sides = [df.select("stream_id", F.col("n").alias("idx"), "text") for df in (observed, expected)]
    rows = align(*sides, gram, lambda text: text)
    count = lambda op: F.count_if(F.col("op") == op)
    return rows.groupBy("stream_id").agg(F.count("m_idx").alias("n_expected"), F.count("idx").alias("n_observed"), count("deleted").alias("n_lost"), count("inserted").alias("n_added"), count("replaced").alias("n_changed"))
