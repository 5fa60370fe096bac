"""Alignment against plain dynamic programming."""

import random

import numpy as np
import pytest

from scriptloom.operators import align

WORDS = "stream_id long, idx long, text string"


def plain(a, b):
    """All cells; from the end a pair first, then a heard word, then a meant one."""
    cost = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


@pytest.mark.parametrize("band, cells", [(1, 1), (2, 50), (16, 1 << 25)])
def test_edits_equal_all_cells(monkeypatch, band, cells):
    monkeypatch.setattr(align, "BAND", band)
    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(band)
    for _ in range(400):
        k = rng.choice([2, 3, 20])
        a = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        b = [rng.randrange(k) for _ in range(rng.randint(0, 40))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.9]
        assert align.edits(np.array(a, int), np.array(b, int)) == plain(a, b)


def test_chains_are_longest():
    rng = random.Random(2)
    for _ in range(300):
        places = rng.sample(range(100), rng.randint(0, 12))
        best = [1] * len(places)
        for i, p in enumerate(places):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] < p), default=0)
        got = align.longest_chain(np.array(places)).tolist()
        assert len(got) == max(best, default=0) and all(places[x] < places[y] for x, y in zip(got, got[1:]))


def test_one_lost_word_is_one_difference(spark):
    said = [f"w{i % 50}" for i in range(400)]
    expected = spark.createDataFrame([(1, i, w) for i, w in enumerate(said)] + [(2, 0, "only")], "stream_id long, n long, text string")
    observed = spark.createDataFrame([(1, i, w) for i, w in enumerate(said) if i != 7] + [(3, 0, "new"), (3, 1, "words")], "stream_id long, n long, text string")
    got = {tuple(r) for r in align.reconcile(expected, observed).collect()}
    assert got == {(1, 400, 399, 1, 0, 0), (2, 1, 0, 1, 0, 0), (3, 0, 2, 0, 2, 0)}


def test_stretches_between_anchors_are_cheapest(spark):
    """With unique words on both sides the whole is cheapest, however it is split."""
    rng = random.Random(5)
    heard, meant, want = [], [], {}
    for s in range(12):
        a = [f"u{i}" if rng.random() < 0.9 else rng.choice("xyz") for i in range(200)]
        b = [w for w in a if rng.random() < 0.95]
        for _ in range(6):
            b.insert(rng.randrange(len(b)), rng.choice("xyz"))
        heard += [(s, i * 3, w) for i, w in enumerate(a)]
        meant += [(s, i, w) for i, w in enumerate(b)]
        want[s] = sum(i < 0 or j < 0 or a[i] != b[j] for i, j in plain(a, b))
    rows = align.align(spark.createDataFrame(heard, WORDS), spark.createDataFrame(meant, WORDS)).collect()
    assert {s: sum(r["op"] != "same" for r in rows if r["stream_id"] == s) for s in want} == want
    for s in want:  # each word of either side once, in order
        mine = [r for r in rows if r["stream_id"] == s]
        assert sorted(r["idx"] for r in mine if r["idx"] is not None) == list(range(0, 600, 3))
        pairs = sorted((r["idx"], r["m_idx"]) for r in mine if r["idx"] is not None and r["m_idx"] is not None)
        assert all(x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_recordings_without_anchors_are_one_stretch(spark):
    rng = random.Random(8)
    sides = {s: [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(2)] for s in range(20)}
    tables = [spark.createDataFrame([(s, i, w) for s, both in sides.items() for i, w in enumerate(both[k])], WORDS) for k in (0, 1)]
    rows = align.align(*tables, gram=40).collect()
    number = lambda words: np.array([ord(w) for w in words], int)
    want = {(s, None if i < 0 else i, None if j < 0 else j) for s, (a, b) in sides.items() for i, j in plain(number(a), number(b))}
    assert {(r["stream_id"], r["idx"], r["m_idx"]) for r in rows} == want and len(rows) == len(want)


def test_odd_words(spark):
    heard = spark.createDataFrame([(1, 0, "The"), (1, 1, None), (1, 1, "cat,"), (1, None, "x"), (None, 0, "y"), (1, 2, "sat"), (4, 0, "z")], WORDS)
    meant = spark.createDataFrame([(1, 0, "the"), (1, 5, "cat"), (1, 6, "sits"), (None, 0, "y")], WORDS)
    got = sorted(map(str, map(tuple, align.align(heard, meant).collect())))
    assert got == sorted(map(str, [(1, 0, 0, "same"), (1, 1, None, "inserted"), (1, 1, 5, "same"), (1, 2, 6, "replaced"), (4, 0, None, "inserted")]))
    assert {tuple(r) for r in align.suspects(heard, meant).collect()} == {(1, 1, "cat,", None), (1, 2, "sat", "sits")}
    empty = heard.limit(0)
    assert align.align(empty, empty).count() == 0 and align.align(empty, meant).count() == 3 and align.suspects(heard, empty).count() == 0


@pytest.mark.parametrize("band, cells", [(1, 1), (2, 50), (16, 1 << 25)])
def test_bands_equal_all_cells(monkeypatch, band, cells):
    monkeypatch.setattr(align, "SMALL", 0)
    test_edits_equal_all_cells(monkeypatch, band, cells)


def test_words_are_dealt_once(spark):
    """Both sides meet in the parts in which they come: no join and no shuffle of words."""
    words = spark.createDataFrame([(s, i, f"w{i % 7}") for s in range(9) for i in range(30)], WORDS).repartition(3, "stream_id")
    plan = align.align(words, words.where("idx % 5 <> 2"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
