"""Repeated phrases and broken-off takes against plain searches."""

import random

import pytest

from scriptloom.operators import takes
from scriptloom.plans.edit import edit
from scriptloom.sources import readers
from test_editing import WORDS, timed


def plain_runs(words, longest):
    """(s, e, period) over all spans: maximal, at least two periods, in no run of a shorter period."""
    found = []
    for p in range(1, longest + 1):
        for s in range(len(words)):
            for e in range(s + 2 * p, len(words) + 1):
                ok = lambda a, b: a >= 0 and b <= len(words) and all(words[i] and words[i] == words[i + p] for i in range(a, b - p))
                if ok(s, e) and not ok(s - 1, e) and not ok(s, e + 1):
                    found.append((s, e, p))
    return {(s, e, p) for s, e, p in found if not any(q < p and a <= s and b >= e for a, b, q in found)}


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_tandems_equal_all_spans(spark, longest):
    rng = random.Random(longest)
    said = {s: [rng.choice(["a", "b", "c", ","][: rng.choice([2, 3, 4])]) for _ in range(rng.randint(0, 25))] for s in range(40)}
    df = spark.createDataFrame([(s, 10 * i, w) for s, ws in said.items() for i, w in enumerate(ws)], "stream_id long, idx long, text string")
    got = {tuple(r) for r in takes.tandems(df, longest).collect()}
    runs = {(s, *r) for s, ws in said.items() for r in plain_runs(["" if w == "," else w for w in ws], longest)}
    assert got == {(s, 10 * a, 10 * (b - 1), p, (b - a) // p) for s, a, b, p in runs} and runs
    cut = {(r["stream_id"], r["idx"]) for r in takes.phrase_stumbles(df, longest).collect()}
    assert cut == {(s, 10 * i) for s, a, b, p in runs for i in range(a, a + ((b - a) // p - 1) * p)}


def test_phrases_and_words_cut_off_are_stumbles(spark):
    words = timed(spark, 1, "I want I want to to go wan- Wanted home ho... house and an— but b-")
    assert {tuple(r)[1:] for r in takes.tandems(words).collect()} == {(0, 3, 2, 2), (4, 5, 1, 2)}
    assert sorted(tuple(r)[1:] for r in takes.cut_offs(words).collect()) == [(7, 8), (10, 11)]
    rules = spark.createDataFrame([], "token string, rule string")
    cut = lambda n: {r["idx"] for r in edit(words, rules, readers.Settings(layers=("stumble",), stumble_words=n)).words.where("not keep").collect()}
    assert cut(1) == {4} and cut(4) == {0, 1, 4, 7, 10}


def plain_takes(words, gram, window, gap, drift, tail):
    """(s, e, again) by comparing every place with every later one."""
    seeds = {}
    n = len(words)
    for p in range(n - gram + 1):
        mine = [w for w, _, _ in words[p : p + gram]]
        if "" in mine:
            continue
        for q in range(p + 1, n - gram + 1):
            if [w for w, _, _ in words[q : q + gram]] == mine:
                if q - p >= gram and words[q][1] - words[p + gram - 1][2] <= window:
                    seeds[p] = q - p
                break
    spans = []
    for p in sorted(seeds):
        if spans and spans[-1][1] == seeds[p] and any(x[1] == seeds[p] and x[2] - gram + 1 == p for x in spans):
            next(x for x in spans if x[1] == seeds[p] and x[2] - gram + 1 == p)[2] = p + gram
        else:
            spans.append([p, seeds[p], p + gram])
    out, chain = [], []
    for span in sorted(spans):
        if chain and (span[0] - chain[-1][2] > gap or abs(span[1] - chain[-1][1]) > drift):
            out.append(chain)
            chain = []
        chain.append(span)
    found = set()
    for chain in out + ([chain] if chain else []):
        s, again = chain[0][0], chain[0][0] + chain[0][1]
        e = min(max(x[2] for x in chain), again)
        found.add((s, again if again - e <= tail else e, again))
    return found


def test_broken_off_takes_equal_a_plain_search(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for s in range(30):
        words, at = [], 0
        said = [rng.choice(["", "a", "b", "c", *(f"w{i}" for i in range(12))]) for _ in range(60)]
        for k in (10, 30):
            again = [w if rng.random() < 0.9 else "x" for w in said[k : k + rng.randint(4, 9)]]
            said[k + 12 : k + 12] = again
        for w in said:
            at += rng.choice([300, 300, 300, 4000])
            words.append((w, at, at + 200))
        rows += [(s, 2 * i, w or ",", a, b) for i, (w, a, b) in enumerate(words)]
        want |= {(s, 2 * a, 2 * (b - 1), 2 * c) for a, b, c in plain_takes(words, 3, 15_000, 3, 2, 6)}
    df = spark.createDataFrame(rows, WORDS)
    assert {tuple(r) for r in takes.aborted_takes(df, 3, 15_000).collect()} == want and len(want) > 20
    cut = {(r["stream_id"], r["idx"]) for r in takes.aborted_words(df, 3, 15_000).collect()}
    assert cut == {(s, i) for s, a, b, _ in want for i in range(a, b + 1, 2)}


def test_a_take_without_full_stops_far_away(spark):
    words = timed(spark, 1, "so today we talk about the sea and its uh well let me think so today we talk about the sea and fish")
    assert [tuple(r) for r in takes.aborted_takes(words).collect()] == [(1, 0, 13, 14)]
    assert takes.aborted_takes(words, window_ms=100).count() == 0
    rules = spark.createDataFrame([], "token string, rule string")
    cut = edit(words, rules, readers.Settings(layers=("retake",), take_words=4)).words.where("not keep")
    assert {r["idx"] for r in cut.collect()} == set(range(14))


def test_odd_words(spark):
    odd = spark.createDataFrame([(None, 0, "a", 0, 1), (None, 1, "a", 0, 1), (1, None, "a", 0, 1), (1, 1, None, 0, 1), (1, 2, None, 0, 1), (1, 3, "b", None, None), (1, 3, "b", 0, 1)], WORDS)
    assert {tuple(r) for r in takes.tandems(odd).collect()} == {(1, 3, 3, 1, 2)}
    assert takes.cut_offs(odd).count() == takes.aborted_takes(odd, 1, 10).count() == 0
    for f in (takes.tandems, takes.phrase_stumbles, takes.cut_offs, takes.aborted_takes, takes.aborted_words):
        assert f(odd.limit(0)).count() == 0
