"""Cues and spans against all ways to choose them."""

import itertools
import random

from scriptloom import queries as own
from scriptloom.operators import captions, choose, export, feedback


def test_breaks_are_the_cheapest():
    rng = random.Random(1)
    rules = captions.Reading(chars=20, chars_a_second=12)
    for _ in range(150):
        n, at, words = rng.randint(1, 9), 0, []
        for _ in range(n):
            took = rng.randint(50, 900)
            words.append((rng.choice([1, 2, 4, 7, 11, 25]), at, at + took, rng.random() < 0.3, rng.random() < 0.3))
            at += took + rng.randint(0, 300)
        ways = []
        for cuts in itertools.product((0, 1), repeat=n - 1):
            edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
            cost = 0
            for a, b in zip(edges, edges[1:]):
                chars = sum(w[0] for w in words[a:b]) + b - a - 1
                if chars > 20 and b - a > 1:
                    break
                cost += captions.cue_cost(rules, chars, max(w[2] for w in words[a:b]) - words[a][1], words[b - 1][3], words[b - 1][4], b == n)
            else:
                sizes = [b - a for a, b in zip(edges, edges[1:])]
                ways.append((cost, [-s for s in sizes], sizes))
        assert captions.best_breaks(rules, words) == min(ways)[2]


def test_readable_cues_say_what_the_output_says(spark, sf_dir):
    kept = own._kept(spark, sf_dir).cache()
    rules = captions.Reading()
    cues = {}
    for r in captions.readable_cues(kept, own.GAP_MS).orderBy("stream_id", "cue").collect():
        cues.setdefault(r["stream_id"], []).append(r["text"])
        assert len(r["text"]) <= rules.chars or " " not in r["text"]
    assert {r["stream_id"]: r["body"] for r in export.transcript(kept).collect()} == {k: " ".join(v) for k, v in cues.items()}
    assert captions.readable_cues(kept.limit(0), own.GAP_MS).count() == 0


def test_chosen_spans_weigh_most(spark):
    rng, rows, want = random.Random(2), [], {}
    for s in range(30):
        spans = sorted({(a + rng.randint(0, 6), a, "l", "r", rng.randint(1, 5)) for a in (rng.randint(0, 30) for _ in range(rng.randint(1, 10)))})
        rows += [(s, a, b, x, y, w) for b, a, x, y, w in spans]
        fits = lambda some: all(p[0] < q[1] or q[0] < p[1] for p, q in itertools.combinations(some, 2))
        want[s] = max(sum(x[4] for x in some) for k in range(len(spans) + 1) for some in itertools.combinations(spans, k) if fits(some))
    odd = [(None, 0, 1, "l", "r", 9), (1, 5, 4, "l", "r", 9), (1, None, 4, "l", "r", 9), (1, 0, 99, "l", "r", 0), (1, 0, 99, "l", "r", None), rows[0]]
    df = spark.createDataFrame(rows + odd, "stream_id long, first_idx long, last_idx long, layer string, reason string, weight long")
    got = choose.without_overlap(df).collect()
    assert {s: sum(r["weight"] for r in got if r["stream_id"] == s) for s in want} == want
    for s in want:
        mine = sorted((r["first_idx"], r["last_idx"]) for r in got if r["stream_id"] == s)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
    tie = spark.createDataFrame([(1, 0, 3, "a", "a", 2), (1, 2, 5, "b", "b", 2)], df.schema)
    assert [r["layer"] for r in choose.without_overlap(tie).collect()] == ["a"]
    assert choose.without_overlap(df.limit(0)).count() == 0


def test_examples_differ(spark):
    rows = [("restored", ["r"], "the old sea")] * 5 + [("restored", ["r"], "the old")] * 6 + [("added", ["r"], "sea")] * 4 + [("added", None, "x y")] * 2 + [("agreed", ["r"], "no")] + [("added", ["r"], None)]
    history = spark.createDataFrame(rows, "class string, reasons array<string>, text string")
    got = [tuple(r) for r in feedback.varied_examples(history, 3).orderBy("reason", "rank").collect()]
    assert got == [("", 1, "added", "x y", 2), ("r", 1, "restored", "the old sea", 5), ("r", 2, "restored", "the old", 6), ("r", 3, "added", "sea", 4)]
    assert feedback.varied_examples(history.limit(0), 3).count() == 0


def test_picks_equal_plain_greedy():
    rng = random.Random(6)
    for _ in range(100):
        rows = [(rng.randint(1, 9), rng.choice("ab"), " ".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(0, 12))]
        shown, left, want = set(), list(range(len(rows))), []
        while left and len(want) < 5:
            scored = sorted((-rows[k][0] * len({w for w in rows[k][2].split() if w not in shown}), -rows[k][0], rows[k][1], rows[k][2]) for k in left)
            k = next(k for k in left if (rows[k][0], rows[k][1], rows[k][2]) == (-scored[0][1], *scored[0][2:]))
            want.append(rows[k])
            left.remove(k)
            shown |= set(rows[k][2].split())
        assert [rows[k] for k in feedback.pick(rows, 5)] == want
