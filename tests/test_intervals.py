"""Interval algebra against sets of milliseconds."""

import random

from scriptloom.operators import intervals

SPANS = "stream_id long, start_ms long, end_ms long"


def spans_of(held):
    """Sets of milliseconds as maximal (start, end) spans."""
    out, begun = [], None
    for t in range(202):
        if (t in held) != (begun is not None):
            if begun is None:
                begun = t
            else:
                out.append((begun, t))
                begun = None
    return out


def test_algebra_equals_sets_of_moments(spark):
    rng = random.Random(3)
    sets, tables = [], []
    for _ in range(2):
        rows = [(s, a, a + rng.randint(-3, 12)) for s in range(25) for a in (rng.randint(0, 180) for _ in range(rng.choice([0, 1, 6, 20])))]
        rows += rows[:5] + [(None, 0, 5), (1, None, 5), (1, 5, None)]
        tables.append(spark.createDataFrame(rows, SPANS).repartition(3))
        sets.append({s: [t for x, a, b in rows if x == s and a is not None and b is not None for t in range(a, b)] for s in range(25)})
    got = lambda df: sorted(tuple(r) for r in df.collect())
    whole = lambda f: sorted((s, *x) for s in range(25) for x in spans_of(f(set(sets[0][s]), set(sets[1][s]))))
    assert got(intervals.union(*tables)) == whole(lambda a, b: a | b)
    assert got(intervals.intersection(*tables)) == whole(lambda a, b: a & b)
    assert got(intervals.difference(*tables)) == whole(lambda a, b: a - b)
    assert got(intervals.union(tables[0])) == whole(lambda a, b: a)
    covered = {(s, t): sets[0][s].count(t) for s in range(25) for t in set(sets[0][s])}
    rows = got(intervals.cover(tables[0]))
    assert {(s, t): n for s, a, b, n in rows for t in range(a, b)} == covered and sum(b - a for _, a, b, _ in rows) == len(covered)
    assert all(not (x[0] == y[0] and x[2] == y[1] and x[3] == y[3]) for x, y in zip(rows, rows[1:]))
    empty = tables[0].limit(0)
    assert intervals.cover(empty).count() == intervals.union(empty, empty).count() == 0 and got(intervals.difference(tables[0], empty)) == whole(lambda a, b: a)


def test_silence_lies_in_the_recording(spark):
    extents = spark.createDataFrame([(1, 0, 1000), (2, 100, 500)], SPANS)
    voiced = spark.createDataFrame([(1, -50, 100), (1, 90, 300), (1, 600, 1200), (3, 0, 5)], SPANS)
    got = sorted(tuple(r) for r in intervals.silence_between(extents, voiced, 300).collect())
    assert got == [(1, 300, 600, 300), (2, 100, 500, 400)]
    assert intervals.silence_between(extents, voiced, 301).count() == 1


def test_words_that_are_hardly_voiced(spark):
    rng = random.Random(9)
    voice = [(s, a, a + rng.randint(1, 15)) for s in range(20) for a in (rng.randint(0, 150) for _ in range(8))]
    words = [(s, i, "w", a, a + rng.randint(0, 20)) for s in range(21) for i, a in enumerate(rng.randint(0, 150) for _ in range(10))]
    heard = {s: {t for x, a, b in voice if x == s for t in range(a, b)} for s in range(21)}
    want = sorted((s, i) for s, i, _, a, b in words if a < b and sum(t in heard[s] for t in range(a, b)) <= 0.5 * (b - a))
    odd = [(None, 0, "w", 0, 5), (1, None, "w", 0, 5), (1, 90, "w", None, 5), words[0]]
    df = spark.createDataFrame(words + odd, "stream_id long, idx long, text string, start_ms long, end_ms long")
    got = sorted((r["stream_id"], r["idx"]) for r in intervals.mostly_outside(df, spark.createDataFrame(voice, SPANS), 0.5).collect())
    assert got == want and 10 < len(want) < 200


def plain_voice(frames, high, low, least, bridge, frame):
    inside, on, before = [], False, None
    for t, e in sorted(frames.items()):
        torn = before is None or t - before > bridge + frame
        on = True if e >= high else False if e < low or torn else on
        before = t
        if on:
            inside.append(t)
    out = []
    for t in inside:
        if out and t - out[-1][1] + frame <= bridge + frame:
            out[-1][1] = t + frame
        else:
            out.append([t, t + frame])
    return [tuple(x) for x in out if x[1] - x[0] >= least]


def test_two_thresholds(spark):
    rng = random.Random(4)
    rows = [(s, 10 * t, rng.choice([0.0, 0.3, 0.6, 0.9])) for s in range(15) for t in range(60) if rng.random() < 0.8]
    best = {}
    for s, t, e in rows + rows[:9]:
        best.setdefault(s, {})[t] = max(e, best.get(s, {}).get(t, 0))
    df = spark.createDataFrame(rows + rows[:9] + [(1, None, 0.9), (None, 1, 0.9), (1, 5, None)], "stream_id long, t_ms long, energy double")
    got = sorted(tuple(r) for r in intervals.voice_from_frames(df, 0.8, 0.5, 30, 20, 10).collect())
    assert got == sorted((s, *x) for s, f in best.items() for x in plain_voice(f, 0.8, 0.5, 30, 20, 10)) and got
    assert intervals.voice_from_frames(df.limit(0), 0.8, 0.5, 30, 20, 10).count() == 0


def test_intervals_stay_in_their_parts(spark):
    """Sets that come by recording are worked there, by sorts alone: no shuffle, no table of all ends."""
    rows = spark.createDataFrame([(s, 10 * i, 10 * i + 15) for s in range(5) for i in range(20)], SPANS).repartition(3, "stream_id")
    for found in (intervals.cover(rows), intervals.difference(rows, rows.where("start_ms % 20 = 0"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Exchange hashpartitioning(stream_id" in plan and ", 4)" not in plan
