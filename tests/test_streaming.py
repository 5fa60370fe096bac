"""Decisions as a stream against the same records as a table."""

import datetime as dt
import json
import random

import pytest

from scriptloom.streaming import feedback as stream

START = dt.datetime(2024, 1, 1)


def records(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        out.append({"record_id": k, "stream_id": rng.randrange(3), "idx": rng.randrange(8), "keep": rng.random() < 0.5, "said_at": (START + dt.timedelta(minutes=rng.choice([k, k, k // 5 * 5]))).isoformat()})
    return out + rng.sample(out, n // 4)  # some come twice


def write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(spark, source, checkpoint, table, late="1 day"):
    """All that is there now goes through the query, which then ends."""
    held = []

    def keep(df, _):
        held.extend(map(tuple, df.collect()))

    query = stream.running_decisions(stream.decision_stream(spark, str(source), 1), late).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    for row in held:
        table[row[:2]] = row
    return len(held)


def wanted(spark, folder):
    return {tuple(r)[:2]: tuple(r) for r in stream.last_decisions(spark.read.schema(stream.DECIDED).json(str(folder))).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_order_of_files_does_not_matter(spark, tmp_path, seed):
    (tmp_path / "in").mkdir()
    rows = records(120, seed)
    random.Random(seed).shuffle(rows)
    for k in range(4):
        write(tmp_path / "in", f"{k}.json", rows[k::4])
    table = {}
    run(spark, tmp_path / "in", tmp_path / "check", table)
    assert table == wanted(spark, tmp_path / "in") and len(table) > 15


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows, table = records(100, 3), {}
    write(tmp_path / "in", "a.json", rows[50:])
    run(spark, tmp_path / "in", tmp_path / "check", table)
    write(tmp_path / "in", "b.json", rows[:50] + rows[60:70])
    changed = run(spark, tmp_path / "in", tmp_path / "check", table)
    assert table == wanted(spark, tmp_path / "in") and changed < 24


def test_late_and_broken_records_decide_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = lambda k, minutes, keep, **more: {"record_id": k, "stream_id": 1, "idx": 0, "keep": keep, "said_at": (START + dt.timedelta(minutes=minutes)).isoformat()} | more
    table = {}
    write(tmp_path / "in", "a.json", [one(1, 600, True), one(2, 700, None), one(3, 700, False, idx=None)])
    run(spark, tmp_path / "in", tmp_path / "check", table, "1 hour")
    write(tmp_path / "in", "b.json", [one(4, 5, False, idx=9), one(5, 590, False), one(6, 600, False)])
    run(spark, tmp_path / "in", tmp_path / "check", table, "1 hour")
    assert {k: r[2] for k, r in table.items()} == {(1, 0): False}  # 4 is late, 6 has the greater id at the same time
