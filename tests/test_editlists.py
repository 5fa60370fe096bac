"""Files written, read back, and broken ones."""

import random
import re

from scriptloom.operators import export, review
from scriptloom.sources import editlists, sinks
from test_editing import timed


def test_files_written_are_read_back(spark, tmp_path):
    words = timed(spark, 1, "a b c d e", pauses=(2, 4)).unionByName(timed(spark, 2, "x y"))
    cues, segs = export.cues(words, 500, 2), review.segments(words, 500)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    for name, rendered in (("srt", export.srt(cues)), ("edl", export.edl(export.edl_events(segs, 30))), ("map", export.timeline_map(segs))):
        sinks.write_rendered(rendered, f"{tmp_path}/{name}")
    read = lambda name: editlists.read_rendered(spark, f"{tmp_path}/{name}")
    assert rows(editlists.parse_srt(read("srt")).drop("bad")) == rows(cues)
    assert rows(editlists.parse_timeline(read("map")).drop("bad")) == rows(segs.drop("n_words"))
    events = editlists.parse_edl(read("edl"), 30)
    assert rows(events.select("stream_id", "event", "src_in", "src_out", "rec_in", "rec_out")) == rows(export.edl_events(segs, 30))
    assert rows(events.selectExpr("stream_id", "event - 1", "round(src_frame * 1000 / 30)")) != [] and events.where("bad is not null").count() == 0


def test_files_of_other_programs(spark, tmp_path):
    (tmp_path / "talk one.srt").write_bytes("1\r\n00:00:01,000 --> 00:00:02.500 X1:10\r\nfirst\r\nsecond\r\n\r\n \r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\nthree\r\n00:61:00,000 --> x\r\n".encode())
    got = editlists.parse_srt(editlists.read_rendered(spark, str(tmp_path))).collect()
    assert {r["stream_id"] for r in got} == {"talk one"}
    assert [(r["cue"], r["start_ms"], r["end_ms"], r["text"]) for r in got if r["bad"] is None] == [(1, 1000, 2500, "first\nsecond"), (2, 3000, 4000, "")]
    assert [r["bad"] for r in got if r["bad"]] == ["three\n00:61:00,000 --> x"]


def test_malformed_files(spark):
    files = lambda *bodies: spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "stream_id long, body string")
    got = {tuple(r) for r in editlists.parse_timeline(files('[{"seg":0,"src_start":0,"src_end":5,"out_start":0}]', "[]", "no", '[{"seg":null,"src_start":0,"src_end":5,"out_start":0}]', '{"seg":1}', None, "")).collect()}
    assert {(r[0], r[5] is None) for r in got} == {(0, True), (2, False), (3, False), (4, False)} and (0, 0, 0, 5, 0, None) in got
    lines = ["TITLE: x", "001  AX V C 00:00:00:00 00:00:01:00 00:00:00:00 00:00:01:00", "002  AX V C 00:00:05:00 00:00:06:00 00:00:01:00 00:00:03:00", "003  AX V C 00:00:09:00 00:00:08:00 00:00:03:00 00:00:02:00", "* 1", "004 junk", "005  R1 V D 010 01:00:00:10 01:00:01:10 00:00:01:00 00:00:02:00"]
    rows = editlists.parse_edl(files("\r\n".join(lines), None), 25).collect()
    assert [(r["event"], r["src_frame"], r["rec_frame"], r["n_frames"]) for r in rows if r["bad"] is None] == [(1, 0, 0, 25), (5, 90_010, 25, 25)]
    assert sorted(r["bad"][:3] for r in rows if r["bad"]) == ["002", "003", "004"]
    assert editlists.parse_srt(files(None, "", "\n\n")).count() == 0


def test_a_text_is_matched_once(spark):
    """However many columns are read and filtered by, the pattern stands in the plan once."""
    files = spark.createDataFrame([(1, "001 AX V C 00:00:00:00 00:00:01:00 00:00:00:00 00:00:01:00")], "stream_id long, body string")
    for read, mark in ((editlists.parse_edl(files, 25), r"\S+\s+\S+\s+\S+"), (editlists.parse_srt(files), "-->")):
        plan = read.where("bad is null").drop("bad")._jdf.queryExecution().optimizedPlan().treeString()
        assert plan.count(mark) == 1, plan


def test_lines_are_read_as_by_the_plain_pattern(spark):
    rng = random.Random(4)
    clock = lambda s: f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}{rng.choice(':;')}{rest}"
    lines = []
    for n in range(300):
        at, to = rng.randrange(9000), rng.randrange(9000)
        length, rest = rng.choice([0, 1, 60, 4000]), rng.choice(["00", "07", "012"])
        cells = [str(n).zfill(3), "AX", "V", rng.choice("CD"), *rng.choice([[], [], ["010"], ["x"]]), clock(at), clock(at + length), clock(to), clock(to + length)]
        for _ in range(rng.choice([0, 0, 0, 1])):
            cells[rng.randrange(len(cells))] = rng.choice(["", "00:60:00:00", "1:00:00:00", "00:00:00:0", "\n", "7"])
        lines += (rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", "\t"]).join(cells) + rng.choice(["", " ", "\t "])).split("\n")
    lines += ["900 AX V C 00:00:00:00 00:00:01:00 00:00:00:00 00:00:01:00\u2028", "901 AX V C 99999999999999999999:00:00:00 00:00:01:00 00:00:00:00 00:00:01:00"]
    code = r"(\d+:[0-5]\d:[0-5]\d[:;]\d{2,3})"
    want = []
    for line in lines:
        if not re.match(r"\s*\d+\s", line, re.ASCII):
            continue
        met = re.search(rf"^\s*(\d+)\s+\S+\s+\S+\s+\S+(?:\s+\d+)?\s+{code}\s+{code}\s+{code}\s+{code}[\s\u2028]*$", line, re.ASCII)
        frames = [sum(int(x) * k for x, k in zip(re.split("[:;]", met[g]), (90_000, 1500, 25, 1))) for g in range(2, 6)] if met else []
        good = met and max(frames) < 1 << 40 and frames[1] > frames[0] and frames[1] - frames[0] == frames[3] - frames[2]
        want.append((int(met[1]), *met.groups()[1:], frames[0], frames[2], frames[1] - frames[0], None) if good else (*[None] * 8, line))
    got = editlists.parse_edl(spark.createDataFrame([(1, "\n".join(lines))], "stream_id long, body string"), 25).drop("stream_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and 30 < sum(r[-1] is None for r in want) < len(want) - 30
