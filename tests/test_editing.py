"""Editing operators on small inputs, and what must always hold of a cut."""

import json
import math
import random
import time
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from scriptloom import queries as own
from scriptloom.functions import distance as many
from scriptloom.functions import text as fn
from scriptloom.operators import detect, export, feedback, review
from scriptloom.plans.edit import edit
from scriptloom.sources import readers, sinks
from scriptloom.streaming.feedback import feedback_stream, running_summary

WORDS = "stream_id long, idx long, text string, start_ms long, end_ms long"


def timed(spark, stream, said, step=300, pauses=()):
    at, rows = 0, []
    for i, w in enumerate(said.split()):
        at += 2000 if i in pauses else 0
        rows.append((stream, i, w, at, at + step - 50))
        at += step
    return spark.createDataFrame(rows, WORDS)


def ids(df):
    return sorted((r["stream_id"], r["idx"]) for r in df.collect())


def test_chinese_words(spark):
    words = timed(spark, 1, "这个 嗯 我们 我们 说 话 。")
    lexicon = spark.createDataFrame([("嗯",)], "token string")
    assert ids(detect.fillers(words, lexicon)) == [(1, 1)]
    assert ids(detect.stumbles(words)) == [(1, 2)]


def test_silence_is_over_the_threshold(spark):
    words = timed(spark, 1, "a b c", pauses=(2,))
    assert [(r["idx"], r["gap_ms"]) for r in detect.silences(words, 2049).collect()] == [(2, 2050)]
    assert detect.silences(words, 2050).count() == 0


def test_the_last_take_stays(spark):
    words = timed(spark, 1, "we went to the shop. we went to a shop. then home we go.")
    sentences = detect.sentences_of(words)
    taken = detect.retakes(sentences, 0.7, 2)
    assert [(r["i"], r["by"]) for r in taken.collect()] == [(0, 1)]
    assert ids(detect.retake_words(words, sentences, taken)) == [(1, k) for k in range(5)]


def test_pauses_end_sentences_without_punctuation(spark):
    words = timed(spark, 1, "we went to the shop we went to a shop then home we go", pauses=(5, 10))
    assert detect.sentences_of(words).count() == 1
    sentences = detect.sentences_of(words, 800)
    assert sorted((r["first_idx"], r["last_idx"]) for r in sentences.collect()) == [(0, 4), (5, 9), (10, 13)]
    cut = edit(words, spark.createDataFrame([], "token string, rule string"), readers.Settings(layers=("retake",)))
    assert {r["idx"] for r in cut.words.where("not keep").collect()} == {0, 1, 2, 3, 4}


def test_repeats_are_found_anywhere_in_the_recording(spark):
    rng = random.Random(8)
    vectors = {s: [[rng.gauss(0, 1) for _ in range(4)] for _ in range(200)] for s in (1, 2)}
    rows = [(s, i, v) for s, vs in vectors.items() for i, v in enumerate(vs)]
    rows += [(3, 0, [0.0] * 4), (3, 1, [0.0] * 4), (3, 2, None), (3, 3, [1.0]), (3, 4, [float("inf")] * 4), (3, 5, []), (None, 0, [1.0]), (None, 1, [1.0]), (3, 6, [1.0, None])]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(s, i, min(later)) for s, vs in vectors.items() for i in range(200) if (later := [j for j in range(i + 1, 200) if cos(vs[i], vs[j]) >= 0.97])}
    got = detect.repeats(spark.createDataFrame(rows, "stream_id long, i long, embedding array<double>"), 0.97)
    assert {tuple(r) for r in got.collect()} == want and any(b - i > 100 for _, i, b in want)
    assert detect.repeats(spark.createDataFrame([], "stream_id long, i long, embedding array<double>"), 0.9).count() == 0


def test_repeated_sentences_are_cut(spark):
    words = timed(spark, 1, "first said. other thing. same meaning. the end.")
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [1.0, 0.01])], "stream_id long, i long, embedding array<double>")
    cut = edit(words, spark.createDataFrame([], "token string, rule string"), readers.Settings(layers=("repeat",)), vectors=vectors)
    assert {(r["idx"], r["layer"]) for r in cut.proposals.collect()} == {(0, "repeat"), (1, "repeat")}


def test_one_pass_decides_as_the_operators_do(spark, sf_dir):
    words = own._words(spark, sf_dir)
    apart = review.decided(words, review.with_reasons(own._proposals(spark, words)), own._decisions(words))
    pick = lambda df: sorted(map(str, df.select("stream_id", "idx", "proposed", "keep", "reasons").collect()))
    assert pick(apart) == pick(own._decided(spark, words))


def test_every_layer_takes_part(spark, sf_dir):
    rows = own.q_every_layer(spark, sf_dir).collect()
    assert {x for r in rows for x in r["layers"].split("+")} - {""} == set(own.EVERY_LAYER.layers)


def test_suspects_are_judged_by_their_own_manuscript(spark):
    words = spark.createDataFrame([(1, 0, "the", 0, 1), (1, 1, "Cat", 1, 2), (1, 2, "sat", 2, 3), (2, 0, "cat", 0, 1), (2, 1, "dog", 1, 2), (3, 0, "cat", 0, 1), (None, 0, "cat", 0, 1)], WORDS)
    man = spark.createDataFrame([(1, 0, "the"), (1, 1, "hat"), (1, 2, "sat"), (2, 0, "cat"), (4, 0, "cat")], "stream_id long, idx long, text string")
    assert ids(review.misheard(words, man)) == [(1, 1), (2, 1)]
    more = spark.createDataFrame([(1, 0, "the"), (1, 1, "cat"), (2, 0, "dog"), (2, 1, "cat")], "stream_id long, idx long, text string")
    assert ids(review.misheard_in_context(words, more)) == [(1, 2), (2, 0), (2, 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_retakes_of_any_length_and_script(spark):
    rng = random.Random(6)
    lines = []
    for _ in range(100):
        line = [rng.choice("ab éß字 ") for _ in range(rng.choice([0, 1, 5, 10, 40, 900]))]
        lines.append("".join(line))
        for at in rng.sample(range(len(line)), int(len(line) * rng.choice([0, 0.1, 0.3, 0.35, 0.9]))):
            line[at] = rng.choice(["", "x", "y字"])
        lines.append("".join(line))
    want = set()
    for i, (a, b) in enumerate(zip(lines, lines[1:])):
        longer = max(len(a), len(b))
        if len(a.split()) >= 2 and (1 if longer == 0 else 1 - distance(a, b) / longer) >= 0.7:
            want.add((i, i + 1))
    rows = [(1, i, x) for i, x in enumerate(lines)] + [(2, 0, None), (2, 1, "a b"), (2, 2, None)]
    got = detect.retakes(spark.createDataFrame(rows, "stream_id long, i long, line string"), 0.7, 1).collect()
    assert {(r["i"], r["by"]) for r in got} == want and all(r["stream_id"] == 1 for r in got) and 20 < len(want) < 180


def test_points_meet_the_segment_that_holds_them(spark):
    segs = spark.createDataFrame([(1, 0, 10, 20, 0), (1, 1, 20, 25, 10), (1, 2, 40, 50, 15), (2, 0, 0, 5, 0)], "stream_id long, seg long, src_start long, src_end long, out_start long")
    points = [(s, t) for s in (1, 2, 3, None) for t in (0, 9, 10, 10, 19, 20, 24, 25, 39, 40, 49, 50, None)]
    held = {1: [(10, 20, 0), (20, 25, 10), (40, 50, 15)], 2: [(0, 5, 0)]}
    want = []
    for s, t in points:
        inside = [(k, o + t - a) for k, (a, b, o) in enumerate(held.get(s, [])) if t is not None and a <= t < b]
        want.append((s, t, *(inside[0] if inside else (None, None))))
    got = export.to_output_time(spark.createDataFrame(points, "stream_id long, src_ms long"), segs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_intervals_touch_but_do_not_overlap(spark):
    words = spark.createDataFrame([(1, 0, "a", 0, 100), (1, 1, "b", 100, 30_000), (1, 2, None, None, None), (2, 0, "c", 0, 100)], WORDS)
    spans = spark.createDataFrame([(1, "cough", 100, 200, 0.9), (1, "cough", 15_000, 16_000, 0.1)], "stream_id long, kind string, start_ms long, end_ms long, score double")
    assert ids(detect.non_speech(words, spans, 0.5)) == [(1, 1)]
    assert ids(detect.unvoiced(words, spans)) == [(1, 0), (1, 2), (2, 0)]


def test_user_wins_and_protection_holds(spark):
    words = timed(spark, 1, "um so um but um fine")
    rules = spark.createDataFrame([("um", "filler"), ("but", "filler"), ("but", "protected")], "token string, rule string")
    said = spark.createDataFrame([(1, 0, True), (1, 5, False), (1, 1, None)], "stream_id long, idx long, keep boolean")
    cut = edit(words, rules, readers.Settings(layers=("filler",)), said)
    assert {r["idx"] for r in cut.words.where("keep").collect()} == {0, 1, 3}
    assert {r["idx"] for r in cut.proposals.collect()} == {0, 2, 4}


def test_the_cut_list_has_the_frame_rate_of_the_settings(spark):
    words = timed(spark, 1, "a b c", step=1000)
    cut = edit(words, spark.createDataFrame([], "token string, rule string"), readers.Settings(layers=(), fps=25))
    assert [r["src_out"] for r in cut.events.collect()] == ["00:00:02:24"]


def test_a_layer_that_is_off_proposes_nothing(spark):
    words = timed(spark, 1, "um um fine")
    rules = spark.createDataFrame([("um", "filler")], "token string, rule string")
    assert {r["layer"] for r in edit(words, rules, readers.Settings(layers=("stumble",))).proposals.collect()} == {"stumble"}
    assert edit(words, rules, readers.Settings(layers=())).proposals.count() == 0


def test_cut_is_ordered_and_complete(spark, sf_dir):
    words = own._words(spark, sf_dir).cache()
    kept = own._kept(spark, sf_dir).cache()
    segs = sorted((r.asDict() for r in own._segments(spark, sf_dir).collect()), key=lambda r: (r["stream_id"], r["seg"]))
    assert sum(r["n_words"] for r in segs) == kept.count() and kept.count() + own._decided(spark, words).where("not keep").count() == words.count()
    for a, b in zip(segs, segs[1:]):
        if a["stream_id"] == b["stream_id"]:
            assert b["seg"] == a["seg"] + 1 and b["src_start"] >= a["src_end"] and b["out_start"] == a["out_start"] + a["src_end"] - a["src_start"]
        else:
            assert b["seg"] == b["out_start"] == 0


def test_times_map_there_and_back(spark, sf_dir):
    segs = own._segments(spark, sf_dir).cache()
    points = own._kept(spark, sf_dir).select("stream_id", F.col("start_ms").alias("src_ms"))
    there = export.to_output_time(points, segs).where("out_ms is not null")
    back = export.to_source_time(there.select("stream_id", "out_ms"), segs)
    assert there.count() == points.count() and back.select("stream_id", "src_ms").exceptAll(points).count() == 0


def test_captions_say_what_the_output_says(spark, sf_dir):
    said = {r["stream_id"]: r["body"] for r in own.q_transcript(spark, sf_dir).collect()}
    cues = {}
    for r in own.q_cues(spark, sf_dir).orderBy("stream_id", "cue").collect():
        cues.setdefault(r["stream_id"], []).append(r["text"])
    assert said == {k: " ".join(v) for k, v in cues.items()}


def test_frames_and_clocks(spark):
    row = spark.range(1).select(fn.clock(F.lit(3_723_004)).alias("c"), fn.frames(F.lit(50), 30).alias("f"), fn.timecode(F.lit(108_031), 30).alias("t"), fn.likeness(F.lit(""), F.lit("")).alias("l"), fn.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("n")).first()
    assert (row["c"], row["f"], row["t"], row["l"], row["n"]) == ("01:02:03,004", 2, "01:00:01:01", 1.0, None)


def test_long_recordings_keep_all_digits(spark):
    rows = spark.createDataFrame([(3_600_000 * 100 + 7,), (359_999_999,)], "ms long")
    got = [(r["c"], r["t"]) for r in rows.select(fn.clock(F.col("ms")).alias("c"), fn.timecode(fn.frames(F.col("ms"), 30), 30).alias("t")).collect()]
    assert got == [("100:00:00,007", "100:00:00:00"), ("99:59:59,999", "100:00:00:00")]
    events = spark.createDataFrame([(1, n, "a", "b", "c", "d") for n in (1, 99, 1000, 1001)], "stream_id long, event long, src_in string, src_out string, rec_in string, rec_out string")
    body = export.edl(events).first()["body"]
    assert [x.split()[0] for x in body.splitlines() if "AX" in x] == ["001", "099", "1000", "1001"] and body.count("* FROM CLIP NAME: 1.mp4") == 4


def test_fcpxml_names_its_media(spark):
    segs = spark.createDataFrame([(5, 0, 0, 1000, 0, 1), (5, 1, 4000, 5000, 1000, 1)], "stream_id long, seg long, src_start long, src_end long, out_start long, n_words long")
    root = ElementTree.fromstring(export.fcpxml(segs, 30).first()["body"].encode())
    asset = root.find("resources/asset")
    assert asset.get("duration") == "150/30s" and asset.find("media-rep").get("src") == "./5.mp4" and len(root.findall(".//asset-clip")) == 2


def test_timeline_map_is_one_ordered_array(spark):
    segs = spark.createDataFrame([(5, 1, 4000, 5000, 1000, 1), (5, 0, 0, 1000, 0, 1)], "stream_id long, seg long, src_start long, src_end long, out_start long, n_words long")
    assert json.loads(export.timeline_map(segs).first()["body"]) == [{"seg": 0, "src_start": 0, "src_end": 1000, "out_start": 0}, {"seg": 1, "src_start": 4000, "src_end": 5000, "out_start": 1000}]


@pytest.mark.parametrize("text", ['{"silence_ms": "500"}', '{"silence_ms": 1.5}', '{"fps": true}', '{"layers": "filler"}', '{"layers": [1]}', "[]"])
def test_settings_of_the_wrong_type_are_errors(text):
    with pytest.raises(ValueError):
        readers.Settings.from_json(text)


def test_settings_rows(spark):
    assert readers.Settings.from_json('{"layers": null, "silence_ms": null}') == readers.Settings()
    df = spark.createDataFrame([(1, '{"silence_ms": 5, "layers": ["x"]}'), (2, None), (3, "not json"), (4, '{"silence_ms": "a"}')], "k long, j string")
    got = {r["k"]: (r["silence_ms"], r["fps"], tuple(r["layers"])) for r in readers.settings_rows(df, "j").collect()}
    own_layers = readers.Settings().layers
    assert got == {1: (5, 30, ("x",)), 2: (800, 30, own_layers), 3: (800, 30, own_layers), 4: (800, 30, own_layers)}


def test_settings_and_rules_from_files(spark, tmp_path):
    got = readers.Settings.from_json('{"silence_ms": 500, "layers": ["filler"], "other": 1}')
    assert got.silence_ms == 500 and got.layers == ("filler",) and got.fps == 30
    (tmp_path / "a.md").write_text("- lost\n# Filler\n- Um\n* äh\nprose\n## Protected\n- but\n")
    assert {(r["token"], r["rule"]) for r in readers.read_habits(spark, str(tmp_path)).collect()} == {("um", "filler"), ("äh", "filler"), ("but", "protected")}


def test_feedback_accumulates_and_streams(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [(1, 0, True, True, "restored", ["filler"], "um"), (1, 1, False, False, "added", None, "x"), (1, 2, True, True, "restored", ["filler"], "um")]
    for _ in range(2):
        sinks.append_feedback(spark.createDataFrame(rows, readers.FEEDBACK), path)
    history = readers.read_json(spark, path, "feedback")
    assert history.count() == 6
    best = {(r["reason"], r["text"], r["n"], r["rank"]) for r in feedback.examples(history, 2).collect()}
    assert best == {("filler", "um", 4, 1), ("", "x", 2, 1)}
    query = running_summary(feedback_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName("corrections").start()
    query.processAllAvailable()
    query.stop()
    assert {r["class"]: r["n"] for r in spark.table("corrections").collect()} == {"restored": 4, "added": 2}


def test_sinks_write_by_recording(spark, tmp_path):
    words = timed(spark, 1, "a b c", pauses=(2,))
    segs = review.segments(words, 500)
    sinks.write_json(segs, f"{tmp_path}/map")
    sinks.write_rendered(export.srt(export.cues(words, 500, 8)), f"{tmp_path}/srt")
    files = list(Path(tmp_path).glob("map/stream_id=1/*.json"))
    assert len(files) == 1 and [json.loads(x)["out_start"] for x in files[0].read_text().splitlines()] == [0, 550]
    many = spark.range(0, 400, 1, 16).select((F.col("id") % 3).alias("stream_id"), (400 - F.col("id")).alias("idx"))
    sinks.write_json(many, f"{tmp_path}/many")
    for s in range(3):
        (one,) = Path(tmp_path).glob(f"many/stream_id={s}/*.json")
        said = [json.loads(x)["idx"] for x in one.read_text().splitlines()]
        assert said == sorted(said) and len(said) > 100
    body = next(Path(tmp_path).glob("srt/stream_id=1/*.txt")).read_text()
    assert body.startswith("1\n00:00:00,000 --> 00:00:00,550\na b\n\n2\n00:00:00,550")


def test_empty_inputs(spark):
    words = spark.createDataFrame([], WORDS)
    cut = edit(words, spark.createDataFrame([], "token string, rule string"))
    assert cut.segments.count() == cut.cues.count() == export.srt(cut.cues).count() == 0


def test_parts_grow_with_the_texts(spark, monkeypatch):
    turns = spark.createDataFrame([(c, t, "so we go on. " * 20) for c in range(40) for t in range(3)], "conv_id long, turn long, text string")
    monkeypatch.setattr(review, "PART_CHARS", 1 << 12)
    parts = review.word_parts(turns)
    assert parts == -(-120 * 260 // (1 << 12)) and review.word_parts(turns.unionByName(turns)) > parts
    words = review.stand_in_words(turns)
    assert words.select(F.spark_partition_id().alias("p")).distinct().count() > 4 and words.count() == 120 * 80
    none = turns.limit(0)
    assert review.word_parts(none) == 1 and review.stand_in_words(none).count() == 0


def test_repeats_beyond_a_block(spark, monkeypatch):
    """Blocks of their own rows first, then open rows against later blocks, equal comparing all with all."""
    monkeypatch.setattr(detect, "BLOCK_SENTENCES", 3)
    rng = random.Random(6)
    rows = [(s, i, [float(rng.choice([-1, 0, 1])) for _ in range(6)]) for s in range(4) for i in range(0, 40, 1 + s)]
    rows += [(0, 90, [1.0, 1.0]), (0, 91, [0.0] * 6), (0, 92, None), (1, 5, [1.0] * 6)]
    length = lambda v: math.sqrt(sum(x * x for x in v))
    sound = [r for r in rows if r[2] and length(r[2]) > 0]
    want = {}
    for s, i, v in sound:
        for z, j, w in sound:
            if z == s and j > i and len(v) == len(w) and sum(a * b for a, b in zip(v, w)) / length(v) / length(w) >= 0.75:
                want[s, i] = min(j, want.get((s, i), j))
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"stream_id long, i long, embedding array<{kind}>")
        assert {(r["stream_id"], r["i"]): r["by"] for r in detect.repeats(df, 0.75).collect()} == want and any(j - i > 12 for (_, i), j in want.items())


def test_distances_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(8)
    said = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pairs = []
    for _ in range(150):
        a = said(rng.choice(["ab", "abc def", "é😀字d"]), rng.choice([1, 5, 63, 64, 65, 128, 129, 200]))
        changed = "".join(c if rng.random() > 0.1 else rng.choice(["", "xy", "q"]) for c in a)
        pairs.append((a, changed or "z" if rng.random() < 0.5 else said("abz", rng.choice([1, 64, 150]))))
    want = [distance(a, b) for a, b in pairs]
    for lanes, table in ((4096, 1 << 22), (3, 1 << 22), (4096, 0)):
        monkeypatch.setattr(many, "LANES", lanes)
        monkeypatch.setattr(many, "TABLE", table)
        assert many.edit_distances(*zip(*pairs)).tolist() == want
    assert many.edit_distances([], []).tolist() == []


def test_long_retakes_are_decided_in_a_moment(spark):
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefg ") for _ in range(n)) for n in (60_000, 59_000))
    near = "".join(c if rng.random() > 0.2 else "x" for c in b)
    lines = spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, near), (1, 3, None), (1, 4, "a b c"), (1, 5, "a b d")], "stream_id long, i long, line string")
    began = time.monotonic()
    got = {tuple(r) for r in detect.retakes(lines, 0.7, 2).collect()}
    assert got == {(1, 1, 2), (1, 4, 5)} and time.monotonic() - began < 60
