"""Conversion by a dictionary against a plain left-to-right search."""

import random

from scriptloom.functions.convert import convert_words, converted, read_dictionary
from test_editing import timed


def plain(text, entries):
    out, at = "", 0
    while at < len(text):
        size = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in entries), 0)
        out += entries[text[at : at + size]] if size else text[at]
        at += size or 1
    return out


def test_the_longest_phrase_decides(spark, tmp_path):
    (tmp_path / "d.txt").write_text("发\t發 髮\n头发\t頭髮\n后\t後\n皇后\t皇后\n# note\n\tx\n头\t頭\n")
    words = timed(spark, 1, "头发 发后 皇后后 嗯 理发")
    got = [r["text"] for r in convert_words(words, read_dictionary(spark, str(tmp_path / "d.txt"))).orderBy("idx").collect()]
    assert got == ["頭髮", "發後", "皇后後", "嗯", "理發"]


def test_conversion_equals_a_plain_search(spark):
    rng = random.Random(5)
    entries = {"".join(rng.choice("ab字") for _ in range(rng.randint(1, 4))): rng.choice(["", "X", "yy", "字"]) for _ in range(12)}
    texts = ["", *("".join(rng.choice("ab字😀") for _ in range(rng.randint(1, 15))) for _ in range(200))]
    table = spark.createDataFrame([*entries.items(), (next(iter(entries)), "zzz"), (None, "x"), ("", "x"), ("b", None)], "phrase string, into string")
    got = {r["text"]: r["into"] for r in converted(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), table).collect()}
    assert got == {t: plain(t, entries) for t in texts}


def test_odd_words(spark):
    words = spark.createDataFrame([(1, 0, None, "u"), (None, 1, "ab", "v"), (1, 2, "ab", "w")], "stream_id long, idx long, text string, into string")
    none = spark.createDataFrame([], "phrase string, into string")
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(convert_words(words, none)) == rows(words)
    one = spark.createDataFrame([("a", "c")], none.schema)
    assert rows(convert_words(words, one)) == sorted(map(str, [(1, 0, None, "u"), (None, 1, "cb", "v"), (1, 2, "cb", "w")]))
    assert convert_words(words.limit(0), one).count() == 0
