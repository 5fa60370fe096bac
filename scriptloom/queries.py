"""The editing operators as queries over the driver's tables, and the same in DuckDB SQL.

The tables hold no recordings, so words are made from conversations with synthetic times, and
the other inputs from tables that have the right shape. All queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.convert import convert_words
from .operators import align, captions, choose, detect, export, feedback, intervals, review, takes
from .plans.edit import decide, edit
from .session import read_table
from .sources import editlists
from .sources.readers import Settings, habits, manuscript, settings_rows

HABITS_MD = ["# Filler", "Words to drop.", "- the", "- und", "- et", "# Protected", "* not", "* of", "* und"]
SETTINGS_JSON = '{"silence_ms": 800, "layers": ["filler", "stumble", "event"], "unknown": 1}'
LAYERS = ("filler", "stumble", "event")
GAP_MS, CUE_WORDS, FPS = 800, 8, 30
FRAME_HIGH, FRAME_LOW, HOUR_MS = 60.0, 20.0, 3_600_000
EVERY_LAYER = Settings(silence_ms=GAP_MS, retake_likeness=0.35, repeat_cosine=0.2)


def _words(spark, sf_dir):
    return review.stand_in_words(read_table(spark, sf_dir, "conversations"))


def _habits(spark):
    lines = spark.createDataFrame([("a.md", i, x) for i, x in enumerate(HABITS_MD)], "file string, n int, value string")
    return habits(lines)


def _intervals(words):
    """A scored interval around every 25th word, as a detector of coughs would give."""
    return words.where("idx % 25 = 7").select("stream_id", F.lit("cough").alias("kind"), (F.col("start_ms") + 10).alias("start_ms"), (F.col("end_ms") + 200).alias("end_ms"), ((F.col("idx") % 10) / 10.0).alias("score"))


def _voiced(words):
    return words.where("idx % 40 < 38").select("stream_id", F.lit("voice").alias("kind"), "start_ms", "end_ms", F.lit(1.0).alias("score"))


def _decisions(words):
    return words.where("idx % 17 = 0").select("stream_id", "idx", (F.col("idx") % 2 == 0).alias("keep"))


def _layers(spark, words):
    return {"filler": detect.fillers(words, _habits(spark).where("rule = 'filler'")), "stumble": detect.stumbles(words), "event": detect.non_speech(words, _intervals(words), 0.5)}


def _proposals(spark, words):
    return review.protect(review.union_layers(_layers(spark, words), LAYERS), words, _habits(spark).where("rule = 'protected'"))


def _decided(spark, words):
    return decide(words, _habits(spark), Settings(layers=LAYERS), _decisions(words), events=_intervals(words))


def _manuscripts(words):
    """The words of most recordings, without every 13th, as the text that was to be read."""
    return words.where("stream_id % 7 <> 3 and idx % 13 <> 5").select("stream_id", "idx", "text")


def _vectors(spark, sf_dir):
    """Vectors of the first sentences of 50 recordings."""
    return read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("stream_id"), F.expr("vec_id div 50").alias("i"), "embedding")


def q_every_layer(spark, sf_dir):
    words = _words(spark, sf_dir)
    judged = words.where("idx % 31 = 4").select("stream_id", "idx", F.lit("judge").alias("layer"), F.lit("judge").alias("reason"))
    whole = decide(words, _habits(spark), EVERY_LAYER, _decisions(words), _intervals(words), _voiced(words), judged, _vectors(spark, sf_dir))
    return whole.select("stream_id", "idx", F.array_join("layers", "+").alias("layers"), F.array_join("reasons", "+").alias("reasons"), "n_layers", "keep")


def _kept(spark, sf_dir):
    """The kept words, dealt once more: what reads them, in several ways, begins there. Of equal numbers of parts Spark leaves a shuffle out."""
    turns = read_table(spark, sf_dir, "conversations")
    return _decided(spark, review.stand_in_words(turns)).where("keep").repartition(review.word_parts(turns) + 1, "stream_id")


def _segments(spark, sf_dir):
    return review.segments(_kept(spark, sf_dir), GAP_MS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to segments: fillers, stumbles and coughs cut, protection and overrides applied."""
    words = _words(spark, sf_dir)
    settings = Settings.from_json(SETTINGS_JSON)
    return edit(words, _habits(spark), settings, _decisions(words), events=_intervals(words)).segments


def q_manuscript(spark, sf_dir):
    return manuscript(read_table(spark, sf_dir, "benchmark"), "item_id", "text")


def q_habits(spark, sf_dir):
    """Each region is a file: its name a heading, its nations list items, with a line of prose between."""
    regions, nations = read_table(spark, sf_dir, "region"), read_table(spark, sf_dir, "nation")
    heads = regions.select(F.col("r_regionkey").alias("file"), F.explode(F.array(F.struct(F.lit(-2).alias("n"), F.concat(F.lit("## "), "r_name").alias("value")), F.struct(F.lit(-1).alias("n"), F.col("r_name").alias("value")))).alias("l"))
    items = nations.select(F.col("n_regionkey").alias("file"), F.col("n_nationkey").alias("n"), F.concat(F.lit("- "), "n_name").alias("value"))
    return habits(heads.select("file", "l.n", "l.value").unionByName(items))


def q_settings(spark, sf_dir):
    """A settings object from each event's own JSON."""
    k = F.get_json_object("props", "$.k")
    given = F.when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"silence_ms": '), k, F.lit(', "event_score": 0.25, "layers": ["filler", "'), "event_type", F.lit('"], "unknown": 1}')))
    rows = settings_rows(read_table(spark, sf_dir, "events").select("event_id", given.alias("given")), "given")
    return rows.select("event_id", "silence_ms", "cue_words", "event_score", F.array_join("layers", ",").alias("layers"))


def q_converted(spark, sf_dir):
    """The words rewritten by a dictionary of beginnings of the manuscript's words, two and four letters long."""
    said = q_manuscript(spark, sf_dir)
    begin = lambda n: said.where(f"char_length(text) >= {n}").select(F.substring("text", 1, n).alias("phrase"))
    entries = begin(2).select("phrase", F.concat(F.lit("["), "phrase", F.lit("]")).alias("into")).unionByName(begin(4).select("phrase", F.concat(F.lit("<"), "phrase", F.lit(">")).alias("into")))
    return convert_words(_words(spark, sf_dir).select("stream_id", "idx", "text"), entries.distinct())


def q_silence(spark, sf_dir):
    return detect.silences(_words(spark, sf_dir), GAP_MS)


def q_event_gaps(spark, sf_dir):
    return detect.event_gaps(read_table(spark, sf_dir, "events"), 3600)


def q_retakes(spark, sf_dir):
    return detect.retakes(review.document_lines(read_table(spark, sf_dir, "documents")), 0.7, 1)


def q_fillers(spark, sf_dir):
    return detect.fillers(_words(spark, sf_dir), _habits(spark).where("rule = 'filler'"))


def q_stumbles(spark, sf_dir):
    return detect.stumbles(_words(spark, sf_dir))


def q_repeats(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("stream_id"), F.col("vec_id").alias("i"), "embedding")
    return detect.repeats(vectors, 0.2)


def q_events(spark, sf_dir):
    words = _words(spark, sf_dir)
    return detect.non_speech(words, _intervals(words), 0.5)


def q_unvoiced(spark, sf_dir):
    words = _words(spark, sf_dir)
    return detect.unvoiced(words, _voiced(words))


def q_protect(spark, sf_dir):
    words = _words(spark, sf_dir)
    return review.protect(detect.fillers(words, _habits(spark).where("rule = 'filler'")), words, _habits(spark).where("rule = 'protected'"))


def q_layers(spark, sf_dir):
    return review.union_layers(_layers(spark, _words(spark, sf_dir)), ("filler", "event"))


def q_reasons(spark, sf_dir):
    rows = review.with_reasons(_proposals(spark, _words(spark, sf_dir)))
    return rows.withColumn("reasons", F.array_join("reasons", "+"))


def q_overrides(spark, sf_dir):
    return _decided(spark, _words(spark, sf_dir)).select("stream_id", "idx", "proposed", "keep")


def q_misheard(spark, sf_dir):
    words = _words(spark, sf_dir)
    return review.misheard(words, _manuscripts(words))


def q_misheard_pairs(spark, sf_dir):
    words = _words(spark, sf_dir)
    return review.misheard_in_context(words, _manuscripts(words))


def _edited_manuscripts(words):
    """The manuscripts once more, with words that were said otherwise and words that were not said."""
    base = words.where("stream_id % 7 <> 3")
    kept = base.where("idx % 13 <> 5").select("stream_id", (F.col("idx") * 2).alias("idx"), F.when(F.col("idx") % 29 == 11, F.lit("other")).otherwise(F.col("text")).alias("text"))
    return kept.unionByName(base.where("idx % 37 = 20").select("stream_id", (F.col("idx") * 2 + 1).alias("idx"), F.lit("unsaid").alias("text")))


def q_alignment(spark, sf_dir):
    words = _words(spark, sf_dir)
    return align.align(words, _edited_manuscripts(words))


def q_suspects(spark, sf_dir):
    words = _words(spark, sf_dir)
    return align.suspects(words, _edited_manuscripts(words))


def _stuttered(words):
    """The words with some phrases of two said twice and some words begun before they are said."""
    at = lambda moved: (F.col("idx") * 10 + moved).alias("idx")
    phrases = words.where("idx % 53 in (9, 10)").select("stream_id", at(F.when(F.col("idx") % 53 == 9, -4).otherwise(-13)), "text")
    begun = words.where("idx % 41 = 7 and char_length(text) > 3").select("stream_id", at(F.lit(-2)), F.concat(F.substring("text", 1, 2), F.lit("-")).alias("text"))
    return words.select("stream_id", at(F.lit(0)), "text").unionByName(phrases).unionByName(begun)


def q_tandems(spark, sf_dir):
    return takes.tandems(_stuttered(_words(spark, sf_dir)), 4)


def q_cut_offs(spark, sf_dir):
    return takes.cut_offs(_stuttered(_words(spark, sf_dir)))


def _broken_off(words):
    """The words with every 90th to 95th said once more, ten words later, as a speaker who begins anew."""
    later = words.where("idx % 90 between 60 and 65").select("stream_id", ((F.col("idx") - F.col("idx") % 90 + 70) * 10 + F.col("idx") % 90 - 59).alias("idx"), "text", (F.col("start_ms") + 4000).alias("start_ms"), (F.col("end_ms") + 4000).alias("end_ms"))
    return words.select("stream_id", (F.col("idx") * 10).alias("idx"), "text", "start_ms", "end_ms").unionByName(later)


def q_aborted(spark, sf_dir):
    return takes.aborted_takes(_broken_off(_words(spark, sf_dir)), 3, 20_000)


def _partly_voiced(words):
    """Voice activity that begins late in some words and leaves some out."""
    return words.where("idx % 40 < 38").select("stream_id", (F.col("start_ms") + (F.col("idx") % 5) * 60).alias("start_ms"), (F.col("end_ms") + 5).alias("end_ms"))


def _extents(words):
    return words.groupBy("stream_id").agg(F.lit(0).cast("long").alias("start_ms"), (F.max("end_ms") + 500).alias("end_ms"))


def q_quiet(spark, sf_dir):
    words = _words(spark, sf_dir)
    return intervals.silence_between(_extents(words), _partly_voiced(words), 300)


def q_frames(spark, sf_dir):
    """The events of a user as the frames of a signal, an hour each."""
    frames = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), F.col("value").alias("energy"))
    return intervals.voice_from_frames(frames, FRAME_HIGH, FRAME_LOW, 2 * HOUR_MS, 24 * HOUR_MS, HOUR_MS)


def q_mostly_unvoiced(spark, sf_dir):
    words = _words(spark, sf_dir)
    return intervals.mostly_outside(words, _partly_voiced(words), 0.7)


def q_output_quiet(spark, sf_dir):
    words = export.output_words(_kept(spark, sf_dir), GAP_MS)
    return intervals.silence_between(_extents(words), words, 200)


def q_cover(spark, sf_dir):
    """How many detections, of events and of voice, cover each moment."""
    words = _words(spark, sf_dir)
    return intervals.cover(_intervals(words).select("stream_id", "start_ms", "end_ms").unionByName(_partly_voiced(words)))


def q_reconcile(spark, sf_dir):
    """Expected words against a hearing that loses, changes and adds some."""
    expected = export.numbered(_kept(spark, sf_dir))
    heard = expected.where("not (stream_id % 4 = 1 and n % 50 = 49)").select("stream_id", (F.col("n") * 2).alias("n"), F.when((F.col("stream_id") + F.col("n")) % 60 == 0, F.lit("?")).otherwise(F.col("text")).alias("text"))
    added = expected.where("stream_id % 3 = 0 and n % 70 = 30").select("stream_id", (F.col("n") * 2 + 1).alias("n"), F.lit("uh").alias("text"))
    return align.reconcile(expected, heard.unionByName(added))


def q_time_map(spark, sf_dir):
    words = _words(spark, sf_dir)
    points = words.select("stream_id", F.col("start_ms").alias("src_ms"))
    return export.to_output_time(points, _segments(spark, sf_dir))


def q_srt_read(spark, sf_dir):
    """The cues as the rendered captions say them."""
    return editlists.parse_srt(q_srt(spark, sf_dir).select("stream_id", "body")).where("bad is null").drop("bad")


def q_srt_words(spark, sf_dir):
    """Word for word, the cut against its own captions, of which every ninth lost its text."""
    cues = q_srt_read(spark, sf_dir).withColumn("text", F.when(F.col("cue") % 9 == 0, F.lit("")).otherwise(F.col("text")))
    return align.reconcile(export.numbered(_kept(spark, sf_dir)), editlists.cue_words(cues))


def q_edl_read(spark, sf_dir):
    return editlists.parse_edl(q_edl(spark, sf_dir), FPS).where("bad is null").select("stream_id", "event", "src_frame", "rec_frame", "n_frames")


def q_timeline_read(spark, sf_dir):
    return editlists.parse_timeline(q_timeline_map(spark, sf_dir)).where("bad is null").drop("bad")


def q_timeline_map(spark, sf_dir):
    return export.timeline_map(_segments(spark, sf_dir))


def q_seams(spark, sf_dir):
    return review.seams(_kept(spark, sf_dir), GAP_MS, 3)


def q_cues(spark, sf_dir):
    return export.cues(_kept(spark, sf_dir), GAP_MS, CUE_WORDS)


def q_readable_cues(spark, sf_dir):
    return captions.readable_cues(_kept(spark, sf_dir), GAP_MS)


def q_chosen_spans(spark, sf_dir):
    """Spans of two detectors that often disagree on where a cut begins and ends."""
    words = _words(spark, sf_dir)
    span = lambda name, first, last, weight: (F.expr(first).alias("first_idx"), F.expr(last).alias("last_idx"), F.lit(name).alias("layer"), F.lit(name).alias("reason"), F.expr(weight).alias("weight"))
    takes_of = words.where("idx % 9 = 4").select("stream_id", *span("retake", "idx", "idx + idx % 7", "10 + idx % 13"))
    judged = words.where("idx % 14 = 3").select("stream_id", *span("judge", "idx - 2", "idx + 5", "20 + idx % 5"))
    return choose.without_overlap(takes_of.unionByName(judged))


def q_srt(spark, sf_dir):
    return export.srt(q_cues(spark, sf_dir))


def q_transcript(spark, sf_dir):
    return export.transcript(_kept(spark, sf_dir))


def q_edl_events(spark, sf_dir):
    return export.edl_events(_segments(spark, sf_dir), FPS)


def q_edl(spark, sf_dir):
    return export.edl(q_edl_events(spark, sf_dir))


def q_fcpxml(spark, sf_dir):
    return export.fcpxml(_segments(spark, sf_dir), FPS)


def q_check_duration(spark, sf_dir):
    observed = q_cues(spark, sf_dir).groupBy("stream_id").agg((F.max("end_ms") + F.when(F.col("stream_id") % 3 == 0, 900).otherwise(10)).alias("observed_ms"))
    return export.check_duration(_segments(spark, sf_dir), observed, 100)


def q_check_silence(spark, sf_dir):
    return detect.silences(export.output_words(_kept(spark, sf_dir), GAP_MS), 200)


def q_check_words(spark, sf_dir):
    expected = export.numbered(_kept(spark, sf_dir))
    heard = expected.where("not (stream_id % 4 = 1 and n % 50 = 49)").select("stream_id", "n", F.when((F.col("stream_id") + F.col("n")) % 60 == 0, F.lit("?")).otherwise(F.col("text")).alias("text"))
    return export.check_words(expected, heard)


def _feedback(spark, sf_dir):
    return feedback.of_decided(_decided(spark, _words(spark, sf_dir)))


def q_feedback(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    pre = docs.select("doc_id", (F.col("n_chars") < 600).alias("proposed"))
    final = labels.select("doc_id", (F.col("quality") == 1).alias("kept"))
    return feedback.differences(pre, final, ["doc_id"])


def q_feedback_summary(spark, sf_dir):
    return feedback.summary(_feedback(spark, sf_dir), ["stream_id", "class"])


def q_examples(spark, sf_dir):
    return feedback.examples(_feedback(spark, sf_dir), 5)


def q_varied_examples(spark, sf_dir):
    """Corrections with the word that follows, so that examples have words in common."""
    records = _feedback(spark, sf_dir)
    after = F.lead("text").over(detect.by_stream())
    return feedback.varied_examples(records.withColumn("text", F.concat_ws(" ", "text", after)), 6)


_WORDS = r"""
toks AS (SELECT conv_id AS stream_id, turn, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM conversations)),
timed AS (SELECT *, 40 + 60 * length(text) AS took, CASE WHEN text LIKE '%.' THEN 900 WHEN text LIKE '%,' THEN 250 ELSE 20 END AS pause FROM toks),
placed AS (SELECT stream_id, row_number() OVER w - 1 AS idx, text, took, CAST(coalesce(sum(took + pause) OVER (PARTITION BY stream_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM timed WINDOW w AS (PARTITION BY stream_id ORDER BY turn, pos)),
words AS (SELECT stream_id, idx, text, start_ms, start_ms + took AS end_ms, regexp_replace(lower(text), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g') AS bare FROM placed)"""
_LAYERS = (
    _WORDS
    + r""",
coughs AS (SELECT stream_id, start_ms + 10 AS a, end_ms + 200 AS b FROM words WHERE idx % 25 = 7 AND (idx % 10) / 10.0 >= 0.5),
filler AS (SELECT stream_id, idx, 'filler' AS layer, 'filler' AS reason FROM words WHERE bare IN ('the', 'und', 'et')),
stumble AS (SELECT stream_id, idx, 'stumble' AS layer, 'stumble' AS reason FROM (SELECT *, lead(bare) OVER (PARTITION BY stream_id ORDER BY idx) AS n FROM words) WHERE bare = n AND bare <> ''),
event AS (SELECT DISTINCT w.stream_id, w.idx, 'event' AS layer, 'event' AS reason FROM words w JOIN coughs c ON w.stream_id = c.stream_id AND w.start_ms < c.b AND c.a < w.end_ms),
proposals AS (SELECT p.* FROM (SELECT * FROM filler UNION ALL SELECT * FROM stumble UNION ALL SELECT * FROM event) p JOIN words USING (stream_id, idx) WHERE bare NOT IN ('not', 'of', 'und')),
reasons AS (SELECT stream_id, idx, array_to_string(list_sort(list(DISTINCT reason)), '+') AS reasons, count(DISTINCT layer) AS n_layers FROM proposals GROUP BY ALL),
decided AS (SELECT w.*, r.reasons, r.idx IS NOT NULL AS proposed, coalesce(CASE WHEN w.idx % 17 = 0 THEN w.idx % 2 = 0 END, r.idx IS NULL) AS keep FROM words w LEFT JOIN reasons r USING (stream_id, idx)),
kept AS (SELECT *, CASE WHEN lag(idx) OVER w IS NULL OR idx <> lag(idx) OVER w + 1 OR start_ms - lag(end_ms) OVER w > 800 THEN 1 ELSE 0 END AS fresh FROM decided WHERE keep WINDOW w AS (PARTITION BY stream_id ORDER BY idx)),
inseg AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS BIGINT) AS seg FROM kept),
spans AS (SELECT stream_id, seg, min(start_ms) AS src_start, max(end_ms) AS src_end, count(*) AS n_words FROM inseg GROUP BY ALL),
segs AS (SELECT stream_id, seg, src_start, src_end, CAST(coalesce(sum(src_end - src_start) OVER (PARTITION BY stream_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start, n_words FROM spans),
outw AS (SELECT i.stream_id, i.idx, i.text, i.seg, row_number() OVER (PARTITION BY i.stream_id, i.seg ORDER BY i.idx) - 1 AS place, i.start_ms + s.out_start - s.src_start AS start_ms, i.end_ms + s.out_start - s.src_start AS end_ms FROM inseg i JOIN segs s USING (stream_id, seg)),
parts AS (SELECT stream_id, seg, place // 8 AS part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY idx) AS text FROM outw GROUP BY ALL),
cues AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY seg, part) AS cue, start_ms, end_ms, text FROM parts),
fr AS (SELECT stream_id, seg, (src_start * 30 + 500) // 1000 AS f_in, greatest((src_end * 30 + 500) // 1000, (src_start * 30 + 500) // 1000 + 1) AS f_out FROM segs),
recs AS (SELECT *, CAST(coalesce(sum(f_out - f_in) OVER (PARTITION BY stream_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rec FROM fr)"""
)


def _padded(x: str, width: int = 2) -> str:
    return f"CASE WHEN length(CAST({x} AS VARCHAR)) < {width} THEN lpad(CAST({x} AS VARCHAR), {width}, '0') ELSE CAST({x} AS VARCHAR) END"


def _clock(c: str) -> str:
    return f"{_padded(f'{c} // 3600000')} || ':' || {_padded(f'{c} // 60000 % 60')} || ':' || {_padded(f'{c} // 1000 % 60')} || ',' || {_padded(f'{c} % 1000', 3)}"


def _timecode(c: str) -> str:
    return "||':'||".join(_padded(x) for x in (f"({c}) // 108000", f"({c}) // 1800 % 60", f"({c}) // 30 % 60", f"({c}) % 30"))


def _alike(a: str, b: str, least: float) -> str:
    """Likeness of two lines by characters: DuckDB's distance counts bytes, so each letter of the pair becomes one byte."""
    one = [f"array_to_string(list_transform(string_split({c}, ''), lambda x: chr(CAST(list_position(letters, x) AS INTEGER))), '')" for c in (a, b)]
    return f"CASE WHEN {a} = {b} THEN true WHEN len(letters) > 127 THEN error('more letters in a pair than bytes that stand for one') ELSE 1 - CAST(levenshtein({one[0]}, {one[1]}) AS DOUBLE) / greatest(length({a}), length({b})) >= {least} END"


_EDL = f"edl AS (SELECT stream_id, seg + 1 AS event, {_timecode('f_in')} AS src_in, {_timecode('f_out')} AS src_out, {_timecode('rec')} AS rec_in, {_timecode('rec + f_out - f_in')} AS rec_out FROM recs)"
_FEEDBACK = ", fb AS (SELECT stream_id, idx, text, reasons, CASE WHEN proposed AND keep THEN 'restored' WHEN NOT proposed AND NOT keep THEN 'added' ELSE 'agreed' END AS class FROM decided)"
_BENCH = r"man AS (SELECT item_id AS stream_id, generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS text FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM benchmark))"
_MAN = "man AS (SELECT stream_id, idx, bare FROM words WHERE stream_id % 7 <> 3 AND idx % 13 <> 5)"


def _aligned(heard: str, meant: str) -> str:
    """CTEs that align two tables (stream_id, idx, w): single runs of three words, their longest chain, edit distance between, a path from the end."""

    def single(side: str, pos: str) -> str:
        return f"SELECT stream_id, g, min(pos) AS {pos} FROM (SELECT stream_id, pos, [w, lead(w, 1) OVER p, lead(w, 2) OVER p] AS g, lead(w, 2) OVER p AS l FROM {side} WINDOW p AS (PARTITION BY stream_id ORDER BY pos)) WHERE l IS NOT NULL GROUP BY stream_id, g HAVING count(*) = 1"

    def stretches(side: str, pos: str, w: str, i: str) -> str:
        return f"SELECT stream_id, stretch, list(w ORDER BY pos) AS {w}, list(idx ORDER BY pos) AS {i} FROM (SELECT x.*, c.{pos} IS NOT NULL AS anchor, count(c.{pos}) OVER (PARTITION BY x.stream_id ORDER BY x.pos) AS stretch FROM {side} x LEFT JOIN chosen c ON c.stream_id = x.stream_id AND c.{pos} = x.pos) WHERE NOT anchor GROUP BY stream_id, stretch"

    return f"""
hs AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS pos FROM {heard}),
ms AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS pos FROM {meant}),
met AS (SELECT stream_id, pos, m_pos FROM ({single("hs", "pos")}) JOIN ({single("ms", "m_pos")}) USING (stream_id, g)),
runs AS (SELECT stream_id, list(pos ORDER BY pos) AS ps, list(m_pos ORDER BY pos) AS qs FROM met GROUP BY stream_id),
lengths AS (SELECT *, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(qs, lambda q: [q])), lambda acc, x: list_append(acc, 1 + coalesce(list_max(list_transform(list_filter(range(1, len(acc) + 1), lambda k: qs[k] < x[1]), lambda k: acc[k])), 0))) AS ls FROM runs),
chains AS (SELECT stream_id, list_reduce(list_prepend([list_max(ls), 9223372036854775807], list_reverse(list_transform(range(1, len(ls) + 1), lambda k: [ls[k], qs[k], ps[k]]))),
  lambda acc, x: CASE WHEN x[1] = acc[1] AND x[2] < acc[2] THEN list_concat([acc[1] - 1, x[2]], list_append(acc[3:], x[3])) ELSE acc END)[3:] AS c FROM lengths),
chosen AS MATERIALIZED (SELECT stream_id, pos, m_pos FROM (SELECT stream_id, unnest(c) AS pos FROM chains) JOIN met USING (stream_id, pos)),
st AS MATERIALIZED (SELECT stream_id, stretch, coalesce(a, []) AS a, coalesce(ai, []) AS ai, coalesce(b, []) AS b, coalesce(bi, []) AS bi FROM ({stretches("hs", "pos", "a", "ai")}) FULL JOIN ({stretches("ms", "m_pos", "b", "bi")}) USING (stream_id, stretch)),
dp AS (SELECT stream_id, stretch, CAST(0 AS BIGINT) AS i, range(0, len(b) + 1) AS r FROM st UNION ALL
  SELECT stream_id, stretch, i + 1, list_reduce(list_prepend([i + 1], list_transform(range(1, len(b) + 1), lambda j: [least(r[j + 1] + 1, r[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END)])), lambda acc, x: list_append(acc, least(acc[len(acc)] + 1, x[1]))) FROM dp JOIN st USING (stream_id, stretch) WHERE i < len(a)),
way AS (SELECT stream_id, stretch, CAST(len(a) AS BIGINT) AS i, CAST(len(b) AS BIGINT) AS j, CAST(NULL AS BIGINT) AS hi, CAST(NULL AS BIGINT) AS mj FROM st UNION ALL
  SELECT stream_id, stretch, i - CAST(step < 2 AS BIGINT), j - CAST(step <> 1 AS BIGINT), CASE WHEN step < 2 THEN i END, CASE WHEN step <> 1 THEN j END FROM
  (SELECT y.*, CASE WHEN y.i > 0 AND y.j > 0 AND d.r[y.j + 1] = u.r[y.j] + CASE WHEN s.a[y.i] = s.b[y.j] THEN 0 ELSE 1 END THEN 0 WHEN y.i > 0 AND d.r[y.j + 1] = u.r[y.j + 1] + 1 THEN 1 ELSE 2 END AS step
   FROM way y JOIN st s USING (stream_id, stretch) JOIN dp d ON d.stream_id = y.stream_id AND d.stretch = y.stretch AND d.i = y.i LEFT JOIN dp u ON u.stream_id = y.stream_id AND u.stretch = y.stretch AND u.i = y.i - 1 WHERE y.i > 0 OR y.j > 0)),
aligned AS (SELECT stream_id, ai[hi] AS idx, bi[mj] AS m_idx, CASE WHEN hi IS NULL THEN 'deleted' WHEN mj IS NULL THEN 'inserted' WHEN a[hi] = b[mj] THEN 'same' ELSE 'replaced' END AS op FROM way JOIN st USING (stream_id, stretch) WHERE hi IS NOT NULL OR mj IS NOT NULL
  UNION ALL SELECT c.stream_id, h.idx, m.idx, 'same' FROM chosen c JOIN hs h ON h.stream_id = c.stream_id AND h.pos = c.pos JOIN ms m ON m.stream_id = c.stream_id AND m.pos = c.m_pos)"""


_EDITED = "eman AS (SELECT stream_id, idx * 2 AS idx, CASE WHEN idx % 29 = 11 THEN 'other' ELSE text END AS text, CASE WHEN idx % 29 = 11 THEN 'other' ELSE bare END AS w FROM words WHERE stream_id % 7 <> 3 AND idx % 13 <> 5 UNION ALL SELECT stream_id, idx * 2 + 1, 'unsaid', 'unsaid' FROM words WHERE stream_id % 7 <> 3 AND idx % 37 = 20), heard AS (SELECT stream_id, idx, bare AS w FROM words), mine AS (SELECT * FROM heard WHERE stream_id IN (SELECT stream_id FROM eman))"
_HEARD = "e AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS idx, text AS w FROM kept), o AS (SELECT stream_id, idx * 2 AS idx, CASE WHEN (stream_id + idx) % 60 = 0 THEN '?' ELSE w END AS w FROM e WHERE NOT (stream_id % 4 = 1 AND idx % 50 = 49) UNION ALL SELECT stream_id, idx * 2 + 1, 'uh' FROM e WHERE stream_id % 3 = 0 AND idx % 70 = 30)"
_STUTTERED = """said AS (SELECT stream_id, idx * 10 AS idx, text FROM words UNION ALL SELECT stream_id, idx * 10 + CASE WHEN idx % 53 = 9 THEN -4 ELSE -13 END, text FROM words WHERE idx % 53 IN (9, 10)
  UNION ALL SELECT stream_id, idx * 10 - 2, substr(text, 1, 2) || '-' FROM words WHERE idx % 41 = 7 AND length(text) > 3),
side AS (SELECT stream_id, idx, lower(text) AS low, regexp_replace(lower(text), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g') AS w, row_number() OVER (PARTITION BY stream_id ORDER BY idx, text) - 1 AS pos FROM said)"""
_TANDEMS = f"""WITH {_WORDS}, {_STUTTERED},
hits AS (SELECT a.stream_id, a.pos, p.period FROM side a, range(1, 5) p(period), side b WHERE b.stream_id = a.stream_id AND b.pos = a.pos + p.period AND a.w = b.w AND a.w <> ''),
runs AS (SELECT stream_id, period, min(pos) AS s, min(pos) + count(*) + period AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY stream_id, period ORDER BY pos) AS island FROM hits) GROUP BY stream_id, period, island HAVING count(*) >= period)
SELECT r.stream_id, f.idx AS first_idx, l.idx AS last_idx, r.period, (r.e - r.s) // r.period AS times FROM runs r JOIN side f ON f.stream_id = r.stream_id AND f.pos = r.s JOIN side l ON l.stream_id = r.stream_id AND l.pos = r.e - 1
WHERE NOT EXISTS (SELECT 1 FROM runs q WHERE q.stream_id = r.stream_id AND q.period < r.period AND q.s <= r.s AND q.e >= r.e)"""
_ABORTED = f"""WITH {_WORDS},
said AS (SELECT stream_id, idx * 10 AS idx, text, start_ms, end_ms FROM words UNION ALL SELECT stream_id, (idx - idx % 90 + 70) * 10 + idx % 90 - 59, text, start_ms + 4000, end_ms + 4000 FROM words WHERE idx % 90 BETWEEN 60 AND 65),
side AS (SELECT stream_id, idx, start_ms, end_ms, regexp_replace(lower(text), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g') AS w, row_number() OVER (PARTITION BY stream_id ORDER BY idx, text) - 1 AS pos FROM said),
threes AS (SELECT stream_id, pos, start_ms, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(end_ms, 2) OVER o AS end_ms FROM side WINDOW o AS (PARTITION BY stream_id ORDER BY pos)),
seeds AS (SELECT stream_id, pos, lead(pos) OVER o - pos AS d, lead(start_ms) OVER o - end_ms AS wait FROM threes WHERE a <> '' AND b <> '' AND c <> '' WINDOW o AS (PARTITION BY stream_id, a, b, c ORDER BY pos)),
spans AS (SELECT stream_id, d, min(pos) AS s, max(pos) + 3 AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY stream_id, d ORDER BY pos) AS island FROM seeds WHERE d >= 3 AND wait <= 20000) GROUP BY stream_id, d, island),
chained AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY s, d) AS chain FROM (SELECT *, CASE WHEN s - lag(e) OVER o > 3 OR abs(d - lag(d) OVER o) > 2 OR lag(e) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM spans WINDOW o AS (PARTITION BY stream_id ORDER BY s, d))),
found AS (SELECT stream_id, min(s) AS s, max(e) AS e, min(s) + arg_min(d, (s, d)) AS again FROM chained GROUP BY stream_id, chain),
cut AS (SELECT stream_id, s, CASE WHEN again - least(e, again) <= 6 THEN again ELSE least(e, again) END AS e, again FROM found)
SELECT c.stream_id, f.idx AS first_idx, l.idx AS last_idx, n.idx AS again_idx FROM cut c JOIN side f ON f.stream_id = c.stream_id AND f.pos = c.s JOIN side l ON l.stream_id = c.stream_id AND l.pos = c.e - 1 JOIN side n ON n.stream_id = c.stream_id AND n.pos = c.again"""
_PARTLY = "part AS (SELECT stream_id, start_ms + idx % 5 * 60 AS s, end_ms + 5 AS e FROM words WHERE idx % 40 < 38 AND start_ms + idx % 5 * 60 < end_ms + 5)"


def _quiet(extents: str, spans: str, least: int) -> str:
    """What the spans leave of the extents: from the furthest end so far to the next start."""
    return f"""ext AS ({extents}), inner_spans AS (SELECT p.stream_id, greatest(p.s, x.s) AS s, least(p.e, x.e) AS e FROM {spans} p JOIN ext x USING (stream_id) WHERE p.s < x.e AND x.s < p.e UNION ALL SELECT stream_id, e, e FROM ext UNION ALL SELECT stream_id, s, s FROM ext),
holes AS (SELECT stream_id, max(e) OVER (PARTITION BY stream_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start_ms, s AS end_ms FROM inner_spans)
SELECT stream_id, start_ms, end_ms, end_ms - start_ms AS gap_ms FROM holes WHERE end_ms - start_ms >= {least}"""


def _extent(table: str) -> str:
    return f"SELECT stream_id, CAST(0 AS BIGINT) AS s, max(end_ms) + 500 AS e FROM {table} GROUP BY 1"


_FRAMES = f"""WITH f AS (SELECT user_id AS stream_id, epoch_us(ts) // 1000 AS t, max(value) AS v FROM events GROUP BY ALL),
steps AS (SELECT *, CASE WHEN v >= {FRAME_HIGH} THEN 1 WHEN v < {FRAME_LOW} OR coalesce(t - lag(t) OVER o > {25 * HOUR_MS}, true) THEN 0 END AS turn FROM f WINDOW o AS (PARTITION BY stream_id ORDER BY t)),
states AS (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY t) AS on_now FROM steps),
runs AS (SELECT *, sum(CASE WHEN t - before <= {25 * HOUR_MS} THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY t) AS run FROM (SELECT *, lag(t) OVER (PARTITION BY stream_id ORDER BY t) AS before FROM states WHERE on_now = 1))
SELECT stream_id, min(t) AS start_ms, max(t) + {HOUR_MS} AS end_ms FROM runs GROUP BY stream_id, run HAVING max(t) + {HOUR_MS} - min(t) >= {2 * HOUR_MS}"""
_MOSTLY = f"""WITH {_WORDS}, {_PARTLY},
blocks AS (SELECT *, sum(CASE WHEN s <= furthest THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT *, max(e) OVER (PARTITION BY stream_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM part)),
voice AS (SELECT stream_id, min(s) AS s, max(e) AS e FROM blocks GROUP BY stream_id, b),
heard AS (SELECT w.stream_id, w.idx, w.end_ms - w.start_ms AS took, sum(CASE WHEN v.s IS NULL THEN 0 ELSE least(v.e, w.end_ms) - greatest(v.s, w.start_ms) END) AS ms FROM words w LEFT JOIN voice v ON v.stream_id = w.stream_id AND v.s < w.end_ms AND w.start_ms < v.e GROUP BY w.stream_id, w.idx, took)
SELECT stream_id, idx, 'unvoiced' AS layer, 'unvoiced' AS reason FROM heard WHERE ms <= CAST(0.7 AS DOUBLE) * took"""
_COVER = f"""WITH {_WORDS}, {_PARTLY}, every AS (SELECT * FROM part UNION ALL SELECT stream_id, start_ms + 10, end_ms + 200 FROM words WHERE idx % 25 = 7),
cuts AS (SELECT stream_id, s AS t FROM every UNION SELECT stream_id, e FROM every),
cells AS (SELECT stream_id, t AS s, lead(t) OVER (PARTITION BY stream_id ORDER BY t) AS e FROM cuts),
counted AS (SELECT c.stream_id, c.s, c.e, count(*) AS n FROM cells c JOIN every v ON v.stream_id = c.stream_id AND v.s <= c.s AND c.e <= v.e GROUP BY ALL),
runs AS (SELECT *, sum(f) OVER (PARTITION BY stream_id ORDER BY s) AS run FROM (SELECT *, CASE WHEN lag(e) OVER o = s AND lag(n) OVER o = n THEN 0 ELSE 1 END AS f FROM counted WINDOW o AS (PARTITION BY stream_id ORDER BY s)))
SELECT stream_id, min(s) AS start_ms, max(e) AS end_ms, n FROM runs GROUP BY stream_id, run, n"""
def _readable() -> str:
    """Least costs from the end of a segment as a fold over its words; a cost and the words of the first cue share a number."""
    r = captions.Reading()
    bound = ", ".join(f"'{w}'" for w in r.bound)
    chars = "(p[j + 1] - p[i] + j - i)"
    end = f"CASE WHEN j = len(t) THEN 0 WHEN b[j] THEN {r.bound_price} WHEN c[j] THEN 0 ELSE {r.open_price} END"
    cost = f"{r.cue_price} + greatest(0, {r.chars} - {chars}) * greatest(0, {r.chars} - {chars}) + {end} + greatest(0, 1000 * {chars} - {r.chars_a_second} * (e[j] - s[i])) // 100"
    least = f"list_min(list_transform(list_filter(range(i, least(len(t), i + {r.chars}) + 1), lambda j: j = i OR {chars} <= {r.chars}), lambda j: ({cost} + acc[len(t) - j + 1] // 1000) * 1000 + 999 - (j - i + 1)))"
    return f"""WITH {_LAYERS},
seglists AS (SELECT stream_id, seg, list(text ORDER BY idx) AS t, list(start_ms ORDER BY idx) AS s, list(end_ms ORDER BY idx) AS e, list(regexp_replace(lower(text), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g') IN ({bound}) ORDER BY idx) AS b,
  list(substr(text, -1, 1) IN ('.', ',', ';', ':', '!', '?', '。', '，', '！', '？') ORDER BY idx) AS c FROM outw GROUP BY stream_id, seg),
sums AS (SELECT *, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(t) + 1), lambda k: CAST(list_sum(list_transform(t[:k], lambda x: length(x))) AS BIGINT))) AS p FROM seglists),
solved AS (SELECT *, list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(len(t), 0, -1), lambda i: [i])), lambda acc, x: list_append(acc, list_transform([x[1]], lambda i: {least})[1])) AS f FROM sums),
walked AS (SELECT *, list_reduce(list_prepend([CAST(1 AS BIGINT)], list_transform(range(1, len(t) + 1), lambda i: [i])), lambda acc, x: CASE WHEN x[1] = acc[1] THEN list_append(list_concat([x[1] + 999 - f[len(t) - x[1] + 2] % 1000], acc[2:]), x[1]) ELSE acc END)[2:] AS starts FROM solved),
each AS (SELECT stream_id, seg, unnest(starts) AS i, unnest(list_append(starts[2:], len(t) + 1)) AS n, t, s, e FROM walked)
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY seg, i) AS cue, s[i] AS start_ms, list_max(e[i:n - 1]) AS end_ms, array_to_string(t[i:n - 1], ' ') AS text FROM each"""


_CHOSEN = f"""WITH {_WORDS},
spans AS (SELECT stream_id, idx AS f, idx + idx % 7 AS l, 'retake' AS layer, 10 + idx % 13 AS w FROM words WHERE idx % 9 = 4 UNION ALL SELECT stream_id, idx - 2, idx + 5, 'judge', 20 + idx % 5 FROM words WHERE idx % 14 = 3),
listed AS (SELECT stream_id, list(f ORDER BY l, f, layer) AS fs, list(l ORDER BY l, f, layer) AS ls, list(layer ORDER BY l, f, layer) AS layers, list(w ORDER BY l, f, layer) AS ws FROM spans GROUP BY stream_id),
met AS (SELECT *, list_transform(fs, lambda f: len(list_filter(ls, lambda l: l < f))) AS before FROM listed),
solved AS (SELECT *, list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, len(fs) + 1), lambda k: [k])), lambda acc, x: list_append(acc, greatest(acc[len(acc)], ws[x[1]] + acc[before[x[1]] + 1]))) AS best FROM met),
picked AS (SELECT *, list_reduce(list_prepend([CAST(len(fs) AS BIGINT)], list_transform(range(len(fs), 0, -1), lambda k: [k])), lambda acc, x: CASE WHEN x[1] <> acc[1] THEN acc WHEN ws[x[1]] + best[before[x[1]] + 1] > best[x[1]] THEN list_append(list_concat([CAST(before[x[1]] AS BIGINT)], acc[2:]), x[1]) ELSE list_concat([acc[1] - 1], acc[2:]) END)[2:] AS ks FROM solved)
SELECT stream_id, fs[k] AS first_idx, ls[k] AS last_idx, layers[k] AS layer, layers[k] AS reason, ws[k] AS weight FROM (SELECT *, unnest(ks) AS k FROM picked)"""
_LOST = "e AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS idx, text AS w FROM kept), o AS (SELECT stream_id, cue * 4294967296 + generate_subscripts(t, 1) - 1 AS idx, unnest(t) AS w FROM (SELECT stream_id, cue, string_split(text, ' ') AS t FROM cues WHERE cue % 9 <> 0))"
_VARIED = f"""WITH RECURSIVE {_LAYERS}{_FEEDBACK}, pairs AS (SELECT class, reasons, concat_ws(' ', text, lead(text) OVER (PARTITION BY stream_id ORDER BY idx)) AS text FROM fb),
x AS (SELECT unnest(string_split(coalesce(reasons, ''), '+')) AS reason, class, text FROM pairs WHERE class <> 'agreed'), counted AS (SELECT reason, class, text, count(*) AS n FROM x GROUP BY ALL),
cand AS (SELECT *, list_distinct(string_split(lower(text), ' ')) AS ws FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY n DESC, class, text) AS place FROM counted) WHERE place <= 1000),
picked AS (SELECT DISTINCT reason, CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS shown, CAST([] AS BIGINT[]) AS gone FROM cand
  UNION ALL SELECT reason, rank, place, shown, gone FROM (SELECT p.reason, p.rank + 1 AS rank, c.place, list_concat(p.shown, c.ws) AS shown, list_append(p.gone, c.place) AS gone,
    row_number() OVER (PARTITION BY p.reason ORDER BY c.n * len(list_filter(c.ws, lambda w: NOT list_contains(p.shown, w))) DESC, c.n DESC, c.class, c.text) AS best
    FROM picked p JOIN cand c ON c.reason = p.reason AND NOT list_contains(p.gone, c.place) WHERE p.rank < 6) WHERE best = 1)
SELECT reason, CAST(rank AS INTEGER) AS rank, class, text, n FROM picked JOIN cand USING (reason, place) WHERE rank > 0"""
_CONVERTED = f"""WITH {_WORDS}, {_BENCH},
dict AS (SELECT DISTINCT text[1:2] AS phrase, '[' || text[1:2] || ']' AS form FROM man WHERE length(text) >= 2 UNION SELECT text[1:4], '<' || text[1:4] || '>' FROM man WHERE length(text) >= 4),
vocab AS (SELECT DISTINCT text FROM words),
best AS (SELECT text, p, max(n) AS n, arg_max(form, n) AS form FROM (SELECT v.text, v.p, d.form, length(d.phrase) AS n FROM (SELECT text, unnest(range(1, length(text) + 1)) AS p FROM vocab) v JOIN dict d ON (length(d.phrase) = 2 AND d.phrase = v.text[v.p:v.p + 1]) OR (length(d.phrase) = 4 AND d.phrase = v.text[v.p:v.p + 3])) GROUP BY text, p),
steps AS (SELECT v.text, list([CAST(p AS VARCHAR), CAST(coalesce(n, 1) AS VARCHAR), coalesce(form, v.text[p:p])] ORDER BY p) AS l FROM (SELECT text, unnest(range(1, length(text) + 1)) AS p FROM vocab) v LEFT JOIN best USING (text, p) GROUP BY v.text),
done AS (SELECT text, list_reduce(list_prepend(['1', ''], l), lambda acc, x: CASE WHEN CAST(x[1] AS INTEGER) < CAST(acc[1] AS INTEGER) THEN acc ELSE [CAST(CAST(x[1] AS INTEGER) + CAST(x[2] AS INTEGER) AS VARCHAR), acc[2] || x[3]] END)[2] AS form FROM steps)
SELECT stream_id, idx, form AS text FROM words JOIN done USING (text)"""
_EVERY = (
    _LAYERS
    + """,
ends AS (SELECT stream_id, idx, text, coalesce(regexp_matches(text, '[.!?。！？]$'), false) OR coalesce(lead(start_ms) OVER w - end_ms > 800, false) AS e FROM words WINDOW w AS (PARTITION BY stream_id ORDER BY idx)),
numbered AS (SELECT stream_id, idx, text, CAST(coalesce(sum(e::INT) OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS i FROM ends),
sent AS (SELECT stream_id, i, string_agg(text, ' ' ORDER BY idx) AS line FROM numbered GROUP BY ALL),
ahead AS (SELECT a.stream_id, a.i, a.line, b.line AS n, list_distinct(string_split(a.line || b.line, '')) AS letters FROM sent a JOIN sent b ON a.stream_id = b.stream_id AND b.i BETWEEN a.i + 1 AND a.i + 2
  WHERE regexp_matches(trim(a.line), '\\S\\s+\\S') AND least(length(a.line), length(b.line)) >= 0.34 * greatest(length(a.line), length(b.line))),
taken AS (SELECT DISTINCT stream_id, i, 'retake' AS layer FROM ahead WHERE """
    + _alike("line", "n", 0.35)
    + """),
vecs AS (SELECT vec_id % 50 AS stream_id, vec_id // 50 AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
again AS (SELECT DISTINCT a.stream_id, a.i, 'repeat' AS layer FROM vecs a JOIN vecs b ON a.stream_id = b.stream_id AND a.i < b.i WHERE list_cosine_similarity(a.e, b.e) >= 0.2),
voiced AS (SELECT stream_id, start_ms AS a, end_ms AS b FROM words WHERE idx % 40 < 38),
every AS (SELECT stream_id, idx, layer FROM filler UNION ALL SELECT stream_id, idx, layer FROM stumble UNION ALL SELECT stream_id, idx, layer FROM event
  UNION ALL SELECT stream_id, idx, layer FROM numbered JOIN (SELECT * FROM taken UNION ALL SELECT * FROM again) USING (stream_id, i)
  UNION ALL SELECT stream_id, idx, 'unvoiced' FROM words w WHERE NOT EXISTS (SELECT 1 FROM voiced v WHERE v.stream_id = w.stream_id AND w.start_ms < v.b AND v.a < w.end_ms)
  UNION ALL SELECT stream_id, idx, 'judge' FROM words WHERE idx % 31 = 4),
found AS (SELECT stream_id, idx, list_sort(list(DISTINCT layer)) AS layers FROM every JOIN words USING (stream_id, idx) WHERE bare NOT IN ('not', 'of', 'und') GROUP BY ALL)"""
)

_W = f"WITH {_WORDS}"
_L = f"WITH {_LAYERS}"
_SQL = {
    "c00_flagship_segments": f"{_L} SELECT * FROM segs",
    "c02_manuscript": f"WITH {_BENCH} SELECT * FROM man",
    "c03_habits": "SELECT DISTINCT lower(trim(n_name)) AS token, lower(trim(r_name)) AS rule FROM nation JOIN region ON n_regionkey = r_regionkey",
    "c04_settings": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 800 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS silence_ms, CAST(8 AS BIGINT) AS cue_words,
        CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS event_score, CASE WHEN event_id % 3 = 0 THEN 'filler,stumble,retake,repeat,event,unvoiced,judge' ELSE 'filler,' || event_type END AS layers FROM events""",
    "c09_silence": f"{_W} SELECT stream_id, idx, s AS start_ms, start_ms AS end_ms, start_ms - s AS gap_ms FROM (SELECT *, lag(end_ms) OVER (PARTITION BY stream_id ORDER BY idx) AS s FROM words) WHERE start_ms - s > 800",
    "c09_event_gaps": "SELECT user_id, event_id, gap_s FROM (SELECT user_id, event_id, date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap_s FROM events) WHERE gap_s > 3600",
    "c10_retakes": r"""WITH lines AS (SELECT doc_id AS stream_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        ahead AS (SELECT *, lead(i) OVER w AS by_i, lead(line) OVER w AS n FROM lines WINDOW w AS (PARTITION BY stream_id ORDER BY i)),
        near AS (SELECT *, list_distinct(string_split(line || n, '')) AS letters FROM ahead WHERE regexp_matches(trim(line), '\S\s+\S') AND least(length(line), length(n)) >= 0.69 * greatest(length(line), length(n)))
        SELECT stream_id, i, by_i AS "by" FROM near WHERE """
    + _alike("line", "n", 0.7),
    "c11_fillers": f"{_L} SELECT * FROM filler",
    "c12_stumbles": f"{_L} SELECT * FROM stumble",
    "c13_repeats": f"""WITH v AS (SELECT CAST(label AS BIGINT) AS stream_id, vec_id AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
        SELECT a.stream_id, a.i, min(b.i) AS "by" FROM v a JOIN v b ON a.stream_id = b.stream_id AND a.i < b.i WHERE list_cosine_similarity(a.e, b.e) >= 0.2 GROUP BY ALL""",
    "c14_events": f"{_L} SELECT * FROM event",
    "c15_unvoiced": f"{_W}, v AS (SELECT stream_id, start_ms AS a, end_ms AS b FROM words WHERE idx % 40 < 38) SELECT stream_id, idx, 'unvoiced' AS layer, 'unvoiced' AS reason FROM words w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.stream_id = w.stream_id AND w.start_ms < v.b AND v.a < w.end_ms)",
    "c17_protect": f"{_L} SELECT f.* FROM filler f JOIN words USING (stream_id, idx) WHERE bare NOT IN ('not', 'of', 'und')",
    "c18_layers": f"{_L} SELECT * FROM filler UNION ALL SELECT * FROM event",
    "c19_reasons": f"{_L} SELECT * FROM reasons",
    "c20_overrides": f"{_L} SELECT stream_id, idx, proposed, keep FROM decided",
    "c21_misheard": f"{_W}, {_MAN} SELECT stream_id, idx, text FROM words w WHERE bare <> '' AND stream_id IN (SELECT stream_id FROM man) AND NOT EXISTS (SELECT 1 FROM man m WHERE m.stream_id = w.stream_id AND m.bare = w.bare)",
    "c21_misheard_pairs": f"{_W}, {_MAN}, mb AS (SELECT stream_id, bare AS a, lead(bare) OVER (PARTITION BY stream_id ORDER BY idx) AS b FROM man), k AS (SELECT DISTINCT stream_id, a, b FROM mb WHERE b IS NOT NULL), p AS (SELECT stream_id, idx, bare AS a, lead(bare) OVER (PARTITION BY stream_id ORDER BY idx) AS b FROM words), h AS (SELECT stream_id, idx FROM p JOIN k USING (stream_id, a, b) UNION SELECT stream_id, idx + 1 FROM p JOIN k USING (stream_id, a, b)) SELECT stream_id, idx, text FROM words w WHERE stream_id IN (SELECT stream_id FROM man) AND NOT EXISTS (SELECT 1 FROM h WHERE h.stream_id = w.stream_id AND h.idx = w.idx)",
    "c10_aborted": _ABORTED,
    "c12_tandems": _TANDEMS,
    "c12_cut_offs": f"WITH {_WORDS}, {_STUTTERED} SELECT stream_id, idx, b AS \"by\" FROM (SELECT *, rtrim(low, '-') AS stem, lead(w) OVER o AS n, lead(idx) OVER o AS b FROM side WINDOW o AS (PARTITION BY stream_id ORDER BY pos)) WHERE low LIKE '%-' AND stem <> '' AND starts_with(n, stem) AND length(n) > length(stem)",
    "c09_quiet": f"WITH {_WORDS}, {_PARTLY}, {_quiet(_extent('words'), 'part', 300)}",
    "c14_frames": _FRAMES,
    "c15_mostly_unvoiced": _MOSTLY,
    "c15_cover": _COVER,
    "c31_quiet": f"{_L}, ow AS (SELECT stream_id, start_ms AS s, end_ms AS e FROM outw), {_quiet(_extent('outw'), 'ow', 200)}",
    "c27_readable_cues": _readable(),
    "c18_chosen_spans": _CHOSEN,
    "c27_srt_read": f"{_L} SELECT * FROM cues",
    "c29_edl_read": f"{_L} SELECT stream_id, seg + 1 AS event, f_in AS src_frame, rec AS rec_frame, f_out - f_in AS n_frames FROM recs",
    "c23_timeline_read": f"{_L} SELECT stream_id, seg, src_start, src_end, out_start FROM segs",
    "c32_srt_words": f"WITH RECURSIVE {_LAYERS}, {_LOST}, {_aligned('o', 'e')} SELECT stream_id, count(m_idx) AS n_expected, count(idx) AS n_observed, count(*) FILTER (op = 'deleted') AS n_lost, count(*) FILTER (op = 'inserted') AS n_added, count(*) FILTER (op = 'replaced') AS n_changed FROM aligned GROUP BY 1",
    "c35_varied_examples": _VARIED,
    "c08_converted": _CONVERTED,
    "c21_alignment": f"WITH RECURSIVE {_WORDS}, {_EDITED}, {_aligned('heard', 'eman')} SELECT * FROM aligned",
    "c21_suspects": f"WITH RECURSIVE {_WORDS}, {_EDITED}, {_aligned('mine', 'eman')} SELECT x.stream_id, x.idx, w.text, m.text AS meant FROM aligned x JOIN words w ON w.stream_id = x.stream_id AND w.idx = x.idx LEFT JOIN eman m ON m.stream_id = x.stream_id AND m.idx = x.m_idx WHERE op IN ('replaced', 'inserted') AND w.bare <> ''",
    "c32_reconcile": f"WITH RECURSIVE {_LAYERS}, {_HEARD}, {_aligned('o', 'e')} SELECT stream_id, count(m_idx) AS n_expected, count(idx) AS n_observed, count(*) FILTER (op = 'deleted') AS n_lost, count(*) FILTER (op = 'inserted') AS n_added, count(*) FILTER (op = 'replaced') AS n_changed FROM aligned GROUP BY 1",
    "c36_every_layer": f"WITH {_EVERY} SELECT stream_id, idx, coalesce(array_to_string(layers, '+'), '') AS layers, array_to_string(layers, '+') AS reasons, coalesce(len(layers), 0) AS n_layers, coalesce(CASE WHEN idx % 17 = 0 THEN idx % 2 = 0 END, layers IS NULL) AS keep FROM words LEFT JOIN found USING (stream_id, idx)",
    "c22_segments": f"{_L} SELECT stream_id, seg, src_start, src_end, n_words FROM segs",
    "c23_time_map": f"{_L} SELECT w.stream_id, w.start_ms AS src_ms, s.seg, s.out_start + w.start_ms - s.src_start AS out_ms FROM words w LEFT JOIN segs s ON w.stream_id = s.stream_id AND w.start_ms >= s.src_start AND w.start_ms < s.src_end",
    "c23_timeline_map": f"""{_L} SELECT stream_id, '[' || string_agg('{{"seg":' || seg || ',"src_start":' || src_start || ',"src_end":' || src_end || ',"out_start":' || out_start || '}}', ',' ORDER BY seg) || ']' AS body FROM segs GROUP BY 1""",
    "c24_seams": f"{_L}, c AS (SELECT stream_id, seg, fresh, concat_ws(' ', lag(text, 3) OVER w, lag(text, 2) OVER w, lag(text, 1) OVER w) AS before, concat_ws(' ', text, lead(text, 1) OVER w, lead(text, 2) OVER w) AS after FROM inseg WINDOW w AS (PARTITION BY stream_id ORDER BY idx)) SELECT stream_id, seg, before, after FROM c WHERE fresh = 1 AND seg > 0",
    "c27_cues": f"{_L} SELECT * FROM cues",
    "c27_srt": f"{_L} SELECT stream_id, string_agg(CAST(cue AS VARCHAR) || chr(10) || {_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY cue) AS body FROM cues GROUP BY 1",
    "c28_transcript": f"{_L} SELECT stream_id, string_agg(text, ' ' ORDER BY idx) AS body FROM kept GROUP BY 1",
    "c29_edl_events": f"{_L}, {_EDL} SELECT * FROM edl",
    "c29_edl": f"{_L}, {_EDL} SELECT stream_id, 'TITLE: ' || stream_id || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || string_agg({_padded('event', 3)} || '  AX       V     C        ' || src_in || ' ' || src_out || ' ' || rec_in || ' ' || rec_out || chr(10) || '* FROM CLIP NAME: ' || stream_id || '.mp4', chr(10) ORDER BY event) || chr(10) AS body FROM edl GROUP BY 1",
    "c29_fcpxml": _L
    + """ SELECT stream_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<fcpxml version="1.9"><resources><format id="r1" frameDuration="1/30s"/><asset id="r2" name="' || stream_id || '" start="0s" duration="' || max(f_out) || '/30s" hasVideo="1" hasAudio="1" format="r1"><media-rep kind="original-media" src="./' || stream_id || '.mp4"/></asset></resources><library><event><project><sequence format="r1" duration="' || CAST(sum(f_out - f_in) AS BIGINT) || '/30s"><spine>' || string_agg('<asset-clip ref="r2" offset="' || rec || '/30s" start="' || f_in || '/30s" duration="' || (f_out - f_in) || '/30s"/>', '' ORDER BY seg) || '</spine></sequence></project></event></library></fcpxml>' || chr(10) AS body FROM recs GROUP BY 1""",
    "c30_check_duration": f"{_L}, p AS (SELECT stream_id, CAST(sum(src_end - src_start) AS BIGINT) AS planned_ms FROM segs GROUP BY 1), o AS (SELECT stream_id, max(end_ms) + CASE WHEN stream_id % 3 = 0 THEN 900 ELSE 10 END AS observed_ms FROM cues GROUP BY stream_id) SELECT stream_id, planned_ms, observed_ms, abs(planned_ms - observed_ms) <= 100 AS ok FROM p FULL JOIN o USING (stream_id)",
    "c31_check_silence": f"{_L} SELECT stream_id, idx, s AS start_ms, start_ms AS end_ms, start_ms - s AS gap_ms FROM (SELECT *, lag(end_ms) OVER (PARTITION BY stream_id ORDER BY idx) AS s FROM outw) WHERE start_ms - s > 200",
    "c32_check_words": f"{_L}, e AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS n, text FROM kept) SELECT stream_id, count(*) AS n_expected, count(*) FILTER (NOT (stream_id % 4 = 1 AND n % 50 = 49)) AS n_observed, count(*) FILTER ((stream_id % 4 = 1 AND n % 50 = 49) OR ((stream_id + n) % 60 = 0 AND text <> '?')) AS n_different FROM e GROUP BY 1",
    "c33_feedback": "SELECT doc_id, proposed, kept, CASE WHEN proposed AND kept THEN 'restored' WHEN NOT proposed AND NOT kept THEN 'added' ELSE 'agreed' END AS class FROM (SELECT doc_id, coalesce(n_chars < 600, false) AS proposed, coalesce(quality = 1, NOT coalesce(n_chars < 600, false)) AS kept FROM documents FULL JOIN labels USING (doc_id))",
    "c34_feedback_summary": f"{_L}{_FEEDBACK} SELECT stream_id, class, count(*) AS n FROM fb GROUP BY ALL",
    "c35_examples": f"{_L}{_FEEDBACK}, x AS (SELECT unnest(string_split(coalesce(reasons, ''), '+')) AS reason, class, text FROM fb WHERE class <> 'agreed'), c AS (SELECT reason, class, text, count(*) AS n FROM x GROUP BY ALL) SELECT reason, rank, class, text, n FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY n DESC, class, text) AS rank FROM c) WHERE rank <= 5",
}
_QUERIES = {
    "c00_flagship_segments": flagship,
    "c02_manuscript": q_manuscript,
    "c03_habits": q_habits,
    "c04_settings": q_settings,
    "c09_silence": q_silence,
    "c09_event_gaps": q_event_gaps,
    "c10_retakes": q_retakes,
    "c11_fillers": q_fillers,
    "c12_stumbles": q_stumbles,
    "c13_repeats": q_repeats,
    "c14_events": q_events,
    "c15_unvoiced": q_unvoiced,
    "c17_protect": q_protect,
    "c18_layers": q_layers,
    "c19_reasons": q_reasons,
    "c20_overrides": q_overrides,
    "c21_misheard": q_misheard,
    "c21_misheard_pairs": q_misheard_pairs,
    "c10_aborted": q_aborted,
    "c12_tandems": q_tandems,
    "c12_cut_offs": q_cut_offs,
    "c09_quiet": q_quiet,
    "c14_frames": q_frames,
    "c15_mostly_unvoiced": q_mostly_unvoiced,
    "c15_cover": q_cover,
    "c31_quiet": q_output_quiet,
    "c27_readable_cues": q_readable_cues,
    "c18_chosen_spans": q_chosen_spans,
    "c27_srt_read": q_srt_read,
    "c29_edl_read": q_edl_read,
    "c23_timeline_read": q_timeline_read,
    "c32_srt_words": q_srt_words,
    "c35_varied_examples": q_varied_examples,
    "c08_converted": q_converted,
    "c21_alignment": q_alignment,
    "c21_suspects": q_suspects,
    "c32_reconcile": q_reconcile,
    "c36_every_layer": q_every_layer,
    "c22_segments": lambda spark, sf_dir: _segments(spark, sf_dir).drop("out_start"),
    "c23_time_map": q_time_map,
    "c23_timeline_map": q_timeline_map,
    "c24_seams": q_seams,
    "c27_cues": q_cues,
    "c27_srt": q_srt,
    "c28_transcript": q_transcript,
    "c29_edl_events": q_edl_events,
    "c29_edl": q_edl,
    "c29_fcpxml": q_fcpxml,
    "c30_check_duration": q_check_duration,
    "c31_check_silence": q_check_silence,
    "c32_check_words": q_check_words,
    "c33_feedback": q_feedback,
    "c34_feedback_summary": q_feedback_summary,
    "c35_examples": q_examples,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
