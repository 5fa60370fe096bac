"""The edit plan: layers as settings enable them, protection, overrides, the cut."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, export, review, takes
from ..sources.readers import Settings


@dataclass(frozen=True)
class Cut:
    """Lazy tables of one plan."""

    proposals: DataFrame
    words: DataFrame
    segments: DataFrame
    cues: DataFrame
    events: DataFrame


def decide(
    words: DataFrame,
    habits: DataFrame,
    settings: Settings = Settings(),
    decisions: DataFrame | None = None,
    events: DataFrame | None = None,
    voiced: DataFrame | None = None,
    judged: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """All words with layers, reasons, proposed and keep. Layers whose input is not given are left out.

    habits: (token, rule) with the rules ``filler`` and ``protected``; judged: proposals of an
    external judge; vectors: (stream_id, i, embedding) of the sentences that
    ``detect.sentences_of`` numbers with the pause of the settings.

    Lexicons and stumbles are read off the words in one pass; only layers that rest on other
    tables are joined, all in one join. Proposals for words that are not there propose nothing.
    Null recordings and indexes are proposed by no joined layer and so kept unless they are
    fillers or stumbles; repeated words are decided each. Empty words give an empty plan.
    """
    on, other = settings.layers, []
    if "retake" in on or ("repeat" in on and vectors is not None):
        sentences = detect.sentences_of(words, settings.silence_ms)
        if "retake" in on:
            other.append(detect.retake_words(words, sentences, detect.retakes(sentences, settings.retake_likeness, settings.retake_ahead)))
        if "repeat" in on and vectors is not None:
            other.append(detect.retake_words(words, sentences, detect.repeats(vectors, settings.repeat_cosine), "repeat"))
    if "retake" in on and settings.take_words:
        other.append(takes.aborted_words(words, settings.take_words))
    if "stumble" in on and settings.stumble_words > 1:
        other.append(takes.phrase_stumbles(words, settings.stumble_words))
    if "event" in on and events is not None:
        other.append(detect.non_speech(words, events, settings.event_score))
    if "unvoiced" in on and voiced is not None:
        other.append(detect.unvoiced(words, voiced))
    if "judge" in on and judged is not None:
        other.append(judged.select("stream_id", "idx", "layer", "reason"))
    return review.decided_at_once(detect.flagged(words, habits), on, reduce(DataFrame.unionByName, other) if other else None, decisions)


def edit(words: DataFrame, habits: DataFrame, settings: Settings = Settings(), decisions: DataFrame | None = None, **inputs: DataFrame | None) -> Cut:
    """Build the plan; inputs are those of ``decide``. proposals: (stream_id, idx, layer); events: the cut list at the frame rate of the settings."""
    whole = decide(words, habits, settings, decisions, **inputs)
    kept = whole.where("keep")
    proposals = whole.select("stream_id", "idx", F.explode("layers").alias("layer"))
    segments = review.segments(kept, settings.silence_ms)
    return Cut(proposals, whole, segments, export.cues(kept, settings.silence_ms, settings.cue_words), export.edl_events(segments, settings.fps))
