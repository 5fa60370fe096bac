"""Inputs: timed words, manuscripts, habit rules, settings, decisions, intervals, feedback."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words_of

WORDS = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])
DECISIONS = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("keep", T.BooleanType())])
INTERVALS = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("score", T.DoubleType())])
FEEDBACK = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("proposed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("class", T.StringType()), T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])
SCHEMAS = {"words": WORDS, "decisions": DECISIONS, "intervals": INTERVALS, "feedback": FEEDBACK}


@dataclass(frozen=True)
class Settings:
    """Thresholds and layer switches of an edit plan.

    stumble_words: the longest phrase of which a repetition is a stumble; with 1 only single
    words, and words cut off are kept. take_words: the equal words that make a broken-off take
    part of the layer retake; 0 for whole sentences only.
    """

    silence_ms: int = 800
    retake_likeness: float = 0.7
    retake_ahead: int = 2
    take_words: int = 0
    stumble_words: int = 1
    repeat_cosine: float = 0.9
    event_score: float = 0.5
    cue_words: int = 8
    fps: int = 30
    layers: tuple[str, ...] = field(default=("filler", "stumble", "retake", "repeat", "event", "unvoiced", "judge"))

    @staticmethod
    def from_json(text: str) -> Settings:
        """Known keys of a JSON object; others are ignored, missing and null ones keep their defaults.

        A value of the wrong type is an error: numbers where numbers are due (whole ones for
        milliseconds and counts), names of layers in a list.
        """
        given = json.loads(text or "{}")
        if not isinstance(given, dict):
            raise ValueError("settings are a JSON object")
        out = {}
        for f in fields(Settings):
            if (value := given.get(f.name)) is None:
                continue
            default = Settings.__dataclass_fields__[f.name].default
            if f.name == "layers":
                if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                    raise ValueError("layers is a list of names")
                value = tuple(value)
            elif isinstance(value, bool) or not isinstance(value, int if isinstance(default, int) else (int, float)):
                raise ValueError(f"{f.name} is {'a whole number' if isinstance(default, int) else 'a number'}, not {value!r}")
            out[f.name] = value
        return Settings(**out)


def settings_rows(df: DataFrame, json_col: str) -> DataFrame:
    """The columns of ``df`` with those of the settings, read from a JSON column, one row per input row.

    As in ``Settings.from_json``, but a value of the wrong type, and an object that is
    malformed, null or missing, counts as not given. Columns of ``df`` with the name of a
    setting are replaced.
    """
    types = {f.name: T.ArrayType(T.StringType()) if f.name == "layers" else T.LongType() if isinstance(f.default, int) else T.DoubleType() for f in fields(Settings)}
    given = F.from_json(F.col(json_col), T.StructType([T.StructField(k, t) for k, t in types.items()]))
    own = Settings()
    default = {k: F.array(*map(F.lit, own.layers)) if k == "layers" else F.lit(getattr(own, k)) for k in types}
    return df.withColumn("_given", given).withColumns({k: F.coalesce(F.col("_given")[k], default[k]) for k in types}).drop("_given")


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of one of the kinds in SCHEMAS; malformed lines give nulls."""
    return spark.read.schema(SCHEMAS[kind]).json(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path) if path.rstrip("/").endswith(".parquet") else read_json(spark, path, "words")


def manuscript(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stream_id, idx, text): the words of pasted texts; null and empty texts have none."""
    return texts.select(F.col(id_col).alias("stream_id"), F.posexplode(words_of(F.col(text_col))).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))


def habits(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(token, rule) from markdown lines: a heading names the rule, list items below it the tokens.

    lines must hold ``n``, the line number, and ``file``; a rule lasts to the next heading of
    its file. Other lines are prose and ignored.
    """
    line = F.trim(F.col(line_col))
    heading = F.when(line.startswith("#"), F.lower(F.trim(F.regexp_replace(line, "^#+", ""))))
    rule = F.last(heading, ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    item = F.regexp_extract(line, "^[-*]\\s+(.+)$", 1)
    return lines.select(rule.alias("rule"), F.lower(F.trim(item)).alias("token")).where("token <> '' and rule is not null").select("token", "rule").distinct()


def read_habits(spark: SparkSession, path: str) -> DataFrame:
    """Rules from markdown files, read anew for each plan so that edits take effect."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return habits(whole)
