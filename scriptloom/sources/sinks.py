"""Outputs: rendered text per recording, JSON lines that accumulate.

The rows of a recording are brought together and ordered before they are written, so each
recording is one file. Null recordings go to Spark's folder for null partitions; columns that
do not order are written as they come; an empty table writes an empty folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns by which the rows of a recording are ordered, those of them that a table has.
ORDER = ("idx", "seg", "event", "cue", "n", "i", "start_ms", "src_ms")


def append_feedback(feedback: DataFrame, path: str) -> None:
    """Add records to a JSON-lines history."""
    feedback.write.mode("append").json(path)


def _by_recording(df: DataFrame) -> DataFrame:
    return df.repartition("stream_id").sortWithinPartitions("stream_id", *(c for c in ORDER if c in df.columns))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table, for example a time map or an edit list, as one file of JSON lines for each recording."""
    _by_recording(df).write.mode(mode).partitionBy("stream_id").json(path)


def write_rendered(rendered: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(stream_id, body) as one text file for each recording."""
    _by_recording(rendered.select("stream_id", F.col("body").alias("value"))).write.mode(mode).partitionBy("stream_id").text(path)
