"""Feedback as a stream: counts of corrections as history files arrive, and the last decision on each word.

Decisions are records (record_id, stream_id, idx, keep, said_at). Of the records of a word the one
said last counts, and of those said at one time the one with the greatest id; so a record that comes
twice changes nothing, and the order in which files arrive does not matter. Records with a null in
any of these columns decide nothing. A record that comes when the watermark is past its time is late
and decides nothing either. The state of a word is its last record, and goes when the watermark is
``open_ms`` past that; a record after that begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.feedback import summary
from ..session import ship_package
from ..sources.readers import FEEDBACK

DECIDED = "record_id long, stream_id long, idx long, keep boolean, said_at timestamp"


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines folder as they are appended; malformed lines give nulls."""
    return spark.readStream.schema(FEEDBACK).json(path)


def running_summary(records: DataFrame) -> DataFrame:
    """Counts by class; the state is one row for each class."""
    return summary(records, ["class"])


def decision_stream(spark: SparkSession, path: str, files_each: int | None = None) -> DataFrame:
    """Decisions of a JSON-lines folder, ``files_each`` files at a time."""
    reader = spark.readStream.schema(DECIDED)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).json(path)


def _sound(records: DataFrame) -> DataFrame:
    return records.dropna(subset=["record_id", "stream_id", "idx", "keep", "said_at"])


def last_decisions(records: DataFrame) -> DataFrame:
    """(stream_id, idx, keep, said_at, record_id) of a table of decisions: the last of each word."""
    last = F.max(F.struct("said_at", "record_id", "keep")).alias("last")
    return _sound(records).groupBy("stream_id", "idx").agg(last).select("stream_id", "idx", "last.keep", "last.said_at", "last.record_id")


def running_decisions(records: DataFrame, late: str = "1 day", open_ms: int = 7 * 86_400_000) -> DataFrame:
    """The same of a stream, in update mode: a row for a word whenever its last decision changes.

    late: how far behind the newest record others may come. The newest row of each word is what
    ``last_decisions`` gives for all records that were not late.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark = state.getCurrentWatermarkMs()
        was = now = tuple(state.get) if state.exists else None
        for batch in batches:
            for at, record, keep in zip(batch["at_ms"].tolist(), batch["record_id"].tolist(), batch["keep"].tolist()):
                if at >= mark and (now is None or (at, record) > now[:2]):
                    now = (at, record, keep)
        if now is None:
            return
        state.update(now)
        state.setTimeoutTimestamp(max(now[0] + open_ms, mark + 1))
        if now != was:
            yield pd.DataFrame({"stream_id": [key[0]], "idx": [key[1]], "keep": [now[2]], "said_at": pd.to_datetime([now[0]], unit="ms"), "record_id": [now[1]]})

    ship_package(records.sparkSession)
    timed = _sound(records).withWatermark("said_at", late).withColumn("at_ms", F.unix_millis("said_at"))
    return timed.groupBy("stream_id", "idx").applyInPandasWithState(follow, "stream_id long, idx long, keep boolean, said_at timestamp, record_id long", "at_ms long, record_id long, keep boolean", "update", GroupStateTimeout.EventTimeTimeout)
