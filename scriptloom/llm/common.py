"""What the text operators share: Arrow batches in and out, tokens, hashes, folds."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers for mixing 64-bit hashes (odd constants of xxHash and of the golden ratio).
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_C = np.uint64(0x9FB21C651E98DF25)

#: Rows of an Arrow batch that a worker turns into Python objects at once.
SLICE_ROWS = 256
#: Most rows of an Arrow batch that goes to a worker.
BATCH_ROWS = 1024


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers unless their PYTHONPATH has it already."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_scriptloom_shipped", False):
        return
    folder = tempfile.mkdtemp()
    archive = shutil.make_archive(os.path.join(folder, "scriptloom"), "zip", root, "scriptloom")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._scriptloom_shipped = True


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def first_by_hash(ids: DataFrame, count: int, most: int) -> DataFrame:
    """The ``most`` distinct values of ``_id``, of ``count`` rows, that come first by their hash.

    A hash below a cutoff, which lets through a little more than ``most`` of ``count`` rows, is
    asked for before rows are ordered, so the one task that orders them reads little more than
    it keeps, whatever the table. Which values come first does not depend on the cutoff; where
    repeated values leave too few below it, it is raised.
    """
    hashed = ids.select("*", F.xxhash64(F.col("_id").cast("string")).alias("_hash"))
    share = 1.0 if count <= most else (most + 8 * most**0.5 + 64) / count
    while True:
        below = hashed if share >= 1 else hashed.where(F.col("_hash") < int((share - 0.5) * 2.0**64))
        below = below.distinct()
        if share >= 1 or below.count() >= most:
            return below.orderBy("_hash", "_id").limit(most).drop("_hash")
        share *= 4


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Text of each value; null is empty, bytes that are not UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in as_bytes(column)]


def ascii_words(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then runs of bytes other than space and 0x09-0x0D."""
    return text.lower().split()


def hash_tokens(tokens: list[bytes]) -> np.ndarray:
    """64-bit hash of each token."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers, ``SLICE_ROWS`` rows at a time.

    Texts are long and become Python objects, so a worker holds few rows of a batch in that
    form, and gives freed Arrow memory back before it serves the next task. The JVM holds a
    batch outside its heap and doubles the buffer as it fills, so batches are kept to
    ``BATCH_ROWS`` rows: the session's limit is lowered to that where it is higher.
    """
    ship_package(df.sparkSession)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(limit)) <= BATCH_ROWS:
        df.sparkSession.conf.set(limit, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batch.slice(i, SLICE_ROWS) for batch in batches for i in range(0, batch.num_rows, SLICE_ROWS))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def non_empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)
