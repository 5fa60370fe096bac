"""Session helpers: table access, checkpoint folder, local sessions for tests and bench."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with settings that suit small inputs; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scriptloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "6g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(df: DataFrame, size: Column, most: int, least: int) -> int:
    """Parts for a table by its summed ``size``: at most about ``most`` in each.

    Left to the session, a shuffle has a fixed number of parts, or is merged to a few for each core,
    and what a task holds grows with the table. Below ``most`` there is a part for each core, unless
    parts would be below ``least``. The sum is one pass over the table.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    spread = min(df.sparkSession.sparkContext.defaultParallelism, total // least)
    return max(1, spread, -(-total // most))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers unless their PYTHONPATH has it already."""
    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_scriptloom_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "scriptloom"), "zip", root, "scriptloom")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._scriptloom_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, which all executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset,
    as in local tests, a temporary folder of this machine is used.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "scriptloom-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that Spark can reach, with all it holds; one that is not there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own in the checkpoint folder, deleted at the end with all it holds."""
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete_folder(spark, folder)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors.

    Its files are deleted once nothing refers to the table any more if the session was started
    with ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``local_session`` does.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
