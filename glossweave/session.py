"""Session settings and the shared folder for materialised steps."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows at most of a side that is broadcast after its size was checked.
BROADCAST_ROWS = 1_000_000
_steps: list[str] = []


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def clear_steps(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the materialised steps written so far, all but the first ``keep``; results that still read them must have been consumed."""
    while len(_steps) > keep:
        fs, at = _file_system(spark, _steps.pop())
        fs.delete(at, True)


@contextmanager
def own_steps(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was materialised inside; consume the results before."""
    before = len(_steps)
    try:
        yield
    finally:
        clear_steps(spark, before)


def get_session(app: str = "glossweave", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine wants; leaves a running one as it is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster an error, since
    each machine would write to a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = os.path.join(tempfile.gettempdir(), f"glossweave-{os.getpid()}")
    if not os.path.exists(at):
        os.makedirs(at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows once, as Parquet, in the shared folder and reads them back.

    A written table survives the loss of executors, is columnar, and keeps nothing in memory. It is deleted by ``clear_steps`` or
    ``own_steps``, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    _steps.append(path)
    df.write.mode("overwrite").parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised ``df``, marked for broadcast if its counted rows are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df
