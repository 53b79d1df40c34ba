"""Session helpers: a local session for tests and the shared folder for tables between stages."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The lists of folders of `temporary` blocks, innermost last.
_blocks = threading.local()


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("domora")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started elsewhere, and keep Arrow batches of long texts small.

    Stages whose generated method is longer than what the JVM compiles (8000 bytes) run as separate operators: as one
    method they would be interpreted. The shuffle files of an action go at its end, not when the driver's memory is
    collected; what is read again is written by `materialise`.
    """
    if spark.conf.get(SHUFFLES_REMOVED) == "false":
        spark.conf.set(SHUFFLES_REMOVED, "true")
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one (tests) gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-domora-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/domora-{uuid.uuid4().hex}"
    if getattr(_blocks, "held", None):
        _blocks.held[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside, tables that `materialise` writes go at the end, but those that the given function writes in its place."""
    _blocks.held = [*getattr(_blocks, "held", []), []]

    def kept(df: DataFrame) -> DataFrame:
        inside, _blocks.held = _blocks.held, _blocks.held[:-1]
        try:
            return materialise(df)
        finally:
            _blocks.held = inside

    try:
        yield kept
    finally:
        *_blocks.held, gone = _blocks.held
        for path in gone:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
