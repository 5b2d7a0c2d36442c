"""Session helpers: sensible defaults, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLES, TOGETHER = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"


def build_session(cores: int | str = "*", app: str = "eralens", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ERALENS_DRIVER_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a session in one process
    (as in tests) gets a folder of its own; a cluster must name one, as its executors do
    not see each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fresh = tempfile.mkdtemp(prefix="eralens-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def scratch(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_of(spark: SparkSession, rows: int, task_rows: int, task_bytes: int) -> Iterator[None]:
    """Shuffles inside deal so many rows to partitions of ``task_rows`` on average, where the
    session's own number of partitions would give them more, and no more of them are put
    together than hold ``task_bytes``: by default, that is a fixed share of the rows up to 64 MB."""
    before = {k: spark.conf.get(k) for k in (SHUFFLES, TOGETHER)}
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[TOGETHER])
    spark.conf.set(SHUFFLES, str(max(int(before[SHUFFLES]), -(-rows // task_rows))))
    spark.conf.set(TOGETHER, str(min(own, task_bytes)))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def scan_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Scans planned inside read so many bytes a task at most: for rows that compress well, of which
    Spark's own number would give a task more than it should hold to add up or to deal."""
    before = spark.conf.get(SPLIT_BYTES, None)
    if int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) > size:
        spark.conf.set(SPLIT_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.unset(SPLIT_BYTES) if before is None else spark.conf.set(SPLIT_BYTES, before)


def cut_lineage(df: DataFrame, name: str = "stage", file_rows: int = 0) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back: survives lost
    executors, is computed once, and its size is known to the planner.

    With ``file_rows``, files have that many rows at most. As a scan charges each file with its
    opening cost, its tasks then read a bounded number of rows however well these compress,
    and so does what a task holds to deal them to many partitions."""
    path = scratch(df.sparkSession, name)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
