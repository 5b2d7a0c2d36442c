"""Helpers of the operators: staged tables, row keys, Arrow batches and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralens.session import cut_lineage

# ASCII letters to lower case; other letters keep theirs.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back; the shuffle files behind it are removed
    when the write ends, so a chain of stages holds one stage's shuffles at a time."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df, f"llm-{name}")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get so many rows at once in what runs inside: for rows of many bytes, of
    which Spark's own number would fill a worker, and the executor's side of it, too."""
    before = spark.conf.get(ARROW_ROWS, None)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_ROWS) if before is None else spark.conf.set(ARROW_ROWS, before)


def release(*staged: DataFrame) -> None:
    """Empty staged tables that nothing reads any more, so that a chain of many stages does not
    keep all of their disk."""
    for df in staged:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blocks(total: int, each: int, least: int = 1) -> int:
    """How many hash blocks keep about ``each`` units apiece."""
    return max(least, -(-int(total) // each))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column has yet, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts; sizes hash blocks, decides nothing else."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def texts(column: pa.Array) -> list[str]:
    """A text column as strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """A text column as UTF-8 bytes, null as empty, one at a time."""
    column = column.cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)`` with the smallest
    node reachable, for nodes that have an edge.

    Every round points each node at its smallest neighbour, follows the pointers to their
    end, and replaces nodes by these roots; that at least halves the components that still
    have edges. Minima combine before the shuffle, and joins on a node with many edges are
    left to the skew handling of adaptive execution. Each round is a stored table."""
    spark = edges.sparkSession
    edges = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    nodes = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        roots = stage(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), name)
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = stage(roots.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), name)
            roots = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        left, right = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        edges = stage(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name)
        if nodes is None:
            nodes = roots.toDF("node", "component")
        else:
            nodes = stage(nodes.join(roots.toDF("component", "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component")), name)
    if nodes is None:
        kind = dict(edges.dtypes)["a"]
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    return nodes
