"""Readers and writers for panels, results, manifests and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralens.functions.checks import ensure, violation
from eralens.session import scratch

SCORE_SCHEMA = "arm string, config_id int, split string, updates int, seed int, corr_mean double, bmc_mean double, runs bigint"
MANIFEST_SCHEMA = "job string, split string, updates int, seed int, arm string, config_id int"
REFIT_SCHEMA = "job string, updates int, seed int, arm string, config_id int"
SPREAD_FROM, ONE_SPLIT = 1 << 20, 128 << 20   # bytes
SCHEMAS: dict = {}
# Directory naming of stored results.
TASK_PATTERN = r"stage-(.+)-u(\d+)-s(\d+)-([a-z]+)"


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet (schema looked up once per application). A table that fits into one
    split but is not tiny is spread over the cores; larger ones have splits enough."""
    slot = (spark.sparkContext.applicationId, path)
    reader = spark.read.schema(SCHEMAS[slot]) if slot in SCHEMAS else spark.read
    d = reader.parquet(path)
    SCHEMAS.setdefault(slot, d.schema)
    size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return d.repartition(spark.sparkContext.defaultParallelism) if SPREAD_FROM <= size <= ONE_SPLIT else d


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("era",)) -> None:
    """Partitioned by era. Rows are spread over a few writers per era by hash, so a
    large era is not written by one task and a small one gives few files."""
    keys = [F.col(c) for c in by]
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(8))
    writer = df.repartition(*keys, spread).write.mode("errorifexists").partitionBy(*by)
    writer.option("header", "true").format(fmt).save(path)


def write_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Store a table in buckets of ``key``, sorted in each, and return it. Joins and windows on the
    key of two tables with the same number of buckets need no shuffle."""
    spark = df.sparkSession
    path = scratch(spark, "bucketed")
    name = "eralens_" + path.rsplit("-", 1)[-1]
    df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return spark.table(name)


def scan_panel(spark: SparkSession, path: str, columns: Sequence[str], eras: Sequence[int] | None = None,
               first: int | None = None, last: int | None = None) -> DataFrame:
    """Only the named columns; era conditions prune partitions or reach the scan."""
    d = spark.read.parquet(path)
    if eras is not None:
        d = d.where(F.col("era").isin(*eras))
    if first is not None:
        d = d.where(F.col("era") >= first)
    if last is not None:
        d = d.where(F.col("era") <= last)
    return d.select(*columns)


def read_results(spark: SparkSession, path: str, schema: str, split: str | None = None,
                 updates: int | None = None, seed: int | None = None) -> DataFrame:
    """Result documents below ``path``; identity comes from the directory name, and a file whose
    directory does not name a task fails the read."""
    d = spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)
    where = F.col("_metadata.file_path")
    d = d.select(
        "*", F.regexp_extract(where, TASK_PATTERN, 1).alias("split"),
        F.regexp_extract(where, TASK_PATTERN, 2).cast("int").alias("updates"),
        F.regexp_extract(where, TASK_PATTERN, 3).cast("int").alias("seed"),
        F.regexp_extract(where, TASK_PATTERN, 4).alias("arm"),
    )
    d = ensure(d, F.col("arm") != "", F.concat(F.lit("no task in the path "), where))
    for name, want in (("split", split), ("updates", updates), ("seed", seed)):
        if want is not None:
            d = d.where(F.col(name) == want)
    return d


def read_manifest_tsv(spark: SparkSession, path: str, refit: bool = False) -> DataFrame:
    """Headerless tab-separated cells; a wrong column count fails the read."""
    d = spark.read.schema(REFIT_SCHEMA if refit else MANIFEST_SCHEMA).option("sep", "\t").option("mode", "FAILFAST").csv(path)
    return d.withColumn("job", F.substring_index("job", ";", 1))


def manifest_violations(cells: DataFrame) -> DataFrame:
    """An empty manifest, or a job id used twice."""
    empty = cells.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    twice = cells.groupBy("job").count().where(F.col("count") > 1)
    return violation(empty, "empty", F.lit("manifest")).unionByName(violation(twice, "job_repeated", F.col("job"), F.col("count")))


def read_scores_union(spark: SparkSession, paths: Sequence[str], schema: str = SCORE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(list(paths))


def explode_curves(df: DataFrame, keys: Sequence[str], column: str = "curve") -> DataFrame:
    """Nested checkpoint lists to rows."""
    return df.select(*keys, F.inline(column))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
