"""Replay-safe output of micro-batches, and running a query over what is available."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralens.session import scratch


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Files of a growing folder; ``per_trigger`` bounds the files of a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def write_batches(out: str, transform: Callable[[DataFrame, int], DataFrame] | None = None):
    """foreachBatch body: each batch goes to its own folder, overwritten on a replay."""

    def body(batch: DataFrame, batch_id: int) -> None:
        d = transform(batch, batch_id) if transform else batch
        d.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return body


def run_available(df: DataFrame, body, checkpoint: str, mode: str = "append") -> list:
    """Process everything that has arrived, then stop; a later call continues. Returns the
    progress of its micro-batches."""
    q = (
        df.writeStream.outputMode(mode).foreachBatch(body)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return list(q.recentProgress)


def stored(spark: SparkSession, out: str, schema) -> DataFrame:
    """The batches written so far."""
    full = f"{schema}, batch_id int"
    return spark.read.schema(full).option("basePath", out).parquet(out)


def latest(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream."""
    packed = F.max_by(F.struct(*values), "batch_id").alias("v")
    return df.groupBy(*keys).agg(packed).select(*keys, "v.*")


def replay(sources: dict[str, DataFrame], chunk: str, chunks: int, start: Callable[[dict[str, DataFrame], bool], None]) -> None:
    """Lets frames arrive in ``chunks`` steps (rows with chunk value c in step c) and calls
    ``start(streams, last)`` after each; every call resumes from its checkpoint."""
    paths = {name: scratch(df.sparkSession, name) for name, df in sources.items()}
    for c in range(chunks):
        for name, df in sources.items():
            df.where(F.col(chunk) == c).drop(chunk).write.mode("append").parquet(paths[name])
        start({name: file_stream(df.sparkSession, paths[name], df.drop(chunk).schema) for name, df in sources.items()}, c == chunks - 1)
