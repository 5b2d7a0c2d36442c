"""Live rounds: score whole rounds, join late labels, reject what must not be there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eralens.functions.checks import findings, together, violation
from eralens.functions.exprs import on_grid, finite
from eralens.functions.ranking import AUTO, dealt, with_rank

ROUND_CHECKS = "kind string, key string, detail string"


def round_violations(rounds: DataFrame, models: list[str], benchmark: str, key: str = "id", round_key: str = "round") -> DataFrame:
    """Ids repeated within a round, predictions or benchmark values that are missing."""
    name = F.concat_ws(":", F.col(round_key).cast("string"), F.col(key).cast("string"))
    twice = rounds.groupBy(round_key, key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    broken = F.lit(False)
    for m in models:
        broken = broken | ~finite(F.col(m))
    return together(
        violation(twice, "duplicate", name, F.col("n")),
        findings(rounds, name, ("prediction_missing", broken), ("benchmark_missing", ~finite(F.col(benchmark)))))


def score_whole_rounds(rounds: DataFrame, models: list[str], benchmark: str, weight: float, key: str = "id",
                       round_key: str = "round") -> DataFrame:
    """Rank every model within the round, average, blend with the benchmark rank, re-rank."""
    d, split = dealt(rounds, [round_key], AUTO)
    for i, m in enumerate([*models, benchmark]):
        d = with_rank(d, [round_key], m, f"__r{i}", plan=split)
    mean = F.col("__r0")
    for i in range(1, len(models)):
        mean = mean + F.col(f"__r{i}")
    mix = F.lit(weight) * mean / F.lit(float(len(models))) + F.lit(1.0 - weight) * F.col(f"__r{len(models)}")
    d = d.withColumn("__mix", on_grid(mix, 12))
    return with_rank(d, [round_key], "__mix", "prediction", plan=split).select(round_key, key, "prediction")


def score_rounds(stream: DataFrame, out: str, checkpoint: str, models: list[str], benchmark: str, arrived: str, closes: str,
                 weight: float = 0.5, key: str = "id", round_key: str = "round", slack: str = "1 millisecond") -> dict[str, str]:
    """Score rounds as they close. A round is held as state until the watermark of ``arrived``
    passes its ``closes``; the batch that hands it over has all its rows and ranks them as a
    whole, whatever the round's size. Every batch writes folders of its own, so replays and
    lost executors change nothing, and no batch reads an earlier one's rows.

    Returns the paths of ``scores``, of ``sorted`` rows (all that left, with their ``kind``: closed,
    repeated, late) and of ``violations`` (late and repeated rows, missing predictions)."""
    from eralens.streaming.arrivals import by_round, require_none_dropped
    from eralens.streaming.sink import run_available

    spark, paths = stream.sparkSession, {n: f"{out}/{n}" for n in ("scores", "sorted", "violations")}
    rows = by_round(stream, round_key, [key], arrived, closes, slack)

    def body(batch: DataFrame, batch_id: int) -> None:
        place = f"{paths['sorted']}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(place)
        seen = spark.read.schema(batch.schema).parquet(place)
        closed = seen.where("kind = 'closed'").drop("kind")
        name = F.concat_ws(":", F.col(round_key).cast("string"), F.col(key).cast("string"))
        aside = seen.where("kind <> 'closed'").groupBy("kind", name.alias("key")).agg(F.count(F.lit(1)).cast("string").alias("detail"))
        together(aside, round_violations(closed, models, benchmark, key, round_key)).write.mode("overwrite").parquet(f"{paths['violations']}/batch_id={batch_id}")
        score_whole_rounds(closed, models, benchmark, weight, key, round_key).write.mode("overwrite").parquet(f"{paths['scores']}/batch_id={batch_id}")

    require_none_dropped(run_available(rows, body, checkpoint))
    return paths


def label_join(predictions: DataFrame, labels: DataFrame, horizon: str, slack: str, key: str = "id") -> DataFrame:
    """Stream-stream left join of predictions (ts) and labels (label_ts) that resolve at
    most ``horizon`` later; unmatched rows come out when the watermark passes."""
    p = predictions.withWatermark("ts", slack)
    lab = labels.withColumnRenamed(key, "label_id").withWatermark("label_ts", slack)
    cond = F.expr(f"{key} = label_id AND label_ts >= ts AND label_ts <= ts + INTERVAL {horizon}")
    return p.join(lab, cond, "leftOuter").drop("label_id")


def matched_scores(joined: DataFrame, expected: DataFrame, round_key: str = "round") -> DataFrame:
    """Per round: matched rows, mean squared error, and whether the round is complete."""
    e = F.col("prediction") - F.col("label")
    got = joined.where(F.col("label").isNotNull()).groupBy(round_key).agg(F.count(F.lit(1)).alias("matched"), F.avg(e * e).alias("mse"))
    d = expected.join(got, round_key, "left")
    return d.select(round_key, "rows", F.coalesce("matched", F.lit(0)).alias("matched"), "mse",
                    (F.coalesce("matched", F.lit(0)) < F.col("rows")).alias("provisional"))


def dedup_ids(stream: DataFrame, round_key: str, ids: list[str], arrived: str, closes: str, slack: str = "1 millisecond") -> DataFrame:
    """Rows sorted by ``kind``: the ``first`` of every id of a round, ``repeated`` ones, and ``late``
    ones that came when the round was closed. None is lost, and a closed round holds no state."""
    from eralens.streaming.arrivals import by_round

    return by_round(stream, round_key, ids, arrived, closes, slack, hold=False)


def era_moments(stream: DataFrame, ts: str, x: str, y: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Running sums per tumbling window, enough for correlation and squared error."""
    c = F.col
    d = c(x) - c(y)
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(c(x) * c(x)).alias("sxx"),
        F.sum(c(y) * c(y)).alias("syy"), F.sum(c(x) * c(y)).alias("sxy"), F.sum(d * d).alias("sse"),
    ).select(F.col("window.start").alias("start"), "n", "sx", "sy", "sxx", "syy", "sxy", "sse")


def round_constancy(stream: DataFrame, out: str, checkpoint: str, round_key: str = "round") -> str:
    """Is the round the same in all rows of a micro-batch, and the same as in the batch before?

    Rows are written to ``rows``; what is seen while they are read (an ``Observation``: no pass
    of its own) is one row per batch in ``rounds``: ``first_round, last_round, rows, constant,
    before, changed``. ``before`` is the last round of the batch before, from that batch's
    own folder, so a replay or a restart finds the same. Returns the path of ``rounds``."""
    from eralens.streaming.sink import run_available

    spark, kind = stream.sparkSession, dict(stream.dtypes)[round_key]
    schema = f"first_round {kind}, last_round {kind}, rows bigint, constant boolean, before {kind}, changed boolean"

    def body(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        c = F.col(round_key)
        batch.observe(seen, F.min(c).alias("first"), F.max(c).alias("last"), F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        got = seen.get
        last = spark.read.schema(schema).parquet(f"{out}/rounds/batch_id={batch_id - 1}").first() if batch_id else None
        before = last["last_round"] if last and last["rows"] else last["before"] if last else None
        first = got["first"]
        row = (first, got["last"], got["rows"], first == got["last"], before, first is not None and before is not None and first != before)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{out}/rounds/batch_id={batch_id}")

    run_available(stream, body, checkpoint)
    return f"{out}/rounds"
