"""Summaries of era scores and of training series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralens.functions.exprs import on_grid, finite
from eralens.functions.ranking import AUTO, Plan, exact_quantiles, on_keys, row_positions, running_weight, top_n
from eralens.functions.series import era_positions, era_window, ema, rolling  # noqa: F401
from eralens.operators.score import pearson


def drawdowns(df: DataFrame, keys: Sequence[str], value: str, era: str = "era") -> DataFrame:
    """Running total, its peak so far (first total, not zero) and the drop below it."""
    w = era_window(keys, era)
    d = df.withColumn("cumulative", F.sum(value).over(w))
    d = d.withColumn("peak", F.max("cumulative").over(w))
    return d.withColumn("drawdown", F.col("peak") - F.col("cumulative"))


def summarize_eras(df: DataFrame, keys: Sequence[str], value: str, era: str = "era") -> DataFrame:
    d = drawdowns(df.where(F.col(value).isNotNull()), keys, value, era)
    return d.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.max("drawdown").alias("max_drawdown"), F.max_by("cumulative", era).alias("cumulative"),
        F.count(value).alias("eras"),
    ).withColumn("sharpe", F.when(F.col("std") > 0, F.col("mean") / F.col("std")))


def sample_sharpe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return s.select(*keys, F.when(F.col("std") > 0, F.col("mean") / F.col("std")).alias("sharpe"))


def rolling_mean_min(df: DataFrame, keys: Sequence[str], value: str, width: int = 26, least: int = 13,
                     era: str = "era", out: str = "rolling") -> DataFrame:
    return rolling(df, keys, era, value, width, least, out, plan=None)


def cumulative_score(df: DataFrame, keys: Sequence[str], value: str, era: str = "era", out: str = "running") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(era_window(keys, era)))


def expanding_mean(df: DataFrame, keys: Sequence[str], value: str, era: str = "era", out: str = "running_mean") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(era_window(keys, era)))


def rolling_valid_argmax(curves: DataFrame, keys: Sequence[str], step: str, valid: str, also: Sequence[str],
                         width: int = 5, plan: Plan = AUTO) -> DataFrame:
    """Step with the largest full-window moving mean (earliest on ties)."""
    s = rolling(curves, keys, step, valid, width, width, "smoothed", plan).where(F.col("smoothed").isNotNull())
    best = top_n(s, keys, [F.desc(on_grid(F.col("smoothed"), 12)), F.asc(step)], 1)
    return best.select(*keys, F.col(step).alias("selected_step"), "smoothed", F.col(valid).alias("raw"), *also)


def tail_window_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, last: int, plan: Plan = AUTO) -> DataFrame:
    """Mean of the last ``last`` values of every series."""
    d = row_positions(df, keys, order, "__pos", plan, total="__n")
    return d.where(F.col("__pos") >= F.col("__n") - last).groupBy(*keys).agg(
        F.avg(value).alias("tail_mean"), F.count(F.lit(1)).alias("n")
    )


def rolling_batch_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int = 250, plan: Plan = AUTO) -> DataFrame:
    return rolling(df, keys, order, value, width, 1, "batch_mean", plan)


def loss_over_initial(df: DataFrame, keys: Sequence[str], order: str, loss: str = "loss") -> DataFrame:
    """loss / first loss of the run. The first loss is an aggregate joined back, so a
    long run is never collected."""
    first = df.groupBy(*keys).agg(F.min_by(loss, order).alias("initial"))
    return on_keys(df, first, list(keys)).withColumn("loss_over_initial", F.col(loss) / F.col("initial"))


def loss_violations(df: DataFrame, keys: Sequence[str], order: str, loss: str = "loss") -> DataFrame:
    """Losses that are not finite and positive, and updates seen twice in a run."""
    from eralens.functions.checks import together, violation

    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    bad = df.where(~finite(F.col(loss)) | (F.col(loss) <= 0))
    twice = df.groupBy(*keys, order).count().where(F.col("count") > 1)
    return together(violation(bad, "loss", key, F.col(order)), violation(twice, "update_repeated", key, F.col(order)))


def curve_envelope(df: DataFrame, arm: str, step: str, seed: str, value: str) -> DataFrame:
    """Mean, range and standard error over seeds at steps that every seed has."""
    per_seed = df.groupBy(arm, seed, step).agg(F.avg(value).alias("v"))
    seeds = per_seed.groupBy(arm).agg(F.countDistinct(seed).alias("seeds"))
    e = per_seed.groupBy(arm, step).agg(
        F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"),
        (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"), F.count("v").alias("n"),
    )
    return e.join(seeds, arm).where(F.col("n") == F.col("seeds")).drop("seeds")


def paired_curve_difference(df: DataFrame, arms: tuple[str, str], step: str, seed: str, value: str, late: int) -> DataFrame:
    """Per seed: late mean (step >= late) of both arms and of their difference by step."""
    per = df.where(F.col("arm").isin(*arms)).groupBy(seed, step).agg(
        F.avg(F.when(F.col("arm") == arms[0], F.col(value))).alias("a"),
        F.avg(F.when(F.col("arm") == arms[1], F.col(value))).alias("b"),
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col(step) >= late))
    return per.groupBy(seed).agg(
        F.avg("a").alias("late_a"), F.avg("b").alias("late_b"),
        F.avg(F.col("a") - F.col("b")).alias("late_difference"), F.count(F.lit(1)).alias("steps"),
    )


def quartiles(df: DataFrame, keys: Sequence[str], value: str, plan: Plan = AUTO) -> DataFrame:
    return exact_quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, plan=plan)


def final_row_per_run(df: DataFrame, arm: str, arms: Sequence[str], config: str, order: str, value: str) -> DataFrame:
    """Last value of every (arm, config), one column per arm."""
    return df.groupBy(config).agg(*[
        F.max_by(value, F.when(F.col(arm) == a, F.col(order))).alias(a) for a in arms
    ])


def acf(df: DataFrame, keys: Sequence[str], value: str, lags: int = 20, era: str = "era") -> DataFrame:
    """Autocorrelation at lag 1..lags as Pearson of the two shifted slices."""
    s = era_positions(df.where(F.col(value).isNotNull()), keys, era).select(*keys, "pos", F.col(value).alias("x"))
    head = s.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("other", F.col("pos") + F.col("lag"))
    tail = s.select(*keys, F.col("pos").alias("other"), F.col("x").alias("y"))
    return pearson(head.join(tail, [*keys, "other"]), [*keys, "lag"], F.col("x"), F.col("y"), "acf", True)


def block_length_rule(acf_table: DataFrame, keys: Sequence[str], overlap: int = 4, lags: int = 20, small: float = 0.1) -> DataFrame:
    first = F.min(F.when(F.abs(F.col("acf")) < small, F.col("lag")))
    return acf_table.groupBy(*keys).agg(
        F.greatest(F.lit(overlap), F.coalesce(first, F.lit(lags + 1))).alias("block_length")
    )


def seed_noise(df: DataFrame, keys: Sequence[str], value: str, seeds: int = 3) -> DataFrame:
    """Root mean variance across seeds, and mean sample sd of the demeaned pairwise
    seed differences scaled to the difference of two seed means."""
    rms = df.groupBy(*keys, "era").agg(F.var_samp(value).alias("v")).groupBy(*keys).agg(
        F.sqrt(F.avg("v")).alias("seed_sd"))
    a = df.select(*keys, "era", F.col("seed").alias("sa"), F.col(value).alias("x"))
    b = df.select(*keys, "era", F.col("seed").alias("sb"), F.col(value).alias("y"))
    pairs = a.join(b, [*keys, "era"]).where(F.col("sa") < F.col("sb"))
    sd = pairs.groupBy(*keys, "sa", "sb").agg(F.stddev_samp(F.col("x") - F.col("y")).alias("d"))
    mean_sd = sd.groupBy(*keys).agg((F.avg("d") / F.sqrt(F.lit(float(seeds)))).alias("difference_sd"))
    return rms.join(mean_sd, list(keys))


def arm_seed_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean across seeds per era and arm."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("seeds"))


def level_interval(df: DataFrame, keys: Sequence[str], value: str, t: float = 4.30265) -> DataFrame:
    """Mean of the seed means with a t interval (4.30265: two degrees of freedom)."""
    per_seed = df.groupBy(*keys, "seed").agg(F.avg(value).alias("m"))
    s = per_seed.groupBy(*keys).agg(F.avg("m").alias("level"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"))
    return s.withColumn("half_width", F.lit(t) * F.col("sem"))


def sanity_band(levels: DataFrame, reference: DataFrame, spearman_gate: float = 0.06) -> DataFrame:
    """Is a model's mean inside [0.25, 1.5] of the reference's; is a leak suspected."""
    d = levels.withColumn("ref", reference.agg(F.first("corr_mean")).scalar())
    return d.select(
        *levels.columns,
        (F.lit(0.25) * F.col("ref")).alias("band_low"), (F.lit(1.5) * F.col("ref")).alias("band_high"),
        F.col("corr_mean").between(0.25 * F.col("ref"), 1.5 * F.col("ref")).alias("inside"),
        ((F.col("corr_mean") > 2.0 * F.col("ref")) | (F.col("spearman_mean") > spearman_gate)).alias("gate_fired"),
    )


def quartile_buckets(eras: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Bucket 0..3 by the quartiles of ``by`` (a value on a cut goes up). Rows are
    eras, so a group's percentile stays as small as the number of eras."""
    cuts = eras.groupBy(*keys).agg(F.percentile(by, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    d = eras.join(cuts, list(keys))
    at_least = [F.when(F.col(by) >= F.col("q")[i], 1).otherwise(0) for i in range(3)]
    return d.withColumn("bucket", at_least[0] + at_least[1] + at_least[2]).drop("q")


def tail_quartiles(eras: DataFrame, keys: Sequence[str], by: str, difference: str) -> DataFrame:
    return quartile_buckets(eras, keys, by).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("eras"), F.avg(by).alias("by_mean"), F.avg(difference).alias("mean_difference")
    )


def target_dispersion(panel: DataFrame, era: str = "era", target: str = "target") -> DataFrame:
    return panel.groupBy(era).agg(F.stddev_samp(target).alias("dispersion"))


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, plan: Plan = AUTO, out: str = "running") -> DataFrame:
    """Running sum of a series of any length."""
    return running_weight(df, keys, order, F.col(value), plan).withColumn(out, F.col("before") + F.col(value)).drop("before", "whole")


def lag_check(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distance to the previous step of the same series (NULL for the first)."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("step_gap", F.col(order) - F.lag(order).over(w))
