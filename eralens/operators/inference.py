"""Paired inference on era scores.

Resamples are rows: (key, sample, block) with a hashed start, so the draws do not
depend on partitioning. A block's sum is looked up from the circular window sums of
the series, which has one row per era. Resamples that all series share are a matrix of
weights instead, which series are multiplied with.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralens.functions.checks import ensure, findings
from eralens.functions.exprs import finite, hash_u32, keyed
from eralens.functions.ranking import AUTO, Plan, distinct_ranks, exact_quantiles, resolve, with_rank
from eralens.functions.series import era_positions

INTERVAL = (0.025, 0.975)


def paired_difference(scores: DataFrame, a: str, b: str, keys: Sequence[str], value: str,
                      arm: str = "arm", era: str = "era") -> DataFrame:
    """Era-aligned value of arm a minus arm b, with b's value as ``base``. Eras that neither arm
    could score are left out; one that only one arm has, or has twice, fails the query
    (``pairing_violations`` lists them)."""
    wide = scores.where(F.col(arm).isin(a, b)).groupBy(*keys, era).agg(
        F.max(F.when(F.col(arm) == a, F.col(value))).alias("va"),
        F.max(F.when(F.col(arm) == b, F.col(value))).alias("base"),
        *[F.count(F.when((F.col(arm) == x) & finite(F.col(value)), 1)).alias(f"n_{i}") for i, x in enumerate((a, b))],
    )
    scored = ensure(wide.where((F.col("n_0") > 0) | (F.col("n_1") > 0)), (F.col("n_0") == 1) & (F.col("n_1") == 1),
                    F.concat(F.lit(f"{a} and {b} are not paired in era "), F.col(era).cast("string")))
    return scored.select(
        *keys, era, (F.col("va") - F.col("base")).alias("difference"), "base"
    )


def pairing_violations(scores: DataFrame, a: str, b: str, keys: Sequence[str], value: str,
                       arm: str = "arm", era: str = "era") -> DataFrame:
    """Eras that are duplicated, missing in one arm, or not finite."""
    both = scores.where(F.col(arm).isin(a, b))
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col(era).cast("string"))
    per = both.groupBy(*keys, era).agg(
        *[F.count(F.when(F.col(arm) == x, 1)).alias(f"n_{i}") for i, x in enumerate((a, b))],
        F.count(F.when(~finite(F.col(value)), 1)).alias("broken"),
    )
    n0, n1 = F.col("n_0"), F.col("n_1")
    return findings(
        per, key, ("duplicate", (n0 > 1) | (n1 > 1)), ("missing", (n0 == 0) | (n1 == 0)), ("not_finite", F.col("broken") > 0))


def series_shape(series: DataFrame, keys: Sequence[str], value: str, era: str = "era") -> DataFrame:
    return era_positions(series.select(*keys, era, F.col(value).alias("x")), keys, era)


def long_enough(shape: DataFrame, length: int) -> DataFrame:
    """A series shorter than a block fails the query."""
    return ensure(shape, F.col("n") >= length, F.concat(F.lit(f"a block of {length} eras from a series of "), F.col("n").cast("string")))


def draw_blocks(shape: DataFrame, keys: Sequence[str], length: int, samples: int, seed: int,
                shared: bool = False) -> DataFrame:
    """Rows (keys, sample, start, take): circular blocks, the last one shortened.
    ``shared`` hashes no key, so all comparisons see the same resamples."""
    head = shape.select(*keys, "n").distinct()
    blocks = F.ceil(F.col("n") / F.lit(float(length))).cast("int")
    rows = (
        head.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .repartition(*[F.col(k) for k in keys], F.col("sample"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    )
    label = keyed(seed, "sample", F.col("sample"), F.col("block")) if shared else keyed(
        seed, *[F.col(k) for k in keys], F.col("sample"), F.col("block"))
    left = F.col("n") - F.col("block") * length
    return rows.select(
        *keys, "n", "sample", F.pmod(hash_u32(label), F.col("n")).alias("start"),
        F.least(F.lit(length), left).cast("int").alias("take"),
    )


def window_sums(shape: DataFrame, keys: Sequence[str], length: int, values: dict[str, object]) -> DataFrame:
    """For every start and both block lengths in use: circular sums of the values."""
    last = F.pmod(F.col("n"), F.lit(length)).cast("int")
    takes = F.array_distinct(F.filter(F.array(F.least(F.lit(length), F.col("n")).cast("int"), last), lambda v: v > 0))
    spread = (
        shape.withColumn("take", F.explode(takes))
        .withColumn("back", F.explode(F.sequence(F.lit(0), F.col("take") - 1)))
        .withColumn("start", F.pmod(F.col("pos") - F.col("back"), F.col("n")).cast("bigint"))
    )
    return spread.groupBy(*keys, "take", "start").agg(*[F.sum(e).alias(name) for name, e in values.items()])


def _interval(boot: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quantiles over the fixed number of samples of each key."""
    return boot.groupBy(*keys).agg(
        F.percentile(value, F.array(*[F.lit(q) for q in INTERVAL])).alias("ci"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("probability_positive"),
        F.count(F.lit(1)).alias("samples"),
    ).select(*keys, F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "probability_positive", "samples")


def bootstrap_samples(series: DataFrame, keys: Sequence[str], value: str, length: int = 8, samples: int = 10_000,
                      seed: int = 20260810, shared: bool = False, era: str = "era") -> DataFrame:
    shape = long_enough(series_shape(series, keys, value, era), length)
    sums = window_sums(shape, keys, length, {"s": F.col("x")})
    draws = draw_blocks(shape, keys, length, samples, seed, shared)
    return draws.join(sums, [*keys, "take", "start"]).groupBy(*keys, "sample").agg(
        (F.sum("s") / F.first("n")).alias("boot_mean")
    )


def block_bootstrap_mean(series: DataFrame, keys: Sequence[str], value: str, length: int = 8, samples: int = 10_000,
                         seed: int = 20260810, shared: bool = False, era: str = "era") -> DataFrame:
    """Estimate, 95% interval and P(> 0) of the mean by circular moving blocks. With ``shared``
    all series see the same resamples, which are drawn once a task (``shared_intervals``)."""
    if shared:
        return shared_intervals(series, keys, value, length, samples, seed, era)
    ci = _interval(bootstrap_samples(series, keys, value, length, samples, seed, shared, era), keys, "boot_mean")
    est = series.groupBy(*keys).agg(F.avg(value).alias("estimate"), F.count(value).alias("eras"))
    return est.join(ci, list(keys)).withColumn("block_length", F.lit(length))


@functools.lru_cache(maxsize=8)
def resample_weights(n: int, length: int, samples: int, seed: int) -> np.ndarray:
    """How often each of n eras stands in each resample (eras x samples). The starts are the
    hashes of ``draw_blocks`` with shared draws, so any task finds the same matrix."""
    blocks = -(-n // length)
    labels = (f"{seed}:sample:{s}:{b}" for s in range(samples) for b in range(blocks))
    start = np.fromiter((int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in labels), np.int64, samples * blocks).reshape(samples, blocks) % n
    take = np.minimum(length, n - np.arange(blocks) * length)
    out = np.zeros((n, samples), np.float64)
    for off in range(length):
        some = np.flatnonzero(off < take)
        np.add.at(out, ((start[:, some] + off) % n, np.arange(samples)[:, None]), 1.0)
    return out


def shared_intervals(series: DataFrame, keys: Sequence[str], value: str, length: int, samples: int, seed: int, era: str = "era") -> DataFrame:
    """Interval of the mean for many series under the same resamples: series (one array of
    eras each) times the resample weights, some series at a time. The draws are made once a
    task and length, whatever the number of series."""
    shape = long_enough(series_shape(series, keys, value, era), length)
    rows = shape.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"].cast("double")).alias("xs"))
    kinds = dict(rows.dtypes)
    made = [("estimate", "double"), ("eras", "bigint"), ("ci_low", "double"), ("ci_high", "double"), ("probability_positive", "double"), ("samples", "bigint")]

    def run(batches):
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            size = held.value_lengths().to_numpy()
            out = np.zeros((len(size), 6))
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                weights = resample_weights(n, length, samples, seed)
                for part in np.array_split(at, -(-len(at) // 64)):
                    x = held.take(pa.array(part)).flatten().to_numpy().reshape(len(part), n)
                    means = x @ weights / n
                    low, high = np.quantile(means, INTERVAL, axis=1)
                    out[part] = np.column_stack([x.mean(axis=1), np.full(len(part), n), low, high, (means > 0).mean(axis=1), np.full(len(part), samples)])
            columns = [pa.array(c if t == "double" else c.astype(np.int64)) for c, (_, t) in zip(out.T, made)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], *columns], names=[*keys, *[n for n, _ in made]])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{n} {t}" for n, t in made])
    return rows.mapInArrow(run, schema).withColumn("block_length", F.lit(length))


def block_bootstrap_sharpe(pairs: DataFrame, keys: Sequence[str], a: str, b: str, length: int = 8,
                           samples: int = 10_000, seed: int = 20260810, era: str = "era") -> DataFrame:
    """Interval of the difference of two mean/std ratios, resampled jointly."""
    d = pairs.select(*keys, era, F.col(a).alias("x"), F.col(b).alias("y"))
    shape = long_enough(era_positions(d, keys, era), length)
    x, y = F.col("x"), F.col("y")
    sums = window_sums(shape, keys, length, {"x1": x, "x2": x * x, "y1": y, "y2": y * y})
    draws = draw_blocks(shape, keys, length, samples, seed)
    boot = draws.join(sums, [*keys, "take", "start"]).groupBy(*keys, "sample").agg(
        F.first("n").alias("n"), *[F.sum(c).alias(c) for c in ("x1", "x2", "y1", "y2")])

    def ratio(s1, s2):
        n = F.col("n")
        var = (F.col(s2) - F.col(s1) * F.col(s1) / n) / (n - 1)
        return F.when(var > 0, F.col(s1) / n / F.sqrt(var))

    ci = _interval(boot.withColumn("d", ratio("x1", "x2") - ratio("y1", "y2")), keys, "d")
    point = d.groupBy(*keys).agg(
        (F.avg("x") / F.stddev_samp("x")).alias("sharpe_a"), (F.avg("y") / F.stddev_samp("y")).alias("sharpe_b"))
    return point.join(ci, list(keys)).withColumn("difference", F.col("sharpe_a") - F.col("sharpe_b"))


def iid_bootstrap_bucket(rows: DataFrame, keys: Sequence[str], value: str, samples: int = 2000, seed: int = 20260810,
                         era: str = "era") -> DataFrame:
    """Independent resamples within a bucket of eras."""
    shape = series_shape(rows, keys, value, era)
    draws = (
        shape.select(*keys, "n").distinct()
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .repartition(*[F.col(k) for k in keys], F.col("sample"))
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
        .withColumn("pos", F.pmod(hash_u32(keyed(seed, *[F.col(k) for k in keys], F.col("sample"), F.col("draw"))), F.col("n")))
    )
    boot = draws.join(shape.select(*keys, F.col("pos").cast("bigint").alias("pos"), "x"), [*keys, "pos"]).groupBy(
        *keys, "sample").agg(F.avg("x").alias("boot_mean"))
    est = rows.groupBy(*keys).agg(F.avg(value).alias("estimate"), F.count(value).alias("eras"))
    return est.join(_interval(boot, keys, "boot_mean"), list(keys))


def with_verdict(intervals: DataFrame, threshold, mean: str = "estimate", low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """helps / hurts / doesnt_help / no_verdict, in that order, and its wording."""
    t = threshold if not isinstance(threshold, float) else F.lit(threshold)
    m, lo, hi = F.col(mean), F.col(low), F.col(high)
    category = (
        F.when((lo > 0) & (m >= t), "helps").when((hi < 0) & (m <= -t), "hurts")
        .when((lo > -t) & (hi < t), "doesnt_help").otherwise("no_verdict")
    )
    d = intervals.withColumn("category", category)
    return d.withColumn("wording", F.when(F.col("category") == "hurts", "no evidence of benefit").otherwise(F.col("category")))


def threshold_of(baseline: DataFrame, keys: Sequence[str], value: str, cap: float = 0.005, share: float = 0.25) -> DataFrame:
    """min(cap, share x mean baseline score)."""
    return baseline.groupBy(*keys).agg(F.least(F.lit(cap), F.lit(share) * F.avg(value)).alias("threshold"))


def model_pairs(scores: DataFrame, models: Sequence[str], values: Sequence[str], pairs: DataFrame, era: str = "era") -> DataFrame:
    """Long table (pair, metric, era, difference) of the named pairs (model_a, model_b). What
    neither model could score is left out; what only one has fails the query."""
    name = F.concat_ws("_s", *[F.col(m).cast("string") for m in models])
    long = scores.select(name.alias("model"), era, *values).unpivot(["model", era], list(values), "metric", "v").where(finite(F.col("v")))
    one = lambda side, v: pairs.join(long.select(F.col("model").alias(side), era, "metric", F.col("v").alias(v)), side)
    both = one("model_a", "va").join(one("model_b", "vb"), ["model_a", "model_b", era, "metric"], "full")
    where = F.concat_ws(" ", F.lit("not paired:"), "model_a", "model_b", "metric", F.col(era).cast("string"))
    return ensure(both, F.col("va").isNotNull() & F.col("vb").isNotNull(), where).select(
        F.concat_ws("-", "model_a", "model_b").alias("pair"), "metric", era, (F.col("va") - F.col("vb")).alias("difference"))


def pair_matrix(scores: DataFrame, models: Sequence[str], values: Sequence[str], pairs: DataFrame, threshold: float,
                length: int = 8, samples: int = 2000) -> DataFrame:
    d = model_pairs(scores, models, values, pairs)
    boot = block_bootstrap_mean(d, ["pair", "metric"], "difference", length, samples, shared=True)
    return with_verdict(boot, threshold)


def seed_pool(scores: DataFrame, original: Sequence[int], rerun: Sequence[int], value: str) -> DataFrame:
    """Mean per (arm, era) over original and rerun seeds. An era that only one pool could score
    fails the query."""
    s = scores.where(F.col(value).isNotNull() & F.col("seed").isin(*original, *rerun))
    pooled = s.groupBy("arm", "era").agg(
        F.avg(F.when(F.col("seed").isin(*original), F.col(value))).alias("original"),
        F.avg(F.when(F.col("seed").isin(*rerun), F.col(value))).alias("rerun"),
        F.avg(F.when(F.col("seed").isin(*original, *rerun), F.col(value))).alias("pooled"),
        F.count(F.when(F.col("seed").isin(*original, *rerun), 1)).alias("seeds"),
    )
    return ensure(pooled, F.col("original").isNotNull() & F.col("rerun").isNotNull(), F.concat(F.lit("only one pool has era "), F.col("era").cast("string")))


def consistency_compare(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two verdict tables side by side: same category, same sign."""
    a = first.select(*keys, F.col("estimate").alias("estimate_a"), F.col("category").alias("category_a"))
    b = second.select(*keys, F.col("estimate").alias("estimate_b"), F.col("category").alias("category_b"))
    return a.join(b, list(keys), "full").withColumn("same_category", F.col("category_a") == F.col("category_b")).withColumn(
        "same_sign", F.signum("estimate_a") == F.signum("estimate_b"))


def verdict_share(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the verdicts that are one of the three, per ``keys``."""
    return verdicts.groupBy(*keys).agg(F.avg(F.when(F.col("category") != "no_verdict", 1.0).otherwise(0.0)).alias("any_verdict"), F.count(F.lit(1)).alias("verdicts"))


def power_gate(power: DataFrame, keys: Sequence[str], probability: str, least: float = 0.6) -> DataFrame:
    worst = power.groupBy(*keys).agg(F.min(probability).alias("gate_value"), F.count(F.lit(1)).alias("scenarios"))
    return worst.withColumn("decision", F.when(F.col("gate_value") >= least, "GO").otherwise("NO-GO"))


def signed_tests(df: DataFrame, keys: Sequence[str], value: str, plan: Plan = AUTO) -> DataFrame:
    """One-sample t, Wilcoxon signed rank (zeros dropped, ties averaged) and the share
    of negative values; p of the latter two by the normal approximation."""
    d = df.where(F.col(value).isNotNull())
    t = d.groupBy(*keys).agg(
        (F.avg(value) / (F.stddev_samp(value) / F.sqrt(F.count(value)))).alias("t_statistic"),
        F.avg(F.when(F.col(value) < 0, 1.0).otherwise(0.0)).alias("share_negative"), F.count(value).alias("n"),
    )
    nz = d.where(F.col(value) != 0).withColumn("__a", F.abs(F.col(value)))
    ranked = with_rank(nz, keys, "__a", "__r", lambda below, ties, total: below + (ties + F.lit(1)) / F.lit(2.0), plan)
    w = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col(value) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.count(F.lit(1)).alias("m"))
    m = F.col("m")
    z = (F.col("w_plus") - m * (m + 1) / 4.0) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24.0)
    return t.join(w.select(*keys, "w_plus", z.alias("wilcoxon_z")), list(keys), "left").withColumn("wilcoxon_p", two_sided_p("wilcoxon_z"))


def two_sided_p(z: str):
    """2 (1 - Phi(|z|)); there is no error function among the SQL built-ins."""
    import math

    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda x: math.erfc(abs(x) / math.sqrt(2.0)), na_action="ignore")

    return tail(F.col(z))


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, first: str, second: str, value: str, plan: Plan = AUTO) -> DataFrame:
    """Two-sample U from average ranks over the union, with medians and quartiles."""
    d = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    split = resolve(d, keys, plan)
    ranks = distinct_ranks(d, keys, value, [
        F.count(F.when(F.col(group) == first, 1)).alias("k1"), F.count(F.when(F.col(group) == second, 1)).alias("k2")], split)
    avg_rank = F.col("below") + (F.col("ties") + 1) / F.lit(2.0)
    u = ranks.groupBy(*keys).agg(
        F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.sum(F.col("k1") * avg_rank).alias("r1"))
    n1 = F.col("n1")
    u = u.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2.0)
    q = exact_quantiles(d, [*keys, group], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, plan=split)
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when(F.col(group) == g, F.col(c))).alias(f"{c}_{tag}")
        for g, tag in ((first, "first"), (second, "second")) for c in ("q25", "median", "q75")])
    return u.select(*keys, "n1", "n2", "u").join(wide, list(keys))
