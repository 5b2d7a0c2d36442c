"""Era-wise ranking metrics. ``keys`` name the group, e.g. (model, era).

Rank windows and the final sums share the same keys, so a metric costs one
shuffle; for over-large groups the ranking primitives switch to ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralens.functions.exprs import on_grid, moments_corr, signed_pow, with_probit
from eralens.functions.ranking import AUTO, Plan, dealt, distinct_ranks, on_keys, resolve, row_positions, with_rank


def rank_within_era(df: DataFrame, value: str = "prediction", keys: Sequence[str] = ("era",),
                    out: str = "rank", plan: Plan = AUTO) -> DataFrame:
    return with_rank(df, list(keys), value, out, plan=plan)


def rank_global(df: DataFrame, value: str, round_key: str, out: str = "rank", plan: Plan = AUTO) -> DataFrame:
    """Rank over a whole live round."""
    return with_rank(df, [round_key], value, out, plan=plan)


def pearson(df: DataFrame, keys: Sequence[str], x: Column, y: Column, out: str, complete: bool = False) -> DataFrame:
    """Per-group Pearson from additive sums; NULL for constant input.
    ``complete`` says that no value is NULL, which saves a filter over both."""
    d = df.select(*keys, x.alias("__x"), y.alias("__y"))
    if not complete:
        d = d.where(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    s = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__x").alias("sx"), F.sum("__y").alias("sy"),
        F.sum(F.col("__x") * F.col("__x")).alias("sxx"), F.sum(F.col("__y") * F.col("__y")).alias("syy"),
        F.sum(F.col("__x") * F.col("__y")).alias("sxy"),
    )
    c = moments_corr(*[F.col(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return s.select(*keys, c.alias(out), F.col("n"))


def _scorable(df: DataFrame, *cols: str) -> DataFrame:
    return df.na.drop(subset=list(cols))


def gaussian_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, split) -> DataFrame:
    """Normal quantile of the within-group rank. Computed right after its rank: two
    quantiles in one generated stage would exceed what the JIT compiles."""
    return with_probit(with_rank(df, keys, value, "__rank", plan=split), F.col("__rank"), out).drop("__rank")


def corr_v1(df: DataFrame, keys: Sequence[str], pred: str = "prediction", target: str = "target",
            plan: Plan = AUTO, out: str = "corr") -> DataFrame:
    """avg rank/(n+1) -> normal quantile -> signed power 1.5, against target - 1/2."""
    r = with_rank(
        _scorable(df, pred, target), keys, pred, "__r",
        lambda below, ties, total: (below + (ties + F.lit(1)) / F.lit(2.0)) / (total + 1), plan,
    )
    return pearson(with_probit(r, F.col("__r"), "__z"), keys, signed_pow(F.col("__z")), signed_pow(F.col(target) - 0.5), out, True)


def corr_v2(df: DataFrame, keys: Sequence[str], row_key: str, pred: str = "prediction", target: str = "target",
            plan: Plan = AUTO, out: str = "corr") -> DataFrame:
    """Ordinal rank (ties by row key) -> centred uniform -> signed power; 0 if constant."""
    p = row_positions(_scorable(df, pred, target), keys, [pred, row_key], "__pos", plan, total="__n")
    x = signed_pow((F.col("__pos") + 0.5) / F.col("__n") - 0.5)
    got = pearson(p, keys, x, signed_pow(F.col(target) - 0.5), out, True)
    return got.withColumn(out, F.coalesce(out, F.lit(0.0)))


def _centred_target(df: DataFrame, keys: Sequence[str], target: str, split) -> DataFrame:
    from pyspark.sql import Window as W

    if split is None:
        return df.withColumn("__tc", F.col(target) - F.avg(target).over(W.partitionBy(*keys)))
    means = df.groupBy(*keys).agg(F.avg(target).alias("__tm"))
    return on_keys(df, means, list(keys), "inner").withColumn("__tc", F.col(target) - F.col("__tm")).drop("__tm")


def corr_official(df: DataFrame, keys: Sequence[str], pred: str = "prediction", target: str = "target",
                  plan: Plan = AUTO, out: str = "corr") -> DataFrame:
    """(avg rank - 1/2)/n -> normal quantile -> power, against the mean-centred target."""
    d = _scorable(df, pred, target)
    d, split = dealt(d, keys, plan)
    r = _centred_target(gaussian_rank(d, keys, pred, "__z", split), keys, target, split)
    return pearson(r, keys, signed_pow(F.col("__z")), signed_pow(F.col("__tc")), out, True)


def bmc(df: DataFrame, keys: Sequence[str], pred: str = "prediction", benchmark: str = "benchmark",
        target: str = "target", plan: Plan = AUTO, out: str = "bmc") -> DataFrame:
    """Contribution over a benchmark: covariance with the target of the part of the
    gaussianised prediction that is orthogonal to the gaussianised benchmark."""
    d = _scorable(df, pred, benchmark, target)
    d, split = dealt(d, keys, plan)
    g = gaussian_rank(gaussian_rank(d, keys, benchmark, "m", split), keys, pred, "p", split).withColumn("t", F.col(target))
    s = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("m").alias("sm"), F.avg("t").alias("tm"),
        F.min("t").alias("lo"), F.max("t").alias("hi"),
        F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("m")).alias("tmm"),
        F.sum(F.col("p") * F.col("m")).alias("pm"), F.sum(F.col("m") * F.col("m")).alias("mm"),
    )
    return s.select(*keys, _contribution("n").alias(out), "n")


def bmc_covered_only(df: DataFrame, keys: Sequence[str], plan: Plan = AUTO, benchmark: str = "benchmark",
                     pred: str = "prediction", target: str = "target") -> DataFrame:
    """corr for every era, bmc only where the benchmark exists (NULL elsewhere).

    Both scores come from one pass: each rank is taken within the group, the bmc
    ranks within its covered rows only."""
    d = _scorable(df, pred, target)
    d, split = dealt(d, keys, plan)
    covered = F.col(benchmark).isNotNull()
    # ranked first: the mean then finds its groups in order and needs no sort of its own
    d = _centred_target(gaussian_rank(d, keys, pred, "z", split), keys, target, split)
    d = d.withColumn("__cp", F.when(covered, F.col(pred)))
    for source, name in (("__cp", "p"), (benchmark, "m")):
        d = gaussian_rank(d, keys, source, name, split)
    d = d.select(*keys, "p", "m", signed_pow(F.col("z")).alias("x"), signed_pow(F.col("__tc")).alias("y"),
                 F.when(covered, F.col(target)).alias("t"))
    c, total = F.col, lambda e: F.sum(e)
    s = d.groupBy(*keys).agg(
        F.count("x").alias("n"), total("x").alias("sx"), total("y").alias("sy"), total(c("x") * c("x")).alias("sxx"),
        total(c("y") * c("y")).alias("syy"), total(c("x") * c("y")).alias("sxy"),
        F.count("t").alias("k"), total("p").alias("sp"), total("m").alias("sm"), F.avg("t").alias("tm"),
        F.min("t").alias("lo"), F.max("t").alias("hi"), total(c("t") * c("p")).alias("tp"),
        total(c("t") * c("m")).alias("tmm"), total(c("p") * c("m")).alias("pm"), total(c("m") * c("m")).alias("mm"),
    )
    corr = moments_corr(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy"))
    return s.select(*keys, corr.alias("corr"), F.when(c("k") > 0, _contribution("k")).alias("bmc"))


def _contribution(rows: str) -> Column:
    c = F.col
    scale = F.when((c("lo") >= 0) & (c("hi") <= 1), 4.0).otherwise(1.0)
    beta = F.when(c("mm") > 1e-12, c("pm") / c("mm")).otherwise(0.0)
    tp, tm = c("tp") - c("tm") * c("sp"), c("tmm") - c("tm") * c("sm")
    return scale * (tp - beta * tm) / c(rows)


def spearman_per_era(df: DataFrame, keys: Sequence[str], pred: str = "prediction", target: str = "target",
                     plan: Plan = AUTO, out: str = "spearman") -> DataFrame:
    d = _scorable(df, pred, target)
    d, split = dealt(d, keys, plan)
    r = with_rank(with_rank(d, keys, target, "__ry", plan=split), keys, pred, "__rx", plan=split)
    return pearson(r, keys, F.col("__rx"), F.col("__ry"), out, True)


def pearson_per_era(df: DataFrame, model_keys: Sequence[str], x: str, y: str, era: str = "era") -> DataFrame:
    """Raw correlation overall and per era: mean, sample std, min, max, count."""
    per = pearson(df, [*model_keys, era], F.col(x), F.col(y), "c")
    spread = per.groupBy(*model_keys).agg(
        F.avg("c").alias("per_era_mean"), F.stddev_samp("c").alias("per_era_std"),
        F.min("c").alias("per_era_min"), F.max("c").alias("per_era_max"), F.count(F.lit(1)).alias("eras"),
    )
    whole = pearson(df, model_keys, F.col(x), F.col(y), "global").drop("n")
    return whole.join(spread, list(model_keys))


def mse(df: DataFrame, keys: Sequence[str], pred: str = "prediction", target: str = "target", centre: float = 0.0) -> DataFrame:
    e = F.col(pred) - (F.col(target) - F.lit(centre))
    return df.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.count(e).alias("n"))


def unpivot_models(df: DataFrame, ids: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Wide prediction columns to rows (model, prediction)."""
    return df.unpivot(list(ids), list(models), "model", "prediction")


def multi_model_era_scores(df: DataFrame, models: Sequence[str], plan: Plan = AUTO, era: str = "era",
                           target: str = "target", benchmark: str = "benchmark") -> DataFrame:
    """corr and bmc for many prediction columns in one pass."""
    split = resolve(df, [era], plan)
    rows = unpivot_models(df, ["id", era, target, benchmark], models)
    return bmc_covered_only(rows, ["model", era], split, benchmark, target=target)


def seed_ensemble(df: DataFrame, plan: Plan = AUTO, arm: str = "arm", seed: str = "seed",
                  era: str = "era", row: str = "id", keep: Sequence[str] = ("target", "benchmark")) -> DataFrame:
    """Mean over seeds of the within-era rank."""
    r = with_rank(df, [arm, seed, era], "prediction", "__r", plan=plan)
    return r.groupBy(arm, era, row).agg(
        F.avg("__r").alias("prediction"), F.count(F.lit(1)).alias("seeds"),
        *[F.first(k).alias(k) for k in keep],
    )


def benchmark_blend(df: DataFrame, weights: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0), plan: Plan = AUTO,
                    keys: Sequence[str] = ("era",), pred: str = "prediction", benchmark: str = "benchmark") -> DataFrame:
    """Re-ranked weighted mean of the model's and the benchmark's within-era rank."""
    keys = list(keys)
    d = _scorable(df, pred, benchmark)
    d, split = dealt(d, keys, plan)
    r = with_rank(with_rank(d, keys, pred, "__m", plan=split), keys, benchmark, "__b", plan=split)
    # one weight after the other, so that a sort holds the rows once and not once per weight
    for i, x in enumerate(weights):
        mix = F.lit(float(x)) * F.col("__m") + (F.lit(1.0) - F.lit(float(x))) * F.col("__b")
        # sums of the same ranks in another order differ in the last digit: compare at 12 places
        r = with_rank(r.withColumn("__mix", on_grid(mix, 12)), keys, "__mix", f"__blend{i}", plan=split).drop("__mix")
    each = F.inline(F.array(*[F.struct(F.lit(float(x)).alias("weight"), F.col(f"__blend{i}").alias("blend")) for i, x in enumerate(weights)]))
    return r.select(*d.columns, each)


def blend_scores(blends: DataFrame, plan: Plan = AUTO, keys: Sequence[str] = ("era",), weight: str = "weight",
                 pred: str = "blend") -> DataFrame:
    """corr and bmc of every blend per group. Weights are text while they are keys: by a floating
    key the rows would be dealt a second time, by a number of partitions that does not follow them."""
    d = blends.withColumn(weight, F.col(weight).cast("string"))
    return bmc_covered_only(d, [*keys, weight], plan, pred=pred).withColumn(weight, F.col(weight).cast("double"))


def target_rank_ensemble(df: DataFrame, targets: Sequence[str], keys: Sequence[str] = ("era",),
                         plan: Plan = AUTO, out: str = "target_ensemble") -> DataFrame:
    """Re-ranked mean of the within-era ranks of several targets; NULL unless all exist."""
    keys = list(keys)
    df, split = dealt(df, keys, plan)
    everywhere = F.lit(True)
    for t in targets:
        everywhere = everywhere & F.col(t).isNotNull()
    d = df
    for i, t in enumerate(targets):
        d = d.withColumn(f"__t{i}", F.when(everywhere, F.col(t)))
        d = with_rank(d, keys, f"__t{i}", f"__r{i}", plan=split)
    total = F.col("__r0")
    for i in range(1, len(targets)):
        total = total + F.col(f"__r{i}")
    d = d.withColumn("__mean", on_grid(total / F.lit(float(len(targets))), 12))
    d = with_rank(d, keys, "__mean", out, plan=split)
    return d.drop("__mean", *[f"__t{i}" for i in range(len(targets))], *[f"__r{i}" for i in range(len(targets))])


def secondary_targets(df: DataFrame, pairs: Sequence[tuple[str, str]], models: Sequence[str] = ("arm", "seed"),
                      plan: Plan = AUTO, era: str = "era") -> DataFrame:
    """Every (target, its benchmark) for every model: corr and bmc per era."""
    split = resolve(df, [*models, era], plan)
    entries = F.array(*[
        F.struct(F.lit(t).alias("target_name"), F.col(t).cast("double").alias("target"), F.col(b).cast("double").alias("benchmark"))
        for t, b in pairs
    ])
    rows = df.select(*models, era, "prediction", F.explode(entries).alias("e")).select(
        *models, era, "prediction", "e.*"
    ).where(F.col("target").isNotNull())
    return bmc_covered_only(rows, ["target_name", *models, era], split)
