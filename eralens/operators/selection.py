"""Selection and promotion over score tables (arm, config_id, split, updates, seed).

Coverage is a property of sets: a candidate's cells are counted and their hashes
summed (exact decimal), so two candidates cover the same cells iff count and sums
agree; no candidate's cells are collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralens.functions.checks import ensure, findings, together, violation
from eralens.functions.exprs import on_grid, finite
from eralens.functions.ranking import AUTO, Plan, exact_quantiles, top_n
from eralens.session import cut_lineage

CELL = ("split", "seed")
ARMS = ("filtered", "plain")


def _set_hash(cells: Sequence[str]) -> list[Column]:
    """Order-free fingerprint of a set of distinct cells: two 64-bit sums."""
    parts = [F.col(c).cast("string") for c in cells]
    return [
        F.sum(F.xxhash64(F.lit(salt), *parts).cast("decimal(38,0)")).alias(f"__h{salt}") for salt in (1, 2)
    ]


def candidate_coverage(scores: DataFrame, candidate: Sequence[str], cells: Sequence[str] = CELL) -> DataFrame:
    once = scores.select(*candidate, *cells).distinct()
    return once.groupBy(*candidate).agg(F.count(F.lit(1)).alias("cells"), *_set_hash(cells))


def equal_coverage(scores: DataFrame, candidate: Sequence[str], cells: Sequence[str] = CELL,
                   value: str = "corr_mean", single_budget: bool = False, arms: Sequence[str] | None = None) -> DataFrame:
    """Violations: duplicate or incomplete cells, mixed budgets, candidates whose cells
    differ from the most frequent coverage, candidates one arm lacks."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in candidate])
    # the input is read once, into a row per cell with the number of its rows and of broken ones
    more = [c for c in ([*(["updates"] if single_budget else []), *(["arm"] if arms else [])]) if c not in (*candidate, *cells)]
    scores = cut_lineage(scores.groupBy(*candidate, *cells, *more).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~finite(F.col(value)), 1)).alias("broken")), "coverage-cells")
    cov = candidate_coverage(scores, candidate, cells)
    shape = ["cells", "__h1", "__h2"]
    common = cov.groupBy(*shape).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("cells"), F.asc("__h1")).limit(1)
    differs = cov.join(common, shape, "left_anti")
    dup = scores.groupBy(*candidate, *cells).agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    missing = scores.where("broken > 0").withColumn("each", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("broken"))))
    parts = [
        violation(differs, "coverage", key, F.col("cells")),
        violation(dup, "duplicate", key, F.concat_ws(":", *[F.col(c).cast("string") for c in cells])),
        violation(missing, "missing_value", key),
    ]
    if single_budget:
        budgets = scores.agg(F.countDistinct("updates").alias("n")).where(F.col("n") > 1)
        parts.append(violation(budgets, "mixed_budgets", F.lit("updates"), F.col("n")))
    if arms:
        rest = [c for c in candidate if c != "arm"]
        seen = scores.groupBy(*rest).agg(F.countDistinct("arm").alias("n")).where(F.col("n") < len(arms))
        parts.append(violation(seen, "one_arm_only", F.concat_ws(":", *[F.col(c).cast("string") for c in rest])))
    return together(*parts)


def candidate_scores(scores: DataFrame, candidate: Sequence[str], value: str = "corr_mean") -> DataFrame:
    return scores.groupBy(*candidate).agg(
        F.avg(value).alias("mean"), F.min(value).alias("worst"), F.count(F.lit(1)).alias("cells"))


def _best_first(ties: Sequence[str]) -> list[Column]:
    # means of the same cells may differ in the last digit between plans
    return [F.desc(on_grid(F.col("mean"), 12)), F.desc(on_grid(F.col("worst"), 12)), *[F.asc(c) for c in ties]]


def select_topk(scores: DataFrame, k: int, keys: Sequence[str] = ("arm",), ties: Sequence[str] = ("config_id",), complete: bool = True) -> DataFrame:
    """Best k candidates per arm: mean, then worst cell, then lower id. An arm with fewer
    candidates fails the query; with ``complete=False`` it has what there is, and ``too_few``
    lists such arms."""
    c = candidate_scores(scores, [*keys, *ties])
    best = top_n(c, list(keys), _best_first(ties), k)
    if not complete:
        return best
    best = best.withColumn("__found", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return ensure(best, F.col("__found") >= k, F.concat(F.lit(f"{k} candidates wanted, found "), F.col("__found").cast("string"))).drop("__found")


def too_few(selected: DataFrame, k: int, keys: Sequence[str] = ("arm",)) -> DataFrame:
    n = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)
    return violation(n, "too_few", F.concat_ws(":", *[F.col(c).cast("string") for c in keys]), F.col("n"))


def paired_union(selected: DataFrame, ids: Sequence[str] = ("config_id",)) -> DataFrame:
    return selected.select(*ids).distinct()


def select_budgeted(scores: DataFrame, k: int) -> DataFrame:
    """Candidates are (config, budget) pairs; a further tie goes to the smaller budget."""
    return select_topk(scores, k, ("arm",), ("config_id", "updates"))


def arm_pair_difference(scores: DataFrame, arms: Sequence[str] = ARMS, ids: Sequence[str] = ("config_id", "updates")) -> DataFrame:
    """Pairs that only one arm evaluated."""
    seen = scores.where(F.col("arm").isin(*arms)).groupBy(*ids).agg(*[F.max(F.col("arm") == x).alias(f"__{i}") for i, x in enumerate(arms[:2])])
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ids])
    return findings(seen, key, (f"only_{arms[0]}", ~F.col("__1")), (f"only_{arms[1]}", ~F.col("__0")))


def restrict_candidates(scores: DataFrame, ids: DataFrame, key: str = "config_id") -> DataFrame:
    """Scores of the listed ids; a listed id without scores fails the query
    (``restriction_violations`` lists them)."""
    known = scores.withColumn("__known", F.lit(True)).join(ids.select(key).distinct(), key, "right")
    return ensure(known, F.col("__known"), F.concat(F.lit("no scores for "), F.col(key).cast("string"))).select(*scores.columns)


def restriction_violations(scores: DataFrame, ids: DataFrame, key: str = "config_id") -> DataFrame:
    return violation(ids.select(key).distinct().join(scores, key, "left_anti"), "missing_id", F.col(key))


def select_multifidelity(scores: DataFrame, k: int) -> DataFrame:
    """Top k per arm within each budget; ``in_union`` rows are the distinct nominees."""
    return select_topk(scores, k, ("updates", "arm"), ("config_id",))


def successive_halving_plan(scores: DataFrame, confirm: int, scout: int, source_id: int,
                            budgets: tuple[int, int] = (5000, 20000)) -> DataFrame:
    """Rows (stage, updates, config_id): confirmation unions per budget (the source id is
    always confirmed at the larger one) and the union nominated for the long scout."""
    ranked = select_multifidelity(scores.where(F.col("updates").isin(*budgets)), max(confirm, scout))
    spark = scores.sparkSession
    forced = spark.createDataFrame(
        [("confirmation", budgets[1], source_id), ("long_scout", 0, source_id)], "stage string, updates int, config_id int")
    conf = ranked.where(F.col("place") <= confirm).select(F.lit("confirmation").alias("stage"), "updates", "config_id")
    long = ranked.where(F.col("place") <= scout).select(F.lit("long_scout").alias("stage"), F.lit(0).alias("updates"), "config_id")
    return conf.unionByName(long).unionByName(forced).distinct()


def select_finalists(scores: DataFrame, long_budget: int, high_ids: DataFrame, high_top: int, source_id: int,
                     high_budget: int = 20000, arm_high: str = "filtered", fold: str = "fold_1") -> DataFrame:
    """Rows (group, config_id): the long scout's winner per arm plus the source, and the
    best listed high-rank configs; both at seed zero."""
    zero = scores.where(F.col("seed") == 0)
    winners = select_topk(zero.where((F.col("updates") == long_budget) & (F.col("split") == fold)), 1)
    spark = scores.sparkSession
    source = spark.createDataFrame([("ordinary", source_id)], "`group` string, config_id int")
    high = restrict_candidates(zero.where((F.col("arm") == arm_high) & (F.col("updates") == high_budget)), high_ids)
    best = select_topk(high, high_top)
    return (
        winners.select(F.lit("ordinary").alias("group"), "config_id").unionByName(source)
        .unionByName(best.select(F.lit("high_rank").alias("group"), "config_id")).distinct()
    )


def expected_cells(plan: DataFrame, splits: Sequence[str], seeds: Sequence[int], arms: Sequence[str] = ARMS) -> DataFrame:
    """Planned (updates, config) x arms x splits x seeds, by exploding the short lists."""
    lit = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    d = plan.where(F.col("stage") == "confirmation").select("updates", "config_id")
    return d.withColumn("arm", lit(arms)).withColumn("split", lit(splits)).withColumn("seed", lit(seeds))


def assemble_equal_cells(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against actual cells of the planned candidates: present / missing / extra."""
    ids = ["arm", "config_id", "updates", "split", "seed"]
    planned = expected.select("arm", "config_id", "updates").distinct()
    actual = scores.join(planned, ["arm", "config_id", "updates"], "left_semi").select(*ids).distinct().withColumn("__a", F.lit(1))
    j = expected.select(*ids).distinct().withColumn("__e", F.lit(1)).join(actual, ids, "full")
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").otherwise("present")
    return j.select(*ids, status.alias("status"))


def collect_stage_audit(scores: DataFrame, expected_ids: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Per arm: expected ids that are absent, unexpected ids, repeated ids."""
    want = expected_ids.select("config_id").distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    got = scores.groupBy("arm", "config_id").agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws(":", "arm", F.col("config_id").cast("string"))
    both = want.withColumn("__want", F.lit(True)).join(got, ["arm", "config_id"], "full")
    return findings(
        both, key, ("missing", F.col("n").isNull()), ("unexpected", F.col("__want").isNull()), ("duplicate", F.col("n") > 1, F.col("n")))


def budget_sensitivity(scores: DataFrame) -> DataFrame:
    return scores.groupBy("arm", "config_id", "updates").agg(
        F.avg("corr_mean").alias("mean"), F.coalesce(F.stddev_samp("corr_mean"), F.lit(0.0)).alias("std"),
        F.min("corr_mean").alias("worst"), F.count(F.lit(1)).alias("cells"))


def select_stopping_point(history: DataFrame, batch: int, train_eras: int, final_eras: int, keys: Sequence[str] = ("arm",),
                          step: str = "updates", value: str = "corr_mean") -> DataFrame:
    """Checkpoint with the best mean over folds (earlier on ties), and the number of
    updates scaled to the larger final train set (half rounded to even)."""
    m = history.groupBy(*keys, step).agg(F.avg(value).alias("mean"))
    best = top_n(m, list(keys), [F.desc(on_grid(F.col("mean"), 12)), F.asc(step)], 1)
    updates = F.floor(F.col(step) / batch)
    return best.select(*keys, F.col(step).alias("examples"), "mean", updates.alias("updates"),
                       F.rint(updates * (final_eras / train_eras)).cast("bigint").alias("refit_updates"))


def split_mean_worst(scores: DataFrame, keys: Sequence[str], value: str = "corr", split: str = "split") -> DataFrame:
    m = scores.groupBy(*keys, split).agg(F.avg(value).alias("split_mean"))
    return m.groupBy(*keys).agg(F.avg("split_mean").alias("mean_of_splits"), F.min("split_mean").alias("worst_split"),
                                F.min_by(split, F.struct("split_mean", split)).alias("worst_name"), F.count(F.lit(1)).alias("splits"))


def select_blend(blend_scores: DataFrame, ensemble_scores: DataFrame, seed_scores: DataFrame, split: str = "split") -> DataFrame:
    """Best (arm, weight) among arms whose ensemble and every seed have a positive mean in
    every split; order: mean corr, worst split, mean bmc, weight, 'filtered' first."""
    blend_scores = cut_lineage(blend_scores, "blend-scores")      # read twice: blends are ranked once

    def positive(df, keys):
        m = df.groupBy("arm", *keys, split).agg(F.avg("corr").alias("m"))
        return m.groupBy("arm").agg(F.bool_and(F.col("m") > 0).alias("ok"))

    ok = positive(ensemble_scores, []).unionByName(positive(seed_scores, ["seed"])).groupBy("arm").agg(F.bool_and("ok").alias("stable"))
    cand = blend_scores.groupBy("arm", "weight").agg(F.avg("corr").alias("corr"), F.avg("bmc").alias("bmc"))
    worst = split_mean_worst(blend_scores, ["arm", "weight"], "corr", split).select("arm", "weight", "worst_split")
    d = cand.join(worst, ["arm", "weight"]).join(ok, "arm")
    order = [F.desc("stable"), F.desc(on_grid(F.col("corr"), 10)), F.desc(on_grid(F.col("worst_split"), 10)), F.desc(on_grid(F.col("bmc"), 10)),
             F.desc("weight"), F.asc(F.when(F.col("arm") == "filtered", 0).otherwise(1))]
    return top_n(d.withColumn("all", F.lit(1)), ["all"], order, 12).drop("all").withColumn(
        "selected", (F.col("place") == 1) & F.col("stable"))


def select_feasible_source(scores: DataFrame, feasible: DataFrame, arm: str = "filtered") -> DataFrame:
    """Best candidate of one arm among those a feasibility table admits."""
    d = restrict_candidates(scores.where(F.col("arm") == arm), feasible.where(F.col("feasible")))
    return select_topk(d, 1)


def rank_sweep_winner(scores: DataFrame, rank: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample std over replicas per rank; the best mean, lower rank on ties."""
    m = scores.groupBy(*keys, rank).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("replicas"))
    return top_n(m, list(keys), [F.desc(on_grid(F.col("mean"), 12)), F.asc(rank)], 1)


def fold_winners(scores: DataFrame) -> DataFrame:
    return select_topk(scores, 1, ("split", "arm"), ("config_id", "updates"))


def winner_union_across_folds(winners: DataFrame, audits: DataFrame) -> DataFrame:
    """Distinct (config, updates) of the winners that the audit of their fold confirms."""
    keys = ["split", "arm", "config_id", "updates"]
    ok = winners.join(audits.select(*keys), keys, "left_semi")
    return ok.groupBy("config_id", "updates").agg(
        F.count(F.lit(1)).alias("wins"), F.concat_ws(",", F.array_sort(F.collect_set("arm"))).alias("arms"))


def fixed_config_confirmation(audits: DataFrame, fixed: DataFrame) -> DataFrame:
    """Audits that do not show the winner fixed beforehand for their arm."""
    bad = audits.join(fixed.select("arm", "config_id", "updates"), ["arm", "config_id", "updates"], "left_anti")
    return violation(bad, "reselected", F.concat_ws(":", "split", "arm"), F.concat_ws(":", F.col("config_id").cast("string"), F.col("updates").cast("string")))


def leaderboard_summary(rows: DataFrame, metrics: Sequence[str], rank: str = "rank", plan: Plan = AUTO) -> DataFrame:
    """Per metric: median, 90% point, maximum, known and missing rows, and the mean and
    number of values held by the best-ranked users."""
    long = rows.unpivot([rank], list(metrics), "metric", "value")
    best = rows.agg(F.min(rank)).scalar()
    known = finite(F.col("value"))
    base = long.groupBy("metric").agg(
        F.max(F.when(known, F.col("value"))).alias("maximum"), F.count(F.when(known, 1)).alias("finite_rows"),
        F.count(F.when(~known, 1)).alias("missing_rows"))
    top = long.where(known & (F.col(rank) == best)).groupBy("metric").agg(
        F.avg("value").alias("top_rank_mean"), F.count(F.lit(1)).alias("top_rank_values"))
    q = exact_quantiles(long.where(known), ["metric"], "value", {"median": 0.5, "p90": 0.9}, plan=plan)
    return base.join(q, "metric", "left").join(top, "metric", "left")


def leaderboard_violations(rows: DataFrame, user: str = "username") -> DataFrame:
    twice = rows.groupBy(user).count().where(F.col("count") > 1)
    return together(violation(twice, "duplicate", F.col(user), F.col("count")), violation(rows.where(F.col(user).isNull()), "missing", F.lit("")))


def grid_axis_shapes(trials: DataFrame, axis: str, others: Sequence[str], value: str) -> DataFrame:
    """The shape of every slice along ``axis``, one for each setting of the other axes: falling
    throughout, rising throughout, a peak inside, or irregular. An axis has few values."""
    points = F.transform(F.array_sort(F.collect_list(F.struct(axis, value))), lambda p: p[value])
    s = trials.groupBy(*others).agg(points.alias("points"))
    steps = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.get(F.col("points"), i) - F.get(F.col("points"), i - 1))
    s = s.withColumn("steps", F.when(F.size("points") > 1, steps).otherwise(F.array().cast("array<double>")))
    inside = (F.get("steps", F.lit(0)) > 0) & (F.get("steps", F.size("steps") - 1) < 0)
    shape = F.when(F.forall("steps", lambda d: d <= 0), "falling").when(F.forall("steps", lambda d: d >= 0), "rising").when(inside, "interior_peak").otherwise("irregular")
    return s.select(*others, F.size("points").alias("points"), shape.alias("shape"))


def grid_axis_slices(trials: DataFrame, axes: Sequence[str], value: str) -> DataFrame:
    """For each axis the slice through the best trial: is the best on the boundary, is it
    still improving there, and the shape of the slice. A grid axis has few values."""
    best = trials.orderBy(F.desc(on_grid(F.col(value), 12)), *[F.asc(a) for a in axes]).limit(1).select(*[F.col(a).alias(f"b_{a}") for a in axes])
    parts = []
    for axis in axes:
        others = [a for a in axes if a != axis]
        cond = None
        for o in others:
            e = F.col(o) == F.col(f"b_{o}")
            cond = e if cond is None else cond & e
        s = trials.join(best, cond).select(F.lit(axis).alias("axis"), F.col(axis).cast("double").alias("x"), F.col(value).alias("v"), F.col(f"b_{axis}").cast("double").alias("best"))
        w = W.partitionBy("axis").orderBy("x")
        s = s.withColumn("step", F.signum(F.col("v") - F.lag("v").over(w)))
        s = s.withColumn("turn", F.when(F.col("step") != F.lag("step").over(w), 1).otherwise(0))
        g = s.groupBy("axis").agg(
            F.first("best").alias("best_value"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("points"),
            F.min_by("step", "x").alias("__skip"), F.max_by("step", "x").alias("last_step"),
            F.min_by("step", F.when(F.col("step").isNotNull(), F.col("x"))).alias("first_step"), F.sum("turn").alias("turns"))
        parts.append(g)
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    at_lo, at_hi = F.col("best_value") == F.col("lo"), F.col("best_value") == F.col("hi")
    improving = F.when(at_hi, F.col("last_step") > 0).when(at_lo, F.col("first_step") < 0)
    shape = F.when(F.col("turns") == 0, "monotone").when((F.col("turns") == 1) & (F.col("first_step") > 0), "interior_peak").otherwise("irregular")
    return d.select("axis", "best_value", "points", (at_lo | at_hi).alias("on_boundary"), improving.alias("still_improving"), shape.alias("shape"))
