"""Ranking and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eralens.functions.exprs import on_grid, rounded, with_probit
from eralens.operators import score, vectors
from eralens.plans.registry import query, with_
from eralens.sources.fixtures import (
    ERA_SCORES, PANEL, PRED, avg_rank_sql, bmc_sql, official_sql, probit_sql, spow,
)

KEYS = ["arm", "seed", "era"]
K = "arm, seed, era"


@query("rank_within_era", with_(PRED, f"SELECT id, arm, seed, era, round({avg_rank_sql('prediction', K)}, 8) AS rank FROM pred"))
def _(t):
    r = score.rank_within_era(t.pred(), keys=KEYS, plan=t.plan())
    return r.select("id", *KEYS, rounded(F.col("rank")).alias("rank"))


@query("rank_global", f"SELECT event_id, round_day, round({avg_rank_sql('value', 'round_day')}, 8) AS rank FROM (SELECT event_id, value, CAST(day(ts) AS INT) AS round_day FROM events)")
def _(t):
    rounds = t.table("events").select("event_id", "value", F.dayofmonth("ts").alias("round_day"))
    return score.rank_global(rounds, "value", "round_day").select("event_id", "round_day", rounded(F.col("rank")).alias("rank"))


@query("probit", with_(PRED + f", r AS (SELECT id, era, arm, seed, {avg_rank_sql('prediction', K)} AS p FROM pred)",
                       f"SELECT id, era, arm, seed, round({probit_sql('p')}, 8) + 0e0 AS z FROM r"))
def _(t):
    r = score.rank_within_era(t.pred(), keys=KEYS, plan=t.plan())
    return with_probit(r, F.col("rank"), "z").select("id", *KEYS, rounded(F.col("z")).alias("z"))


@query("corr_v1", with_(PRED + f""",
r AS (SELECT {K}, (rank() OVER (PARTITION BY {K} ORDER BY prediction) - 1 + (count(*) OVER (PARTITION BY {K}, prediction) + 1)/2e0)/(count(*) OVER (PARTITION BY {K}) + 1) AS p, target - 0.5e0 AS t FROM pred),
g AS (SELECT {K}, {probit_sql('p')} AS z, t FROM r)""",
    f"SELECT {K}, CASE WHEN stddev_pop(z) > 1e-12 AND stddev_pop({spow('t')}) > 1e-12 THEN round(corr({spow('z')}, {spow('t')}), 8) + 0e0 END AS corr, count(*) AS n FROM g GROUP BY {K}"))
def _(t):
    return score.corr_v1(t.pred(), KEYS, plan=t.plan()).select(*KEYS, rounded(F.col("corr")).alias("corr"), "n")


@query("corr_v2", with_(PRED + f""",
r AS (SELECT {K}, (row_number() OVER (PARTITION BY {K} ORDER BY prediction, id) - 0.5e0)/count(*) OVER (PARTITION BY {K}) - 0.5e0 AS x, target - 0.5e0 AS t FROM pred)""",
    f"SELECT {K}, CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop({spow('t')}) > 1e-12 THEN round(corr({spow('x')}, {spow('t')}), 8) + 0e0 ELSE 0e0 END AS corr, count(*) AS n FROM r GROUP BY {K}"))
def _(t):
    return score.corr_v2(t.pred(), KEYS, "id", plan=t.plan()).select(*KEYS, rounded(F.col("corr")).alias("corr"), "n")


@query("corr_official", with_(PRED + "," + official_sql("pred", K), f"SELECT {K}, round(corr, 8) + 0e0 AS corr FROM o_corr"))
def _(t):
    return score.corr_official(t.pred(), KEYS, plan=t.plan()).select(*KEYS, rounded(F.col("corr")).alias("corr"))


@query("bmc", with_(PRED + "," + bmc_sql("pred", K), f"SELECT {K}, round(bmc, 8) + 0e0 AS bmc FROM b_bmc"))
def _(t):
    return score.bmc(t.pred(), KEYS, plan=t.plan()).select(*KEYS, rounded(F.col("bmc")).alias("bmc"))


@query("bmc_covered_only", with_(ERA_SCORES, "SELECT arm, seed, era, round(corr, 8) + 0e0 AS corr, round(bmc, 8) + 0e0 AS bmc FROM era_scores"))
def _(t):
    s = score.bmc_covered_only(t.pred(), KEYS, plan=t.plan())
    return s.select(*KEYS, rounded(F.col("corr")).alias("corr"), rounded(F.col("bmc")).alias("bmc"))


@query("spearman_per_era", with_(PRED + f", r AS (SELECT {K}, {avg_rank_sql('prediction', K)} AS x, {avg_rank_sql('target', K)} AS y FROM pred)",
    f"SELECT {K}, CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN round(corr(x, y), 8) + 0e0 END AS spearman, count(*) AS n FROM r GROUP BY {K}"))
def _(t):
    return score.spearman_per_era(t.pred(), KEYS, plan=t.plan()).select(*KEYS, rounded(F.col("spearman")).alias("spearman"), "n")


@query("pearson_per_era", with_(PRED + """, p AS (SELECT * FROM pred WHERE benchmark IS NOT NULL),
e AS (SELECT arm, seed, era, CASE WHEN stddev_pop(prediction) > 1e-9 AND stddev_pop(benchmark) > 1e-9 THEN corr(prediction, benchmark) END AS c FROM p GROUP BY arm, seed, era),
w AS (SELECT arm, seed, corr(prediction, benchmark) AS g FROM p GROUP BY arm, seed)""",
    """SELECT arm, seed, round(any_value(g), 8) + 0e0 AS "global", round(avg(c), 8) + 0e0 AS per_era_mean, round(stddev_samp(c), 8) AS per_era_std,
  round(min(c), 8) AS per_era_min, round(max(c), 8) AS per_era_max, count(*) AS eras FROM e JOIN w USING (arm, seed) GROUP BY arm, seed"""))
def _(t):
    p = t.pred().where(F.col("benchmark").isNotNull())
    got = score.pearson_per_era(p, ["arm", "seed"], "prediction", "benchmark")
    return got.select("arm", "seed", *[rounded(F.col(c)).alias(c) for c in ("global", "per_era_mean", "per_era_std", "per_era_min", "per_era_max")], "eras")


@query("mse_per_split", with_(PRED, "SELECT arm, CASE WHEN era <= 40 THEN 'train' ELSE 'validation' END AS split, round(avg((prediction - (target - 0.5e0)) * (prediction - (target - 0.5e0))), 8) AS mse, count(*) AS n FROM pred GROUP BY 1, 2"))
def _(t):
    p = t.pred().withColumn("split", F.when(F.col("era") <= 40, "train").otherwise("validation"))
    return score.mse(p, ["arm", "split"], centre=0.5).select("arm", "split", rounded(F.col("mse")).alias("mse"), "n")


@query("multi_model_era_scores", with_(PANEL + f""",
wide AS (SELECT id, era, target, benchmark, latent AS m_signal, 1e0 - latent AS m_inverse, benchmark_b AS m_price FROM panel WHERE target IS NOT NULL),
big AS (SELECT era FROM wide GROUP BY era HAVING count(*) >= 5),
long AS (SELECT * FROM (SELECT id, era, target, benchmark, 'm_signal' AS model, m_signal AS prediction FROM wide UNION ALL SELECT id, era, target, benchmark, 'm_inverse', m_inverse FROM wide
 UNION ALL SELECT id, era, target, benchmark, 'm_price', m_price FROM wide) WHERE era IN (SELECT era FROM big) AND prediction IS NOT NULL),
{official_sql("long", "model, era")},{bmc_sql("long", "model, era")}""",
    "SELECT model, era, round(corr, 8) + 0e0 AS corr, round(bmc, 8) + 0e0 AS bmc FROM o_corr LEFT JOIN b_bmc USING (model, era)"))
def _(t):
    wide = t.panel().where(F.col("target").isNotNull()).join(t.scored_eras(), "era", "left_semi").select(
        "id", "era", "target", "benchmark", F.col("latent").alias("m_signal"), (F.lit(1.0) - F.col("latent")).alias("m_inverse"),
        F.col("benchmark_b").alias("m_price"))
    got = score.multi_model_era_scores(wide, ["m_signal", "m_inverse", "m_price"], plan=t.plan())
    return got.select("model", "era", rounded(F.col("corr")).alias("corr"), rounded(F.col("bmc")).alias("bmc"))


ENSEMBLE = PRED + f""",
sr AS (SELECT *, {avg_rank_sql('prediction', K)} AS r FROM pred),
ens AS (SELECT arm, era, id, avg(r) AS prediction, count(*) AS seeds, any_value(target) AS target, any_value(benchmark) AS benchmark FROM sr GROUP BY arm, era, id)"""


@query("seed_ensemble", with_(ENSEMBLE, "SELECT arm, era, id, round(prediction, 8) AS prediction, seeds FROM ens"))
def _(t):
    return score.seed_ensemble(t.pred(), plan=t.plan()).select("arm", "era", "id", rounded(F.col("prediction")).alias("prediction"), "seeds")


BLEND = f""",
br AS (SELECT *, {avg_rank_sql('prediction', 'arm, era')} AS m, {avg_rank_sql('benchmark', 'arm, era')} AS b FROM ensr WHERE benchmark IS NOT NULL),
bw AS (SELECT arm, era, id, target, benchmark, weight, round(weight*m + (1e0-weight)*b, 12) AS mix FROM br CROSS JOIN (VALUES (0.1e0),(0.25e0),(0.5e0),(0.75e0),(1e0)) w(weight)),
blend AS (SELECT arm, era, id, target, benchmark, weight, {avg_rank_sql('mix', 'arm, weight, era')} AS blend FROM bw)"""
ENSEMBLE_ROUNDED = ENSEMBLE + ", ensr AS (SELECT * REPLACE (round(prediction, 10) AS prediction) FROM ens)"


@query("benchmark_blend", with_(ENSEMBLE_ROUNDED + BLEND, "SELECT arm, era, id, weight, round(blend, 8) AS blend FROM blend"))
def _(t):
    ens = score.seed_ensemble(t.pred(), plan=t.plan()).withColumn("prediction", on_grid(F.col("prediction"), 10))
    return score.benchmark_blend(ens, keys=["arm", "era"], plan=t.plan()).select("arm", "era", "id", "weight", rounded(F.col("blend")).alias("blend"))


@query("target_rank_ensemble", with_(PANEL + f""",
tr AS (SELECT id, era, round(({avg_rank_sql('target', 'era')} + {avg_rank_sql('target_b', 'era')})/2e0, 12) AS m FROM panel WHERE target IS NOT NULL AND target_b IS NOT NULL)""",
    f"SELECT id, era, round({avg_rank_sql('m', 'era')}, 8) AS target_ensemble FROM tr UNION ALL SELECT id, era, NULL FROM panel WHERE target IS NULL OR target_b IS NULL"))
def _(t):
    got = score.target_rank_ensemble(t.panel(), ["target", "target_b"], plan=t.plan())
    return got.select("id", "era", rounded(F.col("target_ensemble")).alias("target_ensemble"))


@query("secondary_targets", with_(PRED + f""",
lt AS (SELECT arm, seed, era, prediction, 'target' AS target_name, target, benchmark FROM pred UNION ALL SELECT arm, seed, era, prediction, 'target_b', target_b, benchmark_b FROM pred),
{official_sql("lt", "target_name, arm, seed, era")},{bmc_sql("lt", "target_name, arm, seed, era")}""",
    "SELECT target_name, arm, seed, era, round(corr, 8) + 0e0 AS corr, round(bmc, 8) + 0e0 AS bmc FROM o_corr LEFT JOIN b_bmc USING (target_name, arm, seed, era)"))
def _(t):
    got = score.secondary_targets(t.pred(), [("target", "benchmark"), ("target_b", "benchmark_b")], plan=t.plan(12))
    return got.select("target_name", *KEYS, rounded(F.col("corr")).alias("corr"), rounded(F.col("bmc")).alias("bmc"))


@query("feature_exposure", with_(PRED + """,
x AS (SELECT pred.arm, pred.seed, pred.era, pred.prediction, unnest(panel.features) AS x, unnest(range(len(panel.features))) AS feature FROM pred JOIN panel USING (id)),
c AS (SELECT arm, seed, era, feature, CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(prediction) > 1e-9 THEN corr(x, prediction) END AS c FROM x GROUP BY arm, seed, era, feature),
e AS (SELECT arm, seed, feature, avg(c) AS exposure FROM c GROUP BY arm, seed, feature)""",
    "SELECT arm, seed, round(max(abs(exposure)), 8) AS max_exposure, count(exposure) AS features FROM e GROUP BY arm, seed"))
def _(t):
    p = t.pred().select("id", "arm", "seed", "era", "prediction").join(t.panel().select("id", "features"), "id")
    got = vectors.feature_exposure(p, ["arm", "seed"], 6)
    return got.select("arm", "seed", rounded(F.col("max_exposure")).alias("max_exposure"), "features")
