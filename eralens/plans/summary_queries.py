"""Era-score summaries and training series."""

from __future__ import annotations

from pyspark.sql import functions as F

from eralens.functions.exprs import rounded
from eralens.operators import score, summary
from eralens.plans.registry import query, with_
from eralens.sources.fixtures import ERA_SCORES, LOGS, PANEL, PRED, avg_rank_sql

MODEL = ["arm", "seed"]
ES = ERA_SCORES


def r(*cols):
    return [rounded(F.col(c)).alias(c) for c in cols]


@query("summarize_eras", with_(ES + """,
cum AS (SELECT arm, seed, era, corr, sum(corr) OVER (PARTITION BY arm, seed ORDER BY era) AS cumulative FROM era_scores WHERE corr IS NOT NULL),
dd AS (SELECT *, max(cumulative) OVER (PARTITION BY arm, seed ORDER BY era) - cumulative AS drawdown FROM cum)""",
    """SELECT arm, seed, round(avg(corr), 8) AS mean, round(stddev_pop(corr), 8) AS std, round(avg(corr)/stddev_pop(corr), 8) AS sharpe,
 round(max(drawdown), 8) + 0e0 AS max_drawdown, round(max_by(cumulative, era), 8) AS cumulative, count(*) AS eras FROM dd GROUP BY arm, seed"""))
def _(t):
    return summary.summarize_eras(t.era_scores(), MODEL, "corr").select(*MODEL, *r("mean", "std", "sharpe", "max_drawdown", "cumulative"), "eras")


@query("sample_sharpe", with_(ES, "SELECT arm, seed, round(avg(corr)/stddev_samp(corr), 8) AS sharpe FROM era_scores GROUP BY arm, seed"))
def _(t):
    return summary.sample_sharpe(t.era_scores(), MODEL, "corr").select(*MODEL, *r("sharpe"))


@query("rolling_mean_min", with_(ES, """SELECT arm, seed, era, CASE WHEN count(corr) OVER w26 >= 13 THEN round(avg(corr) OVER w26, 8) + 0e0 END AS rolling_26,
 CASE WHEN count(corr) OVER w52 >= 26 THEN round(avg(corr) OVER w52, 8) + 0e0 END AS rolling_52 FROM era_scores
 WINDOW w26 AS (PARTITION BY arm, seed ORDER BY era ROWS BETWEEN 25 PRECEDING AND CURRENT ROW), w52 AS (PARTITION BY arm, seed ORDER BY era ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)"""))
def _(t):
    d = summary.rolling_mean_min(t.era_scores(), MODEL, "corr", 26, 13, out="rolling_26")
    d = summary.rolling_mean_min(d, MODEL, "corr", 52, 26, out="rolling_52")
    return d.select(*MODEL, "era", *r("rolling_26", "rolling_52"))


@query("cumulative_score", with_(ES, "SELECT arm, seed, era, round(sum(corr) OVER (PARTITION BY arm, seed ORDER BY era), 8) + 0e0 AS running FROM era_scores"))
def _(t):
    return summary.cumulative_score(t.era_scores(), MODEL, "corr").select(*MODEL, "era", *r("running"))


DIFF = ES + """,
diff AS (SELECT a.seed, a.era, a.corr - b.corr AS d, b.corr AS base FROM era_scores a JOIN era_scores b ON a.seed = b.seed AND a.era = b.era AND a.arm = 'filtered' AND b.arm = 'plain')"""


def paired(t):
    from eralens.operators import inference

    return inference.paired_difference(t.era_scores(), "filtered", "plain", ["seed"], "corr")


@query("expanding_mean", with_(DIFF, "SELECT seed, era, round(avg(d) OVER (PARTITION BY seed ORDER BY era), 8) + 0e0 AS running_mean FROM diff"))
def _(t):
    return summary.expanding_mean(paired(t), ["seed"], "difference").select("seed", "era", *r("running_mean"))


# per run and day: mean loss of each event kind stands for train / valid / test
CURVE = LOGS + """,
curve AS (SELECT user_id AS run, CAST(day(ts) AS INT) AS step, avg(CASE WHEN event_type IN ('click','view') THEN value END) AS valid,
 avg(CASE WHEN event_type = 'purchase' THEN value END) AS train, avg(CASE WHEN event_type IN ('signup','error') THEN value END) AS test FROM events GROUP BY 1, 2)"""


def curve(t):
    v = F.col("value")
    return t.table("events").groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("step")).agg(
        F.avg(F.when(F.col("event_type").isin("click", "view"), v)).alias("valid"),
        F.avg(F.when(F.col("event_type") == "purchase", v)).alias("train"),
        F.avg(F.when(F.col("event_type").isin("signup", "error"), v)).alias("test"),
    )


@query("rolling_valid_argmax", with_(CURVE + """,
s AS (SELECT *, CASE WHEN count(valid) OVER w = 5 THEN avg(valid) OVER w END AS smoothed FROM curve WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(smoothed, 12) DESC, step) AS k FROM s WHERE smoothed IS NOT NULL)""",
    "SELECT run, step AS selected_step, round(smoothed, 8) AS smoothed, round(valid, 8) AS raw, round(train, 8) AS train, round(test, 8) AS test FROM p WHERE k = 1"))
def _(t):
    return summary.rolling_valid_argmax(curve(t), ["run"], "step", "valid", ["train", "test"]).select("run", "selected_step", *r("smoothed", "raw", "train", "test"))


@query("tail_window_mean", with_(LOGS + ", p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY \"update\" DESC) AS k FROM logs)",
    "SELECT run, round(avg(loss), 8) AS tail_mean, count(*) AS n FROM p WHERE k <= 100 GROUP BY run"))
def _(t):
    return summary.tail_window_mean(t.logs(), ["run"], "update", "loss", 100).select("run", *r("tail_mean"), "n")


@query("ema", "WITH RECURSIVE " + LOGS.strip() + """,
p AS (SELECT run, "update", loss, row_number() OVER (PARTITION BY run ORDER BY "update") AS k FROM logs),
e AS (SELECT run, "update", k, loss AS ema FROM p WHERE k = 1 UNION ALL
 SELECT p.run, p."update", p.k, 0.98e0*e.ema + 0.02e0*p.loss FROM e JOIN p ON p.run = e.run AND p.k = e.k + 1)
SELECT run, "update", round(ema, 7) AS ema FROM e""")
def _(t):
    return summary.ema(t.logs(), ["run"], "update", "loss", 0.98, "ema").select("run", "update", rounded(F.col("ema"), 7).alias("ema"))


@query("rolling_batch_mean", with_(LOGS, 'SELECT run, "update", round(avg(loss) OVER (PARTITION BY run ORDER BY "update" ROWS BETWEEN 249 PRECEDING AND CURRENT ROW), 10) AS batch_mean FROM logs'))
def _(t):
    return summary.rolling_batch_mean(t.logs(), ["run"], "update", "loss").select("run", "update", rounded(F.col("batch_mean"), 10).alias("batch_mean"))


@query("loss_over_initial", with_(LOGS, 'SELECT run, "update", round(loss / first_value(loss) OVER (PARTITION BY run ORDER BY "update"), 8) AS loss_over_initial FROM logs'))
def _(t):
    return summary.loss_over_initial(t.logs(), ["run"], "update").select("run", "update", *r("loss_over_initial"))


@query("curve_envelope", with_(LOGS + """,
ps AS (SELECT arm, kind, step, avg(loss) AS v FROM logs GROUP BY 1, 2, 3), sd AS (SELECT arm, count(DISTINCT kind) AS seeds FROM ps GROUP BY arm),
e AS (SELECT arm, step, avg(v) AS mean, min(v) AS low, max(v) AS high, stddev_samp(v)/sqrt(count(*)) AS sem, count(*) AS n FROM ps GROUP BY arm, step)""",
    "SELECT arm, step, round(mean, 8) AS mean, round(low, 8) AS low, round(high, 8) AS high, round(sem, 8) AS sem, n FROM e JOIN sd USING (arm) WHERE n = seeds"))
def _(t):
    return summary.curve_envelope(t.logs(), "arm", "step", "kind", "loss").select("arm", "step", *r("mean", "low", "high", "sem"), "n")


@query("paired_curve_difference", with_(LOGS + """,
ps AS (SELECT run, step, avg(CASE WHEN arm='filtered' THEN loss END) AS a, avg(CASE WHEN arm='plain' THEN loss END) AS b FROM logs GROUP BY 1, 2)""",
    "SELECT run, round(avg(a), 7) AS late_a, round(avg(b), 7) AS late_b, round(avg(a-b), 7) + 0e0 AS late_difference, count(*) AS steps FROM ps WHERE a IS NOT NULL AND b IS NOT NULL AND step >= 15 GROUP BY run"))
def _(t):
    d = summary.paired_curve_difference(t.logs(), ("filtered", "plain"), "step", "run", "loss", 15)
    return d.select("run", *[rounded(F.col(c), 7).alias(c) for c in ("late_a", "late_b", "late_difference")], "steps")


@query("loss_quartiles", with_(LOGS + """, n AS (SELECT *, loss / first_value(loss) OVER (PARTITION BY run ORDER BY "update") AS x FROM logs)""",
    "SELECT arm, step, round(quantile_cont(x, 0.25), 8) AS q25, round(quantile_cont(x, 0.5), 8) AS median, round(quantile_cont(x, 0.75), 8) AS q75 FROM n GROUP BY arm, step"))
def _(t):
    d = summary.loss_over_initial(t.logs(), ["run"], "update")
    return summary.quartiles(d, ["arm", "step"], "loss_over_initial").select("arm", "step", *r("q25", "median", "q75"))


@query("final_row_per_run", with_(LOGS, """SELECT run, max_by(loss, "update") FILTER (WHERE arm='filtered') AS filtered, max_by(loss, "update") FILTER (WHERE arm='plain') AS plain FROM logs GROUP BY run"""))
def _(t):
    return summary.final_row_per_run(t.logs(), "arm", ["filtered", "plain"], "run", "update", "loss")


ACF = ES + """,
ser AS (SELECT arm, era, avg(corr) AS x FROM era_scores WHERE corr IS NOT NULL GROUP BY arm, era),
ps AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY era) AS pos FROM ser),
acf AS (SELECT a.arm, lag, corr(a.x, b.x) AS acf FROM ps a CROSS JOIN (SELECT unnest(range(1, 21)) AS lag) l JOIN ps b ON b.arm = a.arm AND b.pos = a.pos + lag GROUP BY a.arm, lag)"""


def arm_series(t):
    return t.era_scores().where(F.col("corr").isNotNull()).groupBy("arm", "era").agg(F.avg("corr").alias("x"))


@query("acf", with_(ACF, "SELECT arm, CAST(lag AS INT) AS lag, round(acf, 8) + 0e0 AS acf FROM acf"))
def _(t):
    return summary.acf(arm_series(t), ["arm"], "x").select("arm", "lag", *r("acf"))


@query("block_length_rule", with_(ACF, "SELECT arm, CAST(greatest(4, coalesce(min(CASE WHEN abs(acf) < 0.1e0 THEN lag END), 21)) AS INT) AS block_length FROM acf GROUP BY arm"))
def _(t):
    return summary.block_length_rule(summary.acf(arm_series(t), ["arm"], "x"), ["arm"])


@query("seed_noise", with_(ES + """,
v AS (SELECT arm, era, var_samp(corr) AS v FROM era_scores GROUP BY arm, era), rms AS (SELECT arm, sqrt(avg(v)) AS seed_sd FROM v GROUP BY arm),
pr AS (SELECT a.arm, a.seed AS sa, b.seed AS sb, stddev_samp(a.corr - b.corr) AS d FROM era_scores a JOIN era_scores b ON a.arm=b.arm AND a.era=b.era AND a.seed < b.seed GROUP BY 1, 2, 3)""",
    "SELECT arm, round(any_value(seed_sd), 8) AS seed_sd, round(avg(d)/sqrt(3e0), 8) AS difference_sd FROM pr JOIN rms USING (arm) GROUP BY arm"))
def _(t):
    return summary.seed_noise(t.era_scores(), ["arm"], "corr").select("arm", *r("seed_sd", "difference_sd"))


@query("arm_seed_mean", with_(ES + """,
ps AS (SELECT arm, seed, avg(corr) AS m FROM era_scores GROUP BY arm, seed), lv AS (SELECT arm, avg(m) AS level, 4.30265e0*stddev_samp(m)/sqrt(count(*)) AS half_width FROM ps GROUP BY arm),
em AS (SELECT arm, era, avg(corr) AS mean, count(corr) AS seeds FROM era_scores GROUP BY arm, era)""",
    "SELECT arm, era, round(mean, 8) + 0e0 AS mean, seeds, round(level, 8) AS level, round(half_width, 8) AS half_width FROM em JOIN lv USING (arm)"))
def _(t):
    es = t.era_scores()
    d = summary.arm_seed_mean(es, ["arm", "era"], "corr").join(summary.level_interval(es, ["arm"], "corr"), "arm")
    return d.select("arm", "era", *r("mean"), "seeds", *r("level", "half_width"))


@query("sanity_band", with_(ES + f""",
sp0 AS (SELECT arm, seed, era, {avg_rank_sql('prediction', 'arm, seed, era')} AS x, {avg_rank_sql('target', 'arm, seed, era')} AS y FROM pred),
sp AS (SELECT arm, seed, era, CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN corr(x, y) END AS s FROM sp0 GROUP BY 1, 2, 3),
spm AS (SELECT arm, seed, avg(s) AS spearman_mean FROM sp GROUP BY 1, 2), cm AS (SELECT arm, seed, avg(corr) AS corr_mean FROM era_scores GROUP BY 1, 2),
lv AS (SELECT arm, seed, corr_mean, spearman_mean FROM spm JOIN cm USING (arm, seed)), ref AS (SELECT corr_mean AS ref FROM lv WHERE arm = 'plain' AND seed = 0)""",
    """SELECT arm, seed, round(corr_mean, 8) + 0e0 AS corr_mean, round(spearman_mean, 8) + 0e0 AS spearman_mean, round(0.25e0*ref, 8) + 0e0 AS band_low, round(1.5e0*ref, 8) + 0e0 AS band_high,
 corr_mean BETWEEN 0.25e0*ref AND 1.5e0*ref AS inside, corr_mean > 2e0*ref OR spearman_mean > 0.06e0 AS gate_fired FROM lv CROSS JOIN ref"""))
def _(t):
    sp = score.spearman_per_era(t.pred(), ["arm", "seed", "era"], plan=t.plan()).groupBy(*MODEL).agg(F.avg("spearman").alias("spearman_mean"))
    levels = t.era_scores().groupBy(*MODEL).agg(F.avg("corr").alias("corr_mean")).join(sp, MODEL)
    ref = levels.where((F.col("arm") == "plain") & (F.col("seed") == 0))
    return summary.sanity_band(levels, ref).select(*MODEL, *r("corr_mean", "spearman_mean", "band_low", "band_high"), "inside", "gate_fired")


@query("tail_quartiles", with_(DIFF + """,
q AS (SELECT seed, quantile_cont(base, 0.25) AS q1, quantile_cont(base, 0.5) AS q2, quantile_cont(base, 0.75) AS q3 FROM diff GROUP BY seed),
b AS (SELECT d.*, CAST(base >= q1 AS INT) + CAST(base >= q2 AS INT) + CAST(base >= q3 AS INT) AS bucket FROM diff d JOIN q USING (seed))""",
    "SELECT seed, bucket, count(*) AS eras, round(avg(base), 8) + 0e0 AS by_mean, round(avg(d), 8) + 0e0 AS mean_difference FROM b GROUP BY seed, bucket"))
def _(t):
    return summary.tail_quartiles(paired(t), ["seed"], "base", "difference").select("seed", "bucket", "eras", *r("by_mean", "mean_difference"))


@query("target_dispersion", with_(PANEL, "SELECT era, round(stddev_samp(target), 8) AS dispersion FROM panel WHERE target IS NOT NULL GROUP BY era"))
def _(t):
    return summary.target_dispersion(t.panel().where(F.col("target").isNotNull())).select("era", *r("dispersion"))
