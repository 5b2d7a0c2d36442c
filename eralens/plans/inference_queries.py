"""Paired inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eralens.functions.exprs import rounded
from eralens.operators import inference, summary
from eralens.plans.registry import query, with_
from eralens.plans.summary_queries import DIFF, ES, paired, r

SEED, L = 20260810, 8


def hu(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def boot_sql(source: str, keys: str, value: str, label: str, samples: int, tag: str = "bt", length: int = L) -> str:
    """CTEs ending in {tag}_ci(keys, estimate, eras, ci_low, ci_high, probability_positive, samples)."""
    return f"""
{tag}_p AS (SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY era) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
{tag}_h AS (SELECT DISTINCT {keys}, n FROM {tag}_p),
{tag}_d AS (SELECT {keys}, n, sample, block, {hu(label)} % n AS start, least({length}, n - block*{length}) AS take FROM {tag}_h
  CROSS JOIN (SELECT unnest(range({samples})) AS sample) s, LATERAL (SELECT unnest(range(CAST(ceil(n/{length}.0) AS BIGINT))) AS block) b),
{tag}_x AS (SELECT *, unnest(range(take)) AS off FROM {tag}_d),
{tag}_m AS (SELECT {keys}, sample, sum(x)/any_value(n) AS m FROM (SELECT {keys}, n, sample, (start + off) % n AS pos FROM {tag}_x) JOIN {tag}_p USING ({keys}, n, pos) GROUP BY {keys}, sample),
{tag}_q AS (SELECT {keys}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END) AS probability_positive, count(*) AS samples FROM {tag}_m GROUP BY {keys}),
{tag}_e AS (SELECT {keys}, avg({value}) AS estimate, count({value}) AS eras FROM {source} GROUP BY {keys}),
{tag}_ci AS (SELECT * FROM {tag}_e JOIN {tag}_q USING ({keys}))"""


VERDICT = """CASE WHEN ci_low > 0 AND estimate >= {t} THEN 'helps' WHEN ci_high < 0 AND estimate <= -{t} THEN 'hurts'
 WHEN ci_low > -{t} AND ci_high < {t} THEN 'doesnt_help' ELSE 'no_verdict' END"""
DIFF = DIFF.replace("a.arm = 'filtered' AND b.arm = 'plain')", "a.arm = 'filtered' AND b.arm = 'plain' WHERE a.corr IS NOT NULL AND b.corr IS NOT NULL)")
ROUNDED = "round(estimate, 8) + 0e0 AS estimate, round(ci_low, 8) + 0e0 AS ci_low, round(ci_high, 8) + 0e0 AS ci_high"


@query("paired_difference", with_(DIFF, "SELECT seed, era, round(d, 8) + 0e0 AS difference, round(base, 8) + 0e0 AS base FROM diff"))
def _(t):
    return paired(t).select("seed", "era", *r("difference", "base"))


BOOT = DIFF + "," + boot_sql("diff", "seed", "d", f"'{SEED}:' || seed || ':' || sample || ':' || block", 10_000)


def boot(t):
    return inference.block_bootstrap_mean(paired(t), ["seed"], "difference", L, 10_000, SEED)


@query("block_bootstrap_mean", with_(BOOT, f"SELECT seed, {ROUNDED}, round(probability_positive, 8) AS probability_positive, eras, samples FROM bt_ci"))
def _(t):
    return boot(t).select("seed", *r("estimate", "ci_low", "ci_high", "probability_positive"), "eras", "samples")


@query("block_bootstrap_sharpe", with_(DIFF + f""",
p AS (SELECT seed, d + base AS x, base AS y, row_number() OVER (PARTITION BY seed ORDER BY era) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS n FROM diff),
h AS (SELECT DISTINCT seed, n FROM p),
dr AS (SELECT seed, n, sample, {hu(f"'{SEED}:' || seed || ':' || sample || ':' || block")} % n AS start, least({L}, n - block*{L}) AS take FROM h
 CROSS JOIN (SELECT unnest(range(10000)) AS sample) s, LATERAL (SELECT unnest(range(CAST(ceil(n/{L}.0) AS BIGINT))) AS block) b),
ix AS (SELECT seed, n, sample, start, unnest(range(take)) AS off FROM dr),
bm AS (SELECT seed, sample, avg(x)/stddev_samp(x) - avg(y)/stddev_samp(y) AS dd FROM (SELECT seed, n, sample, (start + off) % n AS pos FROM ix) JOIN p USING (seed, n, pos) GROUP BY seed, sample),
ci AS (SELECT seed, quantile_cont(dd, 0.025) AS ci_low, quantile_cont(dd, 0.975) AS ci_high FROM bm GROUP BY seed),
pt AS (SELECT seed, avg(d+base)/stddev_samp(d+base) AS sa, avg(base)/stddev_samp(base) AS sb FROM diff GROUP BY seed)""",
    "SELECT seed, round(sa, 7) AS sharpe_a, round(sb, 7) AS sharpe_b, round(sa - sb, 7) + 0e0 AS difference, round(ci_low, 7) + 0e0 AS ci_low, round(ci_high, 7) + 0e0 AS ci_high FROM pt JOIN ci USING (seed)"))
def _(t):
    d = paired(t).withColumn("a", F.col("difference") + F.col("base"))
    got = inference.block_bootstrap_sharpe(d, ["seed"], "a", "base", L, 10_000, SEED)
    return got.select("seed", *[rounded(F.col(c), 7).alias(c) for c in ("sharpe_a", "sharpe_b", "difference", "ci_low", "ci_high")])


PAIRS = ES + """,
long AS (SELECT arm || '_s' || seed AS model, era, metric, v FROM (SELECT arm, seed, era, 'corr' AS metric, corr AS v FROM era_scores UNION ALL SELECT arm, seed, era, 'bmc', bmc FROM era_scores) WHERE v IS NOT NULL),
pairs AS (SELECT a.model || '-' || b.model AS pair, a.metric, a.era, a.v - b.v AS d FROM long a JOIN long b ON a.era = b.era AND a.metric = b.metric AND a.model < b.model)"""
SHARED = PAIRS + "," + boot_sql("pairs", "pair, metric", "d", f"'{SEED}:sample:' || sample || ':' || block", 10_000)


def named_pairs(t):
    """The comparisons asked for, by name."""
    from itertools import combinations

    from eralens.sources.fixtures import ARMS, SEEDS

    names = [f"{a}_s{s}" for a in ARMS for s in SEEDS]
    return t.spark.createDataFrame(list(combinations(names, 2)), "model_a string, model_b string")


@query("shared_resamples", with_(SHARED, f"SELECT pair, metric, {ROUNDED}, eras FROM bt_ci"))
def _(t):
    d = inference.model_pairs(t.era_scores(), ["arm", "seed"], ["corr", "bmc"], named_pairs(t))
    got = inference.block_bootstrap_mean(d, ["pair", "metric"], "difference", L, 10_000, SEED, shared=True)
    return got.select("pair", "metric", *r("estimate", "ci_low", "ci_high"), "eras")


@query("pair_matrix", with_(SHARED, f"SELECT pair, metric, {ROUNDED}, {VERDICT.format(t='0.005e0')} AS category FROM bt_ci"))
def _(t):
    got = inference.pair_matrix(t.era_scores(), ["arm", "seed"], ["corr", "bmc"], named_pairs(t), 0.005, L, 10_000)
    return got.select("pair", "metric", *r("estimate", "ci_low", "ci_high"), "category")


@query("iid_bootstrap_bucket", with_(DIFF + f""",
q AS (SELECT seed, quantile_cont(base, 0.25) AS q1, quantile_cont(base, 0.5) AS q2, quantile_cont(base, 0.75) AS q3 FROM diff GROUP BY seed),
b AS (SELECT d.*, CAST(base >= q1 AS INT) + CAST(base >= q2 AS INT) + CAST(base >= q3 AS INT) AS bucket FROM diff d JOIN q USING (seed)),
p AS (SELECT seed, bucket, d AS x, row_number() OVER (PARTITION BY seed, bucket ORDER BY era) - 1 AS pos, count(*) OVER (PARTITION BY seed, bucket) AS n FROM b),
h AS (SELECT DISTINCT seed, bucket, n FROM p),
dr AS (SELECT seed, bucket, n, sample, {hu(f"'{SEED}:' || seed || ':' || bucket || ':' || sample || ':' || draw")} % n AS pos FROM h CROSS JOIN (SELECT unnest(range(10000)) AS sample) s, LATERAL (SELECT unnest(range(n)) AS draw) g),
bm AS (SELECT seed, bucket, sample, avg(x) AS m FROM dr JOIN p USING (seed, bucket, n, pos) GROUP BY 1, 2, 3),
ci AS (SELECT seed, bucket, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY 1, 2),
e AS (SELECT seed, bucket, avg(d) AS estimate, count(*) AS eras FROM b GROUP BY 1, 2)""",
    f"SELECT seed, bucket, {ROUNDED}, eras FROM e JOIN ci USING (seed, bucket)"))
def _(t):
    b = summary.quartile_buckets(paired(t), ["seed"], "base")
    got = inference.iid_bootstrap_bucket(b, ["seed", "bucket"], "difference", 10_000, SEED)
    return got.select("seed", "bucket", *r("estimate", "ci_low", "ci_high"), "eras")


THR = "thr AS (SELECT seed, least(0.005e0, 0.25e0*avg(base)) AS threshold FROM diff GROUP BY seed)"


@query("verdict", with_(BOOT + ", " + THR, f"SELECT seed, {ROUNDED}, round(threshold, 8) + 0e0 AS threshold, category, CASE WHEN category = 'hurts' THEN 'no evidence of benefit' ELSE category END AS wording FROM (SELECT *, {VERDICT.format(t='threshold')} AS category FROM bt_ci JOIN thr USING (seed))"))
def _(t):
    thr = inference.threshold_of(paired(t), ["seed"], "base")
    got = inference.with_verdict(boot(t).join(thr, "seed"), F.col("threshold"))
    return got.select("seed", *r("estimate", "ci_low", "ci_high", "threshold"), "category", "wording")


@query("per_seed_comparison", with_(ES + """,
d2 AS (SELECT a.seed, a.era, a.bmc - b.bmc AS d FROM era_scores a JOIN era_scores b ON a.seed = b.seed AND a.era = b.era AND a.arm = 'filtered' AND b.arm = 'plain' WHERE a.bmc IS NOT NULL AND b.bmc IS NOT NULL),
""" + boot_sql("d2", "seed", "d", f"'{SEED}:sample:' || sample || ':' || block", 10_000), f"SELECT seed, {ROUNDED} FROM bt_ci"))
def _(t):
    d = inference.paired_difference(t.era_scores(), "filtered", "plain", ["seed"], "bmc")
    return inference.block_bootstrap_mean(d, ["seed"], "difference", L, 10_000, SEED, shared=True).select("seed", *r("estimate", "ci_low", "ci_high"))


@query("seed_pool", with_(ES, """SELECT arm, era, round(avg(corr) FILTER (WHERE seed IN (0, 1)), 8) + 0e0 AS original, round(avg(corr) FILTER (WHERE seed = 2), 8) + 0e0 AS rerun,
 round(avg(corr), 8) + 0e0 AS pooled, count(corr) AS seeds FROM era_scores WHERE corr IS NOT NULL GROUP BY arm, era HAVING count(*) FILTER (WHERE seed IN (0, 1)) > 0 AND count(*) FILTER (WHERE seed = 2) > 0"""))
def _(t):
    return inference.seed_pool(t.era_scores(), [0, 1], [2], "corr").select("arm", "era", *r("original", "rerun", "pooled"), "seeds")


@query("consistency_compare", with_(SHARED + f", v AS (SELECT *, {VERDICT.format(t='0.005e0')} AS category FROM bt_ci)",
    """SELECT a.pair, round(a.estimate, 8) + 0e0 AS estimate_a, a.category AS category_a, round(b.estimate, 8) + 0e0 AS estimate_b, b.category AS category_b,
 a.category = b.category AS same_category, sign(a.estimate) = sign(b.estimate) AS same_sign FROM (SELECT * FROM v WHERE metric = 'corr') a JOIN (SELECT * FROM v WHERE metric = 'bmc') b USING (pair)"""))
def _(t):
    m = inference.pair_matrix(t.era_scores(), ["arm", "seed"], ["corr", "bmc"], named_pairs(t), 0.005, L, 10_000)
    got = inference.consistency_compare(m.where("metric = 'corr'"), m.where("metric = 'bmc'"), ["pair"])
    return got.select("pair", *r("estimate_a"), "category_a", *r("estimate_b"), "category_b", "same_category", "same_sign")


@query("power_gate", with_(SHARED + f", v AS (SELECT metric, avg(CASE WHEN {VERDICT.format(t='0.005e0')} <> 'no_verdict' THEN 1e0 ELSE 0e0 END) AS p FROM bt_ci GROUP BY metric)",
    "SELECT 'P(any verdict)' AS gate, round(min(p), 8) AS gate_value, count(*) AS scenarios, CASE WHEN min(p) >= 0.6 THEN 'GO' ELSE 'NO-GO' END AS decision FROM v"))
def _(t):
    """A scenario is a metric, and its probability the share of comparisons that reach a verdict."""
    m = inference.pair_matrix(t.era_scores(), ["arm", "seed"], ["corr", "bmc"], named_pairs(t), 0.005, L, 10_000)
    p = inference.verdict_share(m, ["metric"]).withColumn("gate", F.lit("P(any verdict)"))
    return inference.power_gate(p, ["gate"], "any_verdict").select("gate", *r("gate_value"), "scenarios", "decision")


@query("signed_tests", with_(DIFF + """,
tt AS (SELECT seed, avg(d)/(stddev_samp(d)/sqrt(count(*))) AS t_statistic, avg(CASE WHEN d < 0 THEN 1e0 ELSE 0e0 END) AS share_negative, count(*) AS n FROM diff GROUP BY seed),
rk AS (SELECT seed, d, rank() OVER (PARTITION BY seed ORDER BY abs(d)) + (count(*) OVER (PARTITION BY seed, abs(d)) - 1)/2e0 AS rk FROM diff WHERE d <> 0),
w AS (SELECT seed, sum(CASE WHEN d > 0 THEN rk ELSE 0e0 END) AS w_plus, count(*) AS m FROM rk GROUP BY seed)""",
    "SELECT seed, round(t_statistic, 7) + 0e0 AS t_statistic, round(share_negative, 8) AS share_negative, n, w_plus, round((w_plus - m*(m+1)/4e0)/sqrt(m*(m+1)*(2*m+1)/24e0), 8) + 0e0 AS wilcoxon_z FROM tt JOIN w USING (seed)"))
def _(t):
    got = inference.signed_tests(paired(t), ["seed"], "difference", plan=None)
    return got.select("seed", rounded(F.col("t_statistic"), 7).alias("t_statistic"), *r("share_negative"), "n", "w_plus", *r("wilcoxon_z"))


@query("mann_whitney", """WITH e AS (SELECT user_id AS run, event_type, value FROM events WHERE event_type IN ('click', 'view') AND day(ts) >= 5),
rk AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY value) + (count(*) OVER (PARTITION BY run, value) - 1)/2e0 AS rk FROM e)
SELECT run, count(*) FILTER (WHERE event_type='click') AS n1, count(*) FILTER (WHERE event_type='view') AS n2,
 sum(CASE WHEN event_type='click' THEN rk ELSE 0e0 END) - count(*) FILTER (WHERE event_type='click') * (count(*) FILTER (WHERE event_type='click') + 1)/2e0 AS u,
 round(quantile_cont(CASE WHEN event_type='click' THEN value END, 0.5), 8) AS median_first, round(quantile_cont(CASE WHEN event_type='view' THEN value END, 0.5), 8) AS median_second,
 round(quantile_cont(CASE WHEN event_type='click' THEN value END, 0.25), 8) AS q25_first, round(quantile_cont(CASE WHEN event_type='view' THEN value END, 0.25), 8) AS q25_second,
 round(quantile_cont(CASE WHEN event_type='click' THEN value END, 0.75), 8) AS q75_first, round(quantile_cont(CASE WHEN event_type='view' THEN value END, 0.75), 8) AS q75_second
FROM rk GROUP BY run""")
def _(t):
    e = t.table("events").where(F.dayofmonth("ts") >= 5).select(F.col("user_id").alias("run"), "event_type", "value")
    got = inference.mann_whitney(e, ["run"], "event_type", "click", "view", "value")
    return got.select("run", "n1", "n2", "u", *r("median_first", "median_second", "q25_first", "q25_second", "q75_first", "q75_second"))
