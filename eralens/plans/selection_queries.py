"""Selection, promotion and audits over the score cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from eralens.functions.exprs import on_grid, rounded
from eralens.operators import audit, score, selection
from eralens.plans.registry import query, with_
from eralens.plans.score_queries import BLEND, ENSEMBLE_ROUNDED, K, KEYS
from eralens.session import cut_lineage
from eralens.sources.fixtures import CELLS, ERA_SCORES, FILE_ROWS, LOGS, PANEL, PRED, bmc_sql, official_sql, probit_sql, spow

FOLD = "CASE WHEN era <= 25 THEN 'fold_1' WHEN era <= 50 THEN 'fold_2' ELSE 'fold_3' END"
SOURCE_ID = 7


def rr(*cols, digits=8):
    return [rounded(F.col(c), digits).alias(c) for c in cols]


def ranked_sql(keys: str, ids: str, where: str = "true", source: str = "cells", tag: str = "k") -> str:
    """CTE {tag}(keys, ids, mean, worst, cells, place)."""
    order = ", ".join(f"{i} ASC" for i in ids.split(", "))
    both = ", ".join(x for x in (keys, ids) if x)
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""{tag} AS (SELECT *, row_number() OVER ({part}ORDER BY round(mean, 12) DESC, round(worst, 12) DESC, {order}) AS place
 FROM (SELECT {both}, avg(corr_mean) AS mean, min(corr_mean) AS worst, count(*) AS cells FROM {source} WHERE {where} GROUP BY {both}))"""


@query("equal_coverage", with_(CELLS + """,
cv AS (SELECT arm, config_id, updates, count(*) AS n, string_agg(split || seed, ',' ORDER BY split, seed) AS s FROM cells GROUP BY 1, 2, 3),
common AS (SELECT n, s FROM cv GROUP BY 1, 2 ORDER BY count(*) DESC, n DESC LIMIT 1)""",
    """SELECT 'coverage' AS kind, arm || ':' || config_id || ':' || updates AS key, CAST(n AS VARCHAR) AS detail FROM cv WHERE s <> (SELECT s FROM common)
UNION ALL SELECT 'mixed_budgets', 'updates', CAST(count(DISTINCT updates) AS VARCHAR) FROM cells HAVING count(DISTINCT updates) > 1
UNION ALL SELECT 'one_arm_only', config_id || ':' || updates, '' FROM cells GROUP BY config_id, updates HAVING count(DISTINCT arm) < 2"""))
def _(t):
    return selection.equal_coverage(t.cells(), ["arm", "config_id", "updates"], single_budget=True, arms=selection.ARMS)


@query("select_topk", with_(CELLS + ", " + ranked_sql("updates, arm", "config_id"), "SELECT updates, arm, config_id, round(mean, 8) + 0e0 AS mean, round(worst, 8) + 0e0 AS worst, cells, place FROM k WHERE place <= 5"))
def _(t):
    got = selection.select_topk(t.cells(), 5, ("updates", "arm"))
    return got.select("updates", "arm", "config_id", *rr("mean", "worst"), "cells", "place")


@query("paired_union", with_(CELLS + ", " + ranked_sql("updates, arm", "config_id"), "SELECT DISTINCT updates, config_id FROM k WHERE place <= 5"))
def _(t):
    return selection.paired_union(selection.select_topk(t.cells(), 5, ("updates", "arm")), ("updates", "config_id"))


@query("select_budgeted", with_(CELLS + ", " + ranked_sql("arm", "config_id, updates"), "SELECT arm, config_id, updates, round(mean, 8) + 0e0 AS mean, place FROM k WHERE place <= 10"))
def _(t):
    return selection.select_budgeted(t.cells(), 10).select("arm", "config_id", "updates", *rr("mean"), "place")


def listed(t):
    """Configs admitted by a property of their supplier."""
    return t.table("supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").cast("int").alias("config_id"))


LISTED = "listed AS (SELECT CAST(s_suppkey AS INT) AS config_id FROM supplier WHERE s_acctbal > 0)"


@query("restrict_candidates", with_(CELLS + ", " + LISTED, "SELECT arm, config_id, split, updates, seed, round(corr_mean, 8) + 0e0 AS corr_mean FROM cells WHERE config_id IN (SELECT config_id FROM listed)"))
def _(t):
    return selection.restrict_candidates(t.cells(), listed(t)).select("arm", "config_id", "split", "updates", "seed", *rr("corr_mean"))


@query("select_multifidelity", with_(CELLS + ", " + ranked_sql("updates, arm", "config_id"), "SELECT updates, arm, config_id, place FROM k WHERE place <= 4"))
def _(t):
    return selection.select_multifidelity(t.cells(), 4).select("updates", "arm", "config_id", "place")


HALVING = CELLS + ", " + ranked_sql("updates, arm", "config_id", "updates IN (5000, 20000)") + f""",
plan AS (SELECT 'confirmation' AS stage, updates, config_id FROM k WHERE place <= 4 UNION SELECT 'long_scout', 0, config_id FROM k WHERE place <= 2 UNION SELECT 'confirmation', 20000, {SOURCE_ID} UNION SELECT 'long_scout', 0, {SOURCE_ID})"""


def halving(t):
    return selection.successive_halving_plan(t.cells(), 4, 2, SOURCE_ID)


@query("successive_halving_plan", with_(HALVING, "SELECT stage, updates, config_id FROM plan"))
def _(t):
    return halving(t)


@query("select_finalists", with_(CELLS + ", " + LISTED + ", " + ranked_sql("arm", "config_id", "seed = 0 AND updates = 100000 AND split = 'fold_1'", tag="w") + ", "
    + ranked_sql("arm", "config_id", "seed = 0 AND updates = 20000 AND arm = 'filtered' AND config_id IN (SELECT config_id FROM listed)", tag="h"),
    f"""SELECT 'ordinary' AS "group", config_id FROM w WHERE place = 1 UNION SELECT 'ordinary', {SOURCE_ID} UNION SELECT 'high_rank', config_id FROM h WHERE place <= 3"""))
def _(t):
    return selection.select_finalists(t.cells(), 100000, listed(t), 3, SOURCE_ID)


@query("assemble_equal_cells", with_(HALVING + """,
ex AS (SELECT updates, config_id, arm, split, seed FROM plan CROSS JOIN (VALUES ('filtered'), ('plain')) a(arm) CROSS JOIN (VALUES ('fold_1'), ('fold_2')) s(split) CROSS JOIN (VALUES (0), (1), (2)) d(seed) WHERE stage = 'confirmation'),
ac AS (SELECT c.arm, c.config_id, c.updates, c.split, c.seed FROM cells c WHERE EXISTS (SELECT 1 FROM ex WHERE ex.arm = c.arm AND ex.config_id = c.config_id AND ex.updates = c.updates))""",
    "SELECT arm, config_id, updates, split, seed, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'extra' ELSE 'present' END AS status FROM (SELECT *, 1 AS e FROM ex) FULL JOIN (SELECT *, 1 AS a FROM ac) USING (arm, config_id, updates, split, seed)"))
def _(t):
    expected = selection.expected_cells(halving(t), ["fold_1", "fold_2"], [0, 1, 2])
    return selection.assemble_equal_cells(t.cells(), expected)


@query("collect_stage_audit", with_(CELLS + ", " + LISTED + """,
g AS (SELECT arm, config_id, count(*) AS n FROM cells WHERE split = 'fold_1' AND updates = 100000 AND seed = 0 GROUP BY 1, 2), w AS (SELECT arm, config_id FROM listed CROSS JOIN (VALUES ('filtered'), ('plain')) a(arm))""",
    """SELECT 'missing' AS kind, arm || ':' || config_id AS key, '' AS detail FROM w WHERE (arm, config_id) NOT IN (SELECT (arm, config_id) FROM g)
UNION ALL SELECT 'unexpected', arm || ':' || config_id, '' FROM g WHERE (arm, config_id) NOT IN (SELECT (arm, config_id) FROM w) UNION ALL SELECT 'duplicate', arm || ':' || config_id, CAST(n AS VARCHAR) FROM g WHERE n > 1"""))
def _(t):
    stage = t.cells().where("split = 'fold_1' AND updates = 100000 AND seed = 0")
    return selection.collect_stage_audit(stage, listed(t))


@query("budget_sensitivity", with_(CELLS, "SELECT arm, config_id, updates, round(avg(corr_mean), 8) + 0e0 AS mean, round(coalesce(stddev_samp(corr_mean), 0), 8) AS std, round(min(corr_mean), 8) + 0e0 AS worst, count(*) AS cells FROM cells GROUP BY 1, 2, 3"))
def _(t):
    return selection.budget_sensitivity(t.cells()).select("arm", "config_id", "updates", *rr("mean", "std", "worst"), "cells")


@query("select_stopping_point", with_(CELLS + """,
m AS (SELECT arm, config_id, updates, avg(corr_mean) AS mean FROM cells GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY arm, config_id ORDER BY round(mean, 12) DESC, updates) AS p FROM m)""",
    "SELECT arm, config_id, updates AS examples, round(mean, 8) + 0e0 AS mean, CAST(floor(updates/8e0) AS BIGINT) AS updates, CAST(round_even(floor(updates/8e0)*(76e0/60e0), 0) AS BIGINT) AS refit_updates FROM k WHERE p = 1"))
def _(t):
    return selection.select_stopping_point(t.cells(), 8, 60, 76, ("arm", "config_id")).select("arm", "config_id", "examples", *rr("mean"), "updates", "refit_updates")


@query("split_mean_worst", with_(ERA_SCORES + f", m AS (SELECT arm, seed, {FOLD} AS split, avg(corr) AS m FROM era_scores GROUP BY 1, 2, 3)",
    "SELECT arm, seed, round(avg(m), 8) + 0e0 AS mean_of_splits, round(min(m), 8) + 0e0 AS worst_split, arg_min(split, m) AS worst_name, count(*) AS splits FROM m GROUP BY 1, 2"))
def _(t):
    d = t.era_scores().withColumn("split", F.expr(FOLD))
    return selection.split_mean_worst(d, ["arm", "seed"]).select("arm", "seed", *rr("mean_of_splits", "worst_split"), "worst_name", "splits")


@query("select_blend", with_(ENSEMBLE_ROUNDED + BLEND + ", ensc AS (SELECT * FROM ensr WHERE benchmark IS NOT NULL), predc AS (SELECT * FROM pred WHERE benchmark IS NOT NULL),"
    + official_sql("blend", "arm, weight, era", "blend", tag="bc") + "," + bmc_sql("blend", "arm, weight, era", "blend", tag="bb") + ","
    + official_sql("ensc", "arm, era", tag="ec") + "," + official_sql("predc", "arm, seed, era", tag="sc") + f""",
bs AS (SELECT arm, weight, era, {FOLD} AS split, corr, bmc FROM bc_corr JOIN bb_bmc USING (arm, weight, era)),
ok AS (SELECT arm, min(m) > 0 AS stable FROM (SELECT arm, avg(corr) AS m FROM ec_corr GROUP BY arm, {FOLD} UNION ALL SELECT arm, avg(corr) FROM sc_corr GROUP BY arm, seed, {FOLD}) GROUP BY arm),
sp AS (SELECT arm, weight, min(m) AS worst_split FROM (SELECT arm, weight, split, avg(corr) AS m FROM bs GROUP BY 1, 2, 3) GROUP BY 1, 2),
cd AS (SELECT arm, weight, avg(corr) AS corr, avg(bmc) AS bmc FROM bs GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (ORDER BY stable DESC, round(corr, 10) DESC, round(worst_split, 10) DESC, round(bmc, 10) DESC, weight DESC, CASE WHEN arm = 'filtered' THEN 0 ELSE 1 END) AS place FROM cd JOIN sp USING (arm, weight) JOIN ok USING (arm))""",
    "SELECT arm, weight, round(corr, 8) + 0e0 AS corr, round(worst_split, 8) + 0e0 AS worst_split, round(bmc, 8) + 0e0 AS bmc, stable, place, place = 1 AND stable AS selected FROM rk"))
def _(t):
    pred, fold = t.pred().where(F.col("benchmark").isNotNull()), F.expr(FOLD)
    ens = score.seed_ensemble(t.pred(), plan=t.plan()).withColumn("prediction", on_grid(F.col("prediction"), 10)).where(F.col("benchmark").isNotNull())
    ens = cut_lineage(ens, "ensemble", FILE_ROWS)      # blended and scored
    blend = score.benchmark_blend(ens, keys=["arm", "era"], plan=t.plan()).select("arm", "weight", "era", "target", "benchmark", "blend")
    bs = score.blend_scores(blend, t.plan(10), ["arm", "era"]).withColumn("split", fold)
    es = score.corr_official(ens, ["arm", "era"], plan=t.plan()).withColumn("split", fold)
    ss = score.corr_official(pred, KEYS, plan=t.plan()).withColumn("split", fold)
    got = selection.select_blend(bs, es, ss)
    return got.select("arm", "weight", *rr("corr", "worst_split", "bmc"), "stable", "place", "selected")


@query("select_feasible_source", with_(CELLS + ", " + LISTED + ", " + ranked_sql("arm", "config_id", "arm = 'filtered' AND config_id IN (SELECT config_id FROM listed)"), "SELECT arm, config_id, round(mean, 8) + 0e0 AS mean, round(worst, 8) + 0e0 AS worst, cells FROM k WHERE place = 1"))
def _(t):
    feasible = t.table("supplier").select(F.col("s_suppkey").cast("int").alias("config_id"), (F.col("s_acctbal") > 0).alias("feasible"))
    return selection.select_feasible_source(t.cells(), feasible).select("arm", "config_id", *rr("mean", "worst"), "cells")


@query("rank_sweep_winner", with_(CELLS + """, m AS (SELECT arm, split, config_id AS rank, avg(corr_mean) AS mean, stddev_samp(corr_mean) AS std, count(*) AS replicas FROM cells GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY arm, split ORDER BY round(mean, 12) DESC, rank) AS p FROM m)""", "SELECT arm, split, rank, round(mean, 8) + 0e0 AS mean, round(std, 8) AS std, replicas FROM k WHERE p = 1"))
def _(t):
    d = t.cells().withColumnRenamed("config_id", "rank")
    return selection.rank_sweep_winner(d, "rank", "corr_mean", ["arm", "split"]).select("arm", "split", "rank", *rr("mean", "std"), "replicas")


WINNERS = CELLS + ", " + ranked_sql("split, arm", "config_id, updates", tag="fw")
FIXED = ranked_sql("arm", "config_id, updates", tag="fx")


@query("winner_union_across_folds", with_(WINNERS, "SELECT config_id, updates, count(*) AS wins, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms FROM fw WHERE place = 1 AND worst > 0 GROUP BY 1, 2"))
def _(t):
    # the audit of a fold confirms candidates none of whose cells there is negative
    audits = t.cells().groupBy("split", "arm", "config_id", "updates").agg(F.min("corr_mean").alias("worst")).where("worst > 0")
    return selection.winner_union_across_folds(selection.fold_winners(t.cells()), audits)


@query("fixed_config_confirmation", with_(WINNERS + ", " + FIXED, "SELECT 'reselected' AS kind, split || ':' || arm AS key, config_id || ':' || updates AS detail FROM fw WHERE place = 1 AND (arm, config_id, updates) NOT IN (SELECT (arm, config_id, updates) FROM fx WHERE place = 1)"))
def _(t):
    fixed = selection.select_budgeted(t.cells(), 1)
    return selection.fixed_config_confirmation(selection.fold_winners(t.cells()), fixed)


@query("leaderboard_summary", """WITH rw AS (SELECT c_nationkey AS rank, c_acctbal/10000e0 AS corr, CASE WHEN c_acctbal > 0 THEN sqrt(c_acctbal) END AS mmc FROM customer),
l AS (SELECT rank, 'corr' AS metric, corr AS value FROM rw UNION ALL SELECT rank, 'mmc', mmc FROM rw)
SELECT metric, round(max(value), 8) AS maximum, count(value) AS finite_rows, count(*) - count(value) AS missing_rows, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.9), 8) AS p90,
 round(avg(value) FILTER (WHERE rank = (SELECT min(rank) FROM rw)), 8) AS top_rank_mean, count(value) FILTER (WHERE rank = (SELECT min(rank) FROM rw)) AS top_rank_values FROM l GROUP BY metric""")
def _(t):
    c = t.table("customer")
    rows = c.select(F.col("c_nationkey").alias("rank"), (F.col("c_acctbal") / 10000.0).alias("corr"), F.when(F.col("c_acctbal") > 0, F.sqrt("c_acctbal")).alias("mmc"))
    got = selection.leaderboard_summary(rows, ["corr", "mmc"])
    return got.select("metric", *rr("maximum"), "finite_rows", "missing_rows", *rr("median", "p90", "top_rank_mean"), "top_rank_values")


@query("grid_axis_slices", """WITH tr AS (SELECT l_linenumber AS lr, CAST(round(l_tax*100) AS INT) AS wd, CAST(round(l_discount*100) AS INT) AS dr, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)/CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT lr AS blr, wd AS bwd, dr AS bdr FROM tr ORDER BY round(v, 12) DESC, lr, wd, dr LIMIT 1),
s AS (SELECT 'lr' AS axis, CAST(lr AS DOUBLE) AS x, v, CAST(blr AS DOUBLE) AS best FROM tr, b WHERE wd = bwd AND dr = bdr UNION ALL SELECT 'wd', wd, v, bwd FROM tr, b WHERE lr = blr AND dr = bdr UNION ALL SELECT 'dropout', dr, v, bdr FROM tr, b WHERE lr = blr AND wd = bwd),
d AS (SELECT *, CAST(sign(v - lag(v) OVER (PARTITION BY axis ORDER BY x)) AS DOUBLE) AS step FROM s), e AS (SELECT *, CASE WHEN step <> lag(step) OVER (PARTITION BY axis ORDER BY x) THEN 1 ELSE 0 END AS turn FROM d),
g AS (SELECT axis, any_value(best) AS best_value, min(x) AS lo, max(x) AS hi, count(*) AS points, max_by(step, x) AS last_step, min_by(step, x) FILTER (WHERE step IS NOT NULL) AS first_step, sum(turn) AS turns FROM e GROUP BY axis)
SELECT axis, best_value, points, best_value = lo OR best_value = hi AS on_boundary, CASE WHEN best_value = hi THEN last_step > 0 WHEN best_value = lo THEN first_step < 0 END AS still_improving,
 CASE WHEN turns = 0 THEN 'monotone' WHEN turns = 1 AND first_step > 0 THEN 'interior_peak' ELSE 'irregular' END AS shape FROM g""")
def _(t):
    trials = t.table("lineitem").groupBy(
        F.col("l_linenumber").alias("lr"), F.rint(F.col("l_tax") * 100).cast("int").alias("wd"), F.rint(F.col("l_discount") * 100).cast("int").alias("dropout"),
    ).agg((F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1))).alias("v"))
    return selection.grid_axis_slices(trials, ["lr", "wd", "dropout"], "v")


@query("grid_axis_shapes", """WITH tr AS (SELECT l_linenumber AS lr, CAST(round(l_tax*100) AS INT) AS wd, CAST(round(l_discount*100) AS INT) AS dropout, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)/CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT wd, dropout, list(v ORDER BY lr) AS p FROM tr GROUP BY 1, 2), d AS (SELECT *, [p[i + 1] - p[i] for i in range(1, len(p))] AS d FROM s)
SELECT wd, dropout, CAST(len(p) AS INT) AS points, CASE WHEN len([x for x in d if x > 0]) = 0 THEN 'falling' WHEN len([x for x in d if x < 0]) = 0 THEN 'rising' WHEN d[1] > 0 AND d[-1] < 0 THEN 'interior_peak' ELSE 'irregular' END AS shape FROM d""")
def _(t):
    trials = t.table("lineitem").groupBy(
        F.col("l_linenumber").alias("lr"), F.rint(F.col("l_tax") * 100).cast("int").alias("wd"), F.rint(F.col("l_discount") * 100).cast("int").alias("dropout"),
    ).agg((F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1))).alias("v"))
    return selection.grid_axis_shapes(trials, "lr", ["wd", "dropout"], "v")


# ---- audits ---------------------------------------------------------------------------

@query("metric_reproduction", with_(ERA_SCORES + """, c AS (SELECT corr, bmc, round(corr, 7) AS rc, bmc AS rb FROM era_scores)""",
    """SELECT 'corr' AS metric, count(*) AS compared, 0 AS unmatched, count(*) FILTER (WHERE NOT (abs(corr - rc) <= 1e-9 + 1e-6*abs(rc))) AS outside FROM c
UNION ALL SELECT 'bmc', count(*), 0, count(*) FILTER (WHERE NOT (abs(bmc - rb) <= 1e-9 + 1e-6*abs(rb))) FROM c"""))
def _(t):
    fresh = score.bmc_covered_only(t.pred(), KEYS, plan=t.plan())
    recorded = t.era_scores().withColumn("corr", on_grid(F.col("corr"), 7))
    return audit.metric_reproduction(fresh, recorded, KEYS, ["corr", "bmc"]).select("metric", "compared", "unmatched", "outside")


@query("prediction_sanity", with_(PRED, "SELECT arm, seed, count(*) AS rows, count(DISTINCT id) AS unique_rows, 0 AS not_finite, count(*) = (SELECT count(*) FROM panel WHERE target IS NOT NULL AND era IN (SELECT era FROM scored)) AS ok FROM pred GROUP BY 1, 2"))
def _(t):
    p = t.pred()
    rows = t.eras().join(t.scored_eras(), "era", "left_semi").agg(F.count(F.lit(1)).alias("recorded_rows"))
    models = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed")) for a in ("filtered", "plain") for s in (0, 1, 2)]))
    recorded = rows.select("recorded_rows", models.alias("m")).select("m.*", "recorded_rows")
    return audit.prediction_sanity(p, recorded, ["arm", "seed"])


@query("cell_manifest_audit", with_(WINNERS + """,
w AS (SELECT arm, config_id, split, updates FROM fw WHERE place = 1), mf AS (SELECT c.config_id || ':' || c.seed AS job, c.arm, c.config_id, c.split, c.updates, c.seed FROM cells c JOIN (SELECT DISTINCT arm, config_id, updates FROM w) w ON c.config_id = w.config_id AND c.arm = w.arm AND c.updates = w.updates),
ex AS (SELECT arm, config_id, split, updates, seed FROM w CROSS JOIN (VALUES (0), (1), (2)) s(seed)), ms AS (SELECT DISTINCT arm, config_id, split, updates, seed FROM mf)""",
    """SELECT 'missing_cell' AS kind, arm || ':' || config_id || ':' || split || ':' || updates || ':' || seed AS key, '' AS detail FROM (FROM ex EXCEPT FROM ms)
UNION ALL SELECT 'extra_cell', arm || ':' || config_id || ':' || split || ':' || updates || ':' || seed, '' FROM (FROM ms EXCEPT FROM ex) UNION ALL SELECT 'job_repeated', job, CAST(count(*) AS VARCHAR) FROM mf GROUP BY job HAVING count(*) > 1""".replace("AS job, c.arm", "AS job, c.arm")))
def _(t):
    w = selection.fold_winners(t.cells()).select("arm", "config_id", "split", "updates")
    manifest = t.cells().join(w.select("arm", "config_id", "updates").distinct(), ["arm", "config_id", "updates"])
    manifest = manifest.withColumn("job", F.concat_ws(":", F.col("config_id").cast("string"), F.col("seed").cast("string")))
    return audit.cell_manifest_audit(manifest, w, [0, 1, 2])


@query("ordered_id_digest", """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
b AS (SELECT pos // 1024 AS b, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY pos)) AS h FROM p GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS rows, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM b""")
def _(t):
    o = t.table("orders").select("o_orderdate", F.col("o_orderkey").alias("id"))
    return audit.ordered_id_digest(o, ["o_orderdate", "id"])


@query("table_fingerprint")
def _(t):
    return audit.table_fingerprint(t.table("lineitem"))


@query("identity_digest", """SELECT s_suppkey, sha256('{"name":"' || s_name || '","nation":' || s_nationkey || '}') AS digest FROM supplier""")
def _(t):
    s = t.table("supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return audit.identity_digest(s, ["nation", "name"]).select("s_suppkey", "digest")


@query("capped_sample_audit", with_(PANEL + ", s AS (SELECT era, row_number() OVER (PARTITION BY era ORDER BY md5('3:' || id), id) AS k FROM panel)",
    "SELECT era, count(*) FILTER (WHERE k <= 80) AS sample_rows, count(*) AS source_rows, true AS ok FROM s GROUP BY era"))
def _(t):
    from eralens.operators.panel import cap_rows_per_era

    e = t.eras()
    return audit.capped_sample_audit(cap_rows_per_era(e, 80, 3), e, 80)


def _sample_sql(seed, tag):
    return f"""{tag}s AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY era ORDER BY md5('{seed}:' || id), id) AS k FROM one) WHERE k <= 60),
{official_sql(tag + 's', 'era', 'latent', tag=tag)}"""


@query("independent_resample", with_(PANEL + ", one AS (SELECT * FROM panel WHERE target IS NOT NULL AND era IN (SELECT era FROM panel WHERE target IS NOT NULL GROUP BY era HAVING count(*) >= 5)), " + _sample_sql(1, "ra") + ", " + _sample_sql(2, "rb"),
    "SELECT era, round(a.corr, 8) + 0e0 AS score_a, round(b.corr, 8) + 0e0 AS score_b FROM ra_corr a FULL JOIN rb_corr b USING (era)"))
def _(t):
    p = t.panel().where(F.col("target").isNotNull()).join(t.scored_eras(), "era", "left_semi").select("id", "era", "target", "latent")
    got = audit.independent_resample(p, 60, (1, 2), lambda d: score.corr_official(d, ["era"], "latent", plan=t.plan(), out="score"))
    return got.select("era", *rr("score_a", "score_b"))


@query("curve_protocol_audit", """WITH c AS (SELECT user_id AS run, CAST(day(ts) AS INT) AS step, avg(value) AS v, count(*) AS realized FROM events GROUP BY 1, 2),
g AS (SELECT run, step FROM (SELECT DISTINCT run FROM c) CROSS JOIN (SELECT unnest(range(1, 30, 2)) AS step) s)
SELECT 'missing_step' AS kind, CAST(run AS VARCHAR) AS key, CAST(step AS VARCHAR) AS detail FROM g WHERE (run, step) NOT IN (SELECT (run, step) FROM c)
UNION ALL SELECT 'off_grid', CAST(run AS VARCHAR), CAST(step AS VARCHAR) FROM c WHERE step % 2 = 0 UNION ALL SELECT 'rank', CAST(run AS VARCHAR), CAST(step AS VARCHAR) FROM c WHERE realized <> least(2, step - 1)*1 + least(1, step - 1)*2""")
def _(t):
    c = t.table("events").groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("step")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("realized"))
    return audit.curve_protocol_audit(c, ["run"], "step", ["v"], 1, 29, 2, total_rank=4, blocks=3, realized="realized")


@query("one_touch_audit", "SELECT 'touched' AS kind, user_id || ':' || event_type AS key, CAST(count(*) AS VARCHAR) AS detail FROM events GROUP BY user_id, event_type HAVING count(*) <> 1")
def _(t):
    from eralens.session import scratch
    from eralens.sources.tables import read_ledger

    path = scratch(t.spark, "ledger")
    sig = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    t.table("events").select(sig.alias("model_signature"), F.col("event_id").alias("evaluation")).write.json(path)
    return audit.one_touch_audit(read_ledger(t.spark, path, "model_signature string, evaluation bigint"), "model_signature")


@query("live_round_checks", with_(PANEL + ", lv AS (SELECT id, target FROM panel WHERE era BETWEEN 74 AND 80), bn AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 20000 THEN o_totalprice END AS benchmark FROM orders WHERE o_orderstatus <> 'P')",
    """SELECT 'no_benchmark' AS kind, CAST(id AS VARCHAR) AS key, '' AS detail FROM lv WHERE id NOT IN (SELECT id FROM bn) UNION ALL SELECT 'not_live', CAST(id AS VARCHAR), '' FROM bn WHERE id NOT IN (SELECT id FROM lv)
UNION ALL SELECT 'revealed_target', CAST(id AS VARCHAR), '' FROM lv WHERE target IS NOT NULL UNION ALL SELECT 'benchmark_missing', CAST(id AS VARCHAR), '' FROM bn WHERE benchmark IS NULL"""))
def _(t):
    live = t.panel().where(F.col("era").between(74, 80)).select("id", "target")
    bench = t.table("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice")).alias("benchmark"))
    return audit.live_round_checks(live, bench)


@query("prediction_range_check", """WITH p AS (SELECT l_orderkey AS id, l_discount * 10e0 AS prediction FROM lineitem), n AS (SELECT id, count(*) AS n FROM p GROUP BY 1)
SELECT 'range' AS kind, CAST(id AS VARCHAR) AS key, '' AS detail FROM p WHERE NOT (prediction > 0 AND prediction < 1) UNION ALL SELECT 'duplicate', CAST(id AS VARCHAR), CAST(n AS VARCHAR) FROM n WHERE n > 1
UNION ALL SELECT 'missing', CAST(o_orderkey AS VARCHAR), '' FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n) UNION ALL SELECT 'unknown', CAST(id AS VARCHAR), '' FROM n WHERE id NOT IN (SELECT o_orderkey FROM orders)""")
def _(t):
    p = t.table("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_discount") * 10.0).alias("prediction"))
    return audit.prediction_range_check(p, t.table("orders").select(F.col("o_orderkey").alias("id")))


@query("prediction_diff", with_(PRED + """, a AS (SELECT seed, id, prediction AS x FROM pred WHERE arm = 'filtered'), b AS (SELECT seed, id, prediction AS y FROM pred WHERE arm = 'plain')""",
    "SELECT seed, count(*) AS rows, count(*) - count(x + y) AS unmatched, round(max(abs(x - y)), 8) AS max_abs, round(avg(abs(x - y)), 8) AS mean_abs, round(corr(x, y), 8) AS pearson, false AS passed FROM a FULL JOIN b USING (seed, id) GROUP BY seed"))
def _(t):
    p = t.pred()
    got = audit.prediction_diff(p.where("arm = 'filtered'"), p.where("arm = 'plain'"), keys=["seed"])
    return got.select("seed", "rows", "unmatched", *rr("max_abs", "mean_abs", "pearson"), "passed")
