"""Sources, panel preparation, splits and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from eralens.functions.exprs import rounded
from eralens.operators import align, panel, splits
from eralens.plans.registry import query, with_
from eralens.session import scratch
from eralens.sources import arrays, tables
from eralens.sources.fixtures import BUDGETS, CELLS, FEATURES, PANEL, PRED, H, probit_sql

# The protocol's blocks scaled to the 80 months of the given tables.
OUTER = ((44, 54), (55, 65), (66, 76))
INNER = ((22, 32), (33, 43), (44, 54), (55, 65))
PURGE, MIN_INNER = 4, 7


def rr(*cols):
    return [rounded(F.col(c)).alias(c) for c in cols]


# ---- sources and sinks ----------------------------------------------------------------

STORE_COLUMNS = ["id", "era", "data_type", "target", "benchmark"]


@query("scan_panel", with_(PANEL, "SELECT id, era, target FROM panel WHERE era BETWEEN 30 AND 40"))
def _(t):
    path = scratch(t.spark, "panel")
    tables.write_panel(t.panel().select(*STORE_COLUMNS), path)
    return tables.scan_panel(t.spark, path, ["id", "era", "target"], first=30, last=40)


@query("write_panel", with_(PANEL, "SELECT era, count(*) AS n, count(target) AS resolved FROM panel GROUP BY era"))
def _(t):
    path = scratch(t.spark, "panel")
    tables.write_panel(t.panel().select(*STORE_COLUMNS), path)
    return t.spark.read.parquet(path).groupBy("era").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("resolved"))


@query("read_results", with_(CELLS, "SELECT arm, config_id, split, updates, seed, round(corr_mean, 10) + 0e0 AS corr_mean FROM cells WHERE split = 'fold_1' AND updates = 5000 AND seed = 1"))
def _(t):
    path = scratch(t.spark, "results")
    task = F.concat(F.lit("stage-"), "split", F.lit("-u"), F.col("updates").cast("string"), F.lit("-s"), F.col("seed").cast("string"), F.lit("-"), "arm")
    t.cells().select(task.alias("task"), "config_id", "corr_mean", "runs").write.partitionBy("task").json(path)
    got = tables.read_results(t.spark, path, "config_id int, corr_mean double, runs bigint", "fold_1", 5000, 1)
    return got.select("arm", "config_id", "split", "updates", "seed", rounded(F.col("corr_mean"), 10).alias("corr_mean"))


@query("read_manifest_tsv", with_(CELLS, "SELECT config_id || '_' || arm || '_' || split || '_' || updates || '_' || seed AS job, split, updates, seed, arm, config_id FROM cells"))
def _(t):
    path = scratch(t.spark, "manifest")
    job = F.concat_ws("_", *[F.col(c).cast("string") for c in ("config_id", "arm", "split", "updates", "seed")])
    t.cells().select(F.concat(job, F.lit(";node")).alias("job"), "split", "updates", "seed", "arm", "config_id").write.option("sep", "\t").csv(path)
    return tables.read_manifest_tsv(t.spark, path)


@query("read_scores_union", with_(CELLS, "SELECT arm, config_id, split, updates, seed, round(corr_mean, 10) + 0e0 AS corr_mean, runs FROM cells"))
def _(t):
    paths = [scratch(t.spark, "scores") for _ in BUDGETS]
    for path, budget in zip(paths, BUDGETS):
        t.cells().where(F.col("updates") == budget).write.option("header", "true").csv(path)
    got = tables.read_scores_union(t.spark, paths)
    return got.select("arm", "config_id", "split", "updates", "seed", rounded(F.col("corr_mean"), 10).alias("corr_mean"), "runs")


@query("read_arrays", with_(PRED, """SELECT panel.data_type, pred.arm, pred.seed, count(*) AS n, round(avg(pred.prediction), 8) AS mean, round(avg(pred.prediction * panel.target), 8) AS cross_mean
FROM pred JOIN panel USING (id) GROUP BY 1, 2, 3"""))
def _(t):
    """Predictions stored as archives of arrays, read by ranges of rows and joined with the panel."""
    path = scratch(t.spark, "arrays")
    stored = t.pred().select("id", (F.col("arm") == "filtered").alias("filtered"), "seed", "prediction")
    arrays.write_arrays(stored, path).write.format("noop").mode("overwrite").save()
    got = arrays.read_arrays(t.spark, path, ["id", "filtered", "seed", "prediction"], rangeBytes=1 << 20)
    d = got.join(t.panel().select("id", "data_type", "target"), "id")
    arm = F.when(F.col("filtered"), "filtered").otherwise("plain").alias("arm")
    return d.groupBy("data_type", arm, "seed").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean"), F.avg(F.col("prediction") * F.col("target")).alias("cross_mean")).select(
        "data_type", "arm", "seed", "n", *rr("mean", "cross_mean"))


@query("explode_curves", """WITH k AS (SELECT user_id AS run, CAST(day(ts) AS INT) AS step,
 CASE WHEN event_type IN ('click','view') THEN 'valid' WHEN event_type = 'purchase' THEN 'train' ELSE 'test' END AS split, value FROM events)
SELECT run, step, split, round(avg(value), 8) AS mse, count(*) AS n_rows FROM k GROUP BY 1, 2, 3""")
def _(t):
    # a checkpoint document holds one struct per split, at most three
    kinds = {"valid": ("click", "view"), "train": ("purchase",), "test": ("signup", "error")}
    aggs = []
    for k, v in kinds.items():
        own = F.when(F.col("event_type").isin(*v), F.col("value"))
        aggs.append(F.struct(F.lit(k).alias("split"), F.avg(own).alias("mse"), F.count(own).alias("n_rows")).alias(k))
    docs = t.table("events").groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("step")).agg(*aggs)
    docs = docs.select("run", "step", F.filter(F.array(*kinds), lambda x: x["n_rows"] > 0).alias("curve"))
    path = scratch(t.spark, "curves")
    docs.write.json(path)
    read = t.spark.read.schema("run bigint, step int, curve array<struct<split: string, mse: double, n_rows: bigint>>").json(path)
    return tables.explode_curves(read, ["run", "step"]).select("run", "step", "split", *rr("mse"), "n_rows")


# ---- panel preparation ----------------------------------------------------------------

@query("encode_bins", """WITH x AS (SELECT l_discount * 10e0 AS unit, l_quantity - 1e0 AS codes FROM lineitem),
e AS (SELECT unit, codes, round_even(unit*4e0, 0) AS cu, round_even(codes, 0) AS cc FROM x)
SELECT CASE WHEN cu BETWEEN 0 AND 4 AND abs(unit - cu/4e0) <= 1e-6 THEN CAST(cu AS INT) END AS unit_code,
 CASE WHEN cc BETWEEN 0 AND 4 AND abs(codes - cc) <= 1e-6 THEN CAST(cc AS INT) END AS int_code, count(*) AS n FROM e GROUP BY 1, 2""")
def _(t):
    li = t.table("lineitem")
    d = li.select(panel.encode_bins(F.col("l_discount") * 10.0, "unit").cast("int").alias("unit_code"),
                  panel.encode_bins(F.col("l_quantity") - 1.0, "codes").cast("int").alias("int_code"))
    return d.groupBy("unit_code", "int_code").agg(F.count(F.lit(1)).alias("n"))


@query("encode_files", """SELECT l_returnflag AS flag, least(4, CAST(floor(l_quantity / 10.5e0) AS INT)) AS code, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(t):
    """One folder of files with two scales: quarters in some, codes in others, found by file."""
    path = scratch(t.spark, "scales")
    code = F.least(F.lit(4), F.floor(F.col("l_quantity") / 10.5).cast("int"))
    value = F.when(F.col("l_returnflag") == "A", code / F.lit(4.0)).otherwise(code.cast("double"))
    t.table("lineitem").select(F.col("l_returnflag").alias("flag"), value.alias("x")).write.partitionBy("flag").parquet(path)
    got = panel.encode_files(t.spark.read.parquet(path), ["x"])
    return got.groupBy("flag", F.col("x").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("normalise_live_features", with_(PANEL, """, f AS (SELECT id, features, CASE WHEN max(list_max(features)) OVER (PARTITION BY era) > 1 THEN 4e0 ELSE 1e0 END AS scale FROM panel)
SELECT id, round(list_sum([x/scale for x in features]), 8) AS total, features[1]/scale AS first, true AS valid FROM f"""))
def _(t):
    d = panel.normalise_live_features(t.panel().select("id", "era", "features"), by=["era"])
    total = F.aggregate("normalised", F.lit(0.0), lambda a, x: a + x)
    return d.select("id", rounded(total).alias("total"), F.col("normalised")[0].alias("first"), "valid")


@query("scale_features", with_(PANEL, "SELECT id, round(list_sum([x/4e0 for x in features]), 8) AS unit, round(list_sum([(x-2)/2e0 for x in features]), 8) + 0e0 AS centred FROM panel"))
def _(t):
    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    return t.panel().select("id", rounded(total(panel.scale_features())).alias("unit"), rounded(total(panel.scale_features(centred=True))).alias("centred"))


@query("center_target", with_(PANEL, "SELECT id, target - 0.5e0 AS centred, round(sign(target-0.5e0)*pow(abs(target-0.5e0), 1.5e0), 8) + 0e0 AS powered FROM panel"))
def _(t):
    return t.panel().select("id", panel.center_target().alias("centred"), rounded(panel.center_target(power=1.5)).alias("powered"))


@query("filter_data_type", with_(PANEL, "SELECT id, era FROM panel WHERE data_type = 'validation'"))
def _(t):
    return panel.filter_data_type(t.panel()).select("id", "era")


@query("usable_eras", with_(PANEL, "SELECT era, round(avg(CASE WHEN benchmark > 0 THEN 1e0 ELSE 0e0 END), 8) AS coverage, count(*) AS n FROM panel GROUP BY era HAVING avg(CASE WHEN benchmark > 0 THEN 1e0 ELSE 0e0 END) >= 0.9"))
def _(t):
    p = t.panel().withColumn("covered", F.when(F.col("benchmark") > 0, F.col("benchmark")))
    return panel.usable_eras(p, 0.9, "covered").select("era", *rr("coverage"), "n")


@query("drop_unresolved", with_(PANEL, "SELECT id, era, target FROM panel WHERE target IS NOT NULL"))
def _(t):
    return panel.drop_unresolved(t.panel()).select("id", "era", "target")


@query("cap_rows_per_era", with_(PANEL, "SELECT id, era FROM (SELECT id, era, row_number() OVER (PARTITION BY era ORDER BY md5('0:' || id), id) AS k FROM panel) WHERE k <= 50"))
def _(t):
    return panel.cap_rows_per_era(t.panel().select("id", "era"), 50, 0)


@query("min_era_rows", with_(PANEL, "SELECT id, era FROM panel WHERE era IN (SELECT era FROM panel GROUP BY era HAVING count(*) >= 100)"))
def _(t):
    return panel.min_era_rows(t.eras(), 100).select("id", "era")


@query("last_n_eras", with_(PANEL, "SELECT DISTINCT era FROM panel WHERE data_type = 'train' ORDER BY era DESC LIMIT 15"))
def _(t):
    return panel.last_n_eras(t.panel().where(F.col("data_type") == "train"), 15)


@query("select_feature_subset", with_(PANEL, "SELECT id, features[6] AS f0, features[1] AS f1, features[3] AS f2, len([features[6], features[1], features[3]]) AS width FROM panel"))
def _(t):
    d = panel.select_feature_subset(t.panel().select("id", "features"), FEATURES, ("balance", "price", "discount"))
    return d.select("id", *[F.col("features")[i].alias(f"f{i}") for i in range(3)], F.size("features").cast("bigint").alias("width"))


@query("rows_for_eras", with_(PANEL, "SELECT id, era FROM panel WHERE era IN (SELECT DISTINCT era FROM panel ORDER BY era LIMIT 20)"))
def _(t):
    first = t.eras().select("era").distinct().orderBy("era").limit(20)
    return panel.rows_for_eras(t.eras(), first).select("id", "era")


@query("permute_column", with_(PANEL, """SELECT a.id, b.target AS target_permuted FROM (SELECT id, row_number() OVER (ORDER BY id) AS k FROM panel) a
 JOIN (SELECT target, row_number() OVER (ORDER BY md5('7:' || id), id) AS k FROM panel) b USING (k)"""))
def _(t):
    d = panel.permute_column(t.panel().select("id", "target"), "target", 7)
    return d.select("id", "target_permuted")


@query("zero_predictor", with_(PANEL + f", u AS (SELECT id, {H(chr(39) + 'zero:5:' + chr(39) + ' || id')} * (1e0 - 2.3283064365386963e-10) + 1.1641532182693481e-10 AS p FROM panel)",
    f"SELECT id, round({probit_sql('p')}, 7) + 0e0 AS zero_prediction FROM u"))
def _(t):
    return panel.zero_predictor(t.eras(), 5).select("id", rounded(F.col("zero_prediction"), 7).alias("zero_prediction"))


@query("synthetic_quintiles", """WITH c AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.25) AS b, quantile_cont(o_totalprice, 0.75) AS c, quantile_cont(o_totalprice, 0.95) AS d FROM orders)
SELECT o_orderkey, (CAST(o_totalprice > a AS INT) + CAST(o_totalprice > b AS INT) + CAST(o_totalprice > c AS INT) + CAST(o_totalprice > d AS INT))/4e0 - 0.5e0 AS quintile FROM orders CROSS JOIN c""")
def _(t):
    return panel.synthetic_quintiles(t.table("orders"), "o_totalprice").select("o_orderkey", "quintile")


@query("panel_manifest", with_(PANEL, """SELECT count(*) AS rows, count(DISTINCT era) AS eras, min(era) AS era_min, max(era) AS era_max, count(target) AS target_rows,
 count(DISTINCT CASE WHEN target IS NOT NULL THEN era END) AS target_eras, count(benchmark) AS benchmark_rows, count(DISTINCT CASE WHEN benchmark IS NOT NULL THEN era END) AS benchmark_eras FROM panel"""))
def _(t):
    return panel.panel_manifest(t.panel(), ["target", "benchmark"])


# ---- splits ---------------------------------------------------------------------------

def role_sql(eras: str, start: str, end: str, purge: int = PURGE) -> str:
    return f"CASE WHEN era BETWEEN {start} AND {end} THEN 'valid' WHEN era < {start} AND era >= {start} - {purge} THEN 'purged' WHEN era < {start} - {purge} THEN 'train' END"


ERAS_SQL = "eras AS (SELECT DISTINCT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS era FROM orders)"
OUTER_SQL = ERAS_SQL + f""",
ospec AS (SELECT * FROM (VALUES {", ".join(f"('outer_{i+1}', {a}, {b})" for i, (a, b) in enumerate(OUTER))}) s(split, a, b)),
outers AS (SELECT * FROM (SELECT split, era, {role_sql('eras', 'a', 'b')} AS role FROM ospec CROSS JOIN eras) WHERE role IS NOT NULL)"""
INNER_SQL = OUTER_SQL + f""",
mx AS (SELECT split AS o, max(era) AS last FROM outers WHERE role = 'train' GROUP BY split),
ispec AS (SELECT o, a, b, o || '_inner_' || row_number() OVER (PARTITION BY o ORDER BY a) AS split FROM
 (SELECT o, a, least(b0, last) AS b FROM mx CROSS JOIN (VALUES {", ".join(f"({a}, {b})" for a, b in INNER)}) c(a, b0)) WHERE b - a + 1 >= {MIN_INNER}),
inners AS (SELECT * FROM (SELECT i.split, u.era, {role_sql('', 'i.a', 'i.b').replace('era', 'u.era')} AS role FROM ispec i JOIN outers u ON u.split = i.o AND u.role = 'train') WHERE role IS NOT NULL)"""


def outer(t):
    return splits.outer_splits(splits.distinct_eras(t.eras()), OUTER, PURGE)


def every_split(t):
    o = outer(t)
    return o.unionByName(splits.inner_splits(o, INNER, PURGE, MIN_INNER))


@query("expanding_split", with_(ERAS_SQL, f"SELECT * FROM (SELECT 'block' AS split, era, {role_sql('', '50', '60')} AS role FROM eras) WHERE role IS NOT NULL"))
def _(t):
    return splits.expanding_split(splits.distinct_eras(t.eras()), [("block", 50, 60)], PURGE)


@query("outer_splits", with_(OUTER_SQL, "SELECT split, era, role FROM outers"))
def _(t):
    return outer(t)


@query("inner_splits", with_(INNER_SQL, "SELECT split, era, role FROM inners"))
def _(t):
    return splits.inner_splits(outer(t), INNER, PURGE, MIN_INNER)


@query("resolve_split", with_(INNER_SQL, "SELECT split, era, role FROM inners WHERE split = 'outer_2_inner_1' UNION ALL SELECT split, era, role FROM outers WHERE split = 'outer_2_inner_1'"))
def _(t):
    return splits.resolve_split(every_split(t), "outer_2_inner_1")


@query("tail_purge_refit_split", with_(ERAS_SQL, "SELECT 'refit' AS split, era, CASE WHEN row_number() OVER (ORDER BY era DESC) <= 16 THEN 'purged' ELSE 'train' END AS role FROM eras"))
def _(t):
    return splits.tail_purge_refit_split(splits.distinct_eras(t.eras()))


@query("block_split_with_embargo", with_(ERAS_SQL + """,
f AS (SELECT era, row_number() OVER (ORDER BY era) AS k, count(*) OVER () AS n FROM eras WHERE era > 24),
tn AS (SELECT max(era) AS last FROM f WHERE k <= floor(n*0.6e0))""",
    "SELECT era, CASE WHEN k <= floor(n*0.6e0) THEN 'tuning' WHEN era <= last + 4 THEN 'embargoed' ELSE 'verdict' END AS role FROM f CROSS JOIN tn UNION ALL SELECT era, 'dropped_boundary' FROM eras WHERE era BETWEEN 21 AND 24"))
def _(t):
    return splits.block_split_with_embargo(splits.distinct_eras(t.eras()), 20, splits.embargo_eras())


@query("split_role_join", with_(PANEL + "," + OUTER_SQL, "SELECT split, role, count(*) AS n, count(target) AS resolved FROM panel JOIN outers USING (era) GROUP BY 1, 2"))
def _(t):
    j = splits.split_role_join(t.panel().select("id", "era", "target"), outer(t))
    return j.groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("resolved"))


@query("assert_no_leakage", with_(INNER_SQL + """,
alls AS (SELECT * FROM outers UNION ALL SELECT * FROM inners),
g AS (SELECT split, count(*) FILTER (WHERE role='purged') AS purged, max(era) FILTER (WHERE role='train') AS tm, min(era) FILTER (WHERE role='valid') AS vm FROM alls GROUP BY split)""",
    "SELECT 'purge_count' AS kind, split AS key, CAST(purged AS VARCHAR) AS detail FROM g WHERE purged <> 5 UNION ALL SELECT 'gap', split, CAST(vm - tm - 1 AS VARCHAR) FROM g WHERE vm - tm - 1 <> 5"))
def _(t):
    return splits.split_violations(every_split(t), PURGE + 1)


@query("assert_allowed_eras", with_(ERAS_SQL, "SELECT 'not_allowed' AS kind, CAST(era AS VARCHAR) AS key, '' AS detail FROM eras WHERE era NOT BETWEEN 10 AND 70 UNION ALL SELECT 'forbidden', CAST(era AS VARCHAR), '' FROM eras WHERE era BETWEEN 60 AND 64"))
def _(t):
    e = splits.distinct_eras(t.eras())
    return splits.allowed_era_violations(t.eras(), e.where(F.col("era").between(10, 70)), e.where(F.col("era").between(60, 64)))


@query("era_to_split", f"WITH r AS (SELECT o_orderkey AS row_index, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS era, o_orderpriority AS split FROM orders) SELECT era, arg_min(split, row_index) AS split FROM r GROUP BY era")
def _(t):
    rows = t.table("orders").select(F.col("o_orderkey").alias("row_index"), F.expr("CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT)").alias("era"), F.col("o_orderpriority").alias("split"))
    return splits.era_to_split(rows)


# ---- alignment ------------------------------------------------------------------------

ERA = "CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT)"


def bench_table(t):
    o = t.table("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.expr(ERA).alias("bench_era"))
    c = t.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("bench"))
    return o.where(F.col("bench_era") >= 12).join(c, "o_custkey").select("id", "bench_era", "bench")


@query("benchmark_left_join", f"SELECT o_orderkey AS id, {ERA} AS era, CASE WHEN {ERA} >= 12 THEN c_acctbal END AS bench FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    return align.benchmark_left_join(t.eras(), bench_table(t)).select("id", "era", "bench")


@query("bucketed_left_join", f"SELECT o_orderkey AS id, {ERA} AS era, CASE WHEN {ERA} >= 12 THEN c_acctbal END AS bench FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(t):
    """The benchmark join on tables that are stored in buckets of the id: nothing is shuffled."""
    one, two = (tables.write_bucketed(d, "id", 8) for d in (t.eras(), bench_table(t)))
    return align.benchmark_left_join(one, two).select("id", "era", "bench")


@query("coverage_boundary_check", with_(PANEL, "SELECT 'coverage' AS kind, CAST(id AS VARCHAR) AS key, CAST(era AS VARCHAR) AS detail FROM panel WHERE (era >= 13) <> (benchmark IS NOT NULL)"))
def _(t):
    return align.coverage_boundary_check(t.panel(), 13)


SHIP_ERA = "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT)"


@query("era_agreement_check", f"SELECT 'era' AS kind, CAST(o_orderkey AS VARCHAR) AS key, {ERA} || ':' || se AS detail FROM orders JOIN (SELECT l_orderkey, min({SHIP_ERA}) AS se FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE {ERA} <> se")
def _(t):
    ship = t.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.expr(SHIP_ERA)).alias("era"))
    return align.era_agreement_check(t.eras(), ship)


@query("inner_join_predictions", with_(PANEL, "SELECT p.id, p.era, p.target, l.prediction FROM panel p JOIN (SELECT l_orderkey, sum(CAST(round(l_discount*100) AS BIGINT))/100e0 AS prediction FROM lineitem GROUP BY 1) l ON l_orderkey = id WHERE target IS NOT NULL"))
def _(t):
    ext = t.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.sum(F.rint(F.col("l_discount") * 100).cast("bigint")) / 100.0).alias("prediction"))
    return align.inner_join_predictions(t.panel().select("id", "era", "target"), ext).select("id", "era", "target", "prediction")


@query("row_membership_audit", with_(PANEL + """, a AS (SELECT era, features[1] AS f1, features[2] AS f2, features[6] AS f6, target FROM panel WHERE data_type <> 'train'),
b AS (SELECT DISTINCT features[1] AS f1, features[2] AS f2, features[6] AS f6, target FROM panel WHERE data_type = 'train')""",
    "SELECT a.era, count(*) AS rows, count(b.f1) AS matched, round(count(b.f1)/count(*), 8) AS share FROM a LEFT JOIN b ON a.f1 = b.f1 AND a.f2 = b.f2 AND a.f6 = b.f6 AND a.target IS NOT DISTINCT FROM b.target GROUP BY a.era"))
def _(t):
    f = F.col("features")
    p = t.panel().select("era", "data_type", f[0].alias("f1"), f[1].alias("f2"), f[5].alias("f6"), "target")
    got = align.row_membership_audit(p.where("data_type <> 'train'"), p.where("data_type = 'train'"), ["f1", "f2", "f6", "target"])
    return got.select("era", "rows", "matched", *rr("share"))


@query("exact_alignment", """WITH l AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'missing_right' AS kind, CAST(k AS VARCHAR) AS key, '' AS detail FROM l WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT 'missing_left', CAST(k AS VARCHAR), '' FROM r WHERE k NOT IN (SELECT k FROM l)
UNION ALL SELECT 'duplicate', CAST(k AS VARCHAR), '' FROM r WHERE n > 1""")
def _(t):
    left = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    right = t.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("v"))
    return align.exact_alignment(left, right, "id", "v")


@query("seed_alignment", """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_returnflag)) AS d FROM lineitem GROUP BY 1, 2)
SELECT 'disagree' AS kind, l_orderkey || ':' || l_linenumber AS key, CAST(n AS VARCHAR) AS detail FROM g WHERE d > 1 UNION ALL SELECT 'copies', l_orderkey || ':' || l_linenumber, CAST(n AS VARCHAR) FROM g WHERE n <> 1""")
def _(t):
    return align.seed_alignment(t.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_returnflag"], 1)


@query("target_alias_check", with_(PANEL, "SELECT 'target=target' AS pair, 0 AS different, true AS identical UNION ALL SELECT 'target=target_b', count(*) FILTER (WHERE target IS DISTINCT FROM target_b), count(*) FILTER (WHERE target IS DISTINCT FROM target_b) = 0 FROM panel"))
def _(t):
    return align.target_alias_check(t.panel(), [("target", "target"), ("target", "target_b")])


@query("paired_arms", with_(CELLS, """SELECT config_id, split, updates, seed, round(max(corr_mean) FILTER (WHERE arm='filtered'), 8) + 0e0 AS corr_mean_a, round(max(corr_mean) FILTER (WHERE arm='plain'), 8) + 0e0 AS corr_mean_b,
 count(*) FILTER (WHERE arm='filtered') = 1 AND count(*) FILTER (WHERE arm='plain') = 1 AS paired, max(runs) FILTER (WHERE arm='filtered') IS NOT DISTINCT FROM max(runs) FILTER (WHERE arm='plain') AS shared_equal FROM cells GROUP BY 1, 2, 3, 4"""))
def _(t):
    keys = ["config_id", "split", "updates", "seed"]
    return align.paired_arms(t.cells(), keys, ("filtered", "plain"), "corr_mean", ["runs"]).select(*keys, *rr("corr_mean_a", "corr_mean_b"), "paired", "shared_equal")


@query("search_identity_join", """WITH d AS (SELECT s_suppkey, any_value(s_nationkey) AS nation, count(*) AS draws FROM supplier GROUP BY 1)
SELECT c_custkey AS config_id, c_nationkey AS nation, coalesce(draws, 0) AS draws, CASE WHEN draws IS NULL THEN 'unknown' WHEN draws > 1 THEN 'ambiguous' WHEN c_nationkey <> d.nation THEN 'differs' ELSE 'match' END AS status,
 sha256('{"config_id":' || c_custkey || ',"nation":' || c_nationkey || '}') AS signature FROM customer LEFT JOIN d ON c_custkey = s_suppkey""")
def _(t):
    results = t.table("customer").select(F.col("c_custkey").alias("config_id"), F.col("c_nationkey").alias("nation"))
    draws = t.table("supplier").select(F.col("s_suppkey").alias("config_id"), F.col("s_nationkey").alias("nation"))
    return align.search_identity_join(results, draws, "config_id", ["nation"])


@query("arm_seed_pivot", with_(CELLS, "SELECT config_id, split, updates, seed, round(max(corr_mean) FILTER (WHERE arm='filtered'), 8) + 0e0 AS filtered, round(max(corr_mean) FILTER (WHERE arm='plain'), 8) + 0e0 AS plain, round(max(corr_mean) FILTER (WHERE arm='filtered') - max(corr_mean) FILTER (WHERE arm='plain'), 8) + 0e0 AS difference FROM cells GROUP BY 1, 2, 3, 4"))
def _(t):
    keys = ["config_id", "split", "updates", "seed"]
    return align.arm_seed_pivot(t.cells(), keys, ("filtered", "plain"), "corr_mean").select(*keys, *rr("filtered", "plain", "difference"))


@query("append_resolved", with_(PANEL, "SELECT id, era, target FROM panel WHERE data_type = 'train' OR (data_type <> 'train' AND target IS NOT NULL)"))
def _(t):
    p = t.panel()
    return align.append_resolved(p.where("data_type = 'train'"), p.where("data_type <> 'train'"), ["id", "era", "target"])


@query("row_index", f"SELECT o_orderkey AS id, {ERA} AS era, row_number() OVER (ORDER BY {ERA}, o_orderkey) - 1 AS row_index FROM orders")
def _(t):
    return align.row_index(t.eras()).select("id", "era", "row_index")
