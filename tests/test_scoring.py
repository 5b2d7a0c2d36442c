import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eralens.functions.ranking import Split
from eralens.operators import inference, score, summary

SPLIT = Split(rows=10, max_splits=8, sample=1)
inv = statistics.NormalDist().inv_cdf


def power(x):
    return np.sign(x) * np.abs(x) ** 1.5


@pytest.fixture(scope="module")
def panel(spark):
    g = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({
        "id": np.arange(n), "era": np.where(g.random(n) < 0.5, 1, g.integers(2, 5, n)),
        "target": g.integers(0, 5, n) / 4.0, "prediction": np.round(g.random(n), 2), "benchmark": np.round(g.random(n), 2)})
    return pdf, spark.createDataFrame(pdf).repartition(3)


def brute(part, kind):
    n = len(part)
    t = part["target"].to_numpy()
    rank = part["prediction"].rank().to_numpy()
    if kind == "v1":
        return np.corrcoef(power(np.array([inv(r / (n + 1)) for r in rank])), power(t - 0.5))[0, 1]
    if kind == "v2":
        order = part.sort_values(["prediction", "id"])
        x = power((np.arange(n) + 0.5) / n - 0.5)
        return np.corrcoef(x, power(order["target"].to_numpy() - 0.5))[0, 1]
    p = np.array([inv((r - 0.5) / n) for r in rank])
    if kind == "official":
        return np.corrcoef(power(p), power(t - t.mean()))[0, 1]
    m = np.array([inv((r - 0.5) / n) for r in part["benchmark"].rank()])
    left = p - m * (p @ m) / (m @ m)
    return ((4 * t) - (4 * t).mean()) @ left / n


@pytest.mark.parametrize("plan", [None, SPLIT])
@pytest.mark.parametrize("kind", ["v1", "v2", "official", "bmc"])
def test_scores_equal_brute_force(panel, plan, kind):
    pdf, df = panel
    fn = {"v1": lambda: score.corr_v1(df, ["era"], plan=plan), "v2": lambda: score.corr_v2(df, ["era"], "id", plan=plan),
          "official": lambda: score.corr_official(df, ["era"], plan=plan), "bmc": lambda: score.bmc(df, ["era"], plan=plan, out="corr")}[kind]
    got = {r["era"]: r["corr"] for r in fn().collect()}
    assert got == pytest.approx({e: brute(p, kind) for e, p in pdf.groupby("era")}, abs=1e-10)


@pytest.mark.parametrize("plan", [None, SPLIT])
def test_covered_only(panel, spark, plan):
    pdf, _ = panel
    pdf = pdf.copy()
    pdf.loc[pdf["era"] == 2, "benchmark"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("benchmark", F.when(~F.isnan("benchmark"), F.col("benchmark")))
    got = score.bmc_covered_only(df, ["era"], plan).toPandas().set_index("era")
    assert np.isnan(got.loc[2, "bmc"]) and got["corr"].notna().all()
    assert got.loc[1, "bmc"] == pytest.approx(brute(pdf[pdf["era"] == 1], "bmc"), abs=1e-10)


def test_constant_prediction(rows):
    d = rows([(i, 1, 0.5, i / 4) for i in range(5)], "id int, era int, prediction double, target double")
    assert score.corr_official(d, ["era"]).first()["corr"] is None
    flat = d.withColumn("target", F.lit(0.5))
    assert score.corr_v2(flat, ["era"], "id").first()["corr"] == 0.0


def test_pearson_reversed_ramps(rows):
    data = [(e, float(i), float(i if e == 1 else -i)) for e in (1, 2) for i in range(6)]
    r = score.pearson_per_era(rows([("m", *x) for x in data], "model string, era int, a double, b double"), ["model"], "a", "b").first()
    assert (r["per_era_mean"], r["per_era_min"], r["per_era_max"]) == pytest.approx((0.0, -1.0, 1.0))


def test_blend_weight_one_is_the_model(panel):
    pdf, df = panel
    got = score.benchmark_blend(df, (1.0,)).toPandas().set_index("id")["blend"].sort_index()
    want = (pdf.groupby("era")["prediction"].rank() - 0.5) / pdf.groupby("era")["prediction"].transform("size")
    assert np.allclose(got, want)


def test_summary_golden(rows):
    d = rows([("m", e, v) for e, v in enumerate([0.1, -0.3, 0.2, -0.1])], "model string, era int, corr double")
    r = summary.summarize_eras(d, ["model"], "corr").first()
    assert r["mean"] == pytest.approx(-0.025) and r["std"] == pytest.approx(np.std([0.1, -0.3, 0.2, -0.1]))
    assert r["max_drawdown"] == pytest.approx(0.3) and r["cumulative"] == pytest.approx(-0.1)


def test_acf_and_block_length(rows):
    x = [float(np.sin(i)) for i in range(60)]
    d = rows([("m", i, v) for i, v in enumerate(x)], "model string, era int, x double")
    got = {r["lag"]: r["acf"] for r in summary.acf(d, ["model"], "x", 5).collect()}
    assert got[3] == pytest.approx(np.corrcoef(x[:-3], x[3:])[0, 1])
    table = rows([("m", 1, 0.4), ("m", 2, -0.2), ("m", 3, 0.05), ("n", 1, 0.9)], "model string, lag int, acf double")
    assert {r["model"]: r["block_length"] for r in summary.block_length_rule(table, ["model"], 2, 5).collect()} == {"m": 3, "n": 6}


def test_digitize_puts_ties_up(rows):
    d = rows([("a", e, float(v)) for e, v in enumerate([1, 2, 3, 4, 5])], "k string, era int, v double")
    got = summary.quartile_buckets(d, ["k"], "v").orderBy("era").toPandas()["bucket"].tolist()
    assert got == np.digitize([1, 2, 3, 4, 5], np.quantile([1, 2, 3, 4, 5], [0.25, 0.5, 0.75])).tolist()


# ---- inference --------------------------------------------------------------------------

def constant_effect(rows, n=40):
    data = [(a, 0, e, np.sin(e) + (0.004 if a == "filtered" else 0.0)) for e in range(n) for a in ("filtered", "plain")]
    return rows([(a, s, e, float(v)) for a, s, e, v in data], "arm string, seed int, era int, corr double")


def test_bootstrap_constant_effect(rows):
    d = inference.paired_difference(constant_effect(rows), "filtered", "plain", ["seed"], "corr")
    r = inference.block_bootstrap_mean(d, ["seed"], "difference", 8, 500).first()
    assert (r["estimate"], r["ci_low"], r["ci_high"]) == pytest.approx((0.004, 0.004, 0.004))
    assert r["probability_positive"] == 1.0 and r["samples"] == 500 and r["eras"] == 40


def test_bootstrap_is_deterministic_and_resamples_whole_length(rows):
    g = np.random.default_rng(1)
    d = rows([("k", e, float(v)) for e, v in enumerate(g.standard_normal(27))], "k string, era int, x double")
    a = inference.bootstrap_samples(d, ["k"], "x", 8, 200).orderBy("sample").toPandas()
    b = inference.bootstrap_samples(d.repartition(7), ["k"], "x", 8, 200).orderBy("sample").toPandas()
    assert np.allclose(a["boot_mean"], b["boot_mean"]) and a["boot_mean"].std() > 0
    takes = inference.draw_blocks(inference.series_shape(d, ["k"], "x"), ["k"], 8, 50, 1).groupBy("sample").agg(F.sum("take").alias("n"))
    assert {r["n"] for r in takes.collect()} == {27}


def test_verdict_order(rows):
    d = rows([(0.01, 0.001, 0.02), (-0.01, -0.02, -0.001), (0.001, -0.002, 0.003), (0.001, -0.02, 0.02), (0.002, 0.001, 0.003)],
             "estimate double, ci_low double, ci_high double")
    got = [r["category"] for r in inference.with_verdict(d, 0.005).collect()]
    assert got == ["helps", "hurts", "doesnt_help", "no_verdict", "doesnt_help"]


def test_pairing_violations(rows):
    d = rows([("filtered", 0, 1, 0.1), ("filtered", 0, 1, 0.2), ("plain", 0, 1, 0.1), ("plain", 0, 2, 0.1), ("filtered", 0, 3, None), ("plain", 0, 3, 0.2)],
             "arm string, seed int, era int, corr double")
    got = sorted((r["kind"], r["key"]) for r in inference.pairing_violations(d, "filtered", "plain", ["seed"], "corr").collect())
    assert got == [("duplicate", "0:1"), ("missing", "0:2"), ("not_finite", "0:3")]
    assert inference.pairing_violations(constant_effect(rows), "filtered", "plain", ["seed"], "corr").count() == 0


def test_mann_whitney_and_wilcoxon(rows):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0]
    d = rows([("k", "a", x) for x in a] + [("k", "b", x) for x in b], "k string, g string, v double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert inference.mann_whitney(d, ["k"], "g", "a", "b", "v").first()["u"] == pytest.approx(u)
    s = rows([("k", v) for v in [0.3, -0.1, 0.2, 0.0, -0.4]], "k string, v double")
    assert inference.signed_tests(s, ["k"], "v").first()["w_plus"] == pytest.approx(3 + 2)


def test_scores_sort_once_for_each_rank(rows):
    """The target's mean finds its groups in the order of the first rank."""
    d = rows([(1, 0.1, 0.2, 0.5)], "era int, prediction double, benchmark double, target double")
    sorts = lambda df: str(df._jdf.queryExecution().executedPlan()).count("Sort [")
    assert sorts(score.bmc_covered_only(d, ["era"], plan=None)) == 3 and sorts(score.corr_official(d, ["era"], plan=None)) == 1


def test_stored_files_are_bounded(spark):
    """A scan's task reads a bounded number of rows only if files are bounded."""
    from eralens.session import cut_lineage

    stored = cut_lineage(spark.range(0, 1000, 1, 2), "bounded", 100)
    assert len(stored.inputFiles()) == 10 and stored.count() == 1000
    assert all(spark.read.parquet(f).count() <= 100 for f in stored.inputFiles())


def test_blends_are_dealt_once(rows):
    """A floating weight among the keys would deal all rows again, by Spark's own number of partitions."""
    from eralens.functions import ranking as R

    d = rows([(1, w, i / 7, (i * 3 % 5) / 5, float(i % 2)) for w in (0.1, 0.25, 1.0) for i in range(6)], "era int, weight double, blend double, benchmark double, target double")
    shuffles = lambda df: str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")
    got = score.blend_scores(d, R.Whole(5))
    assert shuffles(got) == 1 < shuffles(score.bmc_covered_only(d, ["era", "weight"], R.Whole(5), pred="blend"))
    want = score.bmc_covered_only(d, ["era", "weight"], pred="blend", plan=None)
    assert got.schema["weight"].dataType.simpleString() == "double"
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_scans_inside_read_few_bytes(spark, tmp_path):
    """A task reads so many bytes at most, and the session's own number holds again afterwards."""
    from eralens.session import SPLIT_BYTES, scan_bytes

    for k in range(4):
        spark.range(k * 1000, k * 1000 + 1000, 1, 1).write.mode("append").parquet(str(tmp_path / "ids"))
    before = spark.conf.get(SPLIT_BYTES)
    with scan_bytes(spark, 4096):
        assert spark.read.parquet(str(tmp_path / "ids")).rdd.getNumPartitions() >= 4
        with scan_bytes(spark, 1 << 30):
            assert spark.conf.get(SPLIT_BYTES) == "4096"
    assert spark.conf.get(SPLIT_BYTES) == before


def test_the_panel_and_predictions_are_stored_in_small_files(spark, tmp_path, monkeypatch):
    """Files bound what a task reads, adds up and deals, at any size of the tables."""
    import os

    from eralens.sources import fixtures

    monkeypatch.setattr(fixtures, "FILE_ROWS", 50)
    t = fixtures.Tables(spark, os.path.join(os.environ.get("ERALENS_TEST_ROOT", "/root/testdata"), "sf0.001"))
    monkeypatch.setattr(fixtures, "STORED", {})
    assert all(spark.read.parquet(f).count() <= 50 for f in t.panel().inputFiles()[:4] + t.pred().inputFiles()[:4])


def test_partitions_follow_the_rows(spark):
    from eralens.session import SHUFFLES, TOGETHER, shuffles_of

    before, together = int(spark.conf.get(SHUFFLES)), spark.conf.get(TOGETHER)
    for rows, want in ((0, before), (1000 * before, before), (7001 * before, 7 * before + 1)):
        with shuffles_of(spark, rows, 1000, 1 << 20):
            assert int(spark.conf.get(SHUFFLES)) == want and spark.conf.get(TOGETHER) == str(1 << 20)
    spark.conf.set(TOGETHER, "16k")          # a finer setting stays
    try:
        with pytest.raises(ZeroDivisionError), shuffles_of(spark, 10**6, 10, 1 << 20):
            assert spark.conf.get(TOGETHER) == str(16 << 10)
            1 / 0
        assert int(spark.conf.get(SHUFFLES)) == before and spark.conf.get(TOGETHER) == "16k"
    finally:
        spark.conf.set(TOGETHER, together)
