"""Ranking primitives: golden values, pandas parity, and the range plan on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eralens.functions import ranking as R
from eralens.operators import score

PLANS = [None, R.Split(rows=20, max_splits=16, sample=1)]


@pytest.fixture(scope="module")
def skewed(spark):
    g = np.random.default_rng(7)
    era = np.where(g.random(3000) < 0.6, 1, g.integers(2, 9, 3000))     # one era holds most rows
    value = np.round(g.standard_normal(3000), 2)
    value[g.random(3000) < 0.35] = 0.5                                  # a third are the same value
    pdf = pd.DataFrame({"id": np.arange(3000), "era": era, "value": value})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_golden_rank(rows):
    d = rows([(1, 1, 3.0), (2, 1, 1.0), (3, 1, 1.0), (4, 2, 9.0), (5, 2, 8.0)], "id int, era int, value double")
    got = {r["id"]: r["rank"] for r in R.with_rank(d, ["era"], "value", "rank", plan=None).collect()}
    assert got == pytest.approx({1: 5 / 6, 2: 1 / 3, 3: 1 / 3, 4: 3 / 4, 5: 1 / 4})


@pytest.mark.parametrize("plan", PLANS)
def test_rank_equals_pandas(skewed, plan):
    pdf, df = skewed
    got = R.with_rank(df, ["era"], "value", "rank", plan=plan).toPandas().set_index("id")["rank"].sort_index()
    want = (pdf.groupby("era")["value"].rank() - 0.5) / pdf.groupby("era")["value"].transform("size")
    assert np.allclose(got.to_numpy(), want.to_numpy(), atol=1e-12)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("keys", [["era"], []])
def test_positions_are_dense(skewed, plan, keys):
    pdf, df = skewed
    got = R.row_positions(df, keys, ["value", "id"], plan=plan, total="n").toPandas()
    for _, part in got.groupby(keys) if keys else [(0, got)]:
        part = part.sort_values(["value", "id"])
        assert part["pos"].tolist() == list(range(len(part)))
        assert set(part["n"]) == {len(part)}


@pytest.mark.parametrize("plan", PLANS)
def test_quantiles_equal_numpy(skewed, plan):
    pdf, df = skewed
    got = R.exact_quantiles(df, ["era"], "value", {"a": 0.05, "b": 0.5, "c": 0.9}, plan=plan).toPandas().set_index("era").sort_index()
    for era, part in pdf.groupby("era"):
        assert got.loc[era, ["a", "b", "c"]].to_numpy(float) == pytest.approx(np.quantile(part["value"], [0.05, 0.5, 0.9]))


@pytest.mark.parametrize("plan", PLANS)
def test_running_sum(skewed, plan):
    pdf, df = skewed
    got = R.running_weight(df, ["era"], "id", F.col("value"), plan).toPandas().sort_values("id")
    want = pdf.groupby("era")["value"].cumsum() - pdf["value"]
    assert np.allclose(got["before"].to_numpy(), want.to_numpy())


def test_nulls_are_not_ranked(rows):
    d = rows([(1, 1, None), (2, 1, 1.0), (3, 1, 2.0)], "id int, era int, value double")
    for plan in PLANS:
        got = {r["id"]: r["rank"] for r in R.with_rank(d, ["era"], "value", "rank", plan=plan).collect()}
        assert got == {1: None, 2: 0.25, 3: 0.75}


def test_a_null_key_is_a_group_in_both_plans(rows):
    data = [(None if i % 3 else 5, i, float((i * 37) % 101) if i % 10 else None) for i in range(200)]
    d = rows(data, "era int, id int, value double")
    found = []
    for plan in PLANS:
        r = R.row_positions(R.with_rank(d, ["era"], "value", "rank", plan=plan), ["era"], "id", plan=plan, total="n")
        found.append({x["id"]: (x["era"], x["rank"], x["pos"], x["n"]) for x in r.collect()})
        c = score.corr_official(d.withColumn("target", F.col("id") / 200), ["era"], "value", "target", plan=plan).collect()
        assert {x["era"] for x in c} == {None, 5} and all(x["corr"] is not None for x in c)
    assert found[0] == found[1] and len(found[0]) == 200
    assert all(v[1] is not None for k, v in found[0].items() if k % 10)


def test_plan_follows_the_largest_group(skewed):
    _, df = skewed
    assert R.plan_groups(df, ["era"], bound=10_000) is None
    assert isinstance(R.plan_groups(df, ["era"], bound=100), R.Split)


def test_tasks_hold_a_few_groups_however_large_the_table(spark, skewed, monkeypatch):
    """Partitions follow the rows, so a task's share of a growing table does not grow."""
    _, df = skewed
    monkeypatch.setattr(R, "DEAL_FROM", 1000)
    monkeypatch.setattr(R, "TASK_ROWS", 50)
    d = spark.range(4000).select("id", F.pmod("id", F.lit(80)).alias("era"), F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("value"))
    assert R.plan_groups(d, ["era"]) == R.Whole(80) and R.plan_groups(d, ["era"], times=3) == R.Whole(240)
    whole = R.with_rank(d, ["era"], "value", "rank")
    assert whole.rdd.getNumPartitions() == 80
    share = whole.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert share <= 6 * 50
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, R.with_rank(d, ["era"], "value", "rank", plan=None).collect()))
    pos = [sorted(map(tuple, R.row_positions(d, ["era"], "id", plan=p, total="n").collect())) for p in (R.Whole(80), None)]
    assert pos[0] == pos[1]


def test_large_groups_are_cut(skewed):
    """The biggest era must end up in many ranges, and ties must not pile up rows."""
    _, df = skewed
    split = PLANS[1]
    d = df.groupBy("era", "value").count().withColumn("__o", F.col("value"))
    cuts = R._cut_points(d, ["era"], split)
    sizes = d.join(cuts, "era", "left").withColumn("b", R._range_of(split)).groupBy("era", "b").count().toPandas()
    hot = sizes[sizes["era"] == 1]
    assert len(hot) >= 8 and hot["count"].max() < 0.4 * hot["count"].sum()


def test_top_n(skewed):
    pdf, df = skewed
    got = R.top_n(df, ["era"], [F.desc("value"), F.asc("id")], 4).toPandas()
    want = pdf.sort_values(["value", "id"], ascending=[False, True]).groupby("era").head(4)
    assert set(got["id"]) == set(want["id"])
