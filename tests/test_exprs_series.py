import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eralens.functions import exprs, ranking, series

SPLIT = ranking.Split(rows=20, max_splits=16, sample=1)


def test_probit_matches_the_standard_library(rows):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.02425, 0.075, 0.3, 0.5, 0.77, 0.925, 0.999, 1 - 1e-12]
    d = rows([(x,) for x in [*p, 0.0, 1.0, None]], "p double")
    got = {r["p"]: r["z"] for r in exprs.with_probit(d, F.col("p"), "z").collect()}
    for x in p:
        assert got[x] == pytest.approx(statistics.NormalDist().inv_cdf(x), rel=1e-12, abs=1e-15)
    assert got[0.0] is None and got[1.0] is None and got[None] is None


def test_hash_does_not_depend_on_partitioning(spark):
    d = spark.range(500)
    h = exprs.hash_unit(exprs.keyed("a", F.col("id")))
    a = d.repartition(1).select("id", h.alias("h")).orderBy("id").toPandas()
    b = d.repartition(7).select("id", h.alias("h")).orderBy("id").toPandas()
    assert a.equals(b) and 0 <= a["h"].min() and a["h"].max() < 1 and abs(a["h"].mean() - 0.5) < 0.05


@pytest.fixture(scope="module")
def walk(spark):
    g = np.random.default_rng(3)
    pdf = pd.DataFrame({"run": np.repeat([1, 2], [4000, 30]), "step": np.r_[np.arange(4000), np.arange(30)], "x": g.random(4030) + 1})
    return pdf, spark.createDataFrame(pdf).repartition(6)


@pytest.mark.parametrize("plan", [None, SPLIT])
@pytest.mark.parametrize("decay", [0.98, 0.5])
def test_ema(walk, plan, decay):
    pdf, df = walk
    got = series.ema(df, ["run"], "step", "x", decay, "e", plan).toPandas().sort_values(["run", "step"])
    want = pdf.groupby("run")["x"].transform(lambda s: s.ewm(alpha=1 - decay, adjust=False).mean())
    assert np.allclose(got["e"].to_numpy(), want.to_numpy(), rtol=1e-10)


@pytest.mark.parametrize("plan", [None, SPLIT])
def test_ema_of_a_null_key_and_of_old_values(rows, plan):
    """What is carried over many blocks counts, however small later values are."""
    x = np.r_[1e30, np.zeros(300)]
    d = rows([(k, i, float(v)) for k in (None, 7) for i, v in enumerate(x)], "run int, step int, x double")
    got = series.ema(d, ["run"], "step", "x", 0.5, "e", plan).collect()
    assert len(got) == 602 and {r["run"] for r in got} == {None, 7}
    assert all(r["e"] == pytest.approx(1e30 * 0.5 ** r["step"], rel=1e-9) for r in got)


@pytest.mark.parametrize("plan", [None, SPLIT])
def test_rolling(walk, plan):
    pdf, df = walk
    got = series.rolling(df, ["run"], "step", "x", 26, 13, "m", plan, block=100).toPandas().sort_values(["run", "step"])
    want = pdf.groupby("run")["x"].transform(lambda s: s.rolling(26, min_periods=13).mean())
    assert len(got) == len(pdf)
    assert np.allclose(got["m"].to_numpy(float), want.to_numpy(), equal_nan=True)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=2, max_size=40))
def test_moments_corr_property(spark, xs):
    ys = [(x * 37 % 101) - 50.0 for x in xs]
    d = spark.createDataFrame([(float(a), b) for a, b in zip(xs, ys)], "x double, y double")
    from eralens.operators.score import pearson

    got = pearson(d.withColumn("k", F.lit(1)), ["k"], F.col("x"), F.col("y"), "c").first()["c"]
    if np.std(xs) == 0 or np.std(ys) == 0:
        assert got is None
    else:
        assert got == pytest.approx(np.corrcoef(xs, ys)[0, 1], abs=1e-9)
