import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eralens.functions import lowrank
from eralens.operators import models, vectors
from eralens.session import scratch
from eralens.functions.checks import CheckFailed
from eralens.streaming import keyed, rounds
from eralens.streaming.arrivals import require_none_dropped
from eralens.streaming.sink import latest, replay, run_available, stored, write_batches

DIM = 12


@pytest.fixture(scope="module")
def groups(spark):
    g = np.random.default_rng(42)
    direction = np.eye(DIM)[0]
    sets = {0: g.standard_normal((80, DIM)), 1: g.standard_normal((80, DIM)) + 6 * direction, 2: np.tile(g.standard_normal(DIM), (9, 1)), 3: g.standard_normal((5, DIM))}
    data = [(k, 1000 * k + i, v.tolist()) for k, x in sets.items() for i, v in enumerate(x)]
    return sets, spark.createDataFrame(data, "grp int, seq long, vec array<float>").repartition(5)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_spectrum_equals_the_gram_matrix(groups):
    sets, df = groups
    got = {r["grp"]: r["eigenvalues"] for r in vectors.group_gram_spectrum(df, "grp", "vec", DIM).collect()}
    for k, x in sets.items():
        u = unit(np.float32(x).astype(float))
        want = np.sort(np.linalg.eigvalsh(u @ u.T))[::-1][: len(got[k])]
        assert np.allclose(got[k], np.clip(want, 0, None), atol=1e-9)
    assert got[2][0] == pytest.approx(9.0)          # identical rows: one eigenvalue, the group size
    flipped = df.withColumn("vec", F.when(F.col("seq") % 2 == 0, F.transform("vec", lambda v: -v)).otherwise(F.col("vec")))
    other = {r["grp"]: r["eigenvalues"] for r in vectors.group_gram_spectrum(flipped, "grp", "vec", DIM).collect()}
    assert all(np.allclose(got[k], other[k], atol=1e-9) for k in got)


@pytest.mark.parametrize("mode", ["hard", "soft", "variance"])
def test_consensus_equals_row_weights(groups, mode):
    sets, df = groups
    got = {r["grp"]: r for r in vectors.consensus_filter(df, "grp", "vec", DIM, mode).collect()}
    for k in (0, 1, 3):
        x = np.float32(sets[k]).astype(float)
        n, u = len(x), unit(x)
        lam, vec = np.linalg.eigh(u @ u.T)
        lam, vec = np.clip(lam[::-1], 0, None), vec[:, ::-1]
        mean = lam.sum() / n
        if mode == "soft":
            a = 1 / (1 + np.exp(-(lam - 2 * mean) / (0.5 * mean)))
        else:
            kk = int((lam > 2 * mean).sum()) if mode == "hard" else int((np.cumsum(lam) / lam.sum() < 0.9).sum()) + 1
            a = (np.arange(n) < max(1, kk)).astype(float)
        a = np.where(lam > 1e-12 * lam[0], a, 0.0)
        want = (vec @ (a * (vec.T @ np.full(n, 1 / n)))) @ x
        assert np.allclose(got[k]["filtered_mean"], want, atol=1e-8)
    v = np.array(got[1]["filtered_mean"])
    assert v[0] / np.linalg.norm(v) > 0.99          # the planted direction
    zero = df.withColumn("vec", F.transform("vec", lambda _: F.lit(0.0).cast("float")))
    assert all(r["k"] == 0 and not any(r["filtered_mean"]) for r in vectors.consensus_filter(zero, "grp", "vec", DIM).collect())


@pytest.mark.parametrize("rows", [30, 150])
def test_wide_vectors_in_blocks(spark, rows, monkeypatch):
    """More and fewer rows than coordinates, uneven blocks, early hand-over, a null group."""
    from eralens.operators import products

    monkeypatch.setattr(products, "HELD_BYTES", 40_000)
    g, dim = np.random.default_rng(3), 67
    sets = {1: g.standard_normal((rows, dim)), None: g.standard_normal((rows, dim)) + 2 * np.eye(dim)[5]}
    df = spark.createDataFrame([(k, v.tolist()) for k, x in sets.items() for v in x], "grp int, vec array<double>").repartition(3)
    spectra = {r["grp"]: r for r in vectors.group_gram_spectrum(df, "grp", "vec", dim, 16).collect()}
    means = {r["grp"]: r for r in vectors.consensus_filter(df, "grp", "vec", dim, width=16).collect()}
    assert set(spectra) == set(means) == set(sets)
    for k, x in sets.items():
        u = unit(x)
        lam, vec = np.linalg.eigh(u @ u.T)
        lam, vec = lam[::-1], vec[:, ::-1]
        assert spectra[k]["n"] == rows and np.allclose(spectra[k]["eigenvalues"], lam[: min(rows, dim)], atol=1e-9)
        keep = max(1, int((lam > 2 * lam.sum() / rows).sum()))
        want = (vec[:, :keep] @ vec[:, :keep].sum(axis=0)) @ x / rows
        assert means[k]["k"] == keep and np.allclose(means[k]["filtered_mean"], want, atol=1e-9)
        assert means[k]["ratio"] == pytest.approx(np.linalg.norm(want) / np.linalg.norm(x.mean(axis=0)))
    c = vectors.distributed_covariance(df, "vec", dim, 16).toPandas().pivot(index="i", columns="j", values="covariance").to_numpy()
    assert np.allclose(c, np.cov(np.vstack(list(sets.values())).T, bias=True), atol=1e-9)


def test_random_subspace_has_the_asked_length(groups):
    sets, df = groups
    a = vectors.random_subspace_control(df, "grp", "vec", "seq", DIM, 3, 0.4, 1).orderBy("grp").toPandas()
    b = vectors.random_subspace_control(df.repartition(2), "grp", "vec", "seq", DIM, 3, 0.4, 1).orderBy("grp").toPandas()
    assert np.allclose(a["ratio"], 0.4) and np.allclose(np.stack(a["control_mean"]), np.stack(b["control_mean"]))


def test_covariance(groups):
    sets, df = groups
    x = np.float32(np.vstack(list(sets.values()))).astype(float)
    c = vectors.distributed_covariance(df, "vec", DIM).toPandas().pivot(index="i", columns="j", values="covariance").to_numpy()
    assert np.allclose(c, np.cov(x.T, bias=True), atol=1e-9)


def dense_fold(x, decay, centre="before"):
    mean, cov = x[0].astype(float), np.zeros((x.shape[1],) * 2)
    for v in x[1:]:
        new = decay * mean + (1 - decay) * v
        c = v - (mean if centre == "before" else new)
        mean, cov = new, decay * cov + (1 - decay) * np.outer(c, c)
    return mean, cov


@pytest.mark.parametrize("centre", ["before", "after"])
@pytest.mark.parametrize("block", [7, 4096])
def test_decayed_covariance_equals_the_dense_recursion(spark, centre, block):
    """Whatever the block length; a null key is a key."""
    g = np.random.default_rng(1)
    sets = {0: g.standard_normal((300, 5)), 1: g.standard_normal((1, 5)), None: g.standard_normal((40, 5)), 2: g.standard_normal((49, 5))}
    df = spark.createDataFrame([(k, i, v.tolist()) for k, x in sets.items() for i, v in enumerate(x)] + [(0, 500, None)], "grp int, seq long, vec array<double>").repartition(4)
    got = {r["grp"]: r for r in vectors.streaming_lowrank_cov(df, "grp", "seq", "vec", 5, 0.9, centre=centre, block=block).collect()}
    assert set(got) == set(sets)
    for k, x in sets.items():
        mean, cov = dense_fold(x, 0.9, centre)
        basis, values = np.array(got[k]["basis"]).reshape(-1, 5).T, np.array(got[k]["eigenvalues"])
        assert got[k]["rows"] == len(x) and np.allclose(got[k]["mean"], mean, atol=1e-12)
        assert np.allclose((basis * values) @ basis.T, cov, atol=1e-12) and got[k]["orthogonality_error"] < 1e-12


@pytest.mark.parametrize("block", [16, 4096])
def test_old_rows_keep_their_directions(spark, block):
    """A long constant tail fades the values, not the directions or the effective rank."""
    x = np.vstack([np.random.default_rng(2).standard_normal((50, 4)), np.tile([1.0, -2.0, 0.5, 3.0], (180, 1))])
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "grp int, seq long, vec array<double>")
    r = vectors.streaming_lowrank_cov(df, "grp", "seq", "vec", 4, 0.5, block=block).first()
    _, cov = dense_fold(x[:110], 0.5)            # the mean has settled by then; the rest only fades
    want = np.sort(np.linalg.eigvalsh(cov))[::-1] * 0.5 ** 120
    assert np.allclose(np.array(r["eigenvalues"])[:2] / want[:2], 1.0, rtol=1e-6)


def sketch_holds(values, basis, bound, cov):
    """B'B is below the covariance in every direction, by the bound at most."""
    gap = np.linalg.eigvalsh(cov)[::-1][: len(values)] - values
    assert gap.min() > -1e-10 and gap.max() <= bound + 1e-10 and bound < 0.5 * np.trace(cov)
    if basis is not None:
        assert np.linalg.eigvalsh(cov - (basis * values) @ basis.T).min() > -1e-10


@pytest.mark.parametrize("block", [9, 64, 4096])
def test_sketch_within_its_bound(spark, block):
    g = np.random.default_rng(8)
    x = g.standard_normal((500, 40)) * np.r_[6.0, 4.0, 3.0, np.ones(37)]
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "grp int, seq long, vec array<double>").repartition(3)
    r = vectors.streaming_lowrank_cov(df, "grp", "seq", "vec", 4, 0.98, block=block, size=20).first()
    mean, cov = dense_fold(x, 0.98)
    assert np.allclose(r["mean"], mean) and r["basis_rank"] == 4 and r["orthogonality_error"] < 1e-12
    sketch_holds(np.array(r["eigenvalues"]), np.array(r["basis"]).reshape(-1, 40).T, r["error_bound"], cov)


@pytest.mark.parametrize("chunks", [2, 7])
def test_sketch_state_survives_restarts(spark, chunks):
    g = np.random.default_rng(9)
    x = g.standard_normal((210, 40)) * np.r_[6.0, 4.0, 3.0, np.ones(37)]
    df = spark.createDataFrame([(0, i, v.tolist(), i * chunks // 210) for i, v in enumerate(x)], "grp int, seq long, vec array<double>, chunk int")
    out = scratch(spark, "sketch")
    arrive(df, chunks, lambda s: keyed.stream_lowrank_cov(s, "grp", "seq", "vec", 4, 0.98, 20), out, "update")
    got = latest(stored(spark, f"{out}/rows", "grp int, rows bigint, eigenvalues array<double>, error_bound double"), ["grp"], ["rows", "eigenvalues", "error_bound"]).first()
    _, cov = dense_fold(x, 0.98)
    sketch_holds(np.array(got["eigenvalues"]), None, got["error_bound"], cov)
    assert got["rows"] == 210


def test_projections():
    g = np.random.default_rng(0)
    basis, x = np.linalg.qr(g.standard_normal((6, 2)))[0], g.standard_normal((5, 6))
    top = lowrank.project(x, basis)
    assert np.allclose(lowrank.project(top, basis), top)
    assert np.allclose(top + lowrank.project(x, basis, "remove"), x)
    assert np.allclose(np.linalg.norm(lowrank.project(x, basis, "remove_renorm"), axis=1), np.linalg.norm(x, axis=1))
    assert lowrank.project(x, basis, strength=0.0) is x
    assert np.allclose(lowrank.soft_project(x, basis, np.array([2.0, 2.0])), x)
    for norm in ("var", "degree"):
        y = lowrank.soft_project(x, basis, np.array([2.0, 1.0]), normalise=norm)
        assert np.linalg.matrix_rank(y, tol=1e-6) <= 2
    assert lowrank.rank_by_rule(np.array([8.0, 1.0, 1.0]), "energy", 8) == 2 and lowrank.rank_by_rule(np.array([8.0, 7.0, 0.1]), "gap", 8) == 2


def test_block_ranks(groups):
    _, df = groups
    got = vectors.block_spectral(df, "grp", "seq", "vec", DIM, 5, 4).toPandas()
    assert got.groupby("block")["rank_cap"].first().tolist() == [2, 1, 1] and (got["basis_rank"] <= got["rank_cap"]).all()
    assert got[got["block"] == 2]["filtered"].map(len).eq(2).all()
    with pytest.raises(ValueError):
        vectors.block_spectral(df, "grp", "seq", "vec", DIM, 5, 2)


# ---- models -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def panel(spark):
    g = np.random.default_rng(9)
    x = g.integers(0, 5, (240, 6))
    y = (x / 4) @ np.array([0.5, -0.3, 0, 0.2, 0, 0.1]) + 0.05 * g.standard_normal(240)
    data = [(i, i % 6, x[i].tolist(), float(y[i])) for i in range(240)]
    return x, y, spark.createDataFrame(data, "id long, era int, features array<int>, target double").repartition(3)


def test_linear(panel):
    x, _, df = panel
    w = np.random.default_rng(1).standard_normal((6, 2))
    got = models.score_linear_many(df, w, ["a", "b"]).toPandas().pivot(index="id", columns="model", values="prediction").sort_index()
    assert np.allclose(got.to_numpy(), x / 4 @ w)


@pytest.mark.parametrize("loss", ["mse", "huber"])
def test_era_gradients(panel, loss):
    x, y, df = panel
    w = np.array([0.2, 0.1, 0, 0, 0.3, -0.2])
    got = models.era_gradients(df, w, loss, 0.1).toPandas().pivot(index="era", columns="feature", values="gradient").to_numpy()
    r = x / 4 @ w - y
    slope = 2 * r if loss == "mse" else np.clip(r, -0.1, 0.1)
    for e in range(6):
        assert np.allclose(got[e], ((x / 4) * slope[:, None])[np.arange(240) % 6 == e].mean(0))


def test_batches(spark):
    d = spark.range(200).select("id", (F.col("id") % 4).alias("era"))
    within = models.batch_assignment(d, "within", 10, 5, 1, 5).toPandas()
    assert within.groupby("step")["id"].nunique().eq(15).all() and within.groupby("step")["held_out"].sum().eq(5).all()
    assert (within.assign(era=within["id"] % 4).groupby("step")["era"].nunique() == 1).all()
    one = models.batch_assignment(d, "era", 10, 5, 1).toPandas()
    assert len(one) == 50 and (one.assign(era=one["id"] % 4).groupby("step")["era"].nunique() == 1).all()
    rows = models.batch_assignment(d, "rows", 10, 5, 1).toPandas()
    again = models.batch_assignment(d.repartition(9), "rows", 10, 5, 1).toPandas()
    assert rows.sort_values(["step", "slot"])["id"].tolist() == again.sort_values(["step", "slot"])["id"].tolist()


# ---- streaming ----------------------------------------------------------------------------

def arrive(df, chunks, build, out, mode="append"):
    replay({"live": df}, "chunk", chunks, lambda s, _: run_available(build(s["live"]), write_batches(f"{out}/rows"), f"{out}/cp", mode))


def test_keyed_fold_resumes_and_rejects_old_rows(spark):
    g = np.random.default_rng(4)
    x = g.standard_normal((90, 4))
    data = [(0, i, v.tolist(), i // 30) for i, v in enumerate(x)] + [(0, 3, [9.0] * 4, 2)]      # a late repeat
    df = spark.createDataFrame(data, "grp int, seq long, vec array<double>, chunk int")
    out = scratch(spark, "fold")
    arrive(df, 3, lambda s: keyed.stream_lowrank_cov(s, "grp", "seq", "vec", 4, 0.9), out, "update")
    got = latest(stored(spark, f"{out}/rows", "grp int, rows bigint, eigenvalues array<double>"), ["grp"], ["rows", "eigenvalues"]).first()
    _, cov = dense_fold(x, 0.9)
    assert got["rows"] == 90 and np.allclose(got["eigenvalues"], np.sort(np.linalg.eigvalsh(cov))[::-1], atol=1e-10)


def test_ema_with_a_hot_key(spark):
    x = np.random.default_rng(5).random(6000)
    df = spark.createDataFrame([(1, i, float(v), i // 3000) for i, v in enumerate(x)], "run int, seq long, loss double, chunk int")
    out = scratch(spark, "ema")
    arrive(df, 2, lambda s: keyed.stream_ema(s, "run", "seq", "loss", 0.9), out, "update")
    got = latest(stored(spark, f"{out}/rows", "run int, ema double, rows bigint"), ["run"], ["ema", "rows"]).first()
    assert got["rows"] == 6000 and got["ema"] == pytest.approx(pd.Series(x).ewm(alpha=0.1, adjust=False).mean().iloc[-1], rel=1e-12)


def live_rounds():
    """Rounds of ten rows that close at hour 2 after they begin; some rows late, some twice."""
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(r, 10 * r + i, float(i), float(-i), at(r + i / 10), at(r + 2)) for r in range(9) for i in range(10)]
    rows += [(r, 10 * r, 0.0, 0.0, at(r + 1.95), at(r + 2)) for r in (1, 3)] + [(1, 5, 9.0, 9.0, at(3), at(3))]
    return rows + [(2, 999, 1.0, 1.0, at(8.91), at(4)), (2, 21, 1.0, 1.0, at(8.92), at(4)), (None, 7, 1.0, 1.0, at(8.93), None)]


@pytest.mark.parametrize("chunks", [1, 3, 10])
def test_rounds_close_and_nothing_is_lost(spark, chunks):
    data = sorted(live_rounds(), key=lambda r: r[4])
    df = spark.createDataFrame([(*r, k * chunks // len(data)) for k, r in enumerate(data)], "round int, id long, m1 double, bench double, arrived timestamp, closes timestamp, chunk int")
    out = scratch(spark, "rounds")
    replay({"live": df}, "chunk", chunks, lambda s, _: rounds.score_rounds(s["live"], out, f"{out}/cp", ["m1"], "bench", "arrived", "closes", 1.0))
    got = stored(spark, f"{out}/scores", "round int, id bigint, prediction double").toPandas().sort_values("id")
    assert got["round"].tolist() == [r for r in range(7) for _ in range(10)] and np.allclose(got["prediction"], np.tile((np.arange(10) + 0.5) / 10, 7))
    aside = stored(spark, f"{out}/sorted", "round int, id bigint, kind string").where("kind <> 'closed'").collect()
    assert sorted((r["kind"], r["id"]) for r in aside) == [("late", 5), ("late", 7), ("late", 21), ("late", 999), ("repeated", 10), ("repeated", 30)]
    bad = sorted((r["kind"], r["key"], r["detail"]) for r in stored(spark, f"{out}/violations", rounds.ROUND_CHECKS).collect())
    assert bad == [("late", "1:5", "1"), ("late", "2:21", "1"), ("late", "2:999", "1"), ("late", "7", "1"), ("repeated", "1:10", "1"), ("repeated", "3:30", "1")]


def test_ids_leave_as_three_kinds(spark):
    data = sorted(live_rounds(), key=lambda r: r[4])
    df = spark.createDataFrame([(*r, k * 4 // len(data)) for k, r in enumerate(data)], "round int, id long, m1 double, bench double, arrived timestamp, closes timestamp, chunk int")
    out = scratch(spark, "ids")
    arrive(df, 4, lambda s: rounds.dedup_ids(s, "round", ["id"], "arrived", "closes"), out)
    got = stored(spark, f"{out}/rows", "round int, id bigint, kind string").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"first": 90, "repeated": 2, "late": 4}


@pytest.mark.parametrize("hold", [True, False])
def test_state_calls_do_not_grow_with_rows(monkeypatch, hold):
    """A share's rows go to the state store in blocks; all of them come out when the round closes."""
    import pandas as pd

    from eralens.streaming import arrivals

    class Store(dict):
        calls = 0

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def iterator(self):
            self.calls += 1
            return iter(list(self.items()))

    class Handle:
        timers = []

        def getMapState(self, *_):
            return Store()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    monkeypatch.setattr(arrivals, "BLOCK", 400)
    state = arrivals.RoundState(["id"], {"id": "bigint", "x": "double"}, hold)
    state.init(Handle())
    store = state.blocks
    frame = lambda a, b: pd.DataFrame({"id": range(a, b), "x": [i / 2 for i in range(a, b)], "closes_ms": 10, "arrived_ms": 5})
    first = pd.concat(state.handleInputRows(("k",), iter([frame(0, 600), frame(500, 1000)]), Now()))
    again = pd.concat(state.handleInputRows(("k",), iter([frame(900, 1100)]), Now()))
    assert (first["kind"] == "repeated").sum() == 100 and (again["kind"] == "repeated").sum() == 100
    assert store.calls <= 6
    closed = list(state.handleExpiredTimer(("k",), Now(), None))
    if hold:
        rows = pd.concat(closed)
        assert sorted(rows["id"]) == list(range(1100)) and (rows["x"] == rows["id"] / 2).all()
    else:
        assert not closed and (first["kind"] == "first").sum() == 1000 and (again["kind"] == "first").sum() == 100
    assert not store


def test_rows_that_spark_drops_raise(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(1, 1, at(5), at(9), 0), (1, 2, at(3), at(9), 1)], "round int, id long, arrived timestamp, closes timestamp, chunk int")
    out = scratch(spark, "dropped")
    run = lambda s, _: require_none_dropped(run_available(rounds.dedup_ids(s["live"], "round", ["id"], "arrived", "closes"), write_batches(f"{out}/rows"), f"{out}/cp"))
    with pytest.raises(CheckFailed):
        replay({"live": df}, "chunk", 2, run)


def test_round_violations(rows):
    d = rows([(1, 1, 0.1, 0.2), (1, 1, 0.1, 0.2), (1, 2, None, 0.2), (1, 3, 0.1, None)], "round int, id int, m double, b double")
    got = sorted((r["kind"], r["key"]) for r in rounds.round_violations(d, ["m"], "b").collect())
    assert got == [("benchmark_missing", "1:3"), ("duplicate", "1:1"), ("prediction_missing", "1:2")]


def test_drawdown_monitor_rejects_late_eras(spark):
    df = spark.createDataFrame([("m", 1, 0.1, 0), ("m", 2, -0.3, 0), ("m", 3, 0.2, 1), ("m", 2, 0.9, 1)], "model string, era int, corr double, chunk int")
    out = scratch(spark, "dd")
    arrive(df, 2, lambda s: keyed.stream_drawdown_monitor(s, "model", "era", "corr", 0.25), out)
    rows_ = stored(spark, f"{out}/rows", "model string, era int, cumulative double, peak double, drawdown double, alert boolean, rejected boolean").toPandas()
    ok = rows_[~rows_["rejected"]].sort_values("era")
    assert ok["drawdown"].tolist() == pytest.approx([0.0, 0.3, 0.1]) and ok["alert"].tolist() == [False, True, False]
    assert rows_["rejected"].sum() == 1


def test_feature_exposure(panel, spark):
    x, y, df = panel
    got = vectors.feature_exposure(df.withColumn("model", F.lit("m")).withColumnRenamed("target", "prediction"), ["model"], 6).first()
    era = np.arange(240) % 6
    c = np.array([[np.corrcoef(x[era == e, f], y[era == e])[0, 1] for f in range(6)] for e in range(6)])
    assert got["max_exposure"] == pytest.approx(np.abs(c.mean(axis=0)).max()) and got["features"] == 6
