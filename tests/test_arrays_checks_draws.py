"""Stored arrays, checks that fail where rows are made, permuted draws and shared resamples."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eralens.operators import inference, models, selection
from eralens.sources import arrays, tables


def test_arrays_are_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, y, z = rng.random((1000, 7)), rng.integers(0, 200, 1000).astype(np.uint8), rng.random(1000) > 0.5
    np.savez(tmp_path / "a.npz", x=x, y=y, z=z, other=np.zeros(3))
    np.savez_compressed(tmp_path / "b.npz", x=x[:10], y=y[:10], z=z[:10])
    d = arrays.read_arrays(spark, str(tmp_path), ["x", "y", "z"], rangeBytes=8000)
    assert d.rdd.getNumPartitions() > 5 and dict(d.dtypes)["y"] == "smallint"
    got = d.orderBy("file", "row").collect()
    assert [r["row"] for r in got] == [*range(1000), *range(10)]
    assert np.array_equal(np.array([r["x"] for r in got[:1000]]), x) and [r["y"] for r in got[1000:]] == y[:10].tolist() and [r["z"] for r in got[:1000]] == z.tolist()
    np.save(tmp_path / "one.npy", np.arange(5.0))
    assert [r["one"] for r in arrays.read_arrays(spark, str(tmp_path / "one.npy")).collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    with pytest.raises(PySparkException, match="no array named"):
        arrays.read_arrays(spark, str(tmp_path / "a.npz"), ["w"]).collect()
    with pytest.raises(PySparkException, match="different lengths"):
        arrays.read_arrays(spark, str(tmp_path / "a.npz"), ["x", "other"]).collect()


def test_arrays_written_by_tasks(spark, tmp_path):
    d = spark.range(500).select("id", F.array(F.col("id") * 1.5, F.lit(2.0)).alias("pair")).repartition(3)
    for compress in (False, True):
        path = str(tmp_path / f"c{compress}")
        assert arrays.write_arrays(d, path, compress).agg(F.sum("rows")).first()[0] == 500
        got = arrays.read_arrays(spark, path, rangeBytes=1000).select("id", "pair")
        assert sorted(map(tuple, got.select("id", F.col("pair")[0], F.col("pair")[1]).collect())) == [(i, 1.5 * i, 2.0) for i in range(500)]
    with pytest.raises(PySparkException, match="nulls"):
        arrays.write_arrays(d.withColumn("id", F.when(F.col("id") > 5, F.col("id"))), str(tmp_path / "d")).collect()


def test_a_task_holds_one_archive_at_a_time(spark, tmp_path):
    """However many rows a task has, they go to archives of bounded size; all are read back."""
    d, path = spark.range(0, 1000, 1, 2).select("id", (F.col("id") / 4).alias("x")), str(tmp_path / "a")
    for _ in range(2):                          # the second run replaces the first one's files
        wrote = arrays.write_arrays(d, path, file_rows=150).collect()
        assert sorted(r["rows"] for r in wrote) == [50, 50] + [150] * 6
    arrays.write_arrays(d.where("id < 700"), path, file_rows=150).collect()
    got = arrays.read_arrays(spark, path, ["id", "x"]).select("id", "x").collect()
    assert sorted(map(tuple, got)) == [(i, i / 4) for i in range(700)]


def fails(df, what):
    with pytest.raises(PySparkException, match=what):
        df.collect()


def test_nothing_is_dropped_in_silence(rows, spark, tmp_path):
    schema = "arm string, seed int, era int, corr double"
    good = [(a, s, e, 0.1 * e + s) for a in ("x", "y") for s in (0, 1) for e in range(10)] + [(a, 0, 20, None) for a in ("x", "y")]
    pair = lambda data: inference.paired_difference(rows(data, schema), "x", "y", ["seed"], "corr")
    assert pair(good).count() == 20
    fails(pair([*good, ("x", 0, 11, 0.5)]), "not paired in era 11")
    fails(pair([*good, ("x", 0, 11, 0.5), ("y", 0, 11, float("nan"))]), "not paired in era 11")
    fails(pair([*good, ("x", 0, 3, 0.5)]), "not paired in era 3")
    names = rows([("x_s0", "y_s0"), ("x_s1", "y_s1")], "model_a string, model_b string")
    several = lambda data: inference.model_pairs(rows(data, schema), ["arm", "seed"], ["corr"], names)
    assert several(good).count() == 20
    fails(several([*good, ("y", 1, 11, 0.5)]), "not paired: x_s1 y_s1 corr 11")
    pool = lambda data: inference.seed_pool(rows(data, schema), [0], [1], "corr")
    assert pool(good).count() == 20
    fails(pool([*good, ("x", 1, 12, 0.5)]), "only one pool has era 12")
    series = pair(good)
    for shared in (False, True):
        assert inference.block_bootstrap_mean(series, ["seed"], "difference", 5, 50, shared=shared).count() == 2
        fails(inference.block_bootstrap_mean(series, ["seed"], "difference", 11, 50, shared=shared), "a block of 11 eras from a series of 10")
    cells = rows([("x", c, 0.1 * c) for c in range(4)], "arm string, config_id int, corr_mean double")
    assert selection.select_topk(cells, 4).count() == 4
    fails(selection.select_topk(cells, 5), "5 candidates wanted, found 4")
    assert sorted(r["config_id"] for r in selection.restrict_candidates(cells, rows([(1,), (3,), (3,)], "config_id int")).collect()) == [1, 3]
    fails(selection.restrict_candidates(cells, rows([(1,), (9,)], "config_id int")), "no scores for 9")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "r.json").write_text('{"config_id": 1}')
    fails(tables.read_results(spark, str(tmp_path), "config_id int"), "no task in the path")


def test_draws_without_replacement(spark):
    sizes = {1: 45, 2: 46, 3: 300, 4: 12, 5: 1000, 6: 50}
    d = spark.createDataFrame([(1000 * e + k, e) for e, n in sizes.items() for k in range(n)], "id long, era int")
    got = models.batch_assignment(d, "within", 30, 60, 3, 10).toPandas()
    for _, part in got.groupby("step"):
        part = part.sort_values("slot")
        assert part["slot"].tolist() == list(range(40)) and part["id"].nunique() == 40 and (part["id"] // 1000).nunique() == 1
        assert part["held_out"].tolist() == [False] * 30 + [True] * 10 and part["id"].iloc[0] // 1000 != 4
    assert got["id"].nunique() > 400 and got.groupby("step")["id"].apply(lambda x: tuple(sorted(x))).nunique() > 50
    whole = models.permuted_positions(spark.createDataFrame([(s, n) for s, n in enumerate((1, 2, 7, 40, 41, 1000))], "step int, n long"), F.col("n"), 9).toPandas()
    assert all(sorted(p["__at"]) == list(range(len(p))) and sorted(p["__k"]) == list(range(1, len(p) + 1)) for _, p in whole.groupby("step")) and len(whole) == 1091


def test_shared_resamples_equal_the_rows(spark, rows):
    """The product with the weights gives what exploded draws give."""
    rng = np.random.default_rng(2)
    data = [(k, e, float(rng.normal())) for k, n in ((0, 37), (1, 37), (2, 20), (None, 37)) for e in range(n)]
    df = rows(data, "grp int, era int, x double")
    got = {r["grp"]: r for r in inference.block_bootstrap_mean(df, ["grp"], "x", 8, 400, 5, shared=True).collect()}
    for k in (0, 1, 2, None):
        one = df.where(F.col("grp").eqNullSafe(F.lit(k))).withColumn("grp", F.lit(1))
        boot = inference.bootstrap_samples(one, ["grp"], "x", 8, 400, 5, shared=True).toPandas()["boot_mean"]
        x = [v for g, _, v in data if g == k]
        assert got[k]["eras"] == len(x) and got[k]["estimate"] == pytest.approx(np.mean(x)) and got[k]["samples"] == 400
        assert np.allclose([got[k]["ci_low"], got[k]["ci_high"]], np.quantile(boot, [0.025, 0.975])) and got[k]["probability_positive"] == pytest.approx((boot > 0).mean())


def test_scales_are_found_by_file(spark, rows, tmp_path):
    from eralens.operators import panel

    for name, data in (("unit", [0.0, 0.25, 1.0, None]), ("codes", [0.0, 4.0, 3.0, float("nan")])):
        rows([(name, v) for v in data], "name string, x double").coalesce(1).write.parquet(str(tmp_path / f"d/name={name}"))
    got = panel.encode_files(spark.read.parquet(str(tmp_path / "d")).drop("name").select("x"), ["x"])
    assert sorted(r["x"] for r in got.collect()) == [0, 0, 1, 2, 2, 3, 4, 4]
    for bad in ([0.5, 3.0], [0.3], [7.0], [-1.0, 2.0]):
        path = str(tmp_path / f"bad{bad[0]}")
        rows([(v,) for v in bad], "x double").coalesce(1).write.parquet(path)
        fails(panel.encode_files(spark.read.parquet(path), ["x"]), "is no bin of scale")


def test_bucketed_joins_shuffle_nothing(spark, rows):
    from eralens.operators import align

    left = tables.write_bucketed(spark.range(1000).withColumn("era", F.col("id") % 7), "id", 4)
    right = tables.write_bucketed(spark.range(0, 1000, 3).withColumn("bench", F.col("id") * 2), "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = align.benchmark_left_join(left, right)
        assert joined.count() == 1000 and joined.where("bench = 2 * id").count() == 334
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_round_that_changes_between_batches(spark, tmp_path):
    from eralens.session import scratch
    from eralens.streaming import rounds
    from eralens.streaming.sink import replay, stored

    df = spark.createDataFrame([(5, k, 0) for k in range(4)] + [(5, 9, 1)] + [(6, 10, 2), (6, 11, 2)] + [(6, 12, 3), (7, 13, 3)], "round int, id int, chunk int")
    out = scratch(spark, "constancy")
    replay({"live": df}, "chunk", 4, lambda s, _: rounds.round_constancy(s["live"], out, f"{out}/cp"))
    got = stored(spark, f"{out}/rounds", "first_round int, last_round int, rows bigint, constant boolean, before int, changed boolean").orderBy("batch_id").collect()
    assert [(r["rows"], r["constant"], r["before"], r["changed"]) for r in got] == [(4, True, None, False), (1, True, 5, False), (2, True, 5, True), (2, False, 6, False)]
