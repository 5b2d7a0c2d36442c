import itertools

import pytest
from pyspark.sql import functions as F

from eralens.operators import audit, selection

SCHEMA = "arm string, config_id int, split string, updates int, seed int, corr_mean double"


def kinds(df):
    return sorted((r["kind"], r["key"]) for r in df.collect())


def table(rows, values, updates=5000):
    """values: {(arm, config): [score per split]}"""
    return rows([(a, c, f"s{i}", updates, 0, float(v)) for (a, c), vs in values.items() for i, v in enumerate(vs)], SCHEMA)


def test_topk_order(rows):
    d = table(rows, {("filtered", 3): [0.2, 0.4], ("filtered", 1): [0.3, 0.3], ("filtered", 2): [0.3, 0.3], ("plain", 1): [0.1, 0.1]})
    got = selection.select_topk(d, 3, complete=False).where("arm = 'filtered'").orderBy("place").toPandas()["config_id"].tolist()
    assert got == [1, 2, 3]                  # same mean: better worst cell, then lower id
    assert kinds(selection.too_few(selection.select_topk(d, 3, complete=False), 3)) == [("too_few", "plain")]
    assert {r["config_id"] for r in selection.paired_union(selection.select_topk(d, 1)).collect()} == {1}


def test_budget_tie_takes_the_smaller(rows):
    d = table(rows, {("plain", 1): [0.2]}, 20000).unionByName(table(rows, {("plain", 1): [0.2]}, 5000))
    assert selection.select_budgeted(d, 1).first()["updates"] == 5000


def test_equal_coverage(rows):
    good = table(rows, {(a, c): [0.1, 0.2] for a in ("filtered", "plain") for c in (1, 2, 3)})
    cand = ["arm", "config_id"]
    check = lambda d: kinds(selection.equal_coverage(d, cand, single_budget=True, arms=selection.ARMS))
    assert check(good) == []
    assert check(good.where("NOT (config_id = 2 AND arm = 'plain' AND split = 's1')")) == [("coverage", "plain:2")]
    # same number of cells, other cells
    moved = good.withColumn("split", F.when((F.col("config_id") == 3) & (F.col("arm") == "plain") & (F.col("split") == "s1"), "s9").otherwise(F.col("split")))
    assert check(moved) == [("coverage", "plain:3")]
    assert ("duplicate", "plain:1") in check(good.unionByName(good.where("arm = 'plain' AND config_id = 1 AND split = 's0'")))
    assert ("one_arm_only", "3") in check(good.where("NOT (config_id = 3 AND arm = 'plain')"))
    assert ("missing_value", "plain:1") in check(good.withColumn("corr_mean", F.when((F.col("arm") == "plain") & (F.col("config_id") == 1), None).otherwise(F.col("corr_mean"))))


def test_halving_forces_the_source(rows):
    d = table(rows, {(a, c): [0.1 * c] for a in ("filtered", "plain") for c in range(1, 6)})
    d = d.unionByName(d.withColumn("updates", F.lit(20000)))
    plan = selection.successive_halving_plan(d, 2, 1, 1).collect()
    at = lambda s, u: sorted(r["config_id"] for r in plan if (r["stage"], r["updates"]) == (s, u))
    assert at("confirmation", 5000) == [4, 5] and at("confirmation", 20000) == [1, 4, 5] and at("long_scout", 0) == [1, 5]


def test_assemble(rows):
    plan = rows([("confirmation", 5000, 1)], "stage string, updates int, config_id int")
    want = selection.expected_cells(plan, ["s0"], [0, 1])
    have = rows([(a, 1, "s0", 5000, s, 0.1) for a, s in itertools.product(("filtered", "plain"), (0, 2))], SCHEMA)
    got = sorted((r["arm"], r["seed"], r["status"]) for r in selection.assemble_equal_cells(have, want).collect())
    assert got == sorted([(a, s, st) for a in ("filtered", "plain") for s, st in ((0, "present"), (1, "missing"), (2, "extra"))])


def test_blend_needs_a_stable_arm(rows):
    score = "arm string, weight double, era int, split string, corr double, bmc double"
    blends = rows([(a, w, e, f"f{e % 2}", 0.1 + w * (a == "filtered"), 0.0) for a in ("filtered", "plain") for w in (0.5, 1.0) for e in range(4)], score)
    ens = rows([(a, e, f"f{e % 2}", 0.1 if a == "plain" or e % 2 else -0.1) for a in ("filtered", "plain") for e in range(4)], "arm string, era int, split string, corr double")
    got = selection.select_blend(blends, ens, ens.withColumn("seed", F.lit(0))).where("selected").collect()
    assert [(r["arm"], r["weight"]) for r in got] == [("plain", 1.0)]


def test_stopping_point_rounds_half_to_even(rows):
    h = rows([("a", "s0", 80, 0.1), ("a", "s1", 80, 0.3), ("a", "s0", 160, 0.2), ("a", "s1", 160, 0.2)], "arm string, split string, updates int, corr_mean double")
    r = selection.select_stopping_point(h, 16, 2, 5).first()
    assert (r["examples"], r["updates"], r["refit_updates"]) == (80, 5, 12)     # 12.5 -> 12


def test_leaderboard(rows):
    d = rows([(1, "a", 0.5, None), (1, "b", 0.1, 1.0), (2, "c", 0.3, 3.0)], "rank int, username string, x double, y double")
    got = {r["metric"]: r for r in selection.leaderboard_summary(d, ["x", "y"]).collect()}
    assert got["x"]["median"] == pytest.approx(0.3) and got["x"]["p90"] == pytest.approx(0.46) and got["x"]["top_rank_values"] == 2
    assert got["y"]["missing_rows"] == 1 and got["y"]["top_rank_mean"] == 1.0
    assert kinds(selection.leaderboard_violations(d.unionByName(d.where("username = 'c'")))) == [("duplicate", "c")]


def test_grid_slices(rows):
    d = rows([(lr, wd, 1.0 - (lr - 2) ** 2 - wd) for lr in (1, 2, 3) for wd in (0, 1)], "lr int, wd int, v double")
    got = {r["axis"]: r for r in selection.grid_axis_slices(d, ["lr", "wd"], "v").collect()}
    assert got["lr"]["shape"] == "interior_peak" and not got["lr"]["on_boundary"]
    assert got["wd"]["shape"] == "monotone" and got["wd"]["on_boundary"] and got["wd"]["still_improving"]


# ---- audits -------------------------------------------------------------------------------

def test_metric_reproduction(rows):
    a = rows([(1, 0.1), (2, 0.2), (3, None)], "era int, corr double")
    same = audit.metric_reproduction(a, a, ["era"], ["corr"]).first()
    assert (same["compared"], same["unmatched"], same["outside"]) == (3, 0, 0)
    b = rows([(1, 0.1 + 1e-12), (2, 0.2001), (4, 0.1)], "era int, corr double")
    r = audit.metric_reproduction(a, b, ["era"], ["corr"]).first()
    assert (r["compared"], r["unmatched"], r["outside"]) == (2, 2, 1)


def test_digest_depends_on_order_and_content(spark):
    d = spark.range(5000).select("id", (F.col("id") * 7 % 5000).alias("o"))
    one = audit.ordered_id_digest(d, ["id"], block=64).first()["digest"]
    assert one == audit.ordered_id_digest(d.repartition(7), ["id"], block=64).first()["digest"]
    assert one != audit.ordered_id_digest(d, ["o"], block=64).first()["digest"]
    assert one != audit.ordered_id_digest(d.where("id <> 17"), ["id"], block=64).first()["digest"]


def test_fingerprint(spark):
    d = spark.range(1000).select("id", F.lit("x").alias("t"))
    f = lambda x: tuple(audit.table_fingerprint(x).first())
    assert f(d) == f(d.repartition(9)) != f(d.withColumn("t", F.when(F.col("id") == 5, "y").otherwise("x")))


def test_rank_formula(rows):
    steps = rows([(s,) for s in (1, 2, 3, 40, 500)], "s int")
    got = [r[0] for r in steps.select(audit.rank_formula(100, 30, F.col("s"))).collect()]
    q, rem = divmod(100, 30)
    assert got == [sum(min(q + (i < rem), s - 1) for i in range(30)) for s in (1, 2, 3, 40, 500)]


def test_round_and_range_checks(rows):
    live = rows([(1, None), (2, 0.5), (2, None)], "id int, target double")
    bench = rows([(1, 0.1), (3, None)], "id int, benchmark double")
    assert kinds(audit.live_round_checks(live, bench)) == sorted([
        ("duplicate", "2"), ("no_benchmark", "2"), ("no_benchmark", "2"), ("not_live", "3"), ("revealed_target", "2"), ("benchmark_missing", "3")])
    p = rows([(1, 0.5), (2, 1.0), (4, 0.2)], "id int, prediction double")
    ids = rows([(1,), (2,), (3,)], "id int")
    assert kinds(audit.prediction_range_check(p, ids)) == [("missing", "3"), ("range", "2"), ("unknown", "4")]


def test_prediction_diff(rows):
    a = rows([(1, 0.1), (2, 0.5), (3, 0.9)], "id int, prediction double")
    b = a.withColumn("prediction", F.col("prediction") + 5e-5)
    assert audit.prediction_diff(a, b).first()["passed"]
    assert not audit.prediction_diff(a, b.where("id < 3")).first()["passed"]


def test_one_touch(rows):
    d = rows([("a",), ("b",), ("b",)], "sig string")
    assert kinds(audit.one_touch_audit(d, "sig")) == [("touched", "b")]


def test_round_checks_with_null_and_repeated_ids(rows):
    live = rows([(1, None), (1, None), (2, 0.5), (None, None)], "id int, target double")
    bench = rows([(2, None), (2, None), (3, 0.1)], "id int, benchmark double")
    got = sorted(((r["kind"], r["key"]) for r in audit.live_round_checks(live, bench).collect()), key=str)
    assert got == sorted([
        ("duplicate", "1"), ("no_benchmark", "1"), ("no_benchmark", "1"), ("no_benchmark", None), ("revealed_target", "2"),
        ("benchmark_missing", "2"), ("benchmark_missing", "2"), ("not_live", "3")], key=str)


def test_one_armed_candidates(rows):
    d = rows([("plain", 1, 5), ("filtered", 1, 5), ("plain", 2, 5), ("filtered", None, 5), ("other", 3, 5)], "arm string, config_id int, updates int")
    got = {(r["kind"], r["key"]) for r in selection.arm_pair_difference(d, ("plain", "filtered")).collect()}
    assert got == {("only_plain", "2:5"), ("only_filtered", "5")}
