import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eralens.functions.checks import CheckFailed, require
from eralens.functions.ranking import Split
from eralens.operators import align, panel, splits
from eralens.sources import tables

NAN = float("nan")


def kinds(df):
    return sorted((r["kind"], r["key"]) for r in df.collect())


# ---- preparation ------------------------------------------------------------------------

def test_encode_bins(rows):
    d = rows([(float(i), i / 4) for i in range(5)] + [(5.0, 0.3), (NAN, None)], "c double, u double")
    got = d.select(panel.encode_bins(F.col("c"), "codes").alias("c"), panel.encode_bins(F.col("u"), "unit").alias("u")).collect()
    assert [(r["c"], r["u"]) for r in got] == [(i, i) for i in range(5)] + [(None, None), (2, 2)]
    with pytest.raises(ValueError):
        panel.encode_bins(F.col("c"), "guess")


def test_normalise_live(rows):
    codes = panel.normalise_live_features(rows([(1, [0.0, 4.0]), (2, [2.0, NAN])], "id int, features array<double>")).orderBy("id").collect()
    assert codes[0]["normalised"] == [0.0, 1.0] and codes[0]["valid"]
    assert not codes[1]["valid"]          # a filled half is not an integer code
    unit = panel.normalise_live_features(rows([(1, [0.25, None])], "id int, features array<double>")).first()
    assert unit["normalised"] == [0.25, 0.5] and unit["valid"]


def test_normalise_live_scales_each_round(rows):
    d = rows([(7, 1, [0.0, 4.0]), (8, 2, [1.0, 0.5]), (None, 3, [2.0, 0.0])], "round int, id int, features array<double>")
    got = {r["id"]: (r["normalised"], r["valid"]) for r in panel.normalise_live_features(d, by=["round"]).collect()}
    assert got == {1: ([0.0, 1.0], True), 2: ([1.0, 0.5], True), 3: ([0.5, 0.0], True)}


def test_feature_subset(rows):
    d = rows([(1, [10, 20, 30])], "id int, features array<int>")
    assert panel.select_feature_subset(d, ["a", "b", "c"], ["c", "a"]).first()["features"] == [30, 10]
    for wanted in (["a", "a"], ["z"]):
        with pytest.raises(ValueError):
            panel.select_feature_subset(d, ["a", "b", "c"], wanted)


def test_cap_and_permute(spark):
    d = spark.range(1000).select("id", (F.col("id") % 3).alias("era"), (F.col("id") * 2.0).alias("target"))
    capped = panel.cap_rows_per_era(d, 40, 1)
    assert {r["count"] for r in capped.groupBy("era").count().collect()} == {40}
    ids = {r["id"] for r in capped.collect()}
    assert ids == {r["id"] for r in panel.cap_rows_per_era(d.repartition(9), 40, 1).collect()} != {r["id"] for r in panel.cap_rows_per_era(d, 40, 2).collect()}
    for plan in (None, Split(rows=50, max_splits=16, sample=1)):
        p = panel.permute_column(d, "target", 3, plan=plan).toPandas()
        assert sorted(p["target_permuted"]) == sorted(p["target"]) and (p["target_permuted"] != p["target"]).mean() > 0.9


def test_zero_predictor_is_standard_normal(spark):
    r = panel.zero_predictor(spark.range(20000), 1).agg(F.avg("zero_prediction").alias("m"), F.stddev("zero_prediction").alias("s")).first()
    assert abs(r["m"]) < 0.03 and abs(r["s"] - 1) < 0.03


def test_usable_and_manifest(rows):
    d = rows([(1, 0.5), (1, None), (2, 0.5), (2, 0.25)], "era int, target double")
    assert [r["era"] for r in panel.usable_eras(d).collect()] == [2]
    m = panel.panel_manifest(d, ["target"]).first()
    assert (m["rows"], m["eras"], m["era_min"], m["era_max"], m["target_rows"], m["target_eras"]) == (4, 2, 1, 2, 3, 2)


# ---- splits -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def eras(spark):
    return spark.range(1, 575).select(F.col("id").cast("int").alias("era"))


def roles(df, split, role):
    return sorted(r["era"] for r in df.where((F.col("split") == split) & (F.col("role") == role)).collect())


def test_published_blocks(eras):
    outer = splits.outer_splits(eras)
    for name, (a, b) in zip(("outer_1", "outer_2", "outer_3"), splits.OUTER_BLOCKS):
        assert roles(outer, name, "valid") == list(range(a, b + 1))
        assert roles(outer, name, "purged") == list(range(a - 16, a))
        assert roles(outer, name, "train") == list(range(1, a - 16))
    inner = splits.inner_splits(outer)
    assert max(roles(inner, "outer_1_inner_1", "train")) == 140
    assert roles(inner, "outer_1_inner_1", "purged") == list(range(141, 157))
    assert roles(inner, "outer_1_inner_2", "valid") == list(range(235, 297))
    assert splits.split_violations(outer.unionByName(inner), 16).count() == 0
    assert max(roles(splits.tail_purge_refit_split(eras), "refit", "train")) == 558


def test_short_purge_and_empty_block_are_reported(eras):
    late = splits.expanding_split(eras.where("era > 5"), [("x", 10, 20)], 16)
    assert {k for k, _ in kinds(splits.split_violations(late, 16))} >= {"purge_count"}
    gone = splits.expanding_split(eras, [("y", 600, 610)], 16)
    assert ("empty_valid", "y") in kinds(splits.split_violations(gone, 16))
    with pytest.raises(CheckFailed):
        require(splits.split_violations(gone, 16), "split")


def test_embargo(eras):
    got = splits.block_split_with_embargo(eras.where("era <= 60"), 20, splits.embargo_eras(20, 5)).toPandas()
    by = got.groupby("role")["era"].apply(list).to_dict()
    assert by["dropped_boundary"] == [21, 22, 23, 24] and by["tuning"] == list(range(25, 46))
    assert by["embargoed"] == [46, 47, 48, 49] and by["verdict"] == list(range(50, 61))


# ---- alignment ----------------------------------------------------------------------------

def test_alignment_kinds(rows):
    base = [(i, i / 10) for i in range(5)]
    d = lambda x: rows(x, "id int, v double")
    assert kinds(align.exact_alignment(d(base), d(base[::-1]), "id", "v")) == []       # a shuffle is none once keyed
    assert kinds(align.exact_alignment(d(base), d(base[1:]), "id", "v")) == [("missing_right", "0")]
    assert kinds(align.exact_alignment(d(base[:-1]), d(base), "id", "v")) == [("missing_left", "4")]
    assert kinds(align.exact_alignment(d(base), d([*base, (2, 0.2)]), "id", "v")) == [("duplicate", "2")]
    assert kinds(align.exact_alignment(d(base), d([*base[:4], (4, None)]), "id", "v")) == [("null", "4")]


def test_exact_alignment_reads_each_side_once(spark, tmp_path):
    for side in ("l", "r"):
        spark.range(50).selectExpr("id", "id / 2 AS v").write.parquet(str(tmp_path / side))
    left, right = (spark.read.parquet(str(tmp_path / side)) for side in ("l", "r"))
    plan = align.exact_alignment(left, right, "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1


def test_repeated_benchmark_ids_fail(rows):
    p = rows([(1,), (2,), (3,)], "id int")
    once = align.benchmark_left_join(p, rows([(1, 0.5), (2, 0.6), (None, 0.7), (None, 0.8)], "id int, benchmark double"))
    assert {r["id"]: r["benchmark"] for r in once.collect()} == {1: 0.5, 2: 0.6, 3: None}
    with pytest.raises(PySparkException, match="benchmark id repeated: 2"):
        align.benchmark_left_join(p, rows([(2, 0.5), (2, 0.6)], "id int, benchmark double")).collect()


def test_seed_alignment_treats_null_as_equal(rows):
    d = rows([(1, 0, None), (1, 1, None), (2, 0, 0.5), (2, 1, 0.25)], "id int, seed int, target double")
    assert kinds(align.seed_alignment(d, ["id"], ["target"], 2)) == [("disagree", "2")]


def test_membership_does_not_fan_out(rows):
    a = rows([(1, 1.0, None), (1, 1.0, None), (1, 2.0, 3.0)], "era int, x double, y double")
    b = rows([(1.0, None), (1.0, None), (9.0, 9.0)], "x double, y double")
    r = align.row_membership_audit(a, b, ["x", "y"]).first()
    assert (r["rows"], r["matched"]) == (3, 2)


def test_search_identity(rows):
    res = rows([(1, 5), (2, 6), (3, 7), (4, 8)], "config_id int, lr int")
    draws = rows([(1, 5), (2, 9), (3, 7), (3, 7)], "config_id int, lr int")
    got = {r["config_id"]: r["status"] for r in align.search_identity_join(res, draws, "config_id", ["lr"]).collect()}
    assert got == {1: "match", 2: "differs", 3: "ambiguous", 4: "unknown"}


def test_append_resolved(rows):
    tr = rows([(1, 1, 0.1), (2, 1, 0.2)], "id int, era int, target double")
    va = rows([(3, 2, 0.3), (4, 2, None), (5, 3, 0.4), (6, 3, NAN)], "id int, era int, target double")
    got = align.append_resolved(tr, va, ["id", "era", "target"]).orderBy("id").toPandas()
    assert got["target"].tolist() == [0.1, 0.2, 0.3, 0.4]
    with pytest.raises(CheckFailed, match="era_overlap"):
        align.append_resolved(tr, tr, ["id", "era", "target"])
    assert align.append_violations(tr, va).count() == 0 and kinds(align.append_violations(tr, tr)) == [("era_overlap", "1")]


def test_coverage_boundary(rows):
    d = rows([(1, 1, None), (2, 2, 0.1), (3, 1, 0.2), (4, 2, None)], "id int, era int, benchmark double")
    assert kinds(align.coverage_boundary_check(d, 2)) == [("coverage", "3"), ("coverage", "4")]


# ---- sources --------------------------------------------------------------------------------

def test_panel_store_prunes_partitions(spark, tmp_path):
    d = spark.range(300).select("id", (F.col("id") % 5).cast("int").alias("era"), F.rand(1).alias("x"))
    path = str(tmp_path / "panel")
    tables.write_panel(d, path)
    scan = tables.scan_panel(spark, path, ["id", "era"], eras=[2, 3])
    assert scan.count() == 120
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "era" in plan.split("PartitionFilters:")[1][:80] and "x#" not in plan


def test_manifest_columns_are_checked(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("10;a\tfold\t5000\t0\tplain\t3\n")
    (tmp_path / "bad.tsv").write_text("10;a\tfold\t5000\n")
    assert tables.read_manifest_tsv(spark, str(tmp_path / "good.tsv")).first()["job"] == "10"
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        tables.read_manifest_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "empty.tsv").write_text("")
    assert kinds(tables.manifest_violations(tables.read_manifest_tsv(spark, str(tmp_path / "empty.tsv")))) == [("empty", "manifest")]
