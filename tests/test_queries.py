"""The registered queries against their SQL on the smallest tables.

All of them take some minutes; by default a part runs. ERALENS_ALL_QUERIES=1 runs all."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("ERALENS_TEST_DATA", "/root/testdata/sf0.001"))
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("corr_official", "bmc_covered_only", "benchmark_blend", "ema", "verdict", "select_budgeted", "equal_coverage", "inner_splits",
        "exact_alignment", "row_index", "ordered_id_digest", "batch_assignment", "stream_ema", "read_results")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    return con


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ERALENS_ALL_QUERIES") else SOME)
def test_query_equals_sql(spark, duck, name):
    from check import norm

    got = norm(entry.queries()[name](spark, str(DATA)).toPandas())
    want = norm(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["seed", "estimate", "ci_low", "ci_high", "threshold", "category", "wording"]
