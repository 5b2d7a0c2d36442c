"""Joins by key and the checks that two tables describe the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralens.functions.checks import findings, require, violation
from eralens.functions.exprs import finite
from eralens.functions.ranking import AUTO, Plan, row_positions


def benchmark_left_join(panel: DataFrame, bench: DataFrame, key: str = "id") -> DataFrame:
    """No broadcast hint: the benchmark grows with the panel, AQE decides by size. A
    benchmark id that is repeated fails the job; its count shares the join's shuffle."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    repeated = F.raise_error(F.concat(F.lit(f"benchmark {key} repeated: "), F.col(key).cast("string")))
    once = bench.where(F.col(key).isNotNull()).withColumn("__n", n).where(F.when(F.col("__n") == 1, True).otherwise(repeated))
    return panel.join(once.drop("__n"), key, "left")


def duplicate_violations(df: DataFrame, keys: Sequence[str], kind: str = "duplicate") -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return violation(n, kind, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), F.col("n"))


def coverage_boundary_check(df: DataFrame, first_era: int, column: str = "benchmark", key: str = "id", era: str = "era") -> DataFrame:
    """Rows that have a value before ``first_era``, or none from it on."""
    wrong = (F.col(era) >= first_era) != F.col(column).isNotNull()
    return violation(df.where(wrong), "coverage", F.col(key), F.col(era))


def era_agreement_check(left: DataFrame, right: DataFrame, key: str = "id", era: str = "era") -> DataFrame:
    j = left.select(key, F.col(era).alias("le")).join(right.select(key, F.col(era).alias("re")), key)
    return violation(j.where(F.col("le") != F.col("re")), "era", F.col(key), F.concat_ws(":", F.col("le").cast("string"), F.col("re").cast("string")))


def inner_join_predictions(panel: DataFrame, predictions: DataFrame, key: str = "id", needed: Sequence[str] = ("target", "prediction")) -> DataFrame:
    j = panel.join(predictions, key)
    for c in needed:
        j = j.where(finite(F.col(c)))
    return j


def row_membership_audit(a: DataFrame, b: DataFrame, columns: Sequence[str], era: str = "era") -> DataFrame:
    """Per era: rows of a, and how many of them exist in b on all columns. Both sides
    are counted by value first, so repeated rows neither fan out nor pile up."""
    counted = a.groupBy(era, *columns).agg(F.count(F.lit(1)).alias("n"))
    seen = b.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct().withColumn("__in", F.lit(True))
    same = None
    for c in columns:
        e = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = e if same is None else same & e
    j = counted.join(seen, same, "left")
    got = F.sum(F.when(F.col("__in"), F.col("n")).otherwise(F.lit(0)))
    return j.groupBy(era).agg(F.sum("n").alias("rows"), got.alias("matched")).withColumn("share", F.col("matched") / F.col("rows"))


def exact_alignment(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Violations of 'same unique keys, no missing values' between two tables."""
    def side(df, tag):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.count(F.when(~finite(F.col(value)), 1)).alias(f"null_{tag}"))

    j = side(left, "l").join(side(right, "r"), key, "full")
    return findings(
        j, F.col(key),
        ("missing_left", F.col("n_l").isNull()),
        ("missing_right", F.col("n_r").isNull()),
        ("duplicate", (F.col("n_l") > 1) | (F.col("n_r") > 1)),
        ("null", (F.col("null_l") > 0) | (F.col("null_r") > 0)),
    )


def seed_alignment(df: DataFrame, keys: Sequence[str], fields: Sequence[str], expected: int | None = None) -> DataFrame:
    """Rows on which the copies (seeds, arms) disagree; NULL equals NULL. Extremes of a
    hash of the fields are compared, so a key's copies are never collected."""
    h = F.xxhash64(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\0null")) for f in fields]))
    g = df.groupBy(*keys).agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.count(F.lit(1)).alias("n"))
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    cases = [("disagree", F.col("lo") != F.col("hi"), F.col("n"))]
    if expected is not None:
        cases.append(("copies", F.col("n") != expected, F.col("n")))
    return findings(g, key, *cases)


def target_alias_check(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per pair of columns: identical including missingness, and how many rows differ."""
    wide = df.agg(*[F.count(F.when(~F.col(a).eqNullSafe(F.col(b)), 1)).alias(f"{a}={b}") for a, b in pairs])
    long = wide.unpivot([], [f"{a}={b}" for a, b in pairs], "pair", "different")
    return long.withColumn("identical", F.col("different") == 0)


def paired_arms(df: DataFrame, keys: Sequence[str], arms: tuple[str, str], value: str, shared: Sequence[str]) -> DataFrame:
    """One row per key with both arms' values; flags missing or repeated partners and
    shared fields that differ."""
    a, b = arms
    aggs = []
    for tag, arm in (("a", a), ("b", b)):
        is_arm = F.col("arm") == arm
        aggs += [F.count(F.when(is_arm, 1)).alias(f"n_{tag}"), F.max(F.when(is_arm, F.col(value))).alias(f"{value}_{tag}")]
        aggs += [F.max(F.when(is_arm, F.col(s))).alias(f"__{s}_{tag}") for s in shared]
    g = df.where(F.col("arm").isin(a, b)).groupBy(*keys).agg(*aggs)
    equal = F.lit(True)
    for s in shared:
        equal = equal & F.col(f"__{s}_a").eqNullSafe(F.col(f"__{s}_b"))
    paired = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    return g.select(*keys, f"{value}_a", f"{value}_b", paired.alias("paired"), equal.alias("shared_equal"))


def search_identity_join(results: DataFrame, draws: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Every result must match exactly one draw with equal fields; adds the SHA-256 of
    the result's fields as JSON in name order."""
    d = draws.groupBy(key).agg(F.count(F.lit(1)).alias("draws"), *[F.max(f).alias(f"__{f}") for f in fields])
    j = results.join(d, key, "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    sign = F.sha2(F.to_json(F.struct(*sorted([key, *fields]))), 256)
    n = F.coalesce("draws", F.lit(0)).cast("bigint")
    status = F.when(n == 0, "unknown").when(n > 1, "ambiguous").when(~same, "differs").otherwise("match")
    return j.select(*results.columns, n.alias("draws"), status.alias("status"), sign.alias("signature"))


def arm_seed_pivot(df: DataFrame, keys: Sequence[str], arms: tuple[str, str], value: str) -> DataFrame:
    """Long to wide by arm with the difference first - second."""
    wide = df.groupBy(*keys).pivot("arm", list(arms)).agg(F.first(value))
    return wide.withColumn("difference", F.col(arms[0]) - F.col(arms[1]))


def append_resolved(train: DataFrame, validation: DataFrame, columns: Sequence[str], target: str = "target", era: str = "era") -> DataFrame:
    """Train rows plus the validation rows whose target is known; raises if they share an era."""
    require(append_violations(train, validation, era), "append")
    return train.select(*columns).unionByName(validation.where(finite(F.col(target))).select(*columns))


def append_violations(train: DataFrame, validation: DataFrame, era: str = "era") -> DataFrame:
    both = train.select(era).distinct().join(validation.select(era).distinct(), era, "left_semi")
    return violation(both, "era_overlap", F.col(era))


def row_index(df: DataFrame, order: Sequence[str] = ("era", "id"), out: str = "row_index", plan: Plan = AUTO) -> DataFrame:
    """Dense 0-based position in a total order."""
    return row_positions(df, [], list(order), out, plan)
