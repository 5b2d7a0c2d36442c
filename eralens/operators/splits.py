"""Time-aware splits of the eras into train, purged and validation roles.

Input is the table of distinct eras; a split table is long: (split, era, role).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralens.functions.checks import findings, together, violation

# The published protocol's validation blocks, purge and smallest inner block.
OUTER_BLOCKS = ((313, 390), (391, 468), (469, 574))
INNER_BLOCKS = ((157, 234), (235, 312), (313, 390), (391, 468))
PURGE = 16
MIN_INNER_ERAS = 48


def distinct_eras(df: DataFrame, era: str = "era") -> DataFrame:
    return df.select(F.col(era).cast("int").alias("era")).distinct()


def _role(start: Column, end: Column, purge: int) -> Column:
    e = F.col("era")
    return (
        F.when(e.between(start, end), "valid")
        .when((e < start) & (e >= start - purge), "purged")
        .when(e < start - purge, "train")
    )


def _blocks(blocks: Sequence[tuple[str, int, int]]) -> Column:
    """The few named blocks as an array: exploding it on the era table needs no join."""
    return F.explode(F.array(*[
        F.struct(F.lit(n).alias("split"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in blocks
    ]))


def expanding_split(eras: DataFrame, blocks: Sequence[tuple[str, int, int]], purge: int = PURGE) -> DataFrame:
    """(name, first, last) validation blocks; train ends ``purge`` eras before."""
    d = eras.select("era", _blocks(blocks).alias("b")).select("era", "b.*")
    return d.withColumn("role", _role(F.col("start"), F.col("end"), purge)).where(F.col("role").isNotNull()).select("split", "era", "role")


def outer_splits(eras: DataFrame, blocks: Sequence[tuple[int, int]] = OUTER_BLOCKS, purge: int = PURGE) -> DataFrame:
    return expanding_split(eras, [(f"outer_{i + 1}", a, b) for i, (a, b) in enumerate(blocks)], purge)


def inner_splits(outer: DataFrame, blocks: Sequence[tuple[int, int]] = INNER_BLOCKS, purge: int = PURGE,
                 least: int = MIN_INNER_ERAS) -> DataFrame:
    """Inner blocks wholly inside each outer train range, clipped at its last era and
    kept if long enough; numbered in order. Windows run over the few eras of a split."""
    train = outer.where(F.col("role") == "train").select(F.col("split").alias("outer"), "era")
    d = train.withColumn("last", F.max("era").over(W.partitionBy("outer")))
    d = d.select("outer", "era", "last", _blocks([("", a, b) for a, b in blocks]).alias("b"))
    d = d.select("outer", "era", F.col("b.start").alias("start"), F.least("b.end", "last").alias("end"))
    d = d.where(F.col("end") - F.col("start") + 1 >= least)
    number = F.dense_rank().over(W.partitionBy("outer").orderBy("start"))
    d = d.withColumn("split", F.concat("outer", F.lit("_inner_"), number.cast("string")))
    return d.withColumn("role", _role(F.col("start"), F.col("end"), purge)).where(F.col("role").isNotNull()).select("split", "era", "role")


def resolve_split(splits: DataFrame, name: str) -> DataFrame:
    return splits.where(F.col("split") == name)


def tail_purge_refit_split(eras: DataFrame, purge: int = PURGE, name: str = "refit") -> DataFrame:
    """Train on all eras but the last ``purge`` ones."""
    tail = eras.orderBy(F.desc("era")).limit(purge).withColumn("tail", F.lit(True))
    role = F.when(F.col("tail"), "purged").otherwise("train")
    return eras.join(tail, "era", "left").select(F.lit(name).alias("split"), "era", role.alias("role"))


def embargo_eras(horizon_days: int = 20, spacing_days: int = 5) -> int:
    return -(-horizon_days // spacing_days)


def block_split_with_embargo(eras: DataFrame, train_end: int, embargo: int, share: float = 0.6) -> DataFrame:
    """Drop eras too close to train, then tuning = first share, a gap, and verdict."""
    free = F.col("era") > train_end + embargo
    everything = W.partitionBy(F.col("era") > train_end + embargo)   # over the era list only
    d = eras.where(F.col("era") > train_end).withColumn("k", F.row_number().over(everything.orderBy("era")))
    d = d.withColumn("cut", F.floor(F.count(F.lit(1)).over(everything) * share))
    tuning = free & (F.col("k") <= F.col("cut"))
    d = d.withColumn("last", F.max(F.when(tuning, F.col("era"))).over(everything))
    role = (
        F.when(~free, "dropped_boundary").when(tuning, "tuning")
        .when(F.col("era") <= F.col("last") + embargo, "embargoed").otherwise("verdict")
    )
    return d.select("era", role.alias("role"))


def split_role_join(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Label panel rows with their role in every split (era equi-join)."""
    return panel.join(splits, "era")


def split_violations(splits: DataFrame, purge: int) -> DataFrame:
    """Empty validation, short purge, wrong gap, or an era with two roles."""
    s = splits.groupBy("split").agg(
        F.count(F.when(F.col("role") == "valid", 1)).alias("valid"),
        F.count(F.when(F.col("role") == "purged", 1)).alias("purged"),
        F.max(F.when(F.col("role") == "train", F.col("era"))).alias("train_max"),
        F.min(F.when(F.col("role") == "valid", F.col("era"))).alias("valid_min"),
    )
    gap = F.col("valid_min") - F.col("train_max") - 1
    twice = splits.groupBy("split", "era").agg(F.countDistinct("role").alias("roles")).where(F.col("roles") > 1)
    return together(
        findings(s, F.col("split"), ("empty_valid", F.col("valid") == 0), ("purge_count", F.col("purged") != purge, F.col("purged")),
                 ("gap", gap != purge, gap)),
        violation(twice, "role_overlap", F.concat_ws(":", "split", F.col("era").cast("string"))),
    )


def allowed_era_violations(loaded: DataFrame, allowed: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Loaded eras outside the allowed block, or inside a forbidden one."""
    eras = loaded.select("era").distinct()
    parts = [violation(eras.join(allowed, "era", "left_anti"), "not_allowed", F.col("era"))]
    if forbidden is not None:
        parts.append(violation(eras.join(forbidden, "era", "left_semi"), "forbidden", F.col("era")))
    return together(*parts)


def era_to_split(rows: DataFrame, row: str = "row_index") -> DataFrame:
    """First split label of every era."""
    return rows.groupBy("era").agg(F.min_by("split", row).alias("split"))
