"""Exact ranks, positions, running sums and quantiles for groups of any size.

A whole table without groups is always cut into ranges of its order (``_whole_table``). For
groups there are two plans, chosen by a count of the largest one (``plan_groups``):

* up to ``MAX_GROUP_ROWS`` rows per group: a window per group. Every rank and
  every aggregate on the same keys then shares one shuffle. Tables beyond ``DEAL_FROM``
  rows are dealt to partitions by their number of rows (``Whole``), so that a task's sorts
  hold a few groups however large the table is, not a fixed share of it.
* beyond it: the group is cut into value ranges. Cut points are drawn by hash, so
  they depend on the data alone and all branches of the plan (and retried tasks)
  see the same ones. A range is ranked by its own task and gets the row count of
  the ranges below it; a group has at most ``max_splits`` ranges, so that second
  step stays small. Ranks collapse ties first, so a flood of equal values costs
  one row. The input is checkpointed once, because three branches read it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralens.functions.exprs import avg_rank_unit
from eralens.session import cut_lineage

MAX_GROUP_ROWS = 1_000_000
DEAL_FROM = 4_000_000
TASK_ROWS = 100_000       # rows of a partition on average; groups stay whole, so finer partitions hold fewer of them by chance


@dataclass(frozen=True)
class Split:
    """How finely large groups are cut."""

    rows: int = 1_000_000     # rows wanted per range
    max_splits: int = 4096    # upper bound of ranges per group, a power of two
    sample: int = 16          # one key in `sample` may become a cut point


@dataclass(frozen=True)
class Whole:
    """A window per group, groups dealt to so many partitions."""

    partitions: int


DEFAULT_SPLIT = Split()
AUTO = "auto"
Plan = Split | Whole | None | str     # None: window per group as Spark deals it; AUTO: count, then choose


def plan_groups(df: DataFrame, keys: Sequence[str], bound: int | None = None, times: int = 1) -> Split | Whole | None:
    """A Split if a group of ``keys`` exceeds ``bound`` rows, else a window per group. The plan is
    for frames of up to ``times`` groups for each one of ``df``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    largest, rows = (x or 0 for x in sizes.agg(F.max("n"), F.sum("n")).first())
    if largest > (MAX_GROUP_ROWS if bound is None else bound):
        return DEFAULT_SPLIT
    return Whole(-(-rows * times // TASK_ROWS)) if rows * times > DEAL_FROM else None


def resolve(df: DataFrame, keys: Sequence[str], plan: Plan) -> Split | Whole | None:
    """Without keys there is one plan only (``_whole_table``), so nothing is counted."""
    return plan_groups(df, keys) if plan == AUTO and keys else None if plan == AUTO else plan


def dealt(df: DataFrame, keys: Sequence[str], plan: Plan) -> tuple[DataFrame, Split | None]:
    """The frame as its plan deals it, and the plan for all that follows on the same keys:
    windows and sums on them need no other shuffle. That does not hold for keys of a floating
    type: Spark takes them in a normal form there and deals again, as it sees fit."""
    split = resolve(df, keys, plan)
    if isinstance(split, Whole):
        return (df.repartition(split.partitions, *keys) if keys else df), None
    return df, split


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", plain: Sequence[str] = ()) -> DataFrame:
    """Equi-join in which a null key equals itself, as it does in windows and groups; the
    ``plain`` columns are compared as usual. The key columns of ``left`` stay."""
    cols = [*keys, *plain]
    named = {k: f"__key{i}" for i, k in enumerate(cols)}
    r = right.select(*[F.col(k).alias(n) for k, n in named.items()], *[c for c in right.columns if c not in cols])
    same = [F.col(k).eqNullSafe(F.col(named[k])) for k in keys] + [F.col(k) == F.col(named[k]) for k in plain]
    return left.join(r, same, how).drop(*named.values())


def _cut_points(d: DataFrame, keys: list[str], split: Split) -> DataFrame:
    """Sorted cut values for those groups that exceed ``split.rows`` keys."""
    h = F.xxhash64("__o")
    slots = (
        d.select(*keys, "__o")
        .where(F.pmod(h, F.lit(split.sample)) == 0)
        .groupBy(*keys, F.pmod(F.shiftright(h, 20), F.lit(split.max_splits)).alias("__slot"))
        .agg(F.min_by("__o", F.xxhash64("__o", F.lit(7))).alias("__v"), F.count(F.lit(1)).alias("__c"))
    )
    wanted = F.least(F.lit(split.max_splits), F.ceil(F.col("__s") * split.sample / split.rows))
    return (
        slots.groupBy(*keys)
        .agg(F.sum("__c").alias("__s"), F.collect_list(F.struct("__slot", "__v")).alias("__p"))
        .where(F.col("__s") * split.sample > split.rows)
        .withColumn("__w", wanted)
        .select(
            *keys,
            F.array_sort(
                F.transform(
                    F.filter("__p", lambda x: x["__slot"] < F.col("__w")), lambda x: x["__v"]
                )
            ).alias("__cuts"),
        )
    )


def _range_of(split: Split) -> Column:
    """Number of cut points <= the row's key, by binary search."""
    steps, s = [], split.max_splits
    while s:
        steps.append(s)
        s //= 2
    cuts, o = F.col("__cuts"), F.col("__o")

    def step(acc, width):
        hit = F.coalesce(F.get(cuts, acc + width - 1) <= o, F.lit(False))
        return F.when(hit, acc + width).otherwise(acc)

    found = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), step)
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def running_weight(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, weight: Column,
    plan: Plan = AUTO,
) -> DataFrame:
    """Adds ``before`` (weight of the rows strictly earlier) and ``whole``
    (weight of the group). The order columns must be unique within a group."""
    cols = [order] if isinstance(order, str) else list(order)
    if not keys:
        return _whole_table(df, cols, weight)
    given, split = dealt(df, keys, plan)
    keys_, kept = list(keys), df.columns
    if split is None:
        g = W.partitionBy(*keys_)
        upto = g.orderBy(*cols).rowsBetween(W.unboundedPreceding, 0)
        return given.select(
            *kept, (F.sum(weight).over(upto) - weight).alias("before"), F.sum(weight).over(g).alias("whole")
        )

    order_key = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
    d = cut_lineage(given.withColumn("__o", order_key).withColumn("__wt", weight))
    cuts = _cut_points(d, keys_, split)
    in_range = on_keys(d, cuts, keys_).withColumn("__b", _range_of(split)).drop("__cuts")
    w = W.partitionBy(*keys_, "__b")
    local = in_range.withColumn(
        "__cum", F.sum("__wt").over(w.orderBy("__o").rowsBetween(W.unboundedPreceding, 0))
    ).withColumn("__all", F.sum("__wt").over(w))
    per_range = (
        on_keys(d.select(*keys_, "__o", "__wt"), cuts, keys_, "inner")
        .groupBy(*keys_, _range_of(split).alias("__b"))
        .agg(F.sum("__wt").alias("__r"))
    )
    g = W.partitionBy(*keys_)
    offsets = per_range.select(
        *keys_, "__b",
        (F.sum("__r").over(g.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)) - F.col("__r")).alias("__off"),
        F.sum("__r").over(g).alias("__grp"),
    )
    return on_keys(local, offsets, keys_, plain=["__b"]).select(
        *kept,
        (F.col("__cum") - F.col("__wt") + F.coalesce(F.col("__off"), F.lit(0))).alias("before"),
        F.coalesce(F.col("__grp"), F.col("__all")).alias("whole"),
    )


def _whole_table(df: DataFrame, cols: list[str], weight: Column) -> DataFrame:
    """Running weights over a whole table of any size. Rows are dealt to ranges of the order and
    stored, so that all branches see the same ranges; a range is added up by its own task
    and shifted by the totals of the ranges before it, one row each."""
    ranged = df.withColumn("__wt", weight).repartitionByRange(*cols).withColumn("__range", F.spark_partition_id())
    d = cut_lineage(ranged, "ranges")
    w = W.partitionBy("__range").orderBy(*cols).rowsBetween(W.unboundedPreceding, 0)
    totals = d.groupBy("__range").agg(F.sum("__wt").alias("__sum"))
    upto = W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)
    shifts = totals.select("__range", (F.sum("__sum").over(upto) - F.col("__sum")).alias("__shift"), F.sum("__sum").over(W.partitionBy()).alias("whole"))
    local = d.withColumn("__own", F.sum("__wt").over(w) - F.col("__wt"))
    return local.join(shifts, "__range").select(*df.columns, (F.col("__own") + F.col("__shift")).alias("before"), "whole")


def distinct_ranks(
    df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = (), plan: Plan = AUTO,
) -> DataFrame:
    """One row per distinct (keys, value): ``below``, ``ties``, ``total`` and the
    ``extra`` aggregates of the rows that carry the value. NULLs are not ranked."""
    d = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("ties"), *extra)
    )
    return (
        running_weight(d, keys, value, F.col("ties"), plan)
        .withColumnRenamed("before", "below")
        .withColumnRenamed("whole", "total")
    )


def with_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str,
    formula=avg_rank_unit, plan: Plan = AUTO,
) -> DataFrame:
    """Row-level rank, ties averaged; ``formula(below, ties, total)`` gives the
    value, by default (average rank - 1/2) / n. NULLs get NULL and do not count."""
    given, split = dealt(df, keys, plan)
    if split is None and keys:
        keys_ = list(keys)
        present = F.col(value).isNotNull()
        g = W.partitionBy(*keys_)
        ordered = g.orderBy(F.col(value).asc_nulls_last())
        below = F.rank().over(ordered) - F.lit(1)
        ties = F.count(F.lit(1)).over(ordered.rangeBetween(W.currentRow, W.currentRow))
        total = F.count(F.col(value)).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        ranked = given.select(
            "*", below.alias("__below"), ties.alias("__ties"), total.alias("__total")
        )
        rank = formula(F.col("__below"), F.col("__ties"), F.col("__total"))
        return ranked.withColumn(out, F.when(present, rank)).drop("__below", "__ties", "__total")
    df = cut_lineage(df)
    ranks = distinct_ranks(df, keys, value, plan=split).select(
        *keys, value, formula(F.col("below"), F.col("ties"), F.col("total")).alias(out)
    )
    return on_keys(df, ranks, keys, plain=[value])


def row_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, out: str = "pos",
    plan: Plan = AUTO, total: str | None = None,
) -> DataFrame:
    """0-based dense position of each row; the order must be unique in a group."""
    res = running_weight(df, keys, order, F.lit(1).cast("bigint"), plan)
    res = res.withColumnRenamed("before", out)
    return res.withColumnRenamed("whole", total) if total else res.drop("whole")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
    extra: Sequence[Column] = (), plan: Plan = AUTO,
) -> DataFrame:
    """Linear-interpolated quantiles without holding a group in one map.
    ``extra`` are aggregates over the (ties, below, total, value) rows."""
    r = distinct_ranks(df, keys, value, plan=plan)
    v = F.col(value)
    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("total") - 1)
        for tag, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("below") <= at) & (at < F.col("below") + F.col("ties"))
            aggs.append(F.max(F.when(inside, v)).alias(f"__{name}_{tag}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"__{name}_f"))
    got = r.groupBy(*keys).agg(*aggs, *extra)
    names = [c for c in got.columns if not c.startswith("__")]
    return got.select(
        *names,
        *[
            (F.col(f"__{n}_lo") + F.col(f"__{n}_f") * (F.col(f"__{n}_hi") - F.col(f"__{n}_lo"))).alias(n)
            for n in probs
        ],
    )


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "place",
          salts: int = 64) -> DataFrame:
    """First n rows per group in the given order. Two rounds: a salted one that
    leaves at most ``salts * n`` rows of a group, then the final one."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = W.partitionBy(*keys, "__salt").orderBy(*order)
    kept = (
        df.withColumn("__salt", salt)
        .withColumn("__p", F.row_number().over(first))
        .where(F.col("__p") <= n)
        .drop("__p", "__salt")
    )
    last = W.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(out, F.row_number().over(last)).where(F.col(out) <= n)
