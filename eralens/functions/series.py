"""Ordered series of any length: rolling windows and exponential averages.

A series is cut into blocks of consecutive positions, so a run that holds most of
the table is spread over many tasks. Neighbouring blocks exchange only what the
next one needs: the last rows (rolling) or one carried value (exponential).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralens.functions.ranking import AUTO, Plan, dealt, on_keys, row_positions

BLOCK = 262_144


def rolling(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, least: int,
            out: str, plan: Plan = AUTO, block: int = BLOCK) -> DataFrame:
    """Mean of the last ``width`` values, NULL before ``least`` of them exist."""
    df, split = dealt(df, keys, plan)
    v = F.col(value)

    def mean(w):
        return F.when(F.count(v).over(w) >= least, F.avg(v).over(w))

    if split is None:
        return df.withColumn(out, mean(W.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0)))
    block = max(block, width)
    d = row_positions(df, keys, order, "__pos", split)
    own = F.floor(F.col("__pos") / block)
    # a row also serves the next block if that block's first windows reach back to it
    reaches = F.pmod(F.col("__pos"), F.lit(block)) > block - width
    d = d.withColumn("__own", own).withColumn(
        "__block", F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = W.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(1 - width, 0)
    return d.withColumn(out, mean(w)).where(F.col("__own") == F.col("__block")).drop("__own", "__block", "__pos")


def ema(df: DataFrame, keys: Sequence[str], order: str, value: str, decay: float, out: str,
        plan: Plan = AUTO) -> DataFrame:
    """e_t = decay e_(t-1) + (1 - decay) x_t, started with the first value.

    Inside a block the recursion is a scaled cumulative sum; the block length keeps
    decay**-length near 1e12, so nothing overflows. All blocks before one reach
    it as one carried value. A null key is a key; a null value adds nothing."""
    d = row_positions(df, keys, order, "__pos", plan)
    size = max(2, int(12 * math.log(10) / -math.log(decay)))
    d = d.withColumn("__block", F.floor(F.col("__pos") / size)).withColumn("__j", F.pmod(F.col("__pos"), F.lit(size)).cast("double"))
    scale = F.pow(F.lit(decay), F.col("__j"))
    share = F.when(F.col("__pos") == 0, 1.0).otherwise(1.0 - decay)
    block = W.partitionBy(*keys, "__block")
    upto = block.orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    local = F.sum(share * F.col(value) / scale).over(upto) * scale
    d = d.withColumn("__local", local).withColumn("__scale", F.pow(F.lit(decay), F.col("__j") + 1))
    # What a block starts from: the ends of the blocks before it, each faded by the blocks
    # between; folded in order over one row per block.
    kinds, n, whole = dict(d.dtypes), len(keys), decay ** size
    ends = d.where(F.col("__j") == size - 1).select(*keys, "__block", F.coalesce("__local", F.lit(0.0)).alias("__end"))

    def carry(batches):
        level = 0.0
        for b in batches:
            held = []
            for at, end in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                level = end if at == 0 else whole * level + end
                held.append((at + 1, level))
            after, levels = zip(*held) if held else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(n)], pa.array(after, pa.int64()), pa.array(levels, pa.float64())], names=[*keys, "__block", "__carry"])

    named = "".join(f"{k} {kinds[k]}, " for k in keys)
    in_order = ends.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "__block")
    carried = in_order.mapInArrow(carry, f"{named}__block bigint, __carry double")
    return (
        on_keys(d, carried, keys, plain=["__block"])
        .withColumn(out, F.col("__local") + F.col("__scale") * F.coalesce("__carry", F.lit(0.0)))
        .drop("__pos", "__block", "__j", "__local", "__scale", "__carry")
    )


def era_window(keys: Sequence[str], era: str = "era"):
    """Running window over a model's era scores. One row per era: a partition is
    as long as the number of eras, not as the table."""
    return W.partitionBy(*keys).orderBy(era).rowsBetween(W.unboundedPreceding, 0)


def era_positions(df: DataFrame, keys: Sequence[str], era: str = "era", out: str = "pos") -> DataFrame:
    """0-based position and length of an era-score series."""
    w = W.partitionBy(*keys)
    return df.withColumn(out, F.row_number().over(w.orderBy(era)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
