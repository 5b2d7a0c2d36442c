"""Linear scorers over a panel, their gradients per era, and deterministic batches. Model
weights are small fixed arrays; rows stay in Arrow."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralens.functions.exprs import hash_u32, keyed
from eralens.functions.ranking import AUTO, Plan, resolve, row_positions


# ---- batch inference ------------------------------------------------------------------

def _matrix(column, scale: float) -> np.ndarray:
    n = len(column)
    if n == 0:
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) / scale


def score_linear_many(df: DataFrame, weights: np.ndarray, names: Sequence[str], keep: Sequence[str] = ("id", "era"),
                      features: str = "features", scale: float = 4.0) -> DataFrame:
    """Many linear models (dim x models) in one pass, as rows (keep, model, prediction)."""
    types = dict(df.dtypes)

    def run(batches):
        for b in batches:
            y = _matrix(b.column(len(keep)), scale) @ weights if b.num_rows else np.zeros((0, weights.shape[1]))
            offsets = np.arange(0, y.size + 1, weights.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], lists], names=[*keep, "__y"])

    schema = ", ".join([f"{k} {types[k]}" for k in keep] + ["__y array<double>"])
    got = df.select(*keep, features).mapInArrow(run, schema)
    label = F.array(*[F.lit(n) for n in names])
    return got.select(*keep, F.posexplode("__y").alias("__i", "prediction")).select(*keep, F.get(label, F.col("__i")).alias("model"), "prediction")


# ---- deterministic batches ------------------------------------------------------------

def batch_assignment(rows: DataFrame, mode: str, batch: int, steps: int, seed: int, held_out: int = 0, row: str = "id",
                     era: str = "era", plan: Plan = AUTO) -> DataFrame:
    """Table (step, slot, row, held_out); the same for every arm at a seed.

    'rows': with replacement from all rows; 'era': from one era per step; 'within': one
    sufficiently large era per step without replacement, then ``held_out`` further rows. Rows are
    drawn by their positions, so a step reads as many rows as it keeps."""
    spark = rows.sparkSession
    draw = spark.range(steps).select(F.col("id").cast("int").alias("step"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(batch - 1)))
    if mode == "rows":
        split = resolve(rows, [], plan)
        at = row_positions(rows.select(row), [], row, "__at", split, total="__n").select("__at", row, "__n")
        total = rows.agg(F.count(F.lit(1))).scalar()
        d = draw.withColumn("slot", slots)
        d = d.withColumn("__at", F.pmod(hash_u32(keyed(seed, "rows", F.col("step"), F.col("slot"))), total))
        return d.join(at, "__at").select("step", "slot", row, F.lit(False).alias("held_out"))
    counts = rows.groupBy(era).agg(F.count(F.lit(1)).alias("n"))
    if mode == "within":
        counts = counts.where(F.col("n") >= batch + held_out)
    eras = row_positions(counts, [], era, "__e", None, total="__eras")       # one row per era
    n_eras = F.nullif(counts.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    chosen = draw.withColumn("__e", F.pmod(hash_u32(keyed(seed, mode, F.col("step"))), n_eras)).join(eras, "__e")
    if mode == "era":
        split = resolve(rows, [era], plan)
        at = row_positions(rows.select(row, era), [era], row, "__at", split)
        d = chosen.withColumn("slot", slots)
        d = d.withColumn("__at", F.pmod(hash_u32(keyed(seed, "slot", F.col("step"), F.col("slot"))), F.col("n")))
        return d.join(at, [era, "__at"]).select("step", "slot", row, F.lit(False).alias("held_out"))
    if mode != "within":
        raise ValueError(f"no way of drawing is called {mode!r}")
    wanted = batch + held_out
    at = row_positions(rows.select(row, era), [era], row, "__at", resolve(rows, [era], plan))
    drawn = permuted_positions(chosen.select("step", era, "n"), F.lit(wanted), seed)
    got = drawn.join(at, [era, "__at"])
    return got.select("step", (F.col("__k") - 1).alias("slot"), row, (F.col("__k") > batch).alias("held_out"))


def permuted_positions(groups: DataFrame, wanted, seed: int) -> DataFrame:
    """``groups(step, n, ...)`` with ``__k``, ``__at``: the first ``wanted`` places of a permutation of
    0..n-1 that the step draws, without looking at any row.

    A Feistel network mixes the cells of a grid of a x b >= n: a round adds to one coordinate a
    hash of the other, so cells are permuted. Cells beyond n are passed over; the grid has fewer
    than a of them, so ``wanted`` and that many cells are enough."""
    n = F.col("n")
    grid = groups.withColumn("__a", F.ceil(F.sqrt(n)).cast("bigint")).withColumn("__b", F.ceil(n / F.col("__a")).cast("bigint"))
    d = grid.withColumn("__cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("__a") * F.col("__b"), wanted + F.col("__a") * F.col("__b") - n) - 1)))
    d = d.withColumn("__x", F.pmod("__cell", "__a")).withColumn("__y", F.floor(F.col("__cell") / F.col("__a")))
    for turn in range(4):
        one, other, size = ("__x", "__y", "__a") if turn % 2 == 0 else ("__y", "__x", "__b")
        d = d.withColumn(one, F.pmod(F.col(one) + hash_u32(keyed(seed, "mix", F.col("step"), F.lit(turn), F.col(other))), F.col(size)))
    d = d.withColumn("__at", F.col("__x") + F.col("__a") * F.col("__y")).where(F.col("__at") < n)
    placed = d.withColumn("__k", F.row_number().over(W.partitionBy("step").orderBy("__cell")))
    return placed.where(F.col("__k") <= wanted).drop("__a", "__b", "__cell", "__x", "__y")


# ---- gradients and training -----------------------------------------------------------

def _gradient_rows(df: DataFrame, weights: np.ndarray, loss: str, delta: float, era: str, features: str, target: str) -> DataFrame:
    """(era, pos, v): per era the sums [count, losses, gradient] of a linear scorer."""
    p = len(weights)

    def run(batches):
        held: dict = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _matrix(b.column(1), 4.0)
            eras = b.column(0).to_numpy(zero_copy_only=False)
            r = x @ weights - b.column(2).to_numpy(zero_copy_only=False)
            if loss == "mse":
                value, slope = r * r, 2.0 * r
            else:
                value = np.where(np.abs(r) <= delta, 0.5 * r * r, delta * (np.abs(r) - 0.5 * delta))
                slope = np.clip(r, -delta, delta)
            contribution = np.column_stack([np.ones(len(r)), value, slope[:, None] * x])
            order = np.argsort(eras, kind="stable")
            names, starts = np.unique(eras[order], return_index=True)
            for e, sums in zip(names, np.add.reduceat(contribution[order], starts, axis=0)):
                held[int(e)] = held.get(int(e), np.zeros(p + 2)) + sums
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), type=pa.int32()), pa.array([v.tolist() for v in held.values()], type=pa.list_(pa.float64()))],
                names=["era", "s"])

    got = df.select(F.col(era).cast("int").alias("era"), features, F.col(target).cast("double")).mapInArrow(run, "era int, s array<double>")
    return got.select("era", F.posexplode("s").alias("pos", "v")).groupBy("era", "pos").agg(F.sum("v").alias("v"))


def era_gradients(df: DataFrame, weights: np.ndarray, loss: str = "mse", delta: float = 1.0, era: str = "era",
                  features: str = "features", target: str = "target") -> DataFrame:
    """(era, feature, gradient) of one linear scorer's mean loss per era."""
    p = len(weights)
    rows = _gradient_rows(df, np.asarray(weights, float), loss, delta, era, features, target)
    counts = rows.where(F.col("pos") == 0).select("era", F.col("v").alias("n"))
    return rows.where(F.col("pos") >= 2).join(counts, "era").select(
        "era", (F.col("pos") - 2).alias("feature"), (F.col("v") / F.col("n")).alias("gradient")).where(F.col("feature") < p)

