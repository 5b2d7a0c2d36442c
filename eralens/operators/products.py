"""Sums of products of vectors by group, in blocks of coordinates.

A symmetric product X'X of p coordinates is kept as blocks of ``WIDTH`` x ``WIDTH`` numbers, one
row per group and pair of coordinate blocks, the upper half only. A task adds up its blocks
and hands them on when they exceed ``HELD_BYTES``; blocks of equal keys are then added where
they meet, one at a time. No element is a row and no group is collected: the largest thing
a task holds is one group's p x p matrix, when its eigenproblem is solved.

Groups with no more rows than coordinates are solved from their rows instead (the Gram side),
which are at most p x p numbers as well."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 512
HELD_BYTES = 256 << 20
SUMS = -1                  # block number of a group's linear sums
KEYS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    """The groups (first column) of a batch and their rows; null is a group."""
    coded = batch.column(0).dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    names = coded.dictionary.to_pylist()
    ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
    return ((g, order[a:b]) for g, a, b in zip(names, ends[:-1], ends[1:]))


def summed_blocks(df: DataFrame, group: str, parts: Callable[[object, list, np.ndarray], dict[tuple[int, int], np.ndarray]], columns: Sequence[str]) -> DataFrame:
    """``group, bi, bj, s``: sums over each group of the blocks that ``parts(group, columns of the
    batch, rows)`` gives by number; ``s`` holds 64-bit floats."""
    kind = dict(df.dtypes)[group]

    def pack(held):
        g, bi, bj = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(g, KEYS[kind]), pa.array(bi, pa.int32()), pa.array(bj, pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["g", "bi", "bj", "s"])

    def partial(batches):
        held, size = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for g, rows in by_group(batch):
                for at, block in parts(g, [batch.column(k) for k in range(1, batch.num_columns)], rows).items():
                    key = (g, *at)
                    if key in held:
                        held[key] = held[key] + block
                    else:
                        held[key], size = np.ascontiguousarray(block, np.float64), size + block.nbytes
                if size > HELD_BYTES:
                    yield from (pack(dict([one])) for one in held.items())
                    held, size = {}, 0
        yield from (pack(dict([one])) for one in held.items())

    def add(batches):
        key = total = None
        for batch in batches:
            for *at, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
                at, s = tuple(at), np.frombuffer(s)
                if at == key:
                    total = total + s
                    continue
                if key is not None:
                    yield pack({key: total})
                key, total = at, s
        if key is not None:
            yield pack({key: total})

    schema = f"g {kind}, bi int, bj int, s binary"
    got = df.select(group, *columns).mapInArrow(partial, schema)
    return got.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj").mapInArrow(add, schema).withColumnRenamed("g", group)


def unit_products(df: DataFrame, group: str, vector: str, dim: int, width: int = WIDTH) -> DataFrame:
    """Blocks of U'U for the rows U of each group at length one, and the sums (rows, X, U)."""
    starts = range(0, dim, width)

    def parts(_group, columns, rows):
        x = matrix(columns[0].take(pa.array(rows)), dim)
        u = unit_rows(x)
        out = {(i // width, j // width): (u[:, i:i + width].T @ u[:, j:j + width]).ravel() for i in starts for j in starts if i <= j}
        return out | {(SUMS, SUMS): np.concatenate([[len(x)], x.sum(0), u.sum(0)])}

    return summed_blocks(df.where(F.col(vector).isNotNull()), group, parts, [vector])


def solved(blocks: DataFrame, group: str, dim: int, solve: Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple], schema: str, width: int = WIDTH) -> DataFrame:
    """One row per group, ``group`` and ``solve(rows, sum of X, sum of U, U'U)``: a task puts one
    group's matrix together from its blocks, in order, and holds no other."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    kind = dict(blocks.dtypes)[group]

    def run(batches):
        held, sums, whole = None, None, None

        def done():
            rows = int(round(sums[0]))
            row = solve(rows, sums[1:1 + dim], sums[1 + dim:], whole)
            return pa.RecordBatch.from_arrays([pa.array([held[0]], KEYS[kind]), *(pa.array([v], t) for v, t in zip(row, types))], names=[group, *names])

        for batch in batches:
            for g, bi, bj, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held != (g,):
                    if held is not None:
                        yield done()
                    held, whole = (g,), np.zeros((dim, dim))
                if bi == SUMS:
                    sums = np.frombuffer(s)
                    continue
                i, j = bi * width, bj * width
                block = np.frombuffer(s).reshape(min(width, dim - i), -1)
                whole[i:i + block.shape[0], j:j + block.shape[1]] = block
                whole[j:j + block.shape[1], i:i + block.shape[0]] = block.T
        if held is not None:
            yield done()

    return blocks.repartition(group).sortWithinPartitions(group, "bi", "bj").select(group, "bi", "bj", "s").mapInArrow(run, f"{group} {kind}, {schema}")


def spectrum(product: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, none below zero, and directions; as many as rows at most."""
    lam, vec = np.linalg.eigh((product + product.T) / 2.0)
    k = min(rows, len(lam))
    return np.clip(lam[::-1], 0.0, None)[:k], vec[:, ::-1][:, :k]


def split_by_size(df: DataFrame, group: str, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with more rows than coordinates, and of all others."""
    given = df.select(group, vector).where(F.col(vector).isNotNull())
    sizes = given.groupBy(F.col(group).alias("sized")).agg((F.count(F.lit(1)) > dim).alias("tall"))
    marked = given.join(sizes, F.col(group).eqNullSafe(F.col("sized"))).select(group, vector, "tall")
    return marked.where("tall").drop("tall"), marked.where("not tall").drop("tall")


def from_rows(df: DataFrame, group: str, vector: str, dim: int, solve: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """One row per group with no more rows than coordinates: ``solve(X)``."""
    kind = dict(df.dtypes)[group]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}

    def run(part: pa.Table) -> pa.Table:
        row = solve(matrix(part.column(1).combine_chunks(), dim))
        cells = [pa.array([v], kinds[c.split()[1]]) for v, c in zip(row, schema.split(", "))]
        return pa.table([part.column(0).slice(0, 1).combine_chunks(), *cells], names=[group, *names])

    return df.groupBy(group).applyInArrow(run, f"{group} {kind}, {schema}")
