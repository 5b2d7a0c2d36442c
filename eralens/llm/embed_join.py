"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors closer than epsilon = sqrt(2 - 2 * cosine) link. Vectors are sorted by label
and by the cells, epsilon wide, of their leading principal coordinates; the sequence is cut
into blocks. Blocks meet if they share a label and neighbouring cells in the first
coordinates, and if the distance of their boxes allows a link. A pair of blocks is joined
by halving both sequences and skipping halves whose boxes are too far apart; small pieces
are multiplied. A pair adds numbers of links and one tree of links, never all links.

Equal vectors of a label are one class before that. The principal axes come from a bounded
sample (``SAMPLE_BYTES``) and decide only the order, not the result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralens.llm.common import blocks, components, stage

COSINE = 0.93
AXES, GRID = 8, 3            # coordinates of boxes and of the grid join
BLOCK_ROWS, LEAF = 1024, 128
SAMPLE_BYTES = 8 << 20
SLACK = 1e-6                 # of the distance of boxes, against rounding


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their class, and the classes: ``rep, label, v, n``. Vectors or
    labels that are null, zero vectors and ones with null or non-finite components, and rows
    without an id, have no class."""
    v = F.col("v")
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(
        F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumns({"k1": F.when(good, F.xxhash64("v")), "k2": F.when(good, F.hash("v"))})
    reps = rows.where("k1 is not null").groupBy("label", "k1", "k2").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return rows.select("id", "label", "k1", "k2"), reps


def axes(reps: DataFrame, count: int, dim: int) -> np.ndarray:
    """Leading principal directions (dim x AXES) of a bounded sample, each label around its mean."""
    rows = max(1, SAMPLE_BYTES // (8 * dim))
    some = reps.where(F.size("v") == dim)
    if count > rows:
        some = some.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * rows / count))
    held = some.select("label", "v").toPandas()
    if held.empty:
        return np.eye(dim, min(AXES, dim))
    x = np.stack(held["v"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for label in held["label"].unique():
        own = (held["label"] == label).to_numpy()
        x[own] -= x[own].mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES].copy()


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grid_blocks(reps: DataFrame, direction, eps: float, parts: int, dim: int) -> DataFrame:
    """The sorted sequence in blocks: ``block, label, size, low, high`` and packed ``ids,
    times, data``. Cells are the sort key, the id breaks ties, so that one dense cell is
    still cut."""
    label_kind = reps.schema["label"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim))
            spot = x @ direction.value
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("label"), batch.column("n"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(spot), pa.list_(pa.float64())),
                 pa.array(list(np.floor(spot / eps).astype(np.int32)), pa.list_(pa.int32()))], names=["rep", "label", "n", "x", "spot", "cell"])

    placed = reps.select("rep", "label", "n", "v").mapInArrow(place, f"rep bigint, label {label_kind}, n bigint, x binary, spot array<double>, cell array<int>")
    ordered = placed.repartitionByRange(parts, "label", "cell", "rep").sortWithinPartitions("label", "cell", "rep")

    def cut(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        held: list = []

        def close():
            nonlocal k
            label, spots = held[0][1], np.array([h[4] for h in held])
            out = pa.RecordBatch.from_pylist([{
                "block": base + k, "label": label, "size": len(held), "low": spots.min(axis=0).tolist(), "high": spots.max(axis=0).tolist(), "ids": np.array([h[0] for h in held], np.int64).tobytes(),
                "times": np.array([h[2] for h in held], np.int64).tobytes(), "data": b"".join(h[3] for h in held)}], schema=schema)
            held.clear()
            k += 1
            return out

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("block", pa.int64()), ("label", batch.schema.field("label").type), ("size", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("times", pa.binary()), ("data", pa.binary())])
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) >= BLOCK_ROWS or held[0][1] != row[1]):
                    yield close()
                held.append(row)
        if held:
            yield close()

    return ordered.mapInArrow(cut, f"block bigint, label {label_kind}, size int, low array<double>, high array<double>, ids binary, times binary, data binary")


def block_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """Pairs of blocks ``a <= b`` whose boxes are no further apart than epsilon. They meet
    by equality of label and cells of the first coordinates."""
    one, two = boxes.select(F.col("block").alias("a"), "label", F.col("low").alias("al"), F.col("high").alias("ah")), boxes.select(F.col("block").alias("b"), "label", F.col("low").alias("bl"), F.col("high").alias("bh"))
    keys = ["label"]
    width = len(boxes.select("low").first()[0]) if not boxes.isEmpty() else 0
    for g in range(min(GRID, width)):
        cell = lambda c, g=g: F.floor(F.get(F.col(c), g) / eps).cast("int")
        one = one.withColumn(f"g{g}", F.explode(F.sequence(cell("al"), cell("ah"))))
        two = two.withColumn(f"g{g}", F.explode(F.sequence(cell("bl") - 1, cell("bh") + 1)))
        keys.append(f"g{g}")
    gap = F.aggregate(F.zip_with(F.zip_with("al", "bh", lambda x, y: x - y), F.zip_with("bl", "ah", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    return one.join(two, keys).where((F.col("a") <= F.col("b")) & (gap <= (eps * (1 + SLACK)) ** 2)).select("a", "b").distinct()


def join_sequences(x, y, px, py, eps, found, at_x=0, at_y=0) -> None:
    """Halve the longer sequence until pieces are small; skip pieces whose boxes are apart."""
    gap = np.maximum(0, np.maximum(px.min(axis=0) - py.max(axis=0), py.min(axis=0) - px.max(axis=0)))
    if (gap * gap).sum() > (eps * (1 + SLACK)) ** 2:
        return
    if max(len(x), len(y)) <= LEAF:
        i, j = np.nonzero(x @ y.T >= COSINE)
        found.append((i + at_x, j + at_y))
    elif len(x) >= len(y):
        h = len(x) // 2
        join_sequences(x[:h], y, px[:h], py, eps, found, at_x, at_y)
        join_sequences(x[h:], y, px[h:], py, eps, found, at_x + h, at_y)
    else:
        h = len(y) // 2
        join_sequences(x, y[:h], px, py[:h], eps, found, at_x, at_y)
        join_sequences(x, y[h:], px, py[h:], eps, found, at_x, at_y + h)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each, by halving of paths."""
    up = np.arange(n)
    while True:
        low = up.copy()
        np.minimum.at(low, i, up[j])
        np.minimum.at(low, j, up[i])
        low = low[low]
        if (low == up).all():
            return up
        up = low


def join_pair(same: bool, ids_a, times_a, a, ids_b, times_b, b, direction, eps):
    """Links of a pair of blocks: node, how many vectors it links with, one neighbour in the tree."""
    x = np.frombuffer(a, float).reshape(len(ids_a), -1)
    y = x if same else np.frombuffer(b, float).reshape(len(ids_b), -1)
    found: list = []
    px = x @ direction
    join_sequences(x, y, px, px if same else y @ direction, eps, found)
    if not found:
        return None
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if same:
        i, j = i[i != j], j[i != j]                      # both directions are in it
        ids, links, j_at = ids_a, np.bincount(i, times_a[j], len(ids_a)), j
    else:
        ids, j_at = np.concatenate((ids_a, ids_b)), j + len(ids_a)
        links = np.concatenate((np.bincount(i, times_b[j], len(ids_a)), np.bincount(j, times_a[i], len(ids_b))))
    order = np.argsort(ids, kind="stable")
    spot = np.empty_like(order)
    spot[order] = np.arange(len(ids))
    root = ids[order][forest(len(ids), spot[i], spot[j_at])][spot]
    hit = links > 0
    return ids[hit], links[hit].astype(np.int64), root[hit]


def links(reps: DataFrame, dim: int) -> DataFrame:
    """``node, links, other`` of the classes with ``dim`` components; a node may have several rows."""
    spark = reps.sparkSession
    count = reps.count()
    eps = math.sqrt(2 - 2 * COSINE)
    direction = spark.sparkContext.broadcast(axes(reps, count, dim))
    parts = blocks(count, 16 * BLOCK_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = stage(grid_blocks(reps, direction, eps, parts, dim), "vector-blocks")
    pairs = block_pairs(held.select("block", "label", "low", "high"), eps)
    load = lambda side: held.select(F.col("block").alias(side), F.col("ids").alias(f"ids_{side}"), F.col("times").alias(f"times_{side}"), F.col("data").alias(f"data_{side}"))
    loaded = pairs.join(load("b"), "b").join(load("a"), "a").select("a", "b", "ids_a", "times_a", "data_a", "ids_b", "times_b", "data_b")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, *packed = [c[row].as_py() for c in batch.columns]
                ia, ta, ib, tb = (np.frombuffer(packed[k], np.int64) for k in (0, 1, 3, 4))
                got = join_pair(a == b, ia, ta, packed[2], ib, tb, packed[5], direction.value, eps)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], names=["node", "links", "other"])

    return loaded.mapInArrow(run, "node bigint, links bigint, other bigint")


def near(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors without a class link with nothing and are kept. Vectors of different lengths
    are never compared. Repeated rows are vectors of their own that link; they share an id."""
    rows, reps = classes_of(vectors, id_col, vector_col, label_col)
    reps = stage(reps.withColumn("rep", F.col("rep").cast("bigint")), "vector-classes")
    dims = [r[0] for r in reps.select(F.size("v")).distinct().collect()]       # one, unless tables are mixed
    found = None
    for dim in dims:
        one = links(reps.where(F.size("v") == dim), dim)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "vector-links")
    comp = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-components").withColumnRenamed("node", "rep")
    total = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    judged = reps.select("rep", "label", "k1", "k2", "n").join(total, "rep", "left").join(comp, "rep", "left").select(
        "label", "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(judged, ["label", "k1", "k2"], "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
