"""Statistics of vectors by group.

Everything that depends on a whole group is built from sums that partial
aggregation can add up (blocks of dim x dim at most, see ``products``), so a group
may be any size; the eigenproblem then runs once per group on a dim x dim matrix.
The non-zero spectrum equals that of the rows' Gram matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralens.functions.exprs import hash_u32, keyed, moments_corr
from eralens.functions.lowrank import (
    distances, effective_rank, fold_rows, hashed_normals, leading, leading_rows, mean_share, orthogonality_error, outer_sum, project, shrink, soft_project, turnover,
)
from eralens.functions.ranking import AUTO, Plan, exact_quantiles, on_keys, row_positions
from eralens.operators import products
from eralens.session import cut_lineage

FLUSH_GROUPS = 256   # partial sums a task holds before it hands them on
BLOCK_ROWS = 4096    # consecutive rows of a key that a task sums at once


def element_sums(df: DataFrame, group: str, vector: str, parts: Callable, dim: int, row_id: str | None = None) -> DataFrame:
    """(group, pos, v): element-wise sums over the group of ``parts(ids, X) -> 1-d array``.

    Tasks add up per group with Arrow batches, then single elements are summed by hash
    aggregation with map-side combine."""
    cols = [group, vector] + ([row_id] if row_id else [])
    kind = dict(df.dtypes)[group]
    arrow_key = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]

    def pack(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), type=arrow_key), pa.array([v.tolist() for v in held.values()], type=pa.list_(pa.float64()))],
            names=["g", "s"])

    def partial(batches):
        held: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            coded = batch.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)[order]
            ids = batch.column(2).to_numpy(zero_copy_only=False)[order] if row_id else None
            ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
            for g, a, b in zip(names, ends[:-1], ends[1:]):
                add = parts(None if ids is None else ids[a:b], x[a:b])
                held[g] = held[g] + add if g in held else add
            if len(held) > FLUSH_GROUPS:
                yield pack(held)
                held = {}
        if held:
            yield pack(held)

    got = df.select(*cols).where(F.col(vector).isNotNull()).mapInArrow(partial, f"g {kind}, s array<double>")
    each = got.select("g", F.posexplode("s").alias("pos", "v")).groupBy("g", "pos").agg(F.sum("v").alias("v"))
    return each.withColumnRenamed("g", group)


def group_sums(df: DataFrame, group: str, vector: str, parts: Callable, dim: int, row_id: str | None = None) -> DataFrame:
    """(group, sums): the element sums put together; their number depends on dim only."""
    each = element_sums(df, group, vector, parts, dim, row_id)
    whole = each.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p"))
    return whole.select(group, F.transform("p", lambda e: e["v"]).alias("sums"))


def group_gram_spectrum(df: DataFrame, group: str, vector: str, dim: int, width: int = products.WIDTH) -> DataFrame:
    """(group, n, eigenvalues): spectrum of the Gram matrix of the unit rows, descending. From
    blocked sums of U'U for groups with more rows than coordinates, else from UU'."""
    tall, short = products.split_by_size(df, group, vector, dim)
    schema = "n bigint, eigenvalues array<double>"

    def few(x):
        u = products.unit_rows(x)
        return len(x), products.spectrum(u @ u.T, len(x))[0].tolist()

    many = products.solved(products.unit_products(tall, group, vector, dim, width), group, dim, lambda n, _x, _u, uu: (n, products.spectrum(uu, n)[0].tolist()), schema, width)
    return many.unionByName(products.from_rows(short, group, vector, dim, few, schema))


def direction_gains(lam: np.ndarray, n: int, mode: str, factor: float, soft_temp: float, variance: float) -> tuple[np.ndarray, int]:
    """How much of each direction stays, and how many count as kept. Values are measured in
    units of a row's average share of the trace."""
    share = lam * (n / lam.sum())
    strong = int(np.count_nonzero(share > factor))
    if mode == "soft":
        # the logistic function by tanh, which does not overflow for large arguments
        return 0.5 + 0.5 * np.tanh((share - factor) / (2.0 * soft_temp)), strong
    kept = strong if mode == "hard" else 1 + int(np.searchsorted(np.cumsum(share), variance * n))
    kept = int(np.clip(kept, 1, len(lam)))
    return np.repeat([1.0, 0.0], [kept, len(lam) - kept]), kept


def consensus_filter(df: DataFrame, group: str, vector: str, dim: int, mode: str = "hard", factor: float = 2.0,
                     soft_temp: float = 0.5, variance: float = 0.9, width: int = products.WIDTH) -> DataFrame:
    """Mean of a group restricted to the directions its rows agree on.

    With unit rows U and eigenpairs (l, v) of U'U, the row weights of direction v are
    (U v)(v . sum of U) / (l n). Their sum over directions is U w with w of ``dim`` numbers, so
    one pass finds w from blocked sums and a second one adds up x (u . w). Groups with no more
    rows than coordinates are solved from UU' at once. A group of zero vectors keeps nothing."""
    tall, short = products.split_by_size(df, group, vector, dim)
    kind = dict(df.dtypes)[group]

    def weights(n, total, unit, uu):
        lam, vec = products.spectrum(uu, n)
        live = lam > 1e-12 * max(float(lam[0]), 1.0)
        if not live.any():
            return n, 0, np.zeros(dim).tolist(), (total / n).tolist()
        gain, kept = direction_gains(lam, n, mode, factor, soft_temp, variance)
        vec, scale = vec[:, live], gain[live] / (n * lam[live])
        return n, kept, (vec @ (scale * (vec.T @ unit))).tolist(), (total / n).tolist()

    def few(x):
        u, n = products.unit_rows(x), len(x)
        lam, vec = products.spectrum(u @ u.T, n)
        mean = x.mean(axis=0)
        live = lam > 1e-12 * max(float(lam[0]), 1.0)
        if not live.any():
            return n, 0, 0.0, np.zeros(dim).tolist()
        gain, kept = direction_gains(lam, n, mode, factor, soft_temp, variance)
        got = (vec[:, live] @ (gain[live] * vec[:, live].sum(axis=0))) @ x / n
        size = float(np.sqrt(mean @ mean))
        return n, kept, float(np.sqrt(got @ got)) / size if size > 1e-12 else 0.0, got.tolist()

    found = cut_lineage(products.solved(products.unit_products(tall, group, vector, dim, width), group, dim, weights, "n bigint, k int, w array<double>, mean array<double>", width), "consensus-weights")

    def weighed(_group, columns, rows):
        x, w = products.matrix(columns[0].take(pa.array(rows)), dim), np.asarray(columns[1][int(rows[0])].values.to_numpy())
        return {(0, 0): (products.unit_rows(x) @ w) @ x}

    sums = products.summed_blocks(on_keys(tall, found.select(group, "w"), [group], "inner"), group, weighed, [vector, "w"])

    def finish(batches):
        for batch in batches:
            rows = []
            for g, n, k, mean, s in zip(*(batch.column(i).to_pylist() for i in range(5))):
                got, size = np.frombuffer(s), float(np.linalg.norm(mean))
                rows.append((g, n, k, float(np.sqrt(got @ got)) / size if size > 1e-12 else 0.0, got.tolist()))
            g, n, k, ratio, got = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(g, products.KEYS[kind]), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(ratio, pa.float64()), pa.array(got, pa.list_(pa.float64()))],
                                             names=[group, "n", "k", "ratio", "filtered_mean"])

    schema = "n bigint, k int, ratio double, filtered_mean array<double>"
    many = on_keys(found, sums.select(group, "s"), [group], "inner").select(group, "n", "k", "mean", "s").mapInArrow(finish, f"{group} {kind}, {schema}")
    return many.unionByName(products.from_rows(short, group, vector, dim, few, schema))


def kept_energy(spectrum: DataFrame, group: str, factor: float = 2.0) -> DataFrame:
    """Share of the spectrum above factor x trace / rows."""
    total = F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x)
    d = spectrum.withColumn("threshold", F.lit(factor) * total / F.col("n")).withColumn("total", total)
    kept = F.aggregate(F.filter("eigenvalues", lambda x: x > F.col("threshold")), F.lit(0.0), lambda a, x: a + x)
    return d.select(group, "threshold", (kept / F.col("total")).alias("kept_energy"))


def spectrum_stats(spectrum: DataFrame, group: str, factor: float = 2.0) -> DataFrame:
    """Leading values, how many exceed the threshold and by what margin, effective rank."""
    e, total = F.col("eigenvalues"), F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x)
    d = spectrum.withColumn("total", total).withColumn("threshold", F.lit(factor) * F.col("total") / F.col("n"))
    entropy = F.aggregate(
        e, F.lit(0.0),
        lambda a, x: a - F.when(x > 0, x / F.col("total") * F.log(x / F.col("total"))).otherwise(0.0))
    return d.select(
        group, "n", F.get(e, F.lit(0)).alias("top1"), F.get(e, F.lit(1)).alias("top2"), F.get(e, F.lit(4)).alias("top5"), "threshold",
        F.size(F.filter(e, lambda x: x > F.col("threshold"))).alias("above"),
        (F.get(e, F.lit(0)) / F.col("threshold")).alias("margin"), F.exp(entropy).alias("effective_rank"))


def sign_agreement_mask(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, mean, kept): a coordinate counts iff |sum of signs| >= 2 sqrt(rows)."""
    e = df.select(group, F.posexplode(vector).alias("pos", "v"))
    s = e.groupBy(group, "pos").agg(
        F.sum(F.signum("v")).alias("signs"), F.avg(F.col("v").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
    kept = F.abs(F.col("signs")) >= 2.0 * F.sqrt(F.col("n"))
    return s.select(group, "pos", F.when(kept, F.col("mean")).otherwise(0.0).alias("masked_mean"), kept.alias("kept"))


def random_subspace_control(df: DataFrame, group: str, vector: str, row_id: str, dim: int, k: int, ratio: float, seed: int) -> DataFrame:
    """Mean restricted to a random k-dimensional subspace of the rows, scaled to a given
    share of the mean's length. With R (rows x k, normals hashed per row) the weights
    are R (R'R)^-1 R'1 / rows, so again sums suffice."""

    def parts(ids, x):
        r = hashed_normals(ids, k, seed)
        return np.concatenate([[len(x)], x.sum(0), r.sum(0), (r.T @ r).ravel(), (x.T @ r).ravel()])

    sums = group_sums(df, group, vector, parts, dim, row_id)

    def run(batches):
        for pdf in batches:
            out = []
            for g, s in zip(pdf[group], pdf["sums"]):
                s = np.asarray(s)
                n, at = int(round(s[0])), 1 + dim
                mean, ones = s[1:at] / n, s[at:at + k]
                rr = s[at + k:at + k + k * k].reshape(k, k)
                xr = s[at + k + k * k:].reshape(dim, k)
                v = xr @ (np.linalg.pinv(rr) @ ones) / n
                size, own = float(np.linalg.norm(mean)), float(np.linalg.norm(v))
                scaled = v * (ratio * size / own) if size > 1e-12 and own > 1e-12 else v
                out.append((g, n, float(np.linalg.norm(scaled)) / size if size > 1e-12 else 0.0, scaled.tolist()))
            yield pd.DataFrame(out, columns=[group, "n", "ratio", "control_mean"])

    return sums.mapInPandas(run, f"{group} {dict(df.dtypes)[group]}, n bigint, ratio double, control_mean array<double>")


def group_mean_cosine(df: DataFrame, group: str, vector: str, row_id: str, seed: int = 0) -> DataFrame:
    """Cosine of a group's mean (one hashed half) with its other half and with the other
    half of all remaining groups; the latter is total minus own, so no pairs are formed."""
    half = F.pmod(hash_u32(keyed(seed, F.col(row_id))), F.lit(2))
    e = df.select(group, half.alias("half"), F.posexplode(vector).alias("pos", "v"))
    own = e.groupBy(group, "pos").agg(
        F.sum(F.when(F.col("half") == 0, F.col("v").cast("double"))).alias("a"), F.sum(F.when(F.col("half") == 1, F.col("v").cast("double"))).alias("b"))
    total = own.groupBy("pos").agg(F.sum("b").alias("t"))
    d = own.join(total, "pos").withColumn("o", F.col("t") - F.coalesce("b", F.lit(0.0)))

    def cosine(x, y):
        c = F.col
        return F.sum(c(x) * c(y)) / F.sqrt(F.sum(c(x) * c(x)) * F.sum(c(y) * c(y)))

    return d.groupBy(group).agg(cosine("a", "b").alias("same_group"), cosine("a", "o").alias("other_groups"))


def _stack(vectors_) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors_])


def block_starts(df: DataFrame, keys: list[str], order: str, vector: str, decay: float, plan: Plan, block: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows of each key in blocks of consecutive ones, the mean each block starts from, and the
    keys' types."""
    given = df.select(*keys, order, vector).where(F.col(vector).isNotNull())
    d = row_positions(given, keys, order, "__pos", plan, total="__len").withColumn("__block", F.floor(F.col("__pos") / block))
    d = cut_lineage(d.select(*keys, "__block", "__pos", "__len", F.col(vector).cast("array<double>").alias("__x")), "decayed-rows")
    kinds = dict(df.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def share(pdf):
        pdf = pdf.sort_values("__pos")
        first = pdf["__pos"].iloc[0] == 0
        out = pdf.iloc[:1][[*keys, "__block"]].copy()
        out["__share"], out["__fade"] = [mean_share(_stack(pdf["__x"]), decay, first)], decay ** len(pdf)
        return out

    shares = d.groupBy(*keys, "__block").applyInPandas(share, f"{named}, __block bigint, __share array<double>, __fade double")

    def starts(batches):
        mean = None
        for pdf in batches:
            held = []
            for at, s, fade in zip(pdf["__block"], pdf["__share"], pdf["__fade"]):
                held.append(None if at == 0 else mean)
                mean = np.asarray(s) if at == 0 else fade * mean + np.asarray(s)
            pdf = pdf[[*keys, "__block"]].copy()
            pdf["__mean"] = pd.Series(held, index=pdf.index, dtype=object)
            yield pdf

    sorted_shares = shares.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "__block")
    before = cut_lineage(sorted_shares.mapInPandas(starts, f"{named}, __block bigint, __mean array<double>"), "decayed-means")
    return d, before, named


def decayed_moments(df: DataFrame, keys: Sequence[str], order: str, vector: str, decay: float, centre: str = "before",
                    plan: Plan = AUTO, block: int = BLOCK_ROWS) -> DataFrame:
    """(keys, rows, sums) of the exponentially weighted mean and covariance of each key's
    vectors in order: C <- decay C + (1 - decay) c c', c measured from the mean before the row
    (``centre='after'``: from the one after it); the first row sets the mean. All rows count.

    A key is cut into blocks of consecutive rows. Each gives its share of the mean; a pass over
    these shares, one row per block, gives the mean a block starts from; then blocks sum their
    outer products on their own, and the decayed sums are added up by element. ``sums`` holds
    the covariance before the last row, the last c, the mean, and the last vector. Rows without
    a vector do not count; a null key is a key."""
    keys = list(keys)
    d, before, named = block_starts(df, keys, order, vector, decay, plan, block)

    def sums(rows, start):
        rows = rows.sort_values("__pos")
        n, pos = int(rows["__len"].iloc[0]), rows["__pos"].to_numpy()
        x, mean = _stack(rows["__x"]), start["__mean"].iloc[0]
        c, mean = distances(x, decay, None if mean is None else np.asarray(mean, dtype=np.float64))
        if centre == "after":
            c = c * decay
        ends = pos[-1] == n - 1
        prior = outer_sum(c[:-1] if ends else c, decay) * decay ** float(n - 2 - pos[-1] + ends)
        tail = np.concatenate([c[-1], mean, x[-1]]) if ends else np.zeros(3 * x.shape[1])
        out = rows.iloc[:1][keys].copy()
        out["rows"], out["s"] = n, [np.concatenate([prior.ravel(), tail])]
        return out

    parts = d.groupBy(*keys, "__block").cogroup(before.groupBy(*keys, "__block")).applyInPandas(sums, f"{named}, rows bigint, s array<double>")
    each = parts.select(*keys, "rows", F.posexplode("s").alias("pos", "v")).groupBy(*keys, "rows", "pos").agg(F.sum("v").alias("v"))
    whole = each.groupBy(*keys, "rows").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p"))
    return whole.select(*keys, "rows", F.transform("p", lambda e: e["v"]).alias("sums"))


def moments_of(sums: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Covariance before and after the last row, mean, last vector."""
    s = np.asarray(sums, dtype=np.float64)
    p = int(round(np.sqrt(len(s) + 2.25) - 1.5))          # p * p + 3 p numbers
    c, mean, last = s[p * p:].reshape(3, p)
    prior = s[:p * p].reshape(p, p)
    return prior, decay * prior + (1.0 - decay) * np.outer(c, c), mean, last


def decayed_sketches(df: DataFrame, keys: Sequence[str], order: str, vector: str, decay: float, size: int, centre: str = "before",
                     plan: Plan = AUTO, block: int = BLOCK_ROWS) -> DataFrame:
    """(keys, rows, dim, prior, slack, tail): as ``decayed_moments``, with the covariance before the
    last row as a sketch of at most ``size`` rows (64-bit floats in a row) in place of dim x dim
    numbers. A block is sketched by its own task; a key's sketches, ``size`` x dim numbers a
    block, are put together in order. ``tail`` holds the last c, the mean and the last vector."""
    keys = list(keys)
    d, before, named = block_starts(df, keys, order, vector, decay, plan, block)

    def sketches(rows, start):
        rows = rows.sort_values("__pos")
        n, pos = int(rows["__len"].iloc[0]), rows["__pos"].to_numpy()
        x, mean = _stack(rows["__x"]), start["__mean"].iloc[0]
        c, mean = distances(x, decay, None if mean is None else np.asarray(mean, dtype=np.float64))
        if centre == "after":
            c = c * decay
        ends = pos[-1] == n - 1
        own = c[:-1] if ends else c
        sketch, slack = fold_rows(np.zeros((0, x.shape[1])), 0.0, own, decay, size)
        out = rows.iloc[:1][[*keys, "__block"]].copy()
        out["rows"], out["dim"], out["m"], out["sketch"], out["slack"] = n, x.shape[1], len(own), [sketch.tobytes()], slack
        out["tail"] = [np.concatenate([c[-1], mean, x[-1]]).tobytes() if ends else None]
        return out

    schema = f"{named}, __block bigint, rows bigint, dim int, m bigint, sketch binary, slack double, tail binary"
    parts = d.groupBy(*keys, "__block").cogroup(before.groupBy(*keys, "__block")).applyInPandas(sketches, schema)

    def merge(batches):
        sketch = slack = None
        for pdf in batches:
            done = []
            for row in pdf.itertuples(index=False):
                own = np.frombuffer(row.sketch).reshape(-1, row.dim)
                if row.at == 0:
                    sketch, slack = own, row.slack
                else:
                    sketch, off = shrink(np.vstack([sketch * decay ** (row.m / 2.0), own]), size)
                    slack = slack * decay ** row.m + row.slack + off
                if row.tail is not None:
                    done.append((*row[: len(keys)], row.rows, row.dim, sketch.tobytes(), slack, row.tail))
            yield pd.DataFrame(done, columns=[*keys, "rows", "dim", "prior", "slack", "tail"])

    ordered = parts.withColumnRenamed("__block", "at").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "at")
    return ordered.mapInPandas(merge, f"{named}, rows bigint, dim int, prior binary, slack double, tail binary")


def streaming_lowrank_cov(df: DataFrame, group: str, order: str, vector: str, rank: int = 8, decay: float = 0.99,
                          tol: float = 1e-12, centre: str = "before", plan: Plan = AUTO, block: int = BLOCK_ROWS, size: int | None = None) -> DataFrame:
    """Per key the decayed mean, the leading part of the decayed covariance, and diagnostics.

    The covariance is a sketch of ``size`` rows (four times the rank unless given): its
    eigenvalues are at most ``error_bound`` below those of the whole one, and never above.
    Vectors of no more coordinates than that lose nothing."""
    size = size or 4 * rank

    def one(g, n, dim, prior, slack, tail):
        prior, (c, mean, _) = np.frombuffer(prior).reshape(-1, dim), np.frombuffer(tail).reshape(3, dim)
        sketch, bound = fold_rows(prior, slack, c[None, :], decay, size)
        basis, values = leading_rows(sketch, rank, tol)
        return (g, n, basis.shape[1], values.tolist(), mean.tolist(), basis.T.ravel().tolist(), effective_rank(values),
                turnover(leading_rows(prior, rank, tol)[0], basis), orthogonality_error(basis), bound)

    names = [group, "rows", "basis_rank", "eigenvalues", "mean", "basis", "effective_rank", "turnover", "orthogonality_error", "error_bound"]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(*row) for row in zip(*(pdf[c] for c in (group, "rows", "dim", "prior", "slack", "tail")))], columns=names)

    schema = (f"{group} {dict(df.dtypes)[group]}, rows bigint, basis_rank int, eigenvalues array<double>, mean array<double>, basis array<double>, "
              "effective_rank double, turnover double, orthogonality_error double, error_bound double")
    return decayed_sketches(df, [group], order, vector, decay, size, centre, plan, block).mapInPandas(run, schema)


def _vector_udf(fn):
    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(e, dtype=np.float64) for e in v]) if len(v) else np.zeros((0, 1))
        return pd.Series(list(fn(x)), index=v.index, dtype=object)

    return apply


def lowrank_project(df: DataFrame, vector: str, basis: np.ndarray, mode: str = "top", strength: float = 1.0,
                    out: str = "projected", seed: int = 0) -> DataFrame:
    """Project every vector; ``basis`` (dim x k) is a small fixed matrix. Mode 'random'
    uses one persistent random orthonormal basis of the same rank."""
    if mode == "random":
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal(basis.shape))[0]
        mode = "top"
    return df.withColumn(out, _vector_udf(lambda x: project(x, basis, mode, strength))(F.col(vector)))


def soft_weight_project(df: DataFrame, vector: str, basis: np.ndarray, values: np.ndarray, alpha: float = 1.0,
                        keep_rest: bool = True, normalise: str = "none", out: str = "projected") -> DataFrame:
    return df.withColumn(out, _vector_udf(lambda x: soft_project(x, basis, values, alpha, keep_rest, normalise))(F.col(vector)))


def block_spectral(df: DataFrame, group: str, order: str, vector: str, dim: int, block: int, total_rank: int,
                   decay: float = 0.99, mode: str = "top", plan: Plan = AUTO) -> DataFrame:
    """Coordinates in fixed blocks, the rank spread evenly (the first blocks get the
    remainder); each (key, block) has its own decayed covariance and filters its last vector."""
    sizes = [min(block, dim - i) for i in range(0, dim, block)]
    if len(sizes) > total_rank:
        raise ValueError(f"{len(sizes)} blocks of coordinates need a rank of {len(sizes)} or more")
    caps: list[int] = []
    for left in range(len(sizes), 0, -1):
        caps.append(-(-(total_rank - sum(caps)) // left))          # an even share of what is left, rounded up
    parts = F.posexplode(F.array(*[F.slice(F.col(vector), 1 + i * block, s) for i, s in enumerate(sizes)])).alias("block", "part")
    sums = decayed_moments(df.select(group, order, parts), [group, "block"], order, "part", decay, plan=plan)

    def one(g, b, s):
        _, cov, _, last = moments_of(s, decay)
        basis, values = leading(cov, caps[b])
        done = project(last[None, :], basis, mode)[0] if basis.shape[1] else last
        return g, b, caps[b], basis.shape[1], effective_rank(values), done.tolist()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(*row) for row in zip(pdf[group], pdf["block"], pdf["sums"])],
                               columns=[group, "block", "rank_cap", "basis_rank", "effective_rank", "filtered"])

    return sums.mapInPandas(
        run, f"{group} {dict(df.dtypes)[group]}, block int, rank_cap int, basis_rank int, effective_rank double, filtered array<double>")


def shuffled_history_control(df: DataFrame, group: str, order: str, depth: int = 32, seed: int = 0, plan: Plan = AUTO) -> DataFrame:
    """For every vector the one it is replaced by: a hashed choice among the last
    ``depth`` of its key, itself included. Found by position, not by collecting them."""
    p = row_positions(df.select(group, order), [group], order, "pos", plan)
    size = F.least(F.lit(depth), F.col("pos") + 1)
    pick = F.pmod(hash_u32(keyed(seed, F.col(group), F.col("pos"))), size)
    want = p.withColumn("src", F.col("pos") - size + 1 + pick)
    source = p.select(group, F.col("pos").alias("src"), F.col(order).alias("source"))
    return want.join(source, [group, "src"]).select(group, order, "source")


def distributed_covariance(df: DataFrame, vector: str, dim: int, width: int = products.WIDTH) -> DataFrame:
    """(i, j, covariance, correlation) over the whole table, from one pass of blocked sums; a
    block's cells become rows only after all its sums have met."""
    starts = range(0, dim, width)

    def parts(_group, columns, rows):
        x = products.matrix(columns[0], dim)
        out = {(i // width, j // width): np.concatenate([[len(x)], x[:, i:i + width].sum(0), x[:, j:j + width].sum(0), np.square(x[:, i:i + width]).sum(0), np.square(x[:, j:j + width]).sum(0),
                                                         (x[:, i:i + width].T @ x[:, j:j + width]).ravel()]) for i in starts for j in starts if i <= j}
        return out

    blocks = products.summed_blocks(df.select(F.lit(0).alias("__g"), vector).where(F.col(vector).isNotNull()), "__g", parts, [vector])

    def cells(batches):
        for batch in batches:
            for bi, bj, s in zip(*(batch.column(k).to_pylist() for k in range(3))):
                s, p, q = np.frombuffer(s), min(width, dim - bi * width), min(width, dim - bj * width)
                n, sums, xx = s[0], np.split(s[1:1 + 2 * (p + q)], [p, p + q, 2 * p + q]), s[1 + 2 * (p + q):].reshape(p, q)
                mi, mj, vi, vj = (m / n for m in sums)
                cov = xx / n - np.outer(mi, mj)
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = cov / np.sqrt(np.outer(vi - mi * mi, vj - mj * mj))
                i, j = (k.ravel() for k in np.meshgrid(np.arange(p) + bi * width, np.arange(q) + bj * width, indexing="ij"))
                both = [(i, j)] if bi == bj else [(i, j), (j, i)]
                for a, b in both:
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(cov.ravel()), pa.array(corr.ravel())], names=["i", "j", "covariance", "correlation"])

    return blocks.select("bi", "bj", "s").mapInArrow(cells, "i int, j int, covariance double, correlation double")


def feature_exposure(df: DataFrame, keys: Sequence[str], dim: int, features: str = "features", pred: str = "prediction", era: str = "era") -> DataFrame:
    """Largest absolute era-mean correlation of the prediction with any feature. Per
    (keys, era) the tasks add up sums of all features at once; no row is exploded."""
    d = df.select(*keys, era, F.to_json(F.struct(*keys, era)).alias("__g"),
                  F.array_append(F.transform(features, lambda v: v.cast("double")), F.col(pred).cast("double")).alias("__z"))

    def parts(_ids, z):
        x, y = z[:, :-1], z[:, -1]
        return np.concatenate([[len(z), y.sum(), y @ y], x.sum(0), (x * x).sum(0), x.T @ y])

    s = element_sums(d, "__g", "__z", parts, dim + 1)
    wide = s.where(F.col("pos") < 3).groupBy("__g").agg(*[F.max(F.when(F.col("pos") == i, F.col("v"))).alias(n) for i, n in enumerate(("n", "sy", "syy"))])
    at = F.col("pos") - 3
    per = s.where(F.col("pos") >= 3).groupBy("__g", F.pmod(at, F.lit(dim)).alias("feature")).agg(
        *[F.max(F.when(F.floor(at / dim) == i, F.col("v"))).alias(n) for i, n in enumerate(("sx", "sxx", "sxy"))])
    c = moments_corr(*[F.col(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    kinds = dict(df.dtypes)
    named = per.join(wide, "__g").select(
        F.from_json("__g", ", ".join(f"{k} {kinds[k]}" for k in (*keys, era))).alias("__k"), "feature", c.alias("c"))
    means = named.select("__k.*", "feature", "c").groupBy(*keys, "feature").agg(F.avg("c").alias("exposure"))
    return means.groupBy(*keys).agg(F.max(F.abs(F.col("exposure"))).alias("max_exposure"), F.count("exposure").alias("features"))


def engagement_summary(logs: DataFrame, run: str, step: str, value: str, late: int, low: float, high: float,
                       same: str | None = None, other: str | None = None, plan: Plan = AUTO) -> DataFrame:
    """Per run: medians (all, late steps), shares inside and outside a range, extremes,
    and the mean gap between two probe columns."""
    v, is_late = F.col(value), F.col(step) >= late
    aggs = [
        F.count(F.lit(1)).alias("n_logged"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.avg(F.when(v.between(low, high), 1.0).otherwise(0.0)).alias("share_inside"),
        F.avg(F.when(v < low, 1.0).otherwise(0.0)).alias("share_below"), F.avg(F.when(v > high, 1.0).otherwise(0.0)).alias("share_above"),
        F.avg(F.when(is_late, v)).alias("late_mean"),
    ]
    if same and other:
        aggs.append(F.avg(F.col(same) - F.col(other)).alias("gap_mean"))
    base = logs.groupBy(run).agg(*aggs)
    whole = exact_quantiles(logs, [run], value, {"median_all": 0.5}, plan=plan)
    tail = exact_quantiles(logs.where(is_late), [run], value, {"q25_late": 0.25, "median_late": 0.5, "q75_late": 0.75}, plan=plan)
    return base.join(whole, run).join(tail, run, "left")
