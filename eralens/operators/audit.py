"""Integrity audits: recomputation, coverage, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralens.functions.checks import findings, together, violation
from eralens.functions.exprs import finite
from eralens.functions.ranking import AUTO, Plan, row_positions

RTOL, ATOL = 1e-6, 1e-9


def close(actual: Column, recorded: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """NULL equals NULL; otherwise |a - r| <= atol + rtol |r|."""
    both = F.abs(actual - recorded) <= F.lit(atol) + F.lit(rtol) * F.abs(recorded)
    return F.when(actual.isNull() & recorded.isNull(), True).otherwise(F.coalesce(both, F.lit(False)))


def metric_reproduction(recomputed: DataFrame, recorded: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per metric: rows compared, rows outside tolerance, rows on one side only."""
    a = recomputed.select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics], F.lit(1).alias("__l"))
    j = a.join(recorded.select(*keys, *metrics, F.lit(1).alias("__r")), list(keys), "full")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    aggs = [F.count(F.when(~both, 1)).alias("unmatched"), F.count(F.when(both, 1)).alias("compared")]
    aggs += [F.count(F.when(both & ~close(F.col(f"__{m}"), F.col(m)), 1)).alias(m) for m in metrics]
    return j.agg(*aggs).unpivot(["compared", "unmatched"], list(metrics), "metric", "outside")


def prediction_sanity(predictions: DataFrame, recorded: DataFrame, run: Sequence[str], row: str = "id") -> DataFrame:
    """Per run: row count equals the recorded one, rows unique, all values finite."""
    g = predictions.groupBy(*run).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(row).alias("unique_rows"),
        F.count(F.when(~finite(F.col("prediction")) | ~finite(F.col("target")), 1)).alias("not_finite"))
    j = g.join(recorded, list(run), "left")
    ok = (F.col("rows") == F.col("recorded_rows")) & (F.col("rows") == F.col("unique_rows")) & (F.col("not_finite") == 0)
    return j.select(*run, "rows", "unique_rows", "not_finite", F.coalesce(ok, F.lit(False)).alias("ok"))


def cell_manifest_audit(manifest: DataFrame, selected: DataFrame, seeds: Sequence[int], keys: Sequence[str] = ("arm", "config_id", "split", "updates")) -> DataFrame:
    """Manifest cells against selected candidates x seeds, and job ids used twice."""
    ids = [*keys, "seed"]
    want = selected.select(*keys).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    got = manifest.select(*ids).distinct()
    cells = want.withColumn("__want", F.lit(True)).join(got.withColumn("__got", F.lit(True)), ids, "full")
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ids])
    jobs = manifest.groupBy("job").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return together(
        findings(cells, key, ("missing_cell", F.col("__got").isNull()), ("extra_cell", F.col("__want").isNull())),
        violation(jobs, "job_repeated", F.col("job"), F.col("n")),
    )


def ordered_id_digest(df: DataFrame, order: Sequence[str], row: str = "id", block: int = 1024, plan: Plan = AUTO) -> DataFrame:
    """SHA-256 over ids in order. A running hash is sequential, so ids are hashed in
    blocks of fixed length and the block digests again, level by level, until one
    digest is left; no step collects more than ``block`` texts."""
    d = row_positions(df, [], list(order), "__pos", plan, total="__n").select(
        "__pos", "__n", F.col(row).cast("string").alias("__t"))
    rows = d.agg(F.count(F.lit(1))).first()[0]

    def level(x):
        g = x.groupBy(F.floor(F.col("__pos") / block).alias("__pos")).agg(
            F.sort_array(F.collect_list(F.struct("__pos", "__t"))).alias("p"))
        return g.select("__pos", F.sha2(F.concat_ws("\n", F.transform("p", lambda v: v["__t"])), 256).alias("__t"))

    d, left = level(d), -(-rows // block)
    while left > 1:
        d, left = level(d), -(-left // block)
    return d.select(F.lit(rows).cast("bigint").alias("rows"), F.col("__t").alias("digest"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: row count, xor and sum of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))


def identity_digest(df: DataFrame, fields: Sequence[str], out: str = "digest") -> DataFrame:
    """SHA-256 of the fields as JSON in name order."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256))


def capped_sample_audit(sample: DataFrame, source: DataFrame, cap: int, era: str = "era") -> DataFrame:
    """Per era: rows in the sample against min(rows in the source, cap)."""
    s = sample.groupBy(era).agg(F.count(F.lit(1)).alias("sample_rows"))
    r = source.groupBy(era).agg(F.count(F.lit(1)).alias("source_rows"))
    want = F.least("source_rows", F.lit(cap))
    return s.join(r, era, "full").withColumn("ok", F.coalesce((F.col("sample_rows") <= want), F.lit(False)))


def independent_resample(panel: DataFrame, cap: int, seeds: tuple[int, int], metric) -> DataFrame:
    """Two capped samples with different seeds, both scored: ``metric(df)`` gives
    (era, score); returns both scores per era."""
    from eralens.operators.panel import cap_rows_per_era

    a, b = (metric(cap_rows_per_era(panel, cap, s)).select("era", F.col("score").alias(f"score_{n}")) for n, s in zip("ab", seeds))
    return a.join(b, "era", "full")


def rank_formula(total_rank: int, blocks: int, step: Column) -> Column:
    """sum over blocks of min(block cap, step - 1); caps split the total evenly, the
    first blocks getting the remainder, so only two different caps occur."""
    q, rem = divmod(total_rank, blocks)
    return F.least(F.lit(q + 1), step - 1) * F.lit(rem) + F.least(F.lit(q), step - 1) * F.lit(blocks - rem)


def curve_protocol_audit(curves: DataFrame, keys: Sequence[str], step: str, values: Sequence[str], first: int, last: int, every: int,
                         total_rank: int | None = None, blocks: int = 1, realized: str | None = None) -> DataFrame:
    """Steps missing from or outside the expected grid, non-finite values, and realized
    ranks that break the rank formula."""
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    have = curves.select(*keys, step).distinct()
    grid = curves.select(*keys).distinct().withColumn(step, F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(every))))
    types = dict(curves.dtypes)
    grid = grid.withColumn(step, F.col(step).cast(types[step]))
    broken = F.lit(False)
    for v in values:
        broken = broken | ~finite(F.col(v))
    steps = grid.withColumn("__want", F.lit(True)).join(have.withColumn("__got", F.lit(True)), [*keys, step], "full")
    cases = [("not_finite", broken, F.col(step))]
    if realized:
        cases.append(("rank", F.col(realized) != rank_formula(total_rank, blocks, F.col(step)), F.col(step)))
    return together(
        findings(steps, key, ("missing_step", F.col("__got").isNull(), F.col(step)), ("off_grid", F.col("__want").isNull(), F.col(step))),
        findings(curves, key, *cases),
    )


def one_touch_audit(ledger: DataFrame, signature: str) -> DataFrame:
    """Signatures evaluated other than once."""
    n = ledger.groupBy(signature).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != 1)
    return violation(n, "touched", F.col(signature), F.col("n"))


def live_round_checks(live: DataFrame, bench: DataFrame, target: str = "target", bench_value: str = "benchmark", key: str = "id") -> DataFrame:
    """Empty round, repeated ids, ids on one side only, revealed targets, missing benchmark."""
    empty = live.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    ids = live.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    known = bench.select(key).distinct().withColumn("__known", F.lit(True))
    k = F.col(key)
    return together(
        violation(empty, "empty", F.lit("round")),
        violation(ids.where(F.col("__n") > 1), "duplicate", k, F.col("__n")),
        findings(live.join(known, key, "left"), k, ("no_benchmark", F.col("__known").isNull()), ("revealed_target", F.col(target).isNotNull())),
        findings(bench.join(ids, key, "left"), k, ("not_live", F.col("__n").isNull()), ("benchmark_missing", ~finite(F.col(bench_value)))),
    )


def prediction_range_check(predictions: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Values not strictly inside (0, 1), ids without or with several predictions
    (once an id, however often ``ids`` repeats it)."""
    p = F.col("prediction")
    n = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    known = ids.groupBy(key).agg(F.count(F.lit(1)).alias("__ids"))
    return together(
        violation(predictions.where(~(finite(p) & (p > 0.0) & (p < 1.0))), "range", F.col(key)),
        findings(
            n.join(known, key, "full"), F.col(key),
            ("duplicate", F.col("__n") > 1, F.col("__n")),
            ("missing", F.col("__n").isNull()),
            ("unknown", F.col("__ids").isNull()),
        ),
    )


def prediction_diff(a: DataFrame, b: DataFrame, key: str = "id", value: str = "prediction", tolerance: float = 1e-4, keys: Sequence[str] = ()) -> DataFrame:
    """Two prediction tables, per ``keys``: id agreement, largest and mean difference, correlation."""
    j = a.select(*keys, key, F.col(value).alias("x")).join(b.select(*keys, key, F.col(value).alias("y")), [*keys, key], "full")
    d = F.abs(F.col("x") - F.col("y"))
    one_side = F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1))
    r = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), one_side.alias("unmatched"), F.max(d).alias("max_abs"),
              F.avg(d).alias("mean_abs"), F.corr("x", "y").alias("pearson"))
    return r.withColumn("passed", (F.col("unmatched") == 0) & (F.col("max_abs") <= tolerance))
