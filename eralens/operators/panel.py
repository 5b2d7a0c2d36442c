"""Panel preparation: encodings, filters, sampling and controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralens.functions.checks import ensure
from eralens.functions.exprs import finite, hash_unit, keyed, signed_pow, with_probit
from eralens.functions.ranking import AUTO, Plan, exact_quantiles, on_keys, resolve, row_positions, top_n

TOLERANCE = 1e-6


def encode_bins(x: Column, scale: str) -> Column:
    """0..4 code of a feature value, NULL if it is not one of the five bins.

    ``scale`` is 'codes' (integers 0..4 or floats near them, missing -> 2) or
    'unit' (quarters of [0, 1], missing -> 1/2)."""
    if scale not in ("codes", "unit"):
        raise ValueError("scale must be 'codes' or 'unit'")
    factor, missing = (1.0, 2.0) if scale == "codes" else (4.0, 0.5)
    v = F.when(finite(x), x.cast("double")).otherwise(F.lit(missing))
    c = F.rint(v * factor)
    ok = c.between(0.0, 4.0) & (F.abs(v - c / F.lit(factor)) <= TOLERANCE)
    return F.when(ok, c.cast("tinyint"))


def file_scales(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``file, scale``: the scale of every file behind a frame that was read from files. Whole
    numbers are codes; other values are quarters of [0, 1] if none exceeds 1, else codes.
    One row a file, from the files' own minima and maxima; nulls and NaN say nothing."""
    kinds = dict(frame.dtypes)
    whole = all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in columns)
    known = [F.when(finite(F.col(c)), F.col(c).cast("double")) for c in columns]
    top = F.max(F.greatest(*known) if len(known) > 1 else known[0])
    scale = F.lit("codes") if whole else F.when(top > 1.0, "codes").otherwise("unit")
    return frame.groupBy(F.col("_metadata.file_path").alias("file")).agg(scale.alias("scale"))


def encode_files(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame with ``columns`` as codes 0..4, whichever scale each of its files uses. A value
    that is none of the five bins of its file's scale fails the query."""
    file = F.col("_metadata.file_path").alias("__file")
    rows = frame.select("*", file).join(file_scales(frame, columns).withColumnRenamed("file", "__file"), "__file")
    for c in columns:
        code = F.when(F.col("scale") == "codes", encode_bins(F.col(c), "codes")).otherwise(encode_bins(F.col(c), "unit"))
        rows = rows.withColumn(f"__code_{c}", code)
        where = F.concat(F.lit(f"{c} is no bin of scale "), F.col("scale"), F.lit(": "), F.coalesce(F.col(c).cast("string"), F.lit("null")))
        rows = ensure(rows, F.col(f"__code_{c}").isNotNull(), where)
    return rows.select(*[F.col(f"__code_{c}").alias(c) if c in columns else F.col(c) for c in frame.columns])


def normalise_live_features(df: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """Missing -> 1/2; a frame with any value above 1 must hold integers 0..4 and is
    divided by 4. ``by`` names what tells frames apart, such as the round; without it the
    table is one frame. Adds ``normalised`` and ``valid``."""
    filled = F.transform(features, lambda v: F.when(finite(v.cast("double")), v.cast("double")).otherwise(F.lit(0.5)))
    d = df.withColumn("__f", filled)
    top = F.max(F.array_max("__f")).alias("__top")
    d = on_keys(d, d.groupBy(*by).agg(top), list(by)) if by else d.withColumn("__top", d.agg(top).scalar())
    d = d.withColumn("__scale", F.when(F.col("__top") > 1.0, 4.0).otherwise(1.0)).drop("__top")
    integral = F.forall("__f", lambda v: (F.abs(v - F.rint(v)) <= TOLERANCE) & v.between(0.0, 4.0))
    unit = F.forall("__f", lambda v: v.between(0.0, 1.0))
    return (
        d.withColumn("valid", F.when(F.col("__scale") > 1.0, integral).otherwise(unit))
        .withColumn("normalised", F.transform("__f", lambda v: v / F.col("__scale")))
        .drop("__f", "__scale")
    )


def scale_features(features: str = "features", centred: bool = False) -> Column:
    """code/4 in [0, 1], or (code - 2)/2 in [-1, 1]."""
    if centred:
        return F.transform(features, lambda v: (v - F.lit(2)) / F.lit(2.0))
    return F.transform(features, lambda v: v / F.lit(4.0))


def center_target(target: str = "target", power: float | None = None) -> Column:
    t = F.col(target) - F.lit(0.5)
    return t if power is None else signed_pow(t, power)


def filter_data_type(df: DataFrame, kind: str = "validation") -> DataFrame:
    return df.where(F.col("data_type") == kind)


def usable_eras(df: DataFrame, least: float = 0.95, target: str = "target", era: str = "era") -> DataFrame:
    """Eras whose share of rows with a target is at least ``least``."""
    coverage = F.avg(F.when(F.col(target).isNotNull(), 1.0).otherwise(0.0))
    return df.groupBy(era).agg(coverage.alias("coverage"), F.count(F.lit(1)).alias("n")).where(F.col("coverage") >= least)


def drop_unresolved(df: DataFrame, target: str = "target") -> DataFrame:
    return df.where(finite(F.col(target)))


def cap_rows_per_era(df: DataFrame, rows: int, seed: int, row: str = "id", era: str = "era") -> DataFrame:
    """At most ``rows`` rows per era, chosen by hash of (seed, row)."""
    d = df.withColumn("__h", F.md5(keyed(seed, F.col(row))))
    return top_n(d, [era], [F.asc("__h"), F.asc(row)], rows, "__place").drop("__h", "__place")


def min_era_rows(df: DataFrame, least: int = 100, era: str = "era") -> DataFrame:
    """Drop eras with too few rows (counted, then a semi join on the era)."""
    keep = df.groupBy(era).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(era)
    return df.join(keep, era, "left_semi")


def last_n_eras(eras: DataFrame, n: int, era: str = "era") -> DataFrame:
    """The last n distinct eras."""
    return eras.select(era).distinct().orderBy(F.desc(era)).limit(n)


def select_feature_subset(df: DataFrame, available: Sequence[str], wanted: Sequence[str], features: str = "features") -> DataFrame:
    """Reorder the feature array by name."""
    for names in (available, wanted):
        if len(set(names)) != len(names):
            raise ValueError("duplicate feature names")
    missing = sorted(set(wanted) - set(available))
    if missing:
        raise ValueError(f"unknown features: {missing}")
    at = [list(available).index(w) for w in wanted]
    return df.withColumn(features, F.array(*[F.get(F.col(features), F.lit(i)) for i in at]))


def rows_for_eras(df: DataFrame, eras: DataFrame, era: str = "era") -> DataFrame:
    return df.join(eras.select(era), era, "left_semi")


def permute_column(df: DataFrame, column: str, seed: int, row: str = "id", plan: Plan = AUTO) -> DataFrame:
    """Global seeded shuffle of one column: position by row key meets position by hash."""
    split = resolve(df, [], plan)
    natural = row_positions(df, [], row, "__pos", split)
    drawn = row_positions(
        df.select(row, column).withColumn("__h", F.md5(keyed(seed, F.col(row)))), [], ["__h", row], "__pos", split
    ).select("__pos", F.col(column).alias(f"{column}_permuted"))
    return natural.join(drawn, "__pos").drop("__pos")


def zero_predictor(df: DataFrame, seed: int, row: str = "id", out: str = "zero_prediction") -> DataFrame:
    """Seeded standard normal noise per row, hashed from the row key."""
    u = hash_unit(keyed("zero", seed, F.col(row))) * F.lit(1.0 - 2.0 ** -32) + F.lit(2.0 ** -33)
    return with_probit(df, u, out)


def synthetic_quintiles(df: DataFrame, score: str, out: str = "quintile", plan: Plan = AUTO) -> DataFrame:
    """Bins of a continuous score at its 5/25/75/95% quantiles, as {0, .., 1} - 1/2."""
    cuts = exact_quantiles(df, [], score, {"c1": 0.05, "c2": 0.25, "c3": 0.75, "c4": 0.95}, plan=plan)
    d = df.withColumn("__c", cuts.select(F.array("c1", "c2", "c3", "c4")).scalar())
    above = [F.when(F.col(score) > F.col("__c")[i], 1.0).otherwise(0.0) for i in range(4)]
    return d.withColumn(out, (above[0] + above[1] + above[2] + above[3]) / F.lit(4.0) - F.lit(0.5)).drop("__c")


def panel_manifest(df: DataFrame, targets: Sequence[str], era: str = "era") -> DataFrame:
    """One row: rows, eras, first and last era, and per target resolved rows and eras."""
    resolved = []
    for t in targets:
        has = finite(F.col(t))
        resolved += [
            F.count(F.when(has, 1)).alias(f"{t}_rows"),
            F.size(F.collect_set(F.when(has, F.col(era)))).cast("bigint").alias(f"{t}_eras"),
        ]
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.size(F.collect_set(era)).cast("bigint").alias("eras"),
        F.min(era).alias("era_min"), F.max(era).alias("era_max"), *resolved,
    )


def era_label(era: str = "era") -> Column:
    """Four-digit text form, for reports only."""
    return F.lpad(F.col(era).cast("string"), 4, "0")
