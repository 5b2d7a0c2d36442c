"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published rational approximation AS 241 (PPND16) of the
# inverse normal distribution function. (numerator, denominator), powers 0..7.
AS241_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
AS241_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
AS241_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def ratio_text(coefs, x: str) -> str:
    """Quotient of two polynomials as SQL text (one call instead of some thirty)."""
    def poly(c):
        acc = f"{c[-1]:.17e}"
        for a in reversed(c[:-1]):
            acc = f"({acc}*{x} + {a:.17e})"
        return acc

    return f"{poly(coefs[0])}/{poly(coefs[1])}"


def with_probit(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Inverse normal CDF of p (NULL unless 0 < p < 1), in steps. The intermediate
    columns are never NULL and are used several times, so Catalyst keeps them apart and
    the generated code stays small enough for the JIT (six times faster than one
    expression)."""
    kept = df.columns
    d = df.withColumn("__p", p).withColumn("__p0", F.expr("coalesce(__p, 0.5e0)")).withColumn("__q", F.expr("__p0 - 0.5e0"))
    d = d.withColumn("__r", F.expr(
        "CASE WHEN abs(__q) <= 0.425e0 THEN 0.180625e0 - __q*__q ELSE sqrt(-coalesce(ln(least(__p0, 1e0 - __p0)), -1e0)) END"))
    z = (
        f"CASE WHEN NOT (__p > 0e0 AND __p < 1e0) THEN NULL WHEN abs(__q) <= 0.425e0 THEN __q*{ratio_text(AS241_CENTRE, '__r')} "
        f"WHEN __r <= 5e0 THEN signum(__q)*{ratio_text(AS241_MIDDLE, '(__r - 1.6e0)')} ELSE signum(__q)*{ratio_text(AS241_FAR, '(__r - 5e0)')} END"
    )
    return d.select(*[c for c in kept if c != out], F.expr(f"CASE WHEN __p IS NOT NULL THEN {z} END").alias(out))


def signed_pow(x: Column, power: float = 1.5) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(power))


def hash_u32(text: Column) -> Column:
    """Unsigned 32-bit integer from the first eight hex digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(text: Column) -> Column:
    """Deterministic uniform value in [0, 1); independent of partitioning."""
    return hash_u32(text) / F.lit(4294967296.0)


def keyed(*parts) -> Column:
    """'a:b:c' text of constants and columns, the input of the hash draws."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *cols)


def finite(x: Column) -> Column:
    """False for NULL, NaN and infinities."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def avg_rank_unit(below: Column, ties: Column, total: Column) -> Column:
    """(average rank - 1/2) / n from counts of smaller and equal rows."""
    return (below + ties / F.lit(2.0)) / total


def moments_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from additive sums; NULL if either side is constant."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    eps = F.lit(1e-14)
    ok = (vx > eps * n * sxx) & (vy > eps * n * syy)
    return F.when(ok, (n * sxy - sx * sy) / F.sqrt(vx * vy))


def on_grid(x: Column, digits: int) -> Column:
    """Nearest multiple of 10^-digits, halves away from zero, in floating point; F.round
    would go through BigDecimal for every row."""
    scale = F.lit(10.0 ** digits)
    size = F.abs(x * scale)
    whole = F.rint(size)                        # halves to even: one more if it went down
    return F.signum(x) * (whole + F.when(size - whole == 0.5, 1.0).otherwise(0.0)) / scale


def rounded(x: Column, digits: int = 8) -> Column:
    """Round for comparison between engines, without negative zero."""
    return on_grid(x.cast("double"), digits) + F.lit(0.0)
