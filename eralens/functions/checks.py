"""Audits return violation rows (kind, key, detail); ``require`` raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    pass


def violation(df: DataFrame, kind: str, key: Column, detail: Column | None = None) -> DataFrame:
    """Rows of ``df`` as violations of one kind."""
    return df.select(
        F.lit(kind).alias("kind"),
        key.cast("string").alias("key"),
        (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
    )


def findings(df: DataFrame, key: Column, *cases: tuple) -> DataFrame:
    """Violations of several kinds from one pass over ``df``. A case is ``(kind, condition)``
    or ``(kind, condition, detail)``; a row gives a violation for each condition it meets."""
    found = [
        F.when(condition, F.struct(
            F.lit(kind).alias("kind"), key.cast("string").alias("key"),
            (detail[0] if detail else F.lit("")).cast("string").alias("detail")))
        for kind, condition, *detail in cases
    ]
    return df.select(F.inline(F.filter(F.array(*found), lambda v: v.isNotNull())))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ensure(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """The rows of ``df``; a row that does not meet the condition fails the query that reads it,
    with the message. It is checked where rows are made, in no pass of its own."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.assert_true(F.coalesce(condition, F.lit(False)), text).isNull())


def require(violations: DataFrame, what: str = "check") -> None:
    """Raise if there is at least one violation; reads five of them for the message."""
    first = violations.limit(5).collect()
    if first:
        shown = "; ".join(f"{r['kind']}[{r['key']}] {r['detail']}".strip() for r in first)
        raise CheckFailed(f"{what}: {shown}")
