"""Missing-value rules: sums that propagate nulls, ratios that never raise, NaN as null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def strict_sum(c: Column | str) -> Column:
    """Sum that is null as soon as one input row is null; still combines on the map side."""
    c = as_col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def strict_avg(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division with null in place of an infinite or undefined result."""
    return F.try_divide(as_col(numerator), as_col(denominator))


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def zero_fill(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def row_total(columns: Iterable[str]) -> Column:
    """Row-wise total over named columns; null if one of them is null."""
    total = None
    for name in columns:
        total = as_col(name) if total is None else total + as_col(name)
    return total


def match(c: Column, table: dict, default=None) -> Column:
    """Value of a small fixed dictionary as a CASE expression; unknown keys give `default`."""
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out if default is None else out.otherwise(default)
