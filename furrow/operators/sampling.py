"""Monte Carlo building blocks: draws per row, shared draws, parameter draws, study resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.draws import (high_from_sd, low_from_sd, noise, stream, triangular, uniform)
from furrow.functions.nulls import as_col
from furrow.operators.relational import expand_samples

Bounds = tuple[Column | str, Column | str, Column | str]


def triangular_draws(df: DataFrame, variables: dict[str, Bounds],
                     key: Sequence[str] | dict[str, Sequence[str]], n: int,
                     keep: Sequence[str] | None = None, shared: bool = False) -> DataFrame:
    """Each row n times with one triangular draw (low, mode, high) per variable.

    Stream ids and bounds are fixed before the rows multiply; afterwards a draw is arithmetic on
    its stream and the sample number. `key` is one row key or one per variable; `shared` leaves it
    out, so that all rows move together.
    """
    keep = list(df.columns if keep is None else keep)
    fixed = []
    for i, (name, (low, mode, high)) in enumerate(variables.items()):
        ids = [] if shared else key[name] if isinstance(key, dict) else key
        fixed += [stream(name, *ids).alias(f"__s{i}"), as_col(low).alias(f"__a{i}"),
                  as_col(mode).alias(f"__c{i}"), as_col(high).alias(f"__b{i}")]
    rows = expand_samples(df.select(*[as_col(c) for c in keep], *fixed), n)
    rows = rows.withColumn("__noise", noise("Id_sample"))
    rows = rows.withColumns({f"__u{i}": uniform(f"__s{i}", "__noise")
                             for i in range(len(variables))})
    return rows.select(*[as_col(c) for c in keep], "Id_sample", *[
        triangular(f"__u{i}", f"__a{i}", f"__c{i}", f"__b{i}").alias(name)
        for i, name in enumerate(variables)])


FACTOR_DRAWS = {"N2Oi_ef": "N2Oi", "N2Od_ef": "N2Od", "NH3_ef": "NH3", "NOx_ef": "NOx"}


def factor_row(factors: DataFrame) -> DataFrame:
    """The emission-factor table as one row, columns <factor_key>_<measure>."""
    keys = [*FACTOR_DRAWS.values(), "C_low", "C_high"]
    return factors.groupBy().agg(*[
        F.max(F.when(F.col("factor_key") == k, as_col(m))).alias(f"{k}_{m}")
        for k in keys for m in ["lower_limit", "recommended_value", "upper_limit"]])


def factor_draws(factors: DataFrame, n: int) -> DataFrame:
    """Field emission factors, one row per sample."""
    bounds = {name: (f"{k}_lower_limit", f"{k}_recommended_value", f"{k}_upper_limit")
              for name, k in FACTOR_DRAWS.items()}
    low, high = F.col("C_low_recommended_value"), F.col("C_high_recommended_value")
    bounds["C_ef"] = (low, (high + low) / 2, high)
    return triangular_draws(factor_row(factors), bounds, [], n, keep=[])


def number_sources(pairs: DataFrame, ids: Sequence[str], source: str) -> DataFrame:
    """Distinct sources of an id, numbered by name, with their count `n`."""
    own = Window.partitionBy(*ids)
    return pairs.select(*ids, source).distinct().withColumns({
        "__place": F.row_number().over(own.orderBy(source)),
        "n": F.count(F.lit(1)).over(own)})


def resample_sources(pairs: DataFrame, ids: Sequence[str], source: str, n: int) -> DataFrame:
    """One source per id and sample, uniformly and with replacement.

    Every source checks by itself whether the sample's uniform falls on its number, so the choice
    needs neither a join nor a gathered list.
    """
    numbered = number_sources(pairs, ids, source).withColumn("__s", stream("source", *ids))
    rows = expand_samples(numbered, n)
    place = F.floor(uniform("__s", noise("Id_sample")) * F.col("n")) + 1
    return rows.where(place == F.col("__place")).select("Id_sample", *ids, source)


def bounds_from_sd(df: DataFrame, value: str, sd: str, lower: str | None = None,
                   upper: str | None = None, rule: str = "ratio", scale: float = 1.0) -> DataFrame:
    """Columns `low` and `high`: given limits where present, else from the standard deviation."""
    low = low_from_sd(value, sd, rule) / scale
    high = high_from_sd(value, sd)
    return df.withColumns({"low": F.coalesce(as_col(lower), low) if lower else low,
                           "high": F.coalesce(as_col(upper), high) if upper else high})


def repeat_points(df: DataFrame, n: int = K.N_SAMPLES) -> DataFrame:
    """Point values repeated for every sample."""
    return expand_samples(df, n)
