"""Join, reshape and fill primitives that every domain operator is written with."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.nulls import as_col, strict_sum
from furrow.sources.stages import stage


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(lambda a, b: a & b,
                       [as_col(k).eqNullSafe(as_col(f"__{k}")) for k in keys])
    return left.join(renamed, condition, how)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a null key matches a null key; many-to-many is allowed."""
    return _matched(left, right, keys, "left").drop(*[f"__{k}" for k in keys])


def keep_matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`attach` without the rows that find no partner."""
    return _matched(left, right, keys, "inner").drop(*[f"__{k}" for k in keys])


def keep_facts(attributes: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right join: attributes first, every fact row kept."""
    keys = list(keys)
    renamed = attributes.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(lambda a, b: a & b,
                       [as_col(k).eqNullSafe(as_col(f"__{k}")) for k in keys])
    joined = renamed.join(facts, condition, "right")
    extra = [c for c in attributes.columns if c not in keys]
    rest = [c for c in facts.columns if c not in keys]
    return joined.select(*keys, *[as_col(c) for c in extra + rest])


def align(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on null-safe keys; the key comes from whichever side has it."""
    marked = right.withColumn("__right", F.lit(True))
    joined = _matched(left, marked, keys, "full")
    joined = joined.withColumns(
        {k: F.when(as_col("__right"), as_col(f"__{k}")).otherwise(as_col(k)) for k in keys})
    return joined.drop("__right", *[f"__{k}" for k in keys])


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def widen(df: DataFrame, ids: Sequence[str], key: str, names: dict, value: str,
          total: bool = True) -> DataFrame:
    """Long to wide with the key values stated, so the schema never depends on the data."""
    measure = F.sum(as_col(value)) if total else F.first(as_col(value), ignorenulls=True)
    wide = df.groupBy(*ids).pivot(key, list(names)).agg(measure)
    return wide.withColumnsRenamed({str(k): v for k, v in names.items()})


def lengthen(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str,
             value: str) -> DataFrame:
    """Wide to long over stated columns."""
    return df.unpivot([as_col(c) for c in ids], [as_col(c) for c in columns], key, value)


def join_key(name: str, parts: Sequence[str]) -> Column:
    """Composite text key; a missing part is spelled NA, so that the parts keep their places."""
    return F.concat_ws("-", *[F.coalesce(as_col(p).cast("string"), F.lit("NA"))
                              for p in parts]).alias(name)


def split_key(df: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """Parts of a composite key; the last one keeps any separators of its own."""
    pieces = F.split(as_col(key), "-", len(parts))
    return df.withColumns({p: F.get(pieces, F.lit(i)) for i, p in enumerate(parts)}).drop(key)


def expand_samples(df: DataFrame, n: int, column: str = "Id_sample") -> DataFrame:
    """Every row once per sample number 1..n."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias(column))


#: Rows a task produces when they multiply, about: what it groups follows from this, not from the input.
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, keys: Sequence[str], factor: int) -> DataFrame:
    """Stage rows and place them by key before each of them multiplies by `factor`.

    The number of partitions follows from the number of staged rows, so that a task produces about
    ROWS_PER_TASK rows. Later groupings that contain the keys need no further shuffle, so the
    multiplied rows are never shuffled.
    """
    held = stage(df, "placed")
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return held.repartition(max(parallel, -(-held.count() * factor // ROWS_PER_TASK)), *keys)


def place(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows together by key, unless they are stored so: for groupings by the keys and more columns. Rows
    of a key that are alike follow each other, so they take little of the shuffle."""
    stored = df._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    parts = re.fullmatch(r"hashpartitioning\((.*), \d+\)", stored)
    names = {re.sub(r"#\d+L?$", "", x) for x in parts[1].split(", ")} if parts else set()
    return df if names and names <= set(keys) else df.repartition(*keys)


def nest_samples(df: DataFrame, keys: Sequence[str], values: Sequence[str], n: int, name: str
                 ) -> DataFrame:
    """One row per key with an array of n entries; entry i lists all rows (values) of sample i.

    A sample without rows has an empty list, repeated rows of a sample stay repeated. A sample
    number outside 1..n is an error.
    """
    number = F.col("Id_sample")
    checked = F.when(number.between(1, n), number).otherwise(F.raise_error(F.concat(
        F.lit(f"{name}: sample outside 1..{n}: "), F.coalesce(number.cast("string"), F.lit("null"))))).cast("int")
    lists = df.select(*keys, checked.alias("__i"), F.struct(*values).alias("__row")).groupBy(*keys, "__i").agg(
        F.collect_list("__row").alias("rows"))
    held = lists.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "rows"))).alias("__held"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array_position(F.col("__held.__i"), i))
    gaps = F.transform(at, lambda j: F.coalesce(
        F.get(F.col("__held.rows"), (j - 1).cast("int")), F.array().cast(lists.schema["rows"].dataType)))
    return held.select(*keys, F.when(F.size("__held") == n, F.col("__held.rows")).otherwise(gaps).alias(name))


def unnest_samples(df: DataFrame, nested: dict[str, Sequence[str]], n: int) -> DataFrame:
    """Every row once per sample and combination of the sample's rows in each nested array.

    That is what left joins by key and sample would return one after another: a missing array and
    an empty list give missing values, a list of several rows repeats the row. The arrays are
    zipped and the zipped array is what explodes, so an exploded row carries one entry of each
    array and never the arrays.
    """
    types = dict(df.dtypes)
    arrays = [F.coalesce(F.col(name), F.array().cast(types[name])).alias(name) for name in nested]
    numbers = F.sequence(F.lit(1), F.lit(n)).alias("Id_sample")
    rows = df.withColumn("__entry", F.explode(F.arrays_zip(numbers, *arrays))).drop(*nested)
    counts = [F.greatest(F.coalesce(F.size(F.col(f"__entry.{name}")), F.lit(0)), F.lit(1)) for name in nested]
    if nested:
        combinations = reduce(lambda a, b: a * b, counts)
        rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), combinations - 1)))
    picked, left = {}, F.col("__k")
    for (name, values), count in zip(nested.items(), counts):
        entry = F.get(F.col(f"__entry.{name}"), (left % count).cast("int"))
        picked |= {v: entry[v] for v in values}
        left = F.floor(left / count)
    return rows.withColumns({"Id_sample": F.col("__entry.Id_sample")} | picked).drop("__entry", "__k")


def share_of_total(df: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    """Value over its group's total. The totals combine before the shuffle and come back as a
    staged lookup, so no group is ever gathered in one task."""
    totals = stage(df.groupBy(*keys).agg(strict_sum(value).alias("__total")), "totals")
    joined = attach(df, totals, keys)
    return joined.withColumn(out, F.try_divide(as_col(value), F.col("__total"))).drop("__total")


def fill_by_tier_means(df: DataFrame, columns: Sequence[str], tiers: Sequence[Sequence[str]],
                       label: str | None = None, labels: Sequence[str] = (),
                       driver: str | None = None) -> DataFrame:
    """Fill nulls with group means, tier after tier; each tier's mean includes earlier fills.

    All nulls of one combination of tier keys receive the same fill, so the means are worked out
    on (rows, known rows, sum) per combination and only the finished means meet the rows. `label`
    records the tier that was reached, judged by the column `driver`.
    """
    driver = driver or columns[0]
    keys = list(dict.fromkeys(k for tier in tiers for k in tier))
    clean = df.withColumns({c: F.nanvl(as_col(c), F.lit(None).cast("double")) for c in columns})
    aggregates = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        aggregates += [F.count(as_col(c)).alias(f"__k_{c}"),
                       F.coalesce(F.sum(as_col(c)), F.lit(0.0)).alias(f"__s_{c}")]
    cells = stage(clean.groupBy(*keys).agg(*aggregates), "tier_cells")
    out = clean
    if label:
        out = out.withColumn(label, F.when(as_col(driver).isNull(), F.lit(labels[1]))
                             .otherwise(F.lit(labels[0])))
    for depth, tier in enumerate(tiers):
        means = stage(cells.groupBy(*tier).agg(
            *[F.try_divide(F.sum(as_col(f"__s_{c}")), F.sum(as_col(f"__k_{c}"))).alias(f"__m_{c}")
              for c in columns]), "tier_means")
        cells = attach(cells, means, tier)
        cells = cells.withColumns({
            name: value for c in columns for name, value in (
                (f"__s_{c}", as_col(f"__s_{c}") + F.coalesce(
                    (F.col("__n") - as_col(f"__k_{c}")) * as_col(f"__m_{c}"), F.lit(0.0))),
                (f"__k_{c}", F.when(as_col(f"__m_{c}").isNotNull(), F.col("__n"))
                 .otherwise(as_col(f"__k_{c}"))))
        }).drop(*[f"__m_{c}" for c in columns])
        out = attach(out, means, tier)
        out = out.withColumns({c: F.coalesce(as_col(c), as_col(f"__m_{c}")) for c in columns})
        out = out.drop(*[f"__m_{c}" for c in columns])
        if label and depth + 2 < len(labels):
            out = out.withColumn(label, F.when(as_col(driver).isNull(), F.lit(labels[depth + 2]))
                                 .otherwise(as_col(label)))
    return out


def rows_with_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Audit: rows in which one of the columns is still missing."""
    return df.where(reduce(lambda a, b: a | b, [as_col(c).isNull() for c in columns]))
