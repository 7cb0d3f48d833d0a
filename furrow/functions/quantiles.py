"""Exact quantiles per group without gathering a group in one task.

Values are counted first, so copies cost nothing. A histogram of at most `BUCKETS` equal-width
buckets finds the bucket of every wanted rank. A bucket that holds too many different values gets a
histogram of its own, over its own range, and so on: only buckets of at most `RANKED` different values
are ordered. Linear interpolation between the two neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.nulls import as_col
from furrow.operators.relational import keep_matches
from furrow.sources.stages import stage

BUCKETS = 65536
#: Different values of a bucket that are put in order at once.
RANKED = 4096


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float],
                    weight: str | None = None, ranked: int = RANKED) -> DataFrame:
    """One row per group that has a value; one column per named quantile. `weight` names a column
    of row counts when the values are counted already."""
    group = [*keys] or ["__all"]
    source = df if keys else df.withColumn("__all", F.lit(0))
    v = F.nanvl(as_col(value).cast("double"), F.lit(None).cast("double"))
    rows = source.select(*group, v.alias("__v"), as_col(weight or F.lit(1)).alias("__w"))
    counts = stage(rows.where("__v IS NOT NULL").groupBy(*group, "__v").agg(
        F.sum("__w").alias("__n")), "value_counts")
    whole = counts.groupBy(*group).agg(
        F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__n").alias("__total"),
        F.count(F.lit(1)).alias("__different"))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"))
        for name, p in quantiles.items()]))
    targets = whole.select("*", wanted.alias("__q")).withColumn("__h", F.col("__q.p") * (F.col("__total") - 1))
    targets = targets.select(*group, F.col("__q.name").alias("__name"), "__h", F.explode(
        F.array_distinct(F.array(F.floor("__h"), F.ceil("__h")))).alias("__rank"),
        "__low", "__high", F.lit(0).cast("long").alias("__before"), "__different")
    ends = _found(counts, targets, group, ranked).groupBy(*group, "__name", "__h").agg(
        F.min("__v").alias("a"), F.max("__v").alias("b"))
    point = F.col("a") + (F.col("__h") - F.floor("__h")) * (F.col("b") - F.col("a"))
    return ends.groupBy(*group).agg(*[
        F.max(F.when(F.col("__name") == name, point)).alias(name) for name in quantiles]) \
        .drop("__all")


def _found(counts: DataFrame, targets: DataFrame, group: list[str], ranked: int) -> DataFrame:
    """The value at each target's rank: ranges narrow until few different values are left in each."""
    out = []
    while True:
        targets = stage(targets, "quantile_ranges")
        done = F.col("__different") <= ranked
        out.append(_ordered(counts, targets.where(done), group))
        wide = targets.where(~done)
        if wide.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), out)
        targets = _narrowed(counts, wide, group)


def _within(counts: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    return keep_matches(counts, ranges, group).where(F.col("__v").between(F.col("__low"), F.col("__high")))


def _narrowed(counts: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """The targets with the bucket of their range that holds their rank as the new range."""
    ranges = targets.select(*group, "__low", "__high").distinct()
    # Halves, so that the width of no range overflows.
    part = F.try_divide(F.col("__v") / 2 - F.col("__low") / 2, F.col("__high") / 2 - F.col("__low") / 2)
    bucket = F.least(F.floor(F.nanvl(part, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1))
    histogram = _within(counts, ranges, group).withColumn("__bucket", F.coalesce(bucket, F.lit(0))) \
        .groupBy(*group, "__low", "__high", "__bucket").agg(
            F.sum("__n").alias("__c"), F.count(F.lit(1)).alias("__values"), F.min("__v").alias("__least"),
            F.max("__v").alias("__most"))
    own = [*group, "__low", "__high"]
    up_to = Window.partitionBy(*own).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    histogram = histogram.withColumn("__until", F.sum("__c").over(up_to))
    start = F.col("__before") + F.col("__until") - F.col("__c")
    hits = keep_matches(targets, histogram, own).where(
        (F.col("__rank") >= start) & (F.col("__rank") < start + F.col("__c")))
    # A range that does not narrow (its values differ by less than a double can tell) is put in order as it is.
    stuck = (F.col("__least") == F.col("__low")) & (F.col("__most") == F.col("__high"))
    return hits.select(*group, "__name", "__h", "__rank", F.col("__least").alias("__low"),
                       F.col("__most").alias("__high"), start.alias("__before"),
                       F.when(stuck, 1).otherwise(F.col("__values")).alias("__different"))


def _ordered(counts: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """The value at each target's rank among the values of its range."""
    ranges = targets.select(*group, "__low", "__high", "__before").distinct()
    own = [*group, "__low", "__high"]
    up_to = Window.partitionBy(*own).orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    seen = _within(counts, ranges, group).withColumn("__seen", F.col("__before") + F.sum("__n").over(up_to)) \
        .select(*own, "__v", "__n", "__seen")
    return keep_matches(targets, seen, own).where(
        (F.col("__rank") < F.col("__seen")) & (F.col("__rank") >= F.col("__seen") - F.col("__n"))) \
        .select(*group, "__name", "__h", "__v")
