"""Stage tables: small derived lookups written once to the cluster's shared folder.

A lookup that is staged is computed once, survives the loss of executors, and has a size that
Spark knows from its files: the planner broadcasts it below
`spark.sql.autoBroadcastJoinThreshold` and otherwise plans a shuffle join, whose hot keys adaptive
execution splits. No broadcast is forced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a local session that names none uses its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each write inside deletes its shuffle files as it ends. Else they stay on the executors' disks
    until the driver happens to collect its garbage, for all stage tables of a run together. A write
    plans its rows anew, so nothing reads those files again; the session's setting is put back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _write(df: DataFrame, tag: str, owner: WorkingTables | None) -> DataFrame:
    """The owner knows the table before it is written, so a broken write is deleted too."""
    return _write_parts([df], tag, owner)


def _write_parts(parts: Iterable[DataFrame], tag: str, owner: WorkingTables | None, **options: str) -> DataFrame:
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        if path is None:
            path = f"{stage_root(spark)}/furrow/{tag}-{uuid4().hex}"
            if owner is not None:
                owner.own(spark, path)
        with shuffles_dropped(spark):
            df.write.mode("append").options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a parquet stage table and return the scan of it. Within a `lifetime` the table
    is deleted at its end, else it stays."""
    return _write(df, tag, _LIFETIME.get())


def stage_parts(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """`stage` of the rows of all parts, one after another: what a part shuffles is deleted before the
    next one starts. For large tables, hence compressed more."""
    return _write_parts(parts, tag, _LIFETIME.get(), compression="zstd")


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a stage table, on whatever file system its folder is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class WorkingTables:
    """Stage tables with one owner; `drop` deletes all but those written by `kept`."""

    def __init__(self) -> None:
        self._owned: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        return _write(df, tag, self)

    def own(self, spark: SparkSession, path: str) -> None:
        self._owned.append((spark, path))

    def kept(self, df: DataFrame, tag: str) -> DataFrame:
        return stage(df, tag)

    def drop(self) -> None:
        while self._owned:
            drop_table(*self._owned.pop())


@contextmanager
def working_tables() -> Iterator[WorkingTables]:
    """Stage tables of one computation, deleted at its end, also when it fails.

    What it returns must be written by `kept`: a lazy result would read deleted tables. Its own
    tables have new names each time, so a broken computation can be started again as it is."""
    tables = WorkingTables()
    try:
        yield tables
    finally:
        tables.drop()


#: Owner of the tables that `stage` writes, if any.
_LIFETIME: ContextVar[WorkingTables | None] = ContextVar("lifetime", default=None)


@contextmanager
def lifetime() -> Iterator[None]:
    """All tables that `stage` writes inside, in whatever function, are deleted at the end, also when
    it fails. Results have to be written elsewhere before: a lazy one would read deleted tables. Of
    nested lifetimes the innermost owns a table."""
    tables = WorkingTables()
    outer = _LIFETIME.set(tables)
    try:
        yield
    finally:
        _LIFETIME.reset(outer)
        tables.drop()


#: Bytes of a row in memory for a byte of its parquet file, as the planner is told: keys that repeat or
#: follow each other are that much smaller in a file, and a broadcast table is held by the driver. The
#: planner takes a column's share of a file from its type: a key column alone took 42 times that share.
FILE_EXPANSION = 40.0


def _bytes(size: str) -> int:
    """A size as Spark's settings write it; without a unit it is in bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)i?b?\s*", size.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]


#: Shuffle partitions before adaptive execution joins small ones, at least. With more, map tasks sort.
SHUFFLE_PARTITIONS = 200


def tune(spark: SparkSession, broadcast_limit: str = "10MB", read_by_task: str = "16MB") -> SparkSession:
    """Session settings the joins rely on; all of them are runtime SQL settings.

    Every table that is broadcast is built in the driver, so the limit is on what a table takes there.
    Shuffled rows take up to fifteen times their compressed size when a task sorts or groups them, so
    a task reads few of them and the number of tasks grows with the data. A session that sets lower
    sizes or more partitions keeps them."""
    for size, most in [("spark.sql.autoBroadcastJoinThreshold", broadcast_limit),
                       ("spark.sql.adaptive.advisoryPartitionSizeInBytes", read_by_task)]:
        if _bytes(most) < _bytes(spark.conf.get(size)):
            spark.conf.set(size, most)
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    parts = spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(first, str(max(int(parts), SHUFFLE_PARTITIONS)))
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_EXPANSION))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
