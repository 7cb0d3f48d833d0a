"""Readers and writers: exported sheets, delimited files, parquet tables, pixel layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.sources.schemas import SCHEMAS
from furrow.sources.stages import stage

PIXEL_BAND = 8192
#: Pixel rows of a bucket; aligning them takes about 160 bytes a row of a task's memory.
ROWS_PER_BUCKET = 2_000_000


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated export of a spreadsheet, with a header and a stated schema."""
    return read_delimited(spark, path, schema, ",")


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet file, or a folder of them such as one file per unit and year."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_input(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Input table by name from `root`/<name>, in parquet."""
    return read_table(spark, f"{root}/{name}", SCHEMAS[name])


def read_inputs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_input(spark, root, name) for name in SCHEMAS}


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_pixels(pixels: DataFrame, path: str, band: int = PIXEL_BAND) -> None:
    """Pixel table in folders of layer and year, cells of a row band kept together so that row
    ranges prune files. Bands split by column too, so a wide raster makes no large task."""
    banded = pixels.withColumns({"__r": F.floor(F.col("cell_row") / band),
                                 "__c": F.floor(F.col("cell_col") / band)})
    banded.repartition("layer", "year", "__r", "__c") \
        .sortWithinPartitions("layer", "year", "cell_row").drop("__r", "__c") \
        .write.mode("overwrite").partitionBy("layer", "year").parquet(path)


def save_pixels(pixels: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Pixel table bucketed by cell: all layers and years of a cell share a bucket, so aligning
    them is an aggregation without a shuffle. A bucket is one task's, so there are at least `buckets`
    and more of them by the number of pixels, not larger ones."""
    cell = ["cell_row", "cell_col"]
    held = stage(pixels, "pixel_rows")
    buckets = max(buckets, -(-held.count() // ROWS_PER_BUCKET))
    held.repartition(buckets, *cell).write.mode("overwrite").bucketBy(buckets, *cell) \
        .option("path", path).saveAsTable(table)
    return pixels.sparkSession.table(table)


def read_layer(spark: SparkSession, path: str, layer: str, years: Sequence[int] | None = None
               ) -> DataFrame:
    """One layer of a pixel table; folders of other layers and years are not read."""
    pixels = spark.read.schema(SCHEMAS["pixel"]).parquet(path).where(F.col("layer") == layer)
    return pixels.where(F.col("year").isin(list(years))) if years is not None else pixels
