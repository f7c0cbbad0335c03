"""Sinks and sources of composites and processed cubes, as Parquet that prunes by tile and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions import raster


def write_composite(rows: DataFrame, path: str) -> None:
    """Writes composites (tile, month, r, c, v, n_obs): the index as a scaled 16-bit integer, NODATA where it is missing.

    A tile's month is in one file and files are sorted, so row groups hold few tiles and months. There is a file for each task, however many tiles and
    months there are: a folder for each of them took far longer than their rows.
    """
    packed = rows.withColumn("v", raster.pack(F.col("v")).cast("smallint"))
    packed.repartition("tile", "month").sortWithinPartitions("tile", "month", "r", "c").write.parquet(path)


def read_composite(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("v", raster.unpack(F.col("v")))


def write_cube(rows: DataFrame, path: str) -> None:
    """Writes a processed cube (tile, t, r, c and its bands), sorted within a file so that row groups hold few months."""
    rows.repartition("tile").sortWithinPartitions("tile", "t", "r", "c").write.partitionBy("tile").parquet(path)


def read_cube(spark: SparkSession, path: str, first: int, last: int, bands: list[str], tiles: list | None = None) -> DataFrame:
    """Months ``first`` to ``last`` of some bands: only those columns, tiles and row groups are read."""
    out = spark.read.parquet(path).where(F.col("t").between(first, last))
    return (out if tiles is None else out.where(F.col("tile").isin(tiles))).select("tile", "t", "r", "c", *bands)
