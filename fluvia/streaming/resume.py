"""Extension: daily composites of files that keep landing, across stops and restarts, with repeated rows counted once.

A folder holds what the stream knows: its checkpoint (``state``) and, for each of its batches, the counts and sums
of the rows that were new (``parts/epoch=N``). A batch that was cut off runs again and overwrites its own part, so every
row counts once whatever happened in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = T.StructType([T.StructField("day", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_values", T.LongType()), T.StructField("total", T.DoubleType())])


def first_arrivals(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows (with ``at``) whose keys weren't seen within ``late`` before; rows that come later than that are dropped.

    Keys are remembered until the latest time seen has passed theirs by twice ``late``, so the state doesn't grow with the
    stream. A row with a null among its keys is a repeat of none.
    """
    own = F.when(F.expr(" or ".join(f"`{k}` is null" for k in keys)), F.expr("uuid()")).otherwise(F.lit(""))
    return rows.withColumn("fl_own", own).withWatermark("at", late).dropDuplicatesWithinWatermark([*keys, "fl_own"]).drop("fl_own")


def advance(spark: SparkSession, landed: str, folder: str, time: str, kind: str, value: str, keys: list[str], late: str) -> dict[str, int]:
    """Takes in what has landed since the last call with this ``folder``; the numbers of rows read and dropped as late
    (repeats that come that late included). Rows without a time belong to no day and are left out."""
    source = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    rows = source.select(*keys, F.col(time).cast("timestamp").alias("at"), F.col(kind).cast("string").alias("fl_kind"), F.col(value).cast("double").alias("fl_value")).where("at is not null")

    def part(batch: DataFrame, epoch: int) -> None:
        days = batch.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), F.col("fl_kind").alias("kind"))
        days.agg(F.count("*").alias("n"), F.count("fl_value").alias("n_values"), F.sum("fl_value").alias("total")).write.mode("overwrite").parquet(f"{folder}/parts/epoch={epoch}")

    stream = first_arrivals(rows, keys, late).writeStream.foreachBatch(part).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    seen = stream.recentProgress
    return {"read": sum(p.numInputRows for p in seen), "late": sum(s.numRowsDroppedByWatermark for p in seen for s in p.stateOperators)}


def composites(spark: SparkSession, folder: str) -> DataFrame:
    """Rows day, kind, n, mean of all that the stream of ``folder`` has taken in."""
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    return parts.groupBy("day", "kind").agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum("total"), F.sum("n_values")), 6).alias("mean"))
