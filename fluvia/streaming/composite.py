"""Extension: composites of landed files as a stream, from the start each time; ``resume`` goes on where it stopped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.storage import new_folder


def composites(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Count and mean of each type and day; events later than ``late`` are dropped by the watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def run_to_end(spark: SparkSession, path: str) -> DataFrame:
    """All that is landed under ``path`` now, through the stream, as a table. The folder is read as a file source."""
    schema = spark.read.parquet(path).schema
    name = f"composites_{uuid.uuid4().hex}"
    folder = path.rsplit("/", 1)[0]
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not path.endswith("/events.parquet") else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    out = composites(source.withColumn("at", F.col("ts").cast("timestamp")))
    done, state = new_folder(spark, name), new_folder(spark, "stream-state")

    def landed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{done}/epoch={number}")

    stream = out.writeStream.outputMode("update").foreachBatch(landed).option("checkpointLocation", state).trigger(availableNow=True).start()
    stream.awaitTermination()
    # A batch has the aggregates that it changed; a batch that runs again overwrites its own folder.
    rows = spark.read.schema(T.StructType([*out.schema, T.StructField("epoch", T.LongType())])).parquet(done)
    last = rows.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "mean"), "epoch").alias("x"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "x.n", F.round("x.mean", 6).alias("mean"))
