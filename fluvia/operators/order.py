"""Numbers of ordered rows without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.storage import stored


def placed(rows: DataFrame) -> DataFrame:
    """Ordered rows with place, 1 and on. Rows are numbered within their partitions and partitions by their
    sizes, so that no task sees more than its own rows."""
    numbered = stored(rows.withColumn("fl_part", F.spark_partition_id()).withColumn("fl_row", F.monotonically_increasing_id()), "numbered")
    sizes = numbered.groupBy("fl_part").agg(F.count("*").alias("n"), F.min("fl_row").alias("fl_first"))
    before = sizes.withColumn("fl_before", F.coalesce(F.sum("n").over(Window.orderBy("fl_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return numbered.join(F.broadcast(before), "fl_part").withColumn("place", (F.col("fl_before") + F.col("fl_row") - F.col("fl_first") + 1).cast("int")).drop("fl_part", "fl_row", "fl_first", "fl_before")
