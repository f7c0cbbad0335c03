"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where it is unset and driver and executors are
    one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str = "rows") -> DataFrame:
    """Rows written to the shared folder and read back: cuts lineage, and a lost executor costs the work since."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shared_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to some tasks a core: adaptive execution would join partitions by their bytes, and here few bytes are much work."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


#: Rows of a side that may be broadcast by :func:`beside`.
FEW = 100_000


def beside(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", few: int = FEW) -> DataFrame:
    """Rows joined with a side that has a row for each key. The side is stored and counted: up to ``few`` rows it is
    broadcast, and the rows stay where they are, however few keys they have; beyond, both are shuffled by key."""
    kept = stored(side, "side")
    return rows.join(broadcast(kept) if kept.count() <= few else kept, keys, how)


def remove(spark: SparkSession, pattern: str, keep: str | None = None) -> list[str]:
    """Removes files or folders that match, but for the one named ``keep``; their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in system.globStatus(path) or []]
    gone = [x for x in found if x.getName() != keep]
    for x in gone:
        system.delete(x, True)
    return sorted(x.getName() for x in gone)
