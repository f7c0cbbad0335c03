"""Column functions on pixels: sensors, reflectance, water index, quality bits, codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.config import DEFAULTS

#: Fixed values: (platform, instrument, index, level, native resolution in metres).
SENSORS = [
    ("landsat-1", "mss", "NDWI", "L1", 60.0),
    ("landsat-2", "mss", "NDWI", "L1", 60.0),
    ("landsat-3", "mss", "NDWI", "L1", 60.0),
    ("landsat-4", "tm", "MNDWI", "L2", 30.0),
    ("landsat-5", "tm", "MNDWI", "L2", 30.0),
    ("landsat-7", "etm+", "MNDWI", "L2", 30.0),
    ("landsat-8", "oli", "MNDWI", "L2", 30.0),
    ("landsat-9", "oli", "MNDWI", "L2", 30.0),
]


def sensors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENSORS, "platform string, instrument string, family string, level string, native_m double")


def with_sensor(scenes: DataFrame, strict: bool = True) -> DataFrame:
    """Scenes with family, level and resolution of their sensor. An instrument with ``mss`` in its name
    makes the scene NDWI, whatever its platform; an unknown platform raises unless not ``strict``."""
    known = F.broadcast(sensors(scenes.sparkSession).select(F.col("platform").alias("k_platform"), "family", "level", "native_m"))
    out = scenes.join(known, F.lower("platform") == F.col("k_platform"), "left")
    mss = F.exists("instruments", lambda x: F.contains(F.lower(x), F.lit("mss")))
    unknown = F.raise_error(F.concat(F.lit("unknown platform "), F.col("platform"))).cast("string") if strict else F.lit(None).cast("string")
    return out.withColumn("family", F.when(mss, "NDWI").when(F.col("k_platform").isNull(), unknown).otherwise(F.col("family"))).withColumn("level", F.when(mss, "L1").otherwise(F.col("level"))).withColumn("native_m", F.when(mss, 60.0).otherwise(F.col("native_m"))).drop("k_platform")


def reflectance(dn: Column, level: Column) -> Column:
    """Digital number 0 is missing; level 2 numbers are scaled, level 1 numbers stay."""
    dn = F.nullif(dn.cast("double"), F.lit(0.0))
    return F.when(level == "L2", dn * 0.0000275 - 0.2).otherwise(dn)


def water_index(green: Column, dark: Column) -> Column:
    """(green - dark) / (green + dark) within -1 and 1; null where the sum is about 0 or a band is missing."""
    total = green + dark
    ratio = F.when(F.abs(total) >= 1e-6, F.try_divide(green - dark, total))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)) * F.when(ratio.isNotNull() & ~F.isnan(ratio), F.lit(1.0))


def usable(qa: Column) -> Column:
    """None of the six lowest quality bits is set."""
    return qa.cast("long").bitwiseAND(F.lit(0b111111)) == 0


def pack(index: Column) -> Column:
    """The index as a scaled smallint, cut toward zero; missing is the no-data value."""
    scaled = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), index)) * DEFAULTS["scale"]).cast("smallint")
    return F.when(index.isNull() | F.isnan(index), F.lit(DEFAULTS["nodata"]).cast("smallint")).otherwise(scaled)


def unpack(raw: Column) -> Column:
    return F.when(raw != DEFAULTS["nodata"], raw / float(DEFAULTS["scale"]))


def overview_level(native: Column, target: Column) -> Column:
    """Which pre-built overview to read: none below twice the native resolution."""
    return F.when(target >= 2 * native, F.least(F.lit(5), F.greatest(F.lit(0), F.floor(F.log2(target / native)) - 1))).cast("int")


def month_key(t: Column) -> Column:
    """Month key of a month number (year * 12 + month - 1)."""
    return F.format_string("%04d-%02d", F.floor(t / 12).cast("int"), (F.pmod(t, F.lit(12)) + 1).cast("int"))


def month_number(key: Column) -> Column:
    return F.substring(key, 1, 4).cast("int") * 12 + F.substring(key, 6, 2).cast("int") - 1


def shift_month(key: Column, offset: Column) -> Column:
    return month_key(month_number(key) + offset)


def month_range(first: Column, last: Column) -> Column:
    """All month keys from one to another, both included; none if the last is before the first."""
    a, b = month_number(first), month_number(last)
    return F.when(b >= a, F.transform(F.sequence(a, F.greatest(a, b)), month_key)).otherwise(F.array().cast("array<string>"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
