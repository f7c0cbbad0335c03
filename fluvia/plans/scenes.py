"""Queries of scenes: resampling onto a lattice, and the way from raw bands to a monthly composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import raster
from fluvia.operators import resample, series
from fluvia.plans.oracle import ST
from fluvia.plans.registry import stack, table
from fluvia.sources import npy
from fluvia.storage import new_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PLATFORMS = ("landsat-1", "landsat-4", "landsat-5", "landsat-7", "landsat-8", "landsat-9")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def scenes(spark, d) -> DataFrame:
    """Raw scenes of 16 by 16 cells of 30 m, 256 events each: numbers of two bands (0: missing) and a quality word."""
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.floor(i / 256).alias("scene"), F.floor(i % 256 / 16).cast("int").alias("r"), (i % 16).cast("int").alias("c"),
        F.nullif(F.floor(F.col("value") * 700 + i * 7919) % 20_000, F.lit(0)).alias("green"), F.nullif(i * 104_729 % 7000 * (i % 13), F.lit(0)).alias("dark"),
        F.when(i % 11 == 0, F.lit(8)).otherwise(F.lit(64)).alias("qa"),
    )


def on_lattice(spark, d) -> DataFrame:
    """The scenes on a lattice of 8 by 8 pixels of 60 m whose corner is 9 m east and 12 m south of theirs."""
    raw = scenes(spark, d)
    tiles = raw.select("scene").distinct().select("scene", F.lit(9.0).alias("origin_x"), F.lit(-12.0).alias("origin_y"), F.lit(60.0).alias("pixel"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    pixels = resample.lattice_pixels(tiles, ["scene"])
    sr, sc = resample.place_in(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(30.0))
    return resample.resampled(raw, pixels.select("scene", "r", "c", sr.alias("sr"), sc.alias("sc")), ["scene"], ["green", "dark"], ["qa"])


WARPED = """raw AS (SELECT event_id // 256 AS scene, (event_id % 256) // 16 AS r, event_id % 16 AS c, nullif(floor(value * 700 + event_id * 7919)::BIGINT % 20000, 0) AS green,
                   nullif(event_id * 104729 % 7000 * (event_id % 13), 0) AS dark, CASE WHEN event_id % 11 = 0 THEN 8 ELSE 64 END AS qa FROM events),
    pix AS (SELECT scene, i AS r, j AS c, (12 + (i + 0.5) * 60) / 30.0 - 0.5 AS sr, (9 + (j + 0.5) * 60) / 30.0 - 0.5 AS sc
            FROM (SELECT DISTINCT scene FROM raw) CROSS JOIN range(8) a(i) CROSS JOIN range(8) b(j)),
    four AS (SELECT pix.scene, pix.r, pix.c, raw.green, raw.dark, raw.qa, (1 - abs(sr - raw.r)) * (1 - abs(sc - raw.c)) AS w, raw.r = floor(sr + 0.5) AND raw.c = floor(sc + 0.5) AS own
             FROM pix LEFT JOIN raw ON raw.scene = pix.scene AND raw.r IN (floor(sr), floor(sr) + 1) AND raw.c IN (floor(sc), floor(sc) + 1)),
    warped AS (SELECT scene, r, c, sum(w * green) / sum(w) FILTER (green IS NOT NULL AND w > 0) AS green, sum(w * dark) / sum(w) FILTER (dark IS NOT NULL AND w > 0) AS dark, max(qa) FILTER (own) AS qa FROM four GROUP BY ALL)"""


@query(f"WITH {WARPED} SELECT scene, r, c, round(green, 6)::DOUBLE AS green, round(dark, 6)::DOUBLE AS dark, qa FROM warped")
def resampled_scenes(spark, d):
    return on_lattice(spark, d).select("scene", "r", "c", F.round("green", 6).alias("green"), F.round("dark", 6).alias("dark"), "qa")


@query(
    f"""WITH {WARPED}, seen AS (SELECT *, {list(PLATFORMS)}[scene % 6 + 1] AS platform, 24000 + scene % 3 AS t, scene // 18 AS tile FROM warped),
    refl AS (SELECT tile, t, r, c, qa, CASE WHEN platform = 'landsat-1' THEN nullif(green, 0) ELSE nullif(green, 0) * 0.0000275 - 0.2 END AS green,
                    CASE WHEN platform = 'landsat-1' THEN nullif(dark, 0) ELSE nullif(dark, 0) * 0.0000275 - 0.2 END AS dark FROM seen),
    idx AS (SELECT tile, t, r, c, CASE WHEN qa & 63 = 0 AND abs(green + dark) >= 1e-6 THEN greatest(-1, least(1, (green - dark) / (green + dark))) END AS v FROM refl)
    SELECT tile, t, r, c, round(median(v), 6)::DOUBLE AS v, count(v) AS n_obs FROM idx GROUP BY ALL"""
)
def scene_composites(spark, d):
    """From raw bands to monthly composites: lattice, sensor, reflectance, index, quality, median."""
    names = F.array(*map(F.lit, PLATFORMS))
    placed = on_lattice(spark, d).select("*", F.element_at(names, (F.col("scene") % 6 + 1).cast("int")).alias("platform"), F.array().cast("array<string>").alias("instruments"), (24_000 + F.col("scene") % 3).alias("t"), F.floor(F.col("scene") / 18).alias("tile"))
    known = raster.with_sensor(placed)
    green, dark = (raster.reflectance(F.col(b), F.col("level")) for b in ("green", "dark"))
    pixels = known.select("tile", "t", "r", "c", F.when(raster.usable(F.col("qa")), raster.water_index(green, dark)).alias("v"))
    return series.composite(pixels, ["tile", "t", "r", "c"]).withColumn("v", F.round("v", 6))


@query(f"WITH {ST} SELECT tile::VARCHAR AS tile, t::INT AS t, r::INT AS r, c::INT AS c, round(v, 6)::DOUBLE AS v, n_obs::INT AS n_obs FROM st WHERE t BETWEEN 5 AND 9 AND n_obs > 0")
def array_slices(spark, d):
    """A cube written as arrays and read back: only the slices asked for are opened. Cells without an observation are filled up, and left out here."""
    path = new_folder(spark, "arrays")
    npy.write_frames(stack(spark, d), path, {"v": "f8", "n_obs": "i4"})
    back = npy.read_frames(spark, path, ["v", "n_obs"]).where("t >= 5 and t <= 9").where("n_obs > 0")
    return back.select("tile", "t", "r", "c", F.round("v", 6).alias("v"), "n_obs")


@query(
    f"""WITH {ST} SELECT tile::VARCHAR AS tile, count(DISTINCT t)::INT AS n_months, min(lpad(t::VARCHAR, 4, '0')) AS first_month, max(lpad(t::VARCHAR, 4, '0')) AS last_month,
    (max(r) + 1)::INT AS height, (max(c) + 1)::INT AS width, round(avg((v IS NOT NULL)::INT), 4)::DOUBLE AS observed_fraction_raw FROM st GROUP BY 1"""
)
def cube_metadata(spark, d):
    """Nested metadata of each tile's cube, written as JSON beside it and read back."""
    path = new_folder(spark, "metadata")
    month = F.lpad(F.col("t").cast("string"), 4, "0")
    tiles = stack(spark, d).groupBy(F.col("tile").cast("string").alias("tile")).agg(F.array_sort(F.collect_set(month)).alias("months"), (F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width"), F.round(F.avg(F.col("v").isNotNull().cast("int")), 4).alias("observed_fraction_raw"))
    npy.write_meta(tiles.withColumn("transform", F.array(*map(F.lit, (120.0, 0.0, 0.0, 0.0, -120.0, 0.0)))), path)
    got = npy.read_meta(spark, path)
    return got.select("tile", F.size("months").alias("n_months"), F.element_at("months", 1).alias("first_month"), F.element_at("months", -1).alias("last_month"), "height", "width", "observed_fraction_raw")
