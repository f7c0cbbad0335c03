import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import resample, spatial
from fluvia.sources import npy


def plain(grid, r, c):
    i, j = int(np.floor(r)), int(np.floor(c))
    total = weight = 0.0
    for a in (0, 1):
        for b in (0, 1):
            v = grid.get((i + a, j + b))
            w = (1 - abs(r - i - a)) * (1 - abs(c - j - b))
            if v is not None and w > 0:
                total, weight = total + w * v, weight + w
    return total / weight if weight else None


@pytest.mark.parametrize("block", [1, 3, 256])
def test_resampling_equals_a_plain_version(spark, block):
    rng = np.random.default_rng(1)
    grid = {(r, c): (None if rng.random() < 0.2 else float(rng.normal())) for r in range(9) for c in range(11) if rng.random() < 0.95}
    source = spark.createDataFrame([("a", r, c, v, r * 100 + c) for (r, c), v in grid.items()], "k string, r int, c int, v double, q int")
    asked = [("a", n, float(r), float(c)) for n, (r, c) in enumerate([*rng.uniform(-3, 13, (200, 2)), (2, 3), (2.5, 3), (8, 10), (-0.5, -0.5)])] + [("b", 999, 1.0, 1.0)]
    target = spark.createDataFrame(asked, "k string, n int, sr double, sc double")
    got = {r.n: r for r in resample.resampled(source, target, ["k"], ["v"], ["q"], block).collect()}
    assert len(got) == len(asked) and got[999].v is None and got[999].q is None
    for _, n, r, c in asked[:-1]:
        want = plain(grid, r, c)
        assert (got[n].v is None) == (want is None) and (want is None or abs(got[n].v - want) < 1e-9), (r, c)
        near = (int(np.floor(r + 0.5)), int(np.floor(c + 0.5)))
        assert got[n].q == (near[0] * 100 + near[1] if near in grid else None)


def test_a_projected_target_looks_its_place_up(spark):
    """A source in degrees that holds a linear function: resampled onto metres it is that function of the place."""
    source = spark.range(60 * 60).select(F.lit(1).alias("k"), F.floor(F.col("id") / 60).cast("int").alias("r"), (F.col("id") % 60).cast("int").alias("c"))
    source = source.withColumn("v", 3 * (89.0 + (F.col("c") + 0.5) * 0.01) - 2 * (25.0 - (F.col("r") + 0.5) * 0.01))
    x, y = spatial.utm45(F.lit(89.2), F.lit(24.8))
    tile = spark.range(1).select(F.lit(1).alias("k"), x.alias("origin_x"), y.alias("origin_y"), F.lit(500.0).alias("pixel"), F.lit(20).alias("height"), F.lit(20).alias("width"))
    pixels = resample.lattice_pixels(tile, ["k"])
    lon, lat = spatial.lonlat45(F.col("x"), F.col("y"))
    sr, sc = resample.place_in(lon, lat, F.lit(89.0), F.lit(25.0), F.lit(0.01))
    placed = pixels.select("k", "r", "c", sr.alias("sr"), sc.alias("sc"), (3 * lon - 2 * lat).alias("want"))
    rows = resample.resampled(source, placed, ["k"], ["v"], []).collect()
    assert len(rows) == 400 and max(abs(r.v - r.want) for r in rows) < 1e-6


def cube(spark):
    at = lambda k, n: (F.floor(F.col("id") / k) % n).cast("int")
    rows = spark.range(2 * 30 * 4 * 5).select(F.concat(F.lit("tile_"), at(600, 2)).alias("tile"), at(20, 30).alias("t"), at(5, 4).alias("r"), at(1, 5).alias("c"), F.col("id").alias("i"))
    return rows.select("tile", "t", "r", "c", F.when(F.col("i") % 7 > 0, F.col("i") / 8).cast("float").alias("index"), (F.col("i") % 3 == 0).cast("tinyint").alias("water"))


def test_cubes_come_back_and_only_asked_slices_are_opened(spark, tmp_path):
    folder = f"file://{tmp_path}/cube"
    rows = cube(spark)
    assert npy.write_frames(rows, folder, {"index": "f4", "water": "i1"}, 7).count() == 2 * 2 * 5
    back = npy.read_frames(spark, folder)
    key = lambda r: (r.tile, r.t, r.r, r.c)
    assert back.columns == rows.columns and dict(back.dtypes) == dict(rows.dtypes)
    assert sorted(back.collect(), key=key) == sorted(rows.collect(), key=key)
    few = back.where("t >= 3 and t < 6 and tile = 'tile_1'").select("t", "water")
    assert few.rdd.getNumPartitions() == 3 and few.count() == 60
    for f in (tmp_path / "cube").iterdir():
        if "@0." not in f.name:
            f.write_bytes(f.read_bytes()[:128])  # the other parts have no values any more
    assert npy.read_frames(spark, folder, ["water"]).where(F.col("t").isin(1, 5) & (F.col("tile") == "tile_0")).agg(F.sum("water")).first()[0] == rows.where("tile = 'tile_0' and t in (1, 5)").agg(F.sum("water")).first()[0]


def test_filters_decide_the_partitions():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    files = [npy.File(tile, band, first, "x", (4, 2, 2), "<f4", 128) for tile in "ab" for band in ("i", "w") for first in (0, 4)]
    reader = npy.FramesReader("x", files, ["i", "w"])
    kept = list(reader.pushFilters([GreaterThan(("t",), 1), LessThanOrEqual(("t",), 5), In(("tile",), ("a", "c")), StringContains(("tile",), "a"), EqualTo(("r",), 1)]))
    assert [type(f).__name__ for f in kept] == ["StringContains", "EqualTo"]
    assert [(p.tile, p.t, [f.first for f in p.files]) for p in reader.partitions()] == [("a", t, [t // 4 * 4] * 2) for t in (2, 3, 4, 5)]


def test_arrays_written_by_others_and_metadata(spark, tmp_path):
    array = np.arange(24, dtype=np.float64).reshape(2, 3, 4)
    array[1, 2, 3] = np.nan
    np.save(tmp_path / "north_west_index.npy", array)
    np.save(tmp_path / "north_west_water.npy", (array > 3).astype(np.uint8))
    meta = {"tile": "north_west", "months": ["2001-01", "2001-02"], "transform": [1.0, 0.0, 2.0, 0.0, -1.0, 3.0], "height": 3, "width": 4, "threshold_calibration": {"median": "0.1"}, "extra": 1}
    (tmp_path / "north_west_meta.json").write_text(json.dumps(meta, indent=2))
    rows = {(r.t, r.r, r.c): r for r in npy.read_frames(spark, str(tmp_path)).collect()}
    assert len(rows) == 24 and rows[1, 2, 3]["index"] is None and rows[1, 0, 2]["index"] == 14.0 and rows[0, 1, 0].water == 1 and rows[0, 0, 0].water == 0
    got = npy.read_meta(spark, str(tmp_path)).first()
    assert got.tile == "north_west" and got.months == meta["months"] and got.threshold_calibration == {"median": "0.1"} and got.crs is None
    assert npy.write_meta(npy.read_meta(spark, str(tmp_path)), f"file://{tmp_path}/out").collect() == [("north_west_meta.json",)]
    again = json.loads((tmp_path / "out" / "north_west_meta.json").read_text())
    assert again["transform"] == meta["transform"] and again["crs"] is None and list(again)[:2] == ["tile", "months"]
