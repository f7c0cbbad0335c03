"""What the findings of round 3 asked for."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fluvia.functions import present
from fluvia.operators import frames, learned, spatial, thresholds
from fluvia.sources import cubes, npy, places
from fluvia.storage import new_folder


def test_copies_of_places_and_rings_meet_once(spark, monkeypatch):
    ring = lambda x: [(x, 0.0), (x + 4, 0.0), (x + 4, 4.0), (x, 4.0)]
    polygons = spark.createDataFrame([(k, ring(float(k % 3))) for k in range(30)] + [(99, ring(50.0)), (98, None)], "k int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(2.5, 1.0)] * 20 + [(5.0, 1.0), (None, 1.0)], "x double, y double")
    met = []
    pairs = spatial.points_in_polygons
    monkeypatch.setattr(spatial, "points_in_polygons", lambda *a: met.append(pairs(*a)) or met[0])
    got = {r.k: r.n for r in spatial.counts_in_polygons(points, polygons, "k", 3).collect()}
    assert got == {k: 21 if k % 3 == 2 else 20 for k in range(30)}
    assert met[0].count() == 4  # places and rings, not points and polygons


def test_a_composite_has_a_file_for_each_task(spark):
    path = new_folder(spark, "few")
    rows = spark.range(40 * 30).select((F.col("id") % 40).cast("int").alias("tile"), (F.col("id") % 30).cast("string").alias("month"), F.lit(0).alias("r"), F.col("id").cast("int").alias("c"), F.lit(0.5).alias("v"), F.lit(1).alias("n_obs"))
    cubes.write_composite(rows, path)
    back = cubes.read_composite(spark, path)
    assert back.count() == 1200 and back.where("v = 0.5").count() == 1200
    files = back.select("tile", "month", F.input_file_name().alias("file")).distinct()
    assert files.select("file").distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert files.count() == 120  # a tile's month in one file


def test_frames_without_a_boundary_have_no_row_in_sql(spark, tmp_path):
    c = duckdb.connect()
    c.execute("CREATE TABLE events AS SELECT range AS event_id, range % 7 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (range % 30) DAY AS ts, 'view' AS event_type, 90.0::DOUBLE AS value FROM range(30000)")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert c.execute(entry.oracle_sql()["boundary_displacement"]).fetchall() == []
    assert entry.queries()["boundary_displacement"](spark, str(tmp_path)).collect() == []


def test_halves_of_a_tenth_go_away_from_zero(spark):
    cents = [c for k in range(1, 4000) for c in (35 * (2 * k - 1), -35 * (2 * k - 1))] + [-2, 2]
    rows = spark.createDataFrame([(c, c / 100) for c in cents], "cents long, bal double")
    made = rows.select("cents", F.get_json_object(places.feature(F.lit("erosion"), F.col("bal") / 7, F.lit("u"), F.array(F.array(F.array(F.lit(0.0))))), "$.properties.ha").cast("double").alias("ha"))
    for r in made.collect():
        assert r.ha == np.sign(r.cents) * ((2 * abs(r.cents) + 70) // 140) / 10


def test_halves_of_a_percent_go_upwards(spark):
    rows = spark.createDataFrame([(5000 * k + 2500.0, k) for k in range(100)], "p double, k int")
    assert [r.x for r in rows.select(present.percent(F.col("p") / 5000 / 100, "en").alias("x"), "k").orderBy("k").collect()] == [f"{k + 1}%" for k in range(100)]


def test_a_stencil_holds_no_more_than_its_cells(spark):
    cells = spark.createDataFrame([(f, 300 + r, 700 + c, float(r * c)) for f in range(3) for r in range(5) for c in range(6)], "f int, r int, c int, v double")

    def run(r, c, there, v):
        assert there.shape == v.shape == (7, 8) and (r[0], r[-1], c[0], c[-1]) == (299, 305, 699, 706)
        out = np.full(v.shape, np.nan)
        out[:-1] = v[1:]
        return [out]

    got = {(x.f, x.r, x.c): x.below for x in frames.by_blocks(cells, ["f"], ["v"], 1, run, "below double").collect()}
    assert got == {(f, 300 + r, 700 + c): float((r + 1) * c) if r < 4 else None for f in range(3) for r in range(5) for c in range(6)}


def test_equal_examples_are_fitted_to_once(spark, monkeypatch):
    rows = spark.range(4000).select(F.array(*((F.col("id") % n < k).cast("double") for n, k in ((3, 1), (5, 3)))).alias("features"), ((F.col("id") * 7919 % 11 + F.col("id") % 3) < 6).cast("int").alias("truth"), F.when(F.col("id") % 2 == 0, "train").otherwise("val").alias("split"))
    few = learned.counted(rows, ["split"])
    assert few.count() <= 16 and few.agg(F.sum(learned.TIMES)).first()[0] == 4000
    every, once = learned.fit(rows, 0.01), learned.fit(few, 0.01)
    assert learned.positive_weight(rows) == pytest.approx(learned.positive_weight(few))
    assert every.weights == pytest.approx(once.weights, abs=1e-4) and every.bias == pytest.approx(once.bias, abs=1e-4)
    scored = lambda x: x.select("*", F.get("features", 0).alias("prob"))
    assert thresholds.cut_sweep(scored(rows), [0.3, 1.0]).collect() == thresholds.cut_sweep(scored(few), [0.3, 1.0], learned.TIMES).collect()


def test_a_task_reads_several_slices(spark):
    files = [npy.File(f"{k}", "v", 0, "x", (30, 2, 2), "<f8", 0) for k in range(100)]
    parts = npy.FramesReader("x", files, ["v"]).partitions()
    assert len(parts) <= npy.TASKS and [(s.tile, s.t) for p in parts for s in p.slices] == [(f.tile, t) for f in sorted(files, key=lambda f: f.tile) for t in range(30)]


def test_no_user_has_a_sketch(spark):
    plan = entry.queries()["approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketches and not any("user_id" in line.split("],")[0] for line in sketches)


def test_frames_of_few_blocks_are_one_group(spark, monkeypatch):
    from fluvia.operators import attention
    from fluvia.plans.forecasts import SHAPE, WEIGHTS

    cells = spark.range(1500).select((F.col("id") % 2).alias("w"), F.floor(F.col("id") / 400).cast("int").alias("t"), F.floor(F.col("id") % 256 / 16).cast("int").alias("r"), (F.col("id") % 16).cast("int").alias("c"), (F.col("id") * 37 % 11 / 10).alias("v"))
    got = lambda: {(r.w, r.t, r.place): r.x for r in attention.encoded(cells, ["w"], WEIGHTS, SHAPE).collect()}
    together = attention.encoded(cells, ["w"], WEIGHTS, SHAPE)
    assert "CoGroup" not in together._jdf.queryExecution().optimizedPlan().toString()
    one = got()
    monkeypatch.setattr(attention, "TOGETHER", 0)
    other = got()
    assert one.keys() == other.keys() and all(np.allclose(one[k], other[k]) for k in one)
