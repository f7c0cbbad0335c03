"""Points in polygons over a quadtree, against plain ray casting and against fixed blocks."""

import numpy as np
import pytest
from fluvia.operators import quadtree, spatial
from pyspark.sql import functions as F

RING = "id int, ring array<struct<x double, y double>>"


def within(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def star(rng, size):
    """A concave ring around a random place, its corners on a lattice of eighths."""
    turns = np.sort(rng.random(9)) * 2 * np.pi
    far = size * (0.2 + 0.8 * rng.random(9))
    mx, my = rng.random(2) * 60 - 5
    return [(float(np.round((mx + f * np.cos(t)) * 8) / 8), float(np.round((my + f * np.sin(t)) * 8) / 8)) for t, f in zip(turns, far, strict=True)]


@pytest.mark.parametrize("share", [0.5, 0.05, 0.004])
def test_pairs_are_those_of_ray_casting(spark, share):
    rng = np.random.default_rng(int(1000 * share))
    spots = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.round(rng.random((500, 2)) * 400) / 8)] + [(k, 7.0, 7.125) for k in range(500, 900)]
    rings = [(k, star(rng, size)) for k, size in enumerate([2, 4, 8, 8, 30, 90, 0.5, 3])] + [(90, [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]), (91, [(-900.0, -900.0), (900.0, -900.0), (0.0, 900.0)]), (92, [(70.0, 70.0), (80.0, 70.0), (75.0, 79.0)])]
    points, polygons = spark.createDataFrame(spots, "k int, x double, y double"), spark.createDataFrame(rings, RING)
    tree = quadtree.cut(points, share)
    got = sorted((r.k, r.id) for r in quadtree.points_in_polygons(points, polygons, tree).collect())
    assert got == sorted((k, i) for k, x, y in spots for i, ring in rings if within(x, y, ring))
    assert got == sorted((r.k, r.id) for r in spatial.points_in_polygons(points, polygons, 8.0).collect())


def test_no_key_holds_more_than_its_share(spark):
    """Half of the points in one place, a third in a small corner: no key has much more than the stated share."""
    rng = np.random.default_rng(3)
    spots = [(k, 3.25, 4.5) for k in range(6000)] + [(k, *map(float, rng.random(2) / 1000)) for k in range(6000, 10_000)] + [(k, *map(float, rng.random(2) * 9)) for k in range(10_000, 12_000)]
    points = spark.createDataFrame(spots, "k int, x double, y double")
    tree = quadtree.cut(points, 1 / 50)
    sizes = [r["count"] for r in quadtree.leaf_of(points, tree).groupBy("leaf", "copy").count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) <= 12_000 / 50 * 1.5
    by_sample = quadtree.cut(points, 1 / 50, 2000)
    sizes = [r["count"] for r in quadtree.leaf_of(points, by_sample).groupBy("leaf", "copy").count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) <= 12_000 / 50 * 2.5


def test_leaves_in_a_polygon_need_no_edges(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(k, *map(float, rng.random(2) * 100)) for k in range(3000)], "k int, x double, y double")
    turns = np.arange(400) / 400 * 2 * np.pi
    ring = spark.createDataFrame([(1, [(float(50 + 45 * np.cos(t)), float(50 + 45 * np.sin(t))) for t in turns])], RING)
    rows = quadtree.leaves_of(ring, quadtree.cut(points, 1 / 200)).collect()
    assert sum(r.whole for r in rows) > len(rows) / 3
    assert all(r.edges is None for r in rows if r.whole) and max(len(r.edges) for r in rows if not r.whole) < 200


def test_odd_places_and_rings(spark):
    points = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, 1.0, 1.0), (4, 1.0, 1.0), (5, 0.0, 1.0)], "k int, x double, y double")
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (2, []), (3, None)], RING)
    assert [(r.k, r.id) for r in quadtree.points_in_polygons(points, rings).collect()] == [(4, 1), (4, 1)]
    none = points.where("k > 9")
    assert quadtree.points_in_polygons(none, rings).collect() == quadtree.points_in_polygons(points, rings.where("id > 9")).collect() == []
    assert quadtree.points_in_polygons(points.select(F.col("x"), "y"), rings).columns == ["x", "y", "id"]


def test_small_polygons_meet_few_points(spark):
    """Points meet the polygons around them, not all those of their leaf."""
    rng = np.random.default_rng(8)
    points = spark.createDataFrame([(k, *map(float, rng.random(2) * 100)) for k in range(4000)], "k int, x double, y double")
    corner = [tuple(map(float, p)) for p in rng.random((3000, 2)) * 99]
    rings = spark.createDataFrame([(k, [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]) for k, (x, y) in enumerate(corner)], RING)
    tree = quadtree.cut(points, 0.25)
    assert len(tree.side) < 20
    got, met = quadtree.points_in_polygons(points, rings, tree).count(), quadtree._near(points, rings, tree).count()
    assert got == spatial.points_in_polygons(points, rings, 2.0).count() and met < 16 * got
