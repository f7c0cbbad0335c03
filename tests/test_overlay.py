import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import overlay, rings as rings_of

RINGS = "array<array<struct<x:double,y:double>>>"


def star(rng, x, y, r, n):
    """A concave polygon around a place."""
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.3, 1, n) * r
    return np.stack([x + far * np.cos(a), y + far * np.sin(a)], 1)


def frame(spark, polygons, key):
    return spark.createDataFrame([(k, [[(float(a), float(b)) for a, b in ring] for ring in rings]) for k, rings in polygons.items()], f"{key} bigint, rings {RINGS}")


def inside(rings, x, y):
    out = np.zeros(x.shape, bool)
    for p in rings:
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0), strict=True):
            if y0 != y1:
                out ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return out


def raster(polygons, side=20.0, n=1000):
    at = (np.arange(n) + 0.5) * side / n
    x, y = np.meshgrid(at, at)
    return {k: inside(rings, x, y) for k, rings in polygons.items()}, (side / n) ** 2


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(1)
    zones = {k: [star(rng, *rng.uniform(5, 15, 2), 5, 11)] for k in range(8)}
    zones[8] = [star(rng, 10, 10, 6, 9), np.array([(9.5, 9.5), (10.5, 9.4), (10.2, 10.6)])]
    units = {k: [star(rng, *rng.uniform(4, 16, 2), 6, 8)] for k in range(10, 16)}
    return zones, units


@pytest.mark.parametrize("span", [1.7, 50.0])
def test_shared_areas_equal_a_raster(spark, shapes, span):
    zones, units = shapes
    got = {(r.z, r.u): r.area for r in overlay.shared_areas(overlay.fragments(frame(spark, zones, "z"), ["z"], span), overlay.fragments(frame(spark, units, "u"), ["u"], span), "z", "u").collect()}
    (on, cell), (off, _) = raster(zones), raster(units)
    for z in zones:
        for u in units:
            assert abs(got.get((z, u), 0.0) - (on[z] & off[u]).sum() * cell) < 0.05


@pytest.mark.parametrize("span", [2.3, 50.0])
def test_zones_are_split_without_overlap(spark, shapes, span):
    zones, units = shapes
    parts = overlay.split(frame(spark, zones, "z"), frame(spark, units, "u"), "z", "u", span).cache()
    got = {(r.z, r.u): r.area for r in overlay.areas(parts, ["z", "u"]).collect()}
    (on, cell), (off, _) = raster(zones), raster(units)
    for z, rings in zones.items():
        whole = abs(overlay.ring_size(rings[0])) - sum(abs(overlay.ring_size(h)) for h in rings[1:])
        assert abs(sum(a for (k, _), a in got.items() if k == z) - whole) < 1e-6
        taken = np.zeros_like(on[z])
        for u in sorted(units, key=lambda u: (-(on[z] & off[u]).sum(), u)):
            assert abs(got.get((z, u), 0.0) - (on[z] & off[u] & ~taken).sum() * cell) < 0.05
            taken |= off[u]
        assert abs(got.get((z, None), 0.0) - (on[z] & ~taken).sum() * cell) < 0.05
    rings = overlay.rings(parts, ["z", "u"], span).collect()
    again = {}
    for r in rings:
        p = np.array([(c.x, c.y) for c in r.ring])
        assert abs(overlay.ring_size(p) - r.area) < 1e-9
        again[r.z, r.u] = again.get((r.z, r.u), 0.0) + r.area
    assert again.keys() >= {k for k, a in got.items() if a > 1e-3}
    assert all(abs(again.get(k, 0.0) - a) < 1e-4 for k, a in got.items())


def test_an_overlap_of_two_units_counts_once(spark):
    """Two units that share a strip of 200 by 800, the zone lies in both."""
    square = lambda a, b, c, d: [np.array([(a, b), (c, b), (c, d), (a, d)])]
    zones, units = {1: square(0, 0, 2000, 800)}, {10: square(-500, -500, 1200, 1500), 11: square(1000, -500, 3000, 1500)}
    parts = overlay.split(frame(spark, zones, "z"), frame(spark, units, "u"), "z", "u", 300.0)
    got = {r.u: r.area for r in overlay.areas(parts, ["z", "u"]).collect()}
    assert got == {10: 960_000.0, 11: 640_000.0}
    ring = {r.u: r.ring for r in overlay.rings(parts, ["z", "u"], 300.0).collect()}
    assert sorted((c.x, c.y) for c in ring[10]) == [(0, 0), (0, 800), (1200, 0), (1200, 800)]
    assert sorted((c.x, c.y) for c in ring[11]) == [(1200, 0), (1200, 800), (2000, 0), (2000, 800)]


def test_dissolved_polygons_equal_a_raster(spark, shapes):
    _, units = shapes
    rows = frame(spark, units, "u").withColumn("g", (F.col("u") % 2).cast("int"))
    cover, cell = raster({k: [p + 4 for p in rings] for k, rings in units.items()}, 28.0, 1400)
    for span, together in ((3.1, 2), (50.0, 64)):
        parts = overlay.dissolve(rows, "g", span, together)
        got = {r.g: r.area for r in overlay.areas(parts, ["g"]).collect()}
        rings = {r.g: r.a for r in overlay.rings(parts, ["g"], span).groupBy("g").agg(F.sum("area").alias("a")).collect()}
        for g in (0, 1):
            want = np.logical_or.reduce([cover[u] for u in units if u % 2 == g]).sum() * cell
            assert abs(got[g] - want) < 0.05 and abs(rings[g] - got[g]) < 1e-4


def test_a_dissolved_lattice_has_the_rings_of_its_cells(spark):
    rng = np.random.default_rng(3)
    cells = [(0, int(r), int(c)) for r, c in np.argwhere(rng.random((14, 14)) < 0.65)]
    lattice = spark.createDataFrame(cells, "f int, r int, c int")
    at = lambda a, b: F.struct((F.col("c") + a).cast("double").alias("x"), (F.col("r") + b).cast("double").alias("y"))
    squares = lattice.select("f", F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))).alias("rings"))
    got = overlay.rings(overlay.dissolve(squares, "f", 4.0), ["f"], 4.0).collect()
    want = rings_of.zone_rings(lattice, ["f"]).collect()
    corners = lambda rows, name: {(c.x, c.y) for r in rows for c in r[name]}
    length = lambda ring: sum(abs(a.x - b.x) + abs(a.y - b.y) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    assert sum(r.area for r in got) == len(cells) == sum(r.area for r in want)
    assert corners(got, "ring") == corners(want, "corners")
    assert sum(length(r.ring) for r in got) == sum(length(r.corners) for r in want)


def test_many_polygons_of_a_group_in_one_cell(spark):
    """A third of all polygons in one place: they are united some at a time."""
    rng = np.random.default_rng(4)
    polygons = {k: [np.array([(a, b), (a + 3, b), (a + 3, b + 2), (a, b + 2)])] for k, (a, b) in enumerate(rng.integers(0, 9, (300, 2)))}
    rows = frame(spark, polygons, "u").withColumn("g", F.lit(1))
    (r,) = overlay.areas(overlay.dissolve(rows, "g", 100.0, 8), ["g"]).collect()
    held = {(a + i, b + j) for k in polygons for a, b in [polygons[k][0][0]] for i in range(3) for j in range(2)}
    assert r.area == len(held)


def test_polygons_without_an_area_have_no_parts(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [[(0.0, 0.0), (1.0, 0.0)]]), (4, [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]), (5, [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]])], f"z bigint, rings {RINGS}")
    zone = frame(spark, {7: [np.array([(0, 0), (2, 0), (2, 2), (0, 2)])]}, "u")
    assert overlay.areas(overlay.split(zone.withColumnRenamed("u", "z"), rows.withColumnRenamed("z", "u"), "z", "u", 1.0), ["z", "u"]).collect() == [(7, None, 4.0)]
    assert overlay.split(rows, zone, "z", "u", 1.0).count() == 0 and overlay.dissolve(rows.limit(0), "z", 1.0).count() == 0


def test_pairs_swept_together_equal_pairs_swept_alone():
    rng = np.random.default_rng(3)
    edges = lambda p: np.array([(*a, *b) if a[1] < b[1] else (*b, *a) for a, b in zip(p, np.roll(p, -1, axis=0), strict=True) if a[1] != b[1]])
    box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    a = [edges(star(rng, *rng.uniform(5, 9, 2), 4, n)) for n in (3, 5, 8, 8, 30) for _ in range(6)] + [edges(box(*rng.integers(0, 6, 2), 4, 3)) for _ in range(30)]
    b = [edges(star(rng, *rng.uniform(5, 9, 2), 4, n)) for n in (6, 5, 8, 8, 30) for _ in range(6)] + [edges(box(*rng.integers(0, 6, 2), 3, 5)) for _ in range(30)]
    alone = [overlay.swept([x, y], lambda h: np.where(h[0] & h[1], 0, -1))[0].get(0, 0.0) for x, y in zip(a, b, strict=True)]
    assert np.allclose(overlay.areas_of_both([x.tobytes() for x in a], [x.tobytes() for x in b]), alone, atol=1e-9)
    assert max(alone) > 1 and min(alone) == 0


def test_copies_of_a_shape_are_swept_once(spark, shapes):
    zones, units = shapes
    many = {k + 100 * i: rings for k, rings in zones.items() for i in range(3)}
    more = {k + 100 * i: rings for k, rings in units.items() for i in range(2)}
    once, keys = overlay.copies(frame(spark, many, "z"), "z")
    assert sorted(r.z for r in once.collect()) == sorted(zones) and {(r.z, r.of) for r in keys.collect()} == {(k, k % 100) for k in many}
    one = {(r.z, r.u): r.area for r in overlay.intersections(frame(spark, zones, "z"), frame(spark, units, "u"), "z", "u", 2.3).collect()}
    got = {(r.z, r.u): r.area for r in overlay.intersections(frame(spark, many, "z"), frame(spark, more, "u"), "z", "u", 2.3).collect()}
    assert got.keys() == {(z + 100 * i, u + 100 * j) for z, u in one for i in range(3) for j in range(2)}
    assert all(abs(v - one[z % 100, u % 100]) < 1e-9 for (z, u), v in got.items())
    one = {(r.z, r.u): r.area for r in overlay.split_areas(frame(spark, zones, "z"), frame(spark, units, "u"), "z", "u", 2.3).collect()}
    got = {(r.z, r.u): r.area for r in overlay.split_areas(frame(spark, many, "z"), frame(spark, more, "u"), "z", "u", 2.3).collect()}
    assert got.keys() == {(z + 100 * i, u) for z, u in one for i in range(3)} and all(abs(v - one[z % 100, u]) < 1e-9 for (z, u), v in got.items())
