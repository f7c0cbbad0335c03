"""Spatial operators: lattice, projection, points in polygons, overlays and density, on cells and by block equi-joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.config import DEFAULTS
from fluvia.storage import stored


def utm45(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in UTM zone 45 north (WGS 84), by the third-order Krüger series."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    s = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - 87.0)
    t = F.sinh(F.atanh(F.sin(phi)) - s * F.atanh(s * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, k in enumerate(alpha, 1):
        east = east + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * radius * east, 0.9996 * radius * north


def study_grid(bounds: DataFrame, tile: float = DEFAULTS["tile_m"]) -> DataFrame:
    """Tiles of the lattice that cover left, bottom, right, top: row by row from the north-west."""
    snapped = bounds.select((F.floor(F.col("left") / tile) * tile).alias("x0"), (F.ceil(F.col("top") / tile) * tile).alias("y0"), "right", "bottom")
    sized = snapped.select("*", F.greatest(F.lit(1), F.ceil((F.col("right") - F.col("x0")) / tile)).cast("int").alias("cols"), F.greatest(F.lit(1), F.ceil((F.col("y0") - F.col("bottom")) / tile)).cast("int").alias("rows"))
    rows = sized.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    return cells.select("row", "col", (F.col("x0") + F.col("col") * tile).cast("double").alias("origin_x"), (F.col("y0") - F.col("row") * tile).cast("double").alias("origin_y"))


def lattice_cells(boxes: DataFrame, span: float) -> DataFrame:
    """Cells (i, j) of a lattice anchored at 0 that a box west, south, east, north touches; one at least."""
    low = lambda k: F.floor(F.round(F.col(k) / span, 6)).cast("int")
    high = lambda k, at: F.greatest(low(at), F.ceil(F.round(F.col(k) / span, 6)).cast("int") - 1)
    wide = boxes.withColumn("i", F.explode(F.sequence(low("west"), high("east", "west")))).withColumn("j", F.explode(F.sequence(low("south"), high("north", "south"))))
    return wide.withColumn("cell_west", F.round(F.col("i") * span, 6)).withColumn("cell_south", F.round(F.col("j") * span, 6))


def cell_key(west: Column, south: Column) -> Column:
    """A stable file key of a cell."""
    return F.substring(F.sha1(F.format_string("%.6f_%.6f", west, south)), 1, 16)


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether a place is strictly inside the ring of edges (p, q), by casting a ray to the right; on an edge is outside."""
    cross = lambda e: ((e.p.y > y) != (e.q.y > y)) & (x < (e.q.x - e.p.x) * (y - e.p.y) / F.when(e.q.y != e.p.y, e.q.y - e.p.y).otherwise(1.0) + e.p.x)
    side = lambda e: (e.q.x - e.p.x) * (y - e.p.y) - (e.q.y - e.p.y) * (x - e.p.x)
    on = lambda e: (side(e) == 0) & x.between(F.least(e.p.x, e.q.x), F.greatest(e.p.x, e.q.x)) & y.between(F.least(e.p.y, e.q.y), F.greatest(e.p.y, e.q.y))
    return (F.size(F.filter(edges, cross)) % 2 == 1) & ~F.exists(edges, on)


def points_in_polygons(points: DataFrame, polygons: DataFrame, block: float) -> DataFrame:
    """Pairs of a point (x, y) strictly inside a polygon's ring (array of x, y).

    Both sides are dealt to square blocks, so that the join is an equi-join; ray casting decides within
    a block. Points on an edge are outside.
    """
    box = polygons.select("*", F.array_min(F.transform("ring", lambda p: p.x)).alias("bx0"), F.array_max(F.transform("ring", lambda p: p.x)).alias("bx1"), F.array_min(F.transform("ring", lambda p: p.y)).alias("by0"), F.array_max(F.transform("ring", lambda p: p.y)).alias("by1"))
    at = lambda v: F.floor(v / block).cast("int")
    spread = box.withColumn("block_x", F.explode(F.sequence(at(F.col("bx0")), at(F.col("bx1"))))).withColumn("block_y", F.explode(F.sequence(at(F.col("by0")), at(F.col("by1")))))
    pairs = points.withColumn("block_x", at(F.col("x"))).withColumn("block_y", at(F.col("y"))).join(spread, ["block_x", "block_y"])
    pairs = pairs.where("x > bx0 and x < bx1 and y > by0 and y < by1")
    n = F.size("ring")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("ring", k).alias("p"), F.get("ring", F.pmod(k + 1, n)).alias("q")))
    return pairs.where(inside(edges, F.col("x"), F.col("y"))).drop("block_x", "block_y", "bx0", "bx1", "by0", "by1")


def counts_in_polygons(points: DataFrame, polygons: DataFrame, key: str, block: float) -> DataFrame:
    """Rows key, n for each key: how many pairs there are of a polygon (key, ring) and a point strictly inside it, if any.

    Points of one place are counted before they meet polygons, and polygons of one ring, corner by corner, meet them once,
    so that pairs grow with the different places and rings, not with the copies of either. All pairs count: a key can have several
    polygons, of one ring or of several, and can be null.
    """
    placed = points.groupBy("x", "y").agg(F.count("*").alias("fl_n"))
    once = stored(polygons.groupBy("ring").agg(F.count("*").alias("fl_rings")).select("ring", F.monotonically_increasing_id().alias("fl_of")), "rings")
    found = points_in_polygons(placed, once, block).groupBy("fl_of").agg(F.sum("fl_n").alias("fl_in"))
    return polygons.select(key, "ring").join(once, "ring").join(found, "fl_of").groupBy(key).agg(F.sum("fl_in").alias("n"))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring of x, y."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(ring, k).x * F.get(ring, F.pmod(k + 1, n)).y - F.get(ring, F.pmod(k + 1, n)).x * F.get(ring, k).y)
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def identity(zones: DataFrame, units: DataFrame) -> DataFrame:
    """Zone cells with the units that hold them; cells outside every unit stay, with a null unit. One row for each pair."""
    return zones.join(units, ["r", "c"], "left")


def one_unit_per_cell(pairs: DataFrame) -> DataFrame:
    """Of units that overlap on a cell, the one with the larger part of the zone takes it, ties by unit id."""
    share = F.count("*").over(Window.partitionBy("zone", "unit"))
    order = Window.partitionBy("zone", "r", "c").orderBy(F.desc("share"), F.col("unit").asc_nulls_last())
    return pairs.withColumn("share", share).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("share", "rank")


def zone_pieces(cells: DataFrame, cell_ha: float) -> DataFrame:
    return cells.groupBy("zone", "unit").agg(F.count("*").alias("n_cells"), F.round(F.count("*") * cell_ha, 6).alias("area_ha"))


def density(counts: DataFrame, least: float = DEFAULTS["min_area_km2"], low: float = DEFAULTS["low_below"], high: float = DEFAULTS["high_from"]) -> DataFrame:
    """Density of n over area, where enough area was measured, and its band."""
    d = F.when(F.coalesce("area_km2", F.lit(0.0)) >= least, F.coalesce("n", F.lit(0)) / F.col("area_km2"))
    return counts.withColumn("density", F.round(d, 6)).withColumn("mapping", F.when(F.col("density").isNull(), "not measured").when(F.col("density") < low, "low").when(F.col("density") < high, "medium").otherwise("high"))


def intersection(zones: DataFrame, units: DataFrame) -> DataFrame:
    """Zone cells inside units, one row for each pair; cells outside every unit go."""
    return zones.join(units, ["r", "c"])


def answered_cells(asked: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Cells asked for, once each, and whether they were answered: those make up the coverage."""
    return asked.select(keys).distinct().join(answered.select(*keys, F.lit(True).alias("answered")).distinct(), keys, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def lonlat45(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place in UTM zone 45 north: the inverse of :func:`utm45`, by the same series."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = north / (0.9996 * radius), (east - 500_000) / (0.9996 * radius)
    xi0, eta0 = xi, eta
    for j, k in enumerate(beta, 1):
        xi = xi - k * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - k * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, k in enumerate(delta, 1):
        phi = phi + k * F.sin(2 * j * chi)
    return 87.0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def projected_box(boxes: DataFrame, keys: list[str], steps: int = 25) -> DataFrame:
    """The box in UTM zone 45 of boxes west, south, east, north in degrees: edges bend, so each is projected at
    ``steps`` + 1 places."""
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / steps
    along = boxes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    edges = [(at("west", "east"), F.col("south")), (at("west", "east"), F.col("north")), (F.col("west"), at("south", "north")), (F.col("east"), at("south", "north"))]
    points = along.select(*keys, F.explode(F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in edges))).alias("p"))
    x, y = utm45(F.col("p.lon"), F.col("p.lat"))
    placed = points.select(*keys, x.alias("x"), y.alias("y"))
    return placed.groupBy(*keys).agg(F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top"))


def tile_corners(tiles: DataFrame, tile: float = DEFAULTS["tile_m"]) -> DataFrame:
    """Tiles (origin_x, origin_y: the north-west corner) with the box of their four corners in degrees."""
    corners = F.array(*(F.struct((F.col("origin_x") + i * tile).alias("x"), (F.col("origin_y") - j * tile).alias("y")) for i in (0, 1) for j in (0, 1)))
    place = lambda k: F.transform(corners, lambda p: lonlat45(p.x, p.y)[k])
    return tiles.select("*", F.array_min(place(0)).alias("west"), F.array_min(place(1)).alias("south"), F.array_max(place(0)).alias("east"), F.array_max(place(1)).alias("north"))


def touching(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose box west, south, east, north touches another: a range filter, before anything exact."""
    west, south, east, north = box
    return rows.where((F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north))


def extent(points: DataFrame, buffer: float, keys: list[str] | None = None) -> DataFrame:
    """The box around points x, y, wider by ``buffer`` on each side."""
    return points.groupBy(*(keys or [])).agg((F.min("x") - buffer).alias("west"), (F.min("y") - buffer).alias("south"), (F.max("x") + buffer).alias("east"), (F.max("y") + buffer).alias("north"))


def restrict_cells(cells: DataFrame, footprint: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that a footprint, given as cells, touches; all of them if it touches none."""
    near = cells.join(footprint.select(keys).distinct(), keys, "left_semi")
    return near if not near.isEmpty() else cells


def large_zones(cells: DataFrame, keys: list[str], least_ha: float, cell_ha: float) -> DataFrame:
    """Cells of the zones that have an area of ``least_ha`` at least."""
    large = cells.groupBy(*keys).agg((F.count("*") * cell_ha).alias("ha")).where(F.col("ha") >= least_ha).select(*keys)
    return cells.join(large, keys, "left_semi")


def dissolved(cells: DataFrame, by: list[str]) -> DataFrame:
    """The union of the parts of each group, on cells: a cell that several parts hold counts once."""
    return cells.select(*by, "r", "c").distinct()


def outline(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sides of cells that part a zone from what is around it, as (keys, r, c, side): the zone's rings in pieces.
    A side that two cells of a zone share is met twice and goes."""
    sides = [("n", 0, 0, "h"), ("s", 1, 0, "h"), ("w", 0, 0, "v"), ("e", 0, 1, "v")]
    each = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), (F.col("r") + i).alias("er"), (F.col("c") + j).alias("ec"), F.lit(way).alias("way")) for side, i, j, way in sides))).alias("s")
    out = cells.select(*keys, "r", "c", each).groupBy(*keys, "s.er", "s.ec", "s.way").agg(F.count("*").alias("n"), F.first("r").alias("r"), F.first("c").alias("c"), F.first("s.side").alias("side"))
    return out.where("n = 1").select(*keys, "r", "c", "side")


def _clip_side(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """The part of a ring on one side of a line, by the Sutherland-Hodgman rule for one edge of a box."""
    n = F.size(ring)
    inside = lambda p: (p[axis] >= bound) if above else (p[axis] <= bound)
    other = "y" if axis == "x" else "x"

    def crossing(p: Column, q: Column) -> Column:
        t = F.try_divide(bound - p[axis], q[axis] - p[axis])
        value = {axis: bound.cast("double"), other: p[other] + (q[other] - p[other]) * t}
        return F.struct(value["x"].alias("x"), value["y"].alias("y"))

    def edge(k: Column) -> Column:
        p, q = F.get(ring, k), F.get(ring, F.pmod(k + 1, n))
        return F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(crossing(p, q))).when(inside(q), F.array(crossing(p, q), q)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), edge))).otherwise(ring)


def clipped(rows: DataFrame, ring: str, box: tuple[str, str, str, str], out: str) -> DataFrame:
    """``rows`` with the part of their ring (array of x, y) within the box of four columns; empty without any.

    A column for each side of the box: one expression over all four would hold its parts many times.
    """
    rows = rows.withColumn(out, F.transform(ring, lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))))
    for axis, bound, above in (("x", box[0], True), ("y", box[1], True), ("x", box[2], False), ("y", box[3], False)):
        rows = rows.withColumn(out, _clip_side(F.col(out), axis, F.col(bound), above))
    return rows


def centroid(ring: Column) -> Column:
    """The centroid of a ring as a struct x, y."""
    n = F.size(ring)
    at = lambda k: (F.get(ring, k), F.get(ring, F.pmod(k + 1, n)))
    cross = lambda p, q: p.x * q.y - q.x * p.y
    every = F.sequence(F.lit(0), n - 1)
    total = lambda f: F.aggregate(F.transform(every, lambda k: f(*at(k))), F.lit(0.0), lambda s, t: s + t)
    area = total(cross)
    return F.struct((total(lambda p, q: (p.x + q.x) * cross(p, q)) / (3 * area)).alias("x"), (total(lambda p, q: (p.y + q.y) * cross(p, q)) / (3 * area)).alias("y"))


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: those farther than ``tolerance`` from the line between the ones that stay beside them."""
    stay = np.zeros(len(points), bool)
    stay[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        way, between = points[b] - points[a], points[a + 1 : b] - points[a]
        length = float(np.hypot(*way))
        far = np.abs(way[0] * between[:, 1] - way[1] * between[:, 0]) / length if length else np.hypot(between[:, 0], between[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            stay[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return stay


def simplify(ring: Column, tolerance: float) -> Column:
    """Rings (arrays of x, y) without corners that matter less than ``tolerance``; a ring's first corner and the one
    farthest from it stay, and no ring falls below three corners."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(rings: pd.Series) -> pd.Series:
        def one(ring):
            if ring is None or len(ring) < 4:
                return ring
            points = np.array([(p["x"], p["y"]) for p in ring], float)
            split = int(np.hypot(*(points - points[0]).T).argmax())
            first, second = simplified(points[: split + 1], tolerance), simplified(np.vstack([points[split:], points[:1]]), tolerance)
            stay = np.append(first, second[1:-1])
            return [p for p, s in zip(ring, stay, strict=True) if s] if stay.sum() > 2 else ring

        return rings.map(one)

    return run(ring)


def hectares(square_metres: Column) -> Column:
    return square_metres / 10_000


def square_kilometres(square_metres: Column) -> Column:
    return square_metres / 1_000_000
