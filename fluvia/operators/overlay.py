"""Polygons against polygons: overlays, one unit for each place, dissolving, and rings put together again.

A polygon is a row with ``rings`` (array of rings of x, y), inside where a ray crosses its rings an odd
number of times, so that holes are rings like any other. Polygons are cut along a grid of square
cells; polygons meet by an equi-join of cells, and each cell's work is its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.operators.frames import joined_labels
from fluvia.storage import shared_out, stored

EDGE = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
#: Polygons of a group that a task dissolves together in a cell.
TOGETHER = 64
#: Corners closer than this to each other, or to the line between their neighbours, are one, or none.
CLOSE = 1e-6


def cut_edges(e: np.ndarray, left: float, right: float) -> np.ndarray:
    """Edges (x0, y0, x1, y1, upwards) of a region as those of its part between two x. What lies beyond a border moves
    onto it: there, only stretches that an odd number of edges has matter."""
    for b in (left, right):
        over = (np.minimum(e[:, 0], e[:, 2]) < b) & (np.maximum(e[:, 0], e[:, 2]) > b)
        if over.any():
            x0, y0, x1, y1 = e[over].T
            y = np.clip(y0 + (y1 - y0) * (b - x0) / (x1 - x0), y0, y1)
            at = np.full(len(y), b)
            e = np.concatenate([e[~over], np.stack([x0, y0, at, y], 1), np.stack([at, y, x1, y1], 1)])
    e = np.stack([np.clip(e[:, 0], left, right), e[:, 1], np.clip(e[:, 2], left, right), e[:, 3]], 1)
    parts = [e[(e[:, 0] != e[:, 2]) | ((e[:, 0] != left) & (e[:, 0] != right))]]
    for b in (left, right):
        own = e[(e[:, 0] == b) & (e[:, 2] == b)]
        ends = np.sort(own[:, [1, 3]].ravel()).reshape(-1, 2)
        parts.append(np.stack([np.full(len(ends), b), ends[:, 0], np.full(len(ends), b), ends[:, 1]], 1))
    e = np.concatenate(parts)
    return e[e[:, 1] < e[:, 3]]


def _x_at(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x of each edge at each y, exactly an end's x at its y."""
    x0, y0, x1, y1 = e.T
    x = x0 + (x1 - x0) * (y[:, None] - y0) / (y1 - y0)
    return np.where(y[:, None] == y0, x0, np.where(y[:, None] == y1, x1, x))


def crossings(e: np.ndarray) -> np.ndarray:
    """The y at which two edges cross inside both."""
    x0, y0, x1, y1 = e.T
    slope = (x1 - x0) / (y1 - y0)
    out = []
    for s in range(0, len(e), 256):
        a = slice(s, s + 256)
        low, high = np.maximum(y0[a, None], y0), np.minimum(y1[a, None], y1)
        near = (low < high) & (np.minimum(x0, x1)[a, None] <= np.maximum(x0, x1)) & (np.maximum(x0, x1)[a, None] >= np.minimum(x0, x1))
        i, j = np.nonzero(near & (np.arange(len(e))[a, None] < np.arange(len(e))))
        i += s
        low, high = np.maximum(y0[i], y0[j]), np.minimum(y1[i], y1[j])
        apart = lambda y, i=i, j=j: (x0[i] - x0[j]) + slope[i] * (y - y0[i]) - slope[j] * (y - y0[j])
        below, above = apart(low), apart(high)
        hit = below * above < 0
        y = low[hit] + (high - low)[hit] * below[hit] / (below - above)[hit]
        out.append(y)
    return np.concatenate(out) if out else np.zeros(0)


def swept(edges: list[np.ndarray], rule) -> tuple[dict[int, float], dict[int, np.ndarray]]:
    """Regions of a cell by a sweep from below: {label: area} and {label: rows x0, y0, x1, y1, side}.

    ``edges`` has the edges of each polygon. Between two neighbouring y of ends and crossings the
    edges keep their order, so that the places between them are trapezoids; ``rule`` gives a label (-1:
    none) to each from the boolean arrays of the polygons that hold it. A region's border is its
    edges with ``side`` 1 where it lies to the right, -1 to the left; level parts of it follow from them.
    """
    e = np.concatenate(edges) if edges else np.zeros((0, 4))
    owner = np.repeat(np.arange(len(edges)), [len(x) for x in edges])
    if not len(e):
        return {}, {}
    levels = np.unique(np.concatenate([e[:, 1], e[:, 3], crossings(e)]))
    area: dict[int, float] = {}
    border: dict[int, list] = {}
    step = max(1, 2_000_000 // len(e))
    for s in range(0, len(levels) - 1, step):
        low, high = levels[s : s + step + 1][:-1], levels[s : s + step + 1][1:]
        on = (e[:, 1] <= low[:, None]) & (e[:, 3] >= high[:, None])
        width = int(on.sum(axis=1).max())
        if not width:
            continue
        xa, xb = _x_at(e, low), _x_at(e, high)
        order = np.argsort(np.where(on, xa + xb, np.inf), axis=1, kind="stable")[:, :width]
        take = lambda x, order=order: np.take_along_axis(x, order, axis=1)
        xa, xb, on, whose = take(xa), take(xb), take(on), owner[order]
        held = [np.cumsum((whose == u) & on, axis=1) % 2 == 1 for u in range(len(edges))]
        label = np.where(on, rule(held), -1)
        tall = (high - low)[:, None]
        size = (xa[:, 1:] - xa[:, :-1] + xb[:, 1:] - xb[:, :-1]) / 2 * tall
        real = on[:, 1:] & (label[:, :-1] >= 0)
        for k in np.unique(label[:, :-1][real]).tolist():
            area[k] = area.get(k, 0.0) + float(size[real & (label[:, :-1] == k)].sum())
        before = np.concatenate([np.full((len(low), 1), -1), label[:, :-1]], axis=1)
        low, high = (np.broadcast_to(x[:, None], xa.shape) for x in (low, high))
        for which, side in ((label, 1.0), (before, -1.0)):
            pick = on & (label != before) & (which >= 0)
            for k in np.unique(which[pick]).tolist():
                p = pick & (which == k)
                border.setdefault(k, []).append(np.stack([xa[p], low[p], xb[p], high[p], np.full(int(p.sum()), side)], 1))
    return area, {k: np.concatenate(v) for k, v in border.items()}


def fragments(polygons: DataFrame, keys: list[str], span: float) -> DataFrame:
    """Rows keys, cx, cy, edges, box: each polygon's part in each cell of ``span`` that it touches, as the bytes of rows x0, y0, x1, y1,
    and the part's box (west, south, east, north).

    Edges are cut into the bands of cells that they cross; what a polygon has in a band is then cut into
    the band's cells. A null polygon, and rings of fewer than three corners, have no parts.
    """
    ring = polygons.select(*keys, F.explode("rings").alias("ring")).where(F.size("ring") > 2)
    n = F.size("ring")
    edge = ring.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("ring", k).alias("p"), F.get("ring", F.pmod(k + 1, n)).alias("q")))).alias("e")).where("e.p.y <> e.q.y")
    up = F.col("e.p.y") < F.col("e.q.y")
    ends = {f"{v}{k}": F.when(up if k == 0 else ~up, F.col(f"e.p.{v}")).otherwise(F.col(f"e.q.{v}")).cast("double") for k in (0, 1) for v in ("x", "y")}
    edge = edge.select(*keys, *(c.alias(k) for k, c in ends.items()))
    band = edge.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / span), F.ceil(F.col("y1") / span) - 1)))
    low, high = F.greatest("y0", F.col("cy") * span), F.least("y1", (F.col("cy") + 1) * span)
    x = lambda y: F.when(y == F.col("y0"), F.col("x0")).when(y == F.col("y1"), F.col("x1")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0")))
    cut = band.select(*keys, "cy", F.struct(x(low).alias("x0"), low.alias("y0"), x(high).alias("x1"), high.alias("y1")).alias("e")).where("e.y0 < e.y1")
    rows = cut.groupBy(*keys, "cy").agg(F.collect_list("e").alias("e"))
    kinds = [*(polygons.schema[k] for k in keys), T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("edges", T.BinaryType()), T.StructField("box", T.ArrayType(T.DoubleType()))]

    def run(batches):
        for b in batches:
            at = b.column("e").offsets.to_numpy()
            values = np.stack([x.to_numpy() for x in b.column("e").values.flatten()], 1)
            pick, cx, parts, boxes = [], [], [], []
            for k in range(b.num_rows):
                e = values[at[k] : at[k + 1]]
                first, last = int(np.floor(e[:, [0, 2]].min() / span)), int(np.floor(e[:, [0, 2]].max() / span))
                for c in range(first, last + 1):
                    own = cut_edges(e, c * span, (c + 1) * span)
                    if len(own):
                        pick.append(k)
                        cx.append(c)
                        parts.append(own.tobytes())
                        boxes.append([own[:, [0, 2]].min(), own[:, 1].min(), own[:, [0, 2]].max(), own[:, 3].max()])
            some = b.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keys), pa.array(cx, pa.int64()), some.column("cy"), pa.array(parts, pa.binary()), pa.array(boxes, pa.list_(pa.float64()))], [*keys, "cx", "cy", "edges", "box"])

    return rows.mapInArrow(run, T.StructType(kinds))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that polygons a[i] (n, edges, 4) and b[i] share, by the sweep of :func:`swept` for all i side by side."""
    e, first = np.concatenate([a, b], 1), a.shape[1]
    n, width = e.shape[:2]
    x0, y0, x1, y1 = np.moveaxis(e, 2, 0)
    slope = (x1 - x0) / (y1 - y0)
    i, j = np.triu_indices(width, 1)
    low, high = np.maximum(y0[:, i], y0[:, j]), np.minimum(y1[:, i], y1[:, j])
    apart = lambda y: (x0[:, i] - x0[:, j]) + slope[:, i] * (y - y0[:, i]) - slope[:, j] * (y - y0[:, j])
    below, above = apart(low), apart(high)
    hit = (low < high) & (below * above < 0)
    cross = np.where(hit, low + (high - low) * below / np.where(hit, below - above, 1.0), -np.inf)
    most = int(hit.sum(axis=1).max())
    cross = np.sort(cross, axis=1)[:, cross.shape[1] - most :]  # those that aren't there lie below every level: no edge is on beside them
    levels = np.sort(np.concatenate([y0, y1, cross], 1), axis=1)
    which, k = np.nonzero((levels[:, 1:] > levels[:, :-1]) & np.isfinite(levels[:, :-1]))
    low, high = levels[which, k][:, None], levels[which, k + 1][:, None]
    x0, y0, x1, y1 = np.moveaxis(e[which], 2, 0)
    on = (y0 <= low) & (y1 >= high)
    at = lambda y: np.where(y == y0, x0, np.where(y == y1, x1, x0 + (x1 - x0) * (y - y0) / (y1 - y0)))
    xa, xb = at(low), at(high)
    order = np.argsort(np.where(on, xa + xb, np.inf), axis=1, kind="stable")
    xa, xb, on = (np.take_along_axis(x, order, axis=1) for x in (xa, xb, on))
    held = [np.cumsum(on & own, axis=1) % 2 == 1 for own in (order < first, order >= first)]
    size = (xa[:, 1:] - xa[:, :-1] + xb[:, 1:] - xb[:, :-1]) / 2 * (high - low)
    size = np.where(on[:, 1:] & (held[0] & held[1])[:, :-1], size, 0.0).sum(axis=1)
    return np.bincount(which, size, n)


def areas_of_both(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The area that each polygon of ``a`` shares with that of ``b``, as bytes of edges. Pairs with as many edges are swept together."""
    out = np.zeros(len(a))
    sizes = np.array([(len(x) // 32, len(y) // 32) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for n, m in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes == (n, m)).all(axis=1))
        if n + m > 40:
            both = lambda h: np.where(h[0] & h[1], 0, -1)
            out[rows] = [swept([_edges(a[k]), _edges(b[k])], both)[0].get(0, 0.0) for k in rows]
            continue
        step = max(1, 500_000 // (n + m) ** 3)
        for s in range(0, len(rows), step):
            own = rows[s : s + step]
            x, y = (np.frombuffer(b"".join([side[k] for k in own])).reshape(len(own), -1, 4) for side in (a, b))
            out[own] = _both(x, y)
    return out


def copies(polygons: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Polygons (key, rings) of which each shape is there once, under the smallest key that has it, and all keys with
    that one, as ``of``. Shapes are the same if their rings are, corner by corner."""
    once = stored(polygons.groupBy("rings").agg(F.min(key).alias(key)), "shapes").select(key, "rings")
    return once, stored(polygons.join(once.withColumnRenamed(key, "of"), "rings").select(key, "of"), "copies")


def _edges(b: bytes) -> np.ndarray:
    return np.frombuffer(b).reshape(-1, 4)


def shared_areas(zones: DataFrame, units: DataFrame, zone: str, unit: str) -> DataFrame:
    """Rows zone, unit, area of each pair that shares an area; both sides as :func:`fragments`. Each pair of
    parts whose boxes meet is worked on by itself, so that a cell with many is shared out like any join."""

    def run(batches):
        for b in batches:
            area = areas_of_both(b.column("edges").to_pylist(), b.column("other").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(zone), b.column(unit), pa.array(area, pa.float64())], [zone, unit, "area"])

    near = [F.get("box", k) < F.get("box2", k + 2) for k in (0, 1)] + [F.get("box2", k) < F.get("box", k + 2) for k in (0, 1)]
    met = zones.join(units.withColumnsRenamed({"edges": "other", "box": "box2"}), ["cx", "cy"]).where(near[0] & near[1] & near[2] & near[3])
    pairs = shared_out(met.select(zone, unit, "edges", "other"), zone, unit)
    got = pairs.mapInArrow(run, T.StructType([zones.schema[zone], units.schema[unit], T.StructField("area", T.DoubleType())]))
    return got.groupBy(zone, unit).agg(F.sum("area").alias("area")).where("area > 0")


def intersections(zones: DataFrame, units: DataFrame, zone: str, unit: str, span: float) -> DataFrame:
    """Rows zone, unit, area of each pair of polygons (zone, rings) and (unit, rings) that shares an area. Copies of a shape are worked
    on once: the sweeps grow with the pairs of different shapes, and a join gives each pair of keys its row."""
    (zones, zone_keys), (units, unit_keys) = copies(zones, zone), copies(units, unit)
    met = stored(shared_areas(fragments(zones, [zone], span), fragments(units, [unit], span), zone, unit).toDF("fl_z", "fl_u", "area"), "shared")
    both = met.join(unit_keys.withColumnRenamed("of", "fl_u"), "fl_u").join(zone_keys.withColumnRenamed("of", "fl_z"), "fl_z")
    return both.select(zone, unit, "area")


def split(zones: DataFrame, units: DataFrame, zone: str, unit: str, span: float) -> DataFrame:
    """Rows zone, unit, cx, cy, area, border: the parts of zones (zone, rings) in units (unit, rings), cell by cell, and
    with a null unit what no unit holds.

    Where units overlap, the one with the larger part of the zone has the place (ties by unit): a zone's
    parts never overlap and add up to the zone. ``border`` has the part's edges for :func:`rings`. Key columns must not be null; a
    zone's cell comes to a task with the units that it meets there. Copies of a shape are worked on once.
    """
    once, keys = copies(zones, zone)
    parts = _split(once, units, zone, unit, span).withColumnRenamed(zone, "of")
    return parts.join(keys, "of").select(zone, unit, "cx", "cy", "area", "border")


def split_areas(zones: DataFrame, units: DataFrame, zone: str, unit: str, span: float) -> DataFrame:
    """Rows zone, unit, area: the areas of the parts of :func:`split`, added up before copies of a zone get their rows."""
    once, keys = copies(zones, zone)
    parts = stored(areas(_split(once, units, zone, unit, span), [zone, unit]).withColumnRenamed(zone, "of"), "split")
    return parts.join(keys, "of").select(zone, unit, "area")


def _split(zones: DataFrame, units: DataFrame, zone: str, unit: str, span: float) -> DataFrame:
    # A unit with a copy of a smaller key has no place: the two have the same part of any zone, so the other comes first.
    units, _ = copies(units, unit)
    zones, units = stored(fragments(zones, [zone], span), "zone-parts"), stored(fragments(units, [unit], span), "unit-parts")
    order = Window.partitionBy(zone).orderBy(F.desc("area"), unit)
    ranked = stored(shared_areas(zones, units, zone, unit).withColumn("rank", F.row_number().over(order)).select(zone, unit, "rank"), "ranked")
    met = zones.select(zone, "cx", "cy").join(units.drop("box"), ["cx", "cy"]).join(ranked, [zone, unit])
    found = met.groupBy(zone, "cx", "cy").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(unit).alias("unit"), "edges"))).alias("units"))
    rows = zones.join(found, [zone, "cx", "cy"], "left")
    kinds = [zones.schema[zone], units.schema[unit], *(T.StructField(k, t) for k, t in (("cx", T.LongType()), ("cy", T.LongType()), ("area", T.DoubleType()), ("border", T.BinaryType())))]
    names = [k.name for k in kinds]
    unit_type = rows.schema["units"].dataType.elementType["unit"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            pick, who, areas, borders = [], [], [], []
            for k, (mine, others) in enumerate(zip(b.column("edges").to_pylist(), b.column("units").to_pylist(), strict=True)):
                others = others or []

                def rule(held):
                    out = np.full(held[0].shape, len(held) - 1)
                    for u in range(len(held) - 1, 0, -1):
                        out[held[u]] = u - 1
                    return np.where(held[0], out, -1)

                # Where the first units leave nothing of the part, the others get nothing.
                n = min(4, len(others))
                while True:
                    area, border = swept([_edges(mine), *(_edges(o["edges"]) for o in others[:n])], rule)
                    if n == len(others) or not area.get(n, 0.0):
                        break
                    n = min(2 * n, len(others))
                for label, size in area.items():
                    pick.append(k)
                    who.append(others[label]["unit"] if label < n else None)
                    areas.append(size)
                    borders.append(border.get(label, np.zeros((0, 5))).tobytes())
            some = b.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(zone), pa.array(who, to_arrow_type(unit_type)), some.column("cx"), some.column("cy"), pa.array(areas, pa.float64()), pa.array(borders, pa.binary())], names)

    return shared_out(rows.select(zone, "cx", "cy", "edges", "units"), zone, "cx", "cy").mapInArrow(run, T.StructType(kinds)).where("area > 0")


def areas(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The area of the parts of each group."""
    return parts.groupBy(*keys).agg(F.sum("area").alias("area"))


def dissolve(polygons: DataFrame, by: str, span: float, together: int = TOGETHER) -> DataFrame:
    """Rows by, cx, cy, area, border: the union of the polygons (by, rings) of each group, cell by cell.

    Polygons that meet in a cell are united TOGETHER at a time, and what comes of it again, so that no task
    takes all of a group's polygons in a cell, however many lie there. Borders that two polygons of a group share go.
    """
    now = fragments(polygons.select(F.monotonically_increasing_id().alias("id"), by, "rings"), ["id", by], span)
    now = stored(now.select(by, "cx", "cy", "edges", F.xxhash64("id").alias("deal")), "parts")
    kinds = [polygons.schema[by], *(T.StructField(k, t) for k, t in (("cx", T.LongType()), ("cy", T.LongType()), ("area", T.DoubleType()), ("border", T.BinaryType())))]
    names = [k.name for k in kinds]

    def run(batches):
        for b in batches:
            areas, borders = [], []
            for parts in b.column("edges").to_pylist():
                area, border = swept([_edges(x) for x in parts], lambda held: np.where(np.logical_or.reduce(held), 0, -1))
                areas.append(area.get(0, 0.0))
                borders.append(border.get(0, np.zeros((0, 5))).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (by, "cx", "cy")), pa.array(areas, pa.float64()), pa.array(borders, pa.binary())], names)

    @F.pandas_udf("binary")
    def as_edges(border: pd.Series) -> pd.Series:
        return border.map(lambda x: np.ascontiguousarray(np.frombuffer(x).reshape(-1, 5)[:, :4]).tobytes())

    while True:
        sized = now.groupBy(by, "cx", "cy").agg(F.count("*").alias("n"))
        most = sized.agg(F.max("n")).first()[0] or 0
        dealt = now.join(sized.withColumnRenamed(by, "b").withColumnsRenamed({"cx": "x", "cy": "y"}), (F.col(by).eqNullSafe(F.col("b"))) & (F.col("cx") == F.col("x")) & (F.col("cy") == F.col("y")))
        task = F.pmod("deal", F.ceil(F.col("n") / together)).alias("task")
        done = dealt.groupBy(by, "cx", "cy", task).agg(F.collect_list("edges").alias("edges")).select(by, "cx", "cy", "edges").mapInArrow(run, T.StructType(kinds))
        if most <= together:
            return done.where("area > 0")
        united = stored(done, "united")
        now = united.where("area > 0").select(by, "cx", "cy", as_edges("border").alias("edges"), F.xxhash64("border", F.rand(1)).alias("deal"))
        now = stored(now, "parts")


def _net(e: np.ndarray) -> np.ndarray:
    """Border edges (x0, y0, x1, y1, side) without those that are met from both sides: edges of no width, and
    the cells' own borders, which are cut at other places on either side."""
    upright = e[:, 0] == e[:, 2]
    kept = []
    rest = e[~upright]
    if len(rest):
        line, inverse = np.unique(rest[:, :4], axis=0, return_inverse=True)
        net = np.bincount(inverse.ravel(), rest[:, 4])
        kept.append(np.column_stack([line, np.sign(net)])[net != 0])
    for x in np.unique(e[upright, 0]):
        own = e[upright & (e[:, 0] == x)]
        y = np.unique(own[:, [1, 3]])
        change = np.zeros(len(y))
        np.add.at(change, np.searchsorted(y, own[:, 1]), own[:, 4])
        np.add.at(change, np.searchsorted(y, own[:, 3]), -own[:, 4])
        net = np.cumsum(change)[:-1]
        some = net != 0
        k = int(some.sum())
        kept.append(np.stack([np.full(k, x), y[:-1][some], np.full(k, x), y[1:][some], np.sign(net[some])], 1))
    return np.concatenate(kept) if kept else np.zeros((0, 5))


def chains(e: np.ndarray, low: float, high: float) -> list[tuple[np.ndarray, bool]]:
    """The lines (corners, closed) of a band's border edges, walked with the region to the left; open ones begin and
    end on the band's borders.

    On a level, the line that ends as the k-th from the left goes on with the one that begins as the k-th: what
    lies between them is border on the level itself, or nothing.
    """
    e = _net(e)
    n = len(e)
    up = e[:, 4] < 0
    x0, y0, x1, y1 = np.where(up[:, None], e[:, :4], e[:, [2, 3, 0, 1]]).T
    inner = lambda y: np.flatnonzero((y > low) & (y < high))
    begins, ends = inner(y0), inner(y1)
    begins, ends = begins[np.lexsort((x0[begins], y0[begins]))], ends[np.lexsort((x1[ends], y1[ends]))]
    to = np.full(n, -1)
    to[ends] = begins
    open_ = np.ones(n, bool)
    open_[begins] = False
    seen = np.zeros(n, bool)
    out = []
    for start in [*np.flatnonzero(open_).tolist(), *range(n)]:
        if seen[start]:
            continue
        at, line = start, []
        while at >= 0 and not seen[at]:
            seen[at] = True
            line += [(x0[at], y0[at]), (x1[at], y1[at])]
            at = to[at]
        out.append((np.array(line), at >= 0))
    return out


def tidy_ring(p: np.ndarray) -> np.ndarray:
    """A ring's corners without repeated ones and without those on a straight line."""
    while len(p) > 2:
        before, after = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
        way = after - before
        length = np.hypot(*way.T)
        off = np.abs(way[:, 0] * (p - before)[:, 1] - way[:, 1] * (p - before)[:, 0])
        gone = (np.hypot(*(p - before).T) < CLOSE) | (off <= CLOSE * np.maximum(length, CLOSE))
        if not gone.any():
            return p
        # Of neighbours only one goes at a time.
        first = gone & ~np.roll(gone, 1)
        p = p[~first] if first.any() else p[1:]
    return p[:0]


def ring_size(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    o = p[0] if len(p) else 0
    return float(((p - o)[:, 0] * (q - o)[:, 1] - (q - o)[:, 0] * (p - o)[:, 1]).sum() / 2) if len(p) else 0.0


def rings(parts: DataFrame, keys: list[str], span: float) -> DataFrame:
    """Rows keys, area (holes below 0), ring (array of x, y; the region to the left of it) of the regions of ``parts``
    (keys, cy, border), as :func:`split` and :func:`dissolve` give them.

    Edges are put together to lines within each band of cells; lines that meet on the bands' borders are
    linked, and linked lines are one ring (found by star contraction). So only a ring's own lines ever meet in one task.
    """
    line_kinds = [*(parts.schema[k] for k in keys), T.StructField("cy", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("closed", T.BooleanType()), *(T.StructField(k, T.ArrayType(T.DoubleType())) for k in ("xs", "ys"))]

    def band(part: pd.DataFrame) -> pd.DataFrame:
        cy = int(part["cy"].iloc[0])
        got = chains(np.concatenate([np.frombuffer(x).reshape(-1, 5) for x in part["border"]]), cy * span, (cy + 1) * span)
        head = part[keys].astype(object).iloc[[0] * len(got)].reset_index(drop=True)
        return head.assign(cy=cy, n=range(len(got)), closed=[c for _, c in got], xs=[p[:, 0].tolist() for p, _ in got], ys=[p[:, 1].tolist() for p, _ in got])

    lines = parts.select(*keys, "cy", "border").groupBy(*keys, "cy").applyInPandas(band, T.StructType(line_kinds))
    lines = stored(lines.withColumn("id", F.xxhash64(*keys, "cy", "n")), "lines")
    end = lambda begins, at: F.struct(F.lit(begins).alias("begins"), F.element_at("xs", at).alias("x"), F.element_at("ys", at).alias("y"))
    ends = lines.where("not closed").select(*keys, "id", F.explode(F.array(end(True, 1), end(False, -1))).alias("e")).select(*keys, "id", "e.*")
    level = ends.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "y", "begins").orderBy("x", "id")))
    links = level.groupBy(*keys, "y", "k").agg(F.max(F.when(~F.col("begins"), F.col("id"))).alias("line"), F.max(F.when(F.col("begins"), F.col("id"))).alias("to")).select("line", "to")
    links = stored(links, "line-links")
    part_of = joined_labels(links.select(F.col("line").alias("u"), F.col("to").alias("v")), []).toDF("a_line", "ring_id")
    whole = lines.join(links, F.col("id") == F.col("line"), "left").join(part_of, F.col("id") == F.col("a_line"), "left").withColumn("ring_id", F.coalesce("ring_id", "id"))
    corner = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    kinds = [*(parts.schema[k] for k in keys), T.StructField("area", T.DoubleType()), T.StructField("ring", T.ArrayType(corner))]

    def close(part: pd.DataFrame) -> pd.DataFrame:
        ids, to = part["id"].tolist(), part["to"].tolist()
        row = {i: k for k, i in enumerate(ids)}
        at, corners = 0, []
        seen = set()
        while at not in seen:
            seen.add(at)
            corners.append(at)
            if part["closed"].iloc[at]:
                break
            at = row[int(to[at])]
        p = tidy_ring(np.concatenate([np.column_stack([part["xs"].iloc[k], part["ys"].iloc[k]]) for k in corners]))
        head = part[keys].astype(object).iloc[[0]].reset_index(drop=True)
        return head.assign(area=[ring_size(p)], ring=[[{"x": float(a), "y": float(b)} for a, b in p]])

    whole = whole.select(*keys, "ring_id", "id", F.col("to").cast("string").alias("to"), "closed", "xs", "ys")
    return whole.groupBy(*keys, "ring_id").applyInPandas(close, T.StructType(kinds)).where(F.size("ring") > 2)
