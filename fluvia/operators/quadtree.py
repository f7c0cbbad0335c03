"""Points in polygons over a quadtree that is cut by load."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvia.operators.spatial import inside
from fluvia.storage import stored

#: Halvings of the plane's sides: places are numbers of 16 bits, their codes of 32.
LEVELS = 16
SIDE = 1 << LEVELS


@dataclass(frozen=True)
class Tree:
    """Leaves in the order of their codes: the lower left place and side of each, and how many copies its rows are dealt to."""

    west: float
    south: float
    unit: float
    left: tuple[int, ...]
    low: tuple[int, ...]
    side: tuple[int, ...]
    copies: tuple[int, ...]

    @property
    def starts(self) -> list[int]:
        return [int(_code(np.int64(x), np.int64(y))) for x, y in zip(self.left, self.low, strict=True)]

    def place(self, value: Column, start: float) -> Column:
        """A coordinate as a number from 0 to 65,535; what lies outside the plane counts as its border."""
        return F.least(F.lit(SIDE - 1), F.greatest(F.lit(0), F.floor((value - start) / self.unit))).cast("bigint")


def _gaps(v):
    """A bit between any two of a number of 16 bits; numbers, arrays or columns."""
    if isinstance(v, Column):
        shift, join, meet = F.shiftleft, Column.bitwiseOR, lambda x, mask: x.bitwiseAND(F.lit(mask))
    else:
        shift, join, meet = np.left_shift, np.bitwise_or, np.bitwise_and
    for k, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = meet(join(v, shift(v, k)), mask)
    return v


def _code(x, y):
    both = _gaps(x), _gaps(y)
    return both[0].bitwiseOR(F.shiftleft(both[1], 1)) if isinstance(x, Column) else both[0] | (both[1] << 1)


def finite(points: DataFrame) -> DataFrame:
    """Points whose x and y are numbers: no other can lie in a polygon."""
    number = lambda k: F.abs(F.col(k).cast("double")) < math.inf
    return points.where(number("x") & number("y"))


def cut(points: DataFrame, share: float = 1 / 256, sample: int = 20_000) -> Tree:
    """A quadtree over points x, y: a leaf is cut in four while it holds more than ``share`` of a sample of them.

    The sample has about ``sample`` points, twice as many at most; the leaves, 64 / share at most, are all that
    comes to the driver beside it. Only their shapes depend on the sample: every point is dealt to one of them.
    A leaf that can't be cut further, such as one place that many points share, is dealt to copies.
    """
    p = finite(points).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n, west, south, east, north = p.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n:
        return Tree(0.0, 0.0, 1.0, (0,), (0,), (SIDE,), (1,))
    unit = max(east - west, north - south) / (SIDE - 1) or 1.0
    some = p.sample(min(1.0, sample / n), seed=1).limit(2 * sample).toPandas() if n > sample else p.toPandas()
    at = lambda k, start: np.clip((some[k].to_numpy() - start) // unit, 0, SIDE - 1).astype(np.int64)
    codes = np.sort(_code(at("x", west), at("y", south)))
    most, leaves, open_ = max(1.0, share * len(codes)), [], [(0, 0, SIDE)]
    while open_:
        x, y, side = open_.pop()
        start = int(_code(np.int64(x), np.int64(y)))
        held = int(np.searchsorted(codes, start + side * side) - np.searchsorted(codes, start))
        if held > most and side > 1:
            half = side // 2
            open_ += [(x + i * half, y + j * half, half) for j in (1, 0) for i in (1, 0)]
        else:
            leaves.append((x, y, side, max(1, math.ceil(held / most))))
    return Tree(west, south, unit, *zip(*leaves, strict=True))


def leaf_of(points: DataFrame, tree: Tree) -> DataFrame:
    """Points with the number of their leaf, by a binary search among the leaves' codes, and their copy."""
    code = _code(tree.place(F.col("x"), tree.west), tree.place(F.col("y"), tree.south))
    cuts = [-1.0, *map(float, tree.starts), float(SIDE * SIDE)]
    found = Bucketizer(splits=cuts, inputCol="fl_code", outputCol="fl_bucket").transform(finite(points).withColumn("fl_code", code.cast("double")))
    copies = F.get(F.array(*(F.lit(n) for n in tree.copies)), F.col("leaf")) if len(set(tree.copies)) > 1 else F.lit(tree.copies[0])
    dealt = found.withColumn("leaf", (F.col("fl_bucket") - 1).cast("int")).drop("fl_code", "fl_bucket")
    return dealt.withColumn("copy", F.pmod(F.xxhash64(*points.columns), copies).cast("int"))


def leaves_of(polygons: DataFrame, tree: Tree) -> DataFrame:
    """A row for each leaf that a polygon's ring touches or that lies in it: leaf, copy, whole, edges; no ring.

    A leaf that no edge touches lies in the polygon as a whole, and needs no edges, or has no row. Any other gets
    the edges that a ray to the right from its places can meet: those beside it or farther right in its rows.
    Within its leaf a polygon goes to the cells (fl_level, fl_cx, fl_cy) that it touches, of the smallest power of
    two that isn't below its box: four at most, so that small polygons don't meet a leaf's other points.
    """
    n = F.size("ring")
    edge = lambda k: F.struct(F.get("ring", k).alias("p"), F.get("ring", F.pmod(k + 1, n)).alias("q"))
    ends = lambda e, axis, start: [tree.place(f(e.p[axis], e.q[axis]), start) for f in (F.least, F.greatest)]
    made = polygons.where(n > 0).withColumn("fl_edges", F.transform(F.transform(F.sequence(F.lit(0), n - 1), edge), lambda e: F.struct(e.p.alias("p"), e.q.alias("q"), *(v.alias(k) for k, v in zip(("x0", "x1", "y0", "y1"), ends(e, "x", tree.west) + ends(e, "y", tree.south), strict=True)))))
    left, low, side = (np.array(v, np.int64) for v in (tree.left, tree.low, tree.side))

    @F.pandas_udf("array<int>")
    def touched(x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero((left <= b) & (left + side > a) & (low <= d) & (low + side > c)).tolist() for a, b, c, d in zip(x0, x1, y0, y1, strict=True)])

    far = lambda f, k: f(F.transform("fl_edges", lambda e: e[k]))
    box = [far(F.array_min, "x0"), far(F.array_max, "x1"), far(F.array_min, "y0"), far(F.array_max, "y1")]
    ends_of = dict(zip(("fl_x0", "fl_x1", "fl_y0", "fl_y1"), box, strict=True))
    spread = made.withColumns(ends_of).withColumn("leaf", F.explode(touched(*ends_of)))
    rows = [(i, x, y, s, s.bit_length() - 1, c) for i, (x, y, s, c) in enumerate(zip(tree.left, tree.low, tree.side, tree.copies, strict=True))]
    leaves = polygons.sparkSession.createDataFrame(rows, "leaf int, fl_x bigint, fl_y bigint, fl_side bigint, fl_top int, fl_copies int")
    at = spread.join(F.broadcast(leaves), "leaf")  # 64 / share leaves at most
    rows = F.filter("fl_edges", lambda e: (e.y1 >= F.col("fl_y")) & (e.y0 < F.col("fl_y") + F.col("fl_side")) & (e.x1 >= F.col("fl_x")))
    at = at.withColumn("edges", rows).withColumn("near", F.exists("edges", lambda e: e.x0 < F.col("fl_x") + F.col("fl_side")))
    middle = lambda k, start: F.lit(start) + (F.col(k) + F.col("fl_side") / 2) * tree.unit
    at = at.withColumn("whole", ~F.col("near") & inside(F.col("edges"), middle("fl_x", tree.west), middle("fl_y", tree.south))).where("near or whole")
    edges = F.when(F.col("near"), F.transform("edges", lambda e: F.struct(e.p.alias("p"), e.q.alias("q")))).alias("edges")
    kept = [c for c in polygons.columns if c != "ring"]
    wide = F.greatest(F.col("fl_x1") - F.col("fl_x0"), F.col("fl_y1") - F.col("fl_y0")) + 1
    level = F.least(F.ceil(F.log2(wide)).cast("int"), F.col("fl_top")).alias("fl_level")
    sized = at.select(*kept, "leaf", "whole", edges, level, "fl_copies", *(f(a, b).alias(k) for k, f, a, b in (("fl_l", F.greatest, "fl_x0", "fl_x"), ("fl_d", F.greatest, "fl_y0", "fl_y"))), *(F.least(F.col(a), F.col(b) + F.col("fl_side") - 1).alias(k) for k, a, b in (("fl_r", "fl_x1", "fl_x"), ("fl_u", "fl_y1", "fl_y"))))
    for to, a, b in (("fl_cx", "fl_l", "fl_r"), ("fl_cy", "fl_d", "fl_u")):
        sized = sized.withColumn(to, F.explode(F.expr(f"sequence(shiftright({a}, fl_level), shiftright({b}, fl_level))")))
    return sized.select(*kept, "leaf", "whole", "edges", "fl_level", "fl_cx", "fl_cy", F.explode(F.sequence(F.lit(0), F.col("fl_copies") - 1)).alias("copy"))


def _near(points: DataFrame, polygons: DataFrame, tree: Tree) -> DataFrame:
    """Pairs of a point and a polygon that share a cell of the polygon's level in a leaf, each once."""
    dealt = stored(leaves_of(polygons, tree), "leaves")
    levels = sorted(r.fl_level for r in dealt.select("fl_level").distinct().collect())  # of 17 at most
    places = {"fl_px": tree.place(F.col("x"), tree.west), "fl_py": tree.place(F.col("y"), tree.south)}
    top = F.get(F.array(*(F.lit(s.bit_length() - 1) for s in tree.side)), F.col("leaf"))
    cells = leaf_of(points, tree).withColumns(places).withColumn("fl_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).where(F.col("fl_level") <= top)
    cells = cells.withColumns({k: F.expr(f"shiftright({p}, fl_level)") for k, p in (("fl_cx", "fl_px"), ("fl_cy", "fl_py"))}).drop(*places)
    return cells.join(dealt, ["leaf", "copy", "fl_level", "fl_cx", "fl_cy"])


def points_in_polygons(points: DataFrame, polygons: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Pairs of a point (x, y) strictly inside a polygon's ring (array of x, y), with the columns of both but the ring.

    Leaves of ``tree`` (see :func:`cut`), copies of those that can't be cut, and cells in them of about the size of each
    polygon are the keys of an equi-join (a point goes to a cell of each size that polygons have, 17 at most), so that
    no key holds much more than the tree's share of the points, wherever they lie. Points on an edge are outside;
    points without a finite place and empty rings, null ones included, have no row. Points equal in all columns go to one
    copy: count them before, if many are. No column may be named leaf or copy.
    """
    tree = tree or cut(points)
    pairs = _near(points, polygons, tree).where(F.col("whole") | inside(F.col("edges"), F.col("x"), F.col("y")))
    return pairs.drop("leaf", "copy", "whole", "edges", "fl_level", "fl_cx", "fl_cy")
