"""Rings of zones: the sides of their cells, put together to closed lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fluvia.operators.spatial import outline

#: For each side of a cell (r, c) its ends as steps from (c, r): walked so, the zone lies to the right (y grows downwards).
ENDS = {"n": ((0, 0), (1, 0)), "e": ((1, 0), (1, 1)), "s": ((1, 1), (0, 1)), "w": ((0, 1), (0, 0))}


def closed(sides: list[tuple[int, int, str]]) -> list[list[tuple[int, int]]]:
    """The closed lines of sides (r, c, side), as corners (x, y) without those on a straight line.

    Where two cells of a zone touch at a corner only, the line goes on from one to the other, so that what is
    connected over corners gets one outer ring. Holes run the other way round than outer rings.
    """
    out: dict[tuple[int, int], dict[tuple[int, int], None]] = {}
    for r, c, side in sorted(sides):
        (a, b), (x, y) = ENDS[side]
        out.setdefault((c + a, r + b), {})[(c + x, r + y)] = None
    rings = []
    while out:
        start = next(iter(out))
        line, at = [start], start
        while True:
            if len(line) > 1:
                dx, dy = at[0] - line[-2][0], at[1] - line[-2][1]
                left = (at[0] + dy, at[1] - dx)
                to = left if left in out[at] else next(iter(out[at]))
            else:
                to = next(iter(out[at]))
            del out[at][to]
            if not out[at]:
                del out[at]
            if to == start and not (to in out and _turns_left(at, to, out[to])):
                break
            line.append(to)
            at = to
        n = len(line)
        straight = [(line[k][0] - line[k - 1][0], line[k][1] - line[k - 1][1]) == (line[(k + 1) % n][0] - line[k][0], line[(k + 1) % n][1] - line[k][1]) for k in range(n)]
        rings.append([p for p, s in zip(line, straight, strict=True) if not s])
    return rings


def _turns_left(a: tuple[int, int], b: tuple[int, int], ways: dict) -> bool:
    dx, dy = b[0] - a[0], b[1] - a[1]
    return (b[0] + dy, b[1] - dx) in ways


def signed_area(ring: list[tuple[int, int]]) -> float:
    """In cells: above 0 for an outer ring, below for a hole."""
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def zone_rings(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows keys, ring (a number), area (in cells, holes below 0) and corners for each closed line of each zone.

    Only sides on a zone's border come to the zone's task: as many as its perimeter, not its area.
    """
    sides = outline(cells, keys)
    corner = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    kinds = [*(sides.schema[k] for k in keys), T.StructField("ring", T.IntegerType()), T.StructField("area", T.DoubleType()), T.StructField("corners", T.ArrayType(corner))]

    def trace(part: pd.DataFrame) -> pd.DataFrame:
        rings = closed(list(zip(part["r"].tolist(), part["c"].tolist(), part["side"].tolist(), strict=True)))
        rows = [(*part[keys].iloc[0].tolist(), k, signed_area(ring), [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring in enumerate(rings)]
        return pd.DataFrame(rows, columns=[*keys, "ring", "area", "corners"])

    return sides.groupBy(*keys).applyInPandas(trace, T.StructType(kinds))
