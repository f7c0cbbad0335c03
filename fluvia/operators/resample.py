"""Resampling between lattices: each target pixel looks up its place in the source, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells on a side of the source's blocks.
BLOCK = 256


def lattice_pixels(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Rows keys, r, c, x, y: the pixels of tiles (keys, origin_x, origin_y, pixel, height, width) with their
    centres; the origin is the north-west corner."""
    rows = tiles.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return rows.select(*keys, "r", "c", (F.col("origin_x") + (F.col("c") + 0.5) * F.col("pixel")).alias("x"), (F.col("origin_y") - (F.col("r") + 0.5) * F.col("pixel")).alias("y"))


def place_in(x: Column, y: Column, origin_x: Column, origin_y: Column, pixel: Column) -> tuple[Column, Column]:
    """Row and column of a place in a lattice, whole numbers at the centres of its cells. ``x`` and ``y`` are in the
    lattice's own units: a projected target's are projected back first."""
    return (origin_y - y) / pixel - 0.5, (x - origin_x) / pixel - 0.5


def bilinear(grid: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Values between the four cells around each place, NaN cells left out and the others' weights made 1 in sum;
    NaN where no cell with a weight has a value. ``grid`` reaches one cell beyond every place."""
    i, j = np.floor(r).astype(np.int64), np.floor(c).astype(np.int64)
    u, v = r - i, c - j
    total, weight = np.zeros(len(r)), np.zeros(len(r))
    for di, wr in ((0, 1 - u), (1, u)):
        for dj, wc in ((0, 1 - v), (1, v)):
            value, w = grid[i + di, j + dj], wr * wc
            there = ~np.isnan(value) & (w > 0)
            total += np.where(there, w * np.nan_to_num(value), 0.0)
            weight += np.where(there, w, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight > 0, total / weight, np.nan)


def resampled(source: DataFrame, target: DataFrame, keys: list[str], smooth: list[str], nearest: list[str], block: int = BLOCK) -> DataFrame:
    """``target`` (keys, sr, sc and others) without sr and sc, with the columns of ``source`` (keys, r, c and values) at
    row sr and column sc: ``smooth`` ones bilinear (doubles), ``nearest`` ones of the nearest cell (halves go
    to the larger number), null where the source has none.

    Both sides are dealt to blocks of the source by one shuffle each; a source cell also goes to the block
    before it if that one ends beside it. A task holds one block and the targets in it: about as many as its cells,
    unless the target is finer.
    """
    names = [c for c in target.columns if c not in ("sr", "sc")]
    base = lambda k: F.floor(F.col(k))
    asked = target.withColumns({"fl_br": F.floor(base("sr") / block), "fl_bc": F.floor(base("sc") / block)})
    both = lambda k: F.array_distinct(F.array(F.floor(F.col(k) / block), F.floor((F.col(k) - 1) / block)))
    cells = source.select(*keys, "r", "c", *(F.col(c).cast("double").alias(c) for c in (*smooth, *nearest)), F.explode(both("r")).alias("fl_br")).withColumn("fl_bc", F.explode(both("c")))
    kinds = [*(target.schema[c] for c in names), *(T.StructField(c, T.DoubleType()) for c in (*smooth, *nearest))]

    def run(asked: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame()
        top, left = int(asked["fl_br"].iloc[0]) * block, int(asked["fl_bc"].iloc[0]) * block
        r, c = asked["sr"].to_numpy() - top, asked["sc"].to_numpy() - left
        out = pd.DataFrame({n: asked[n] if asked[n].dtype.kind in "biuf" else asked[n].astype(object) for n in names})
        for name in (*smooth, *nearest):
            grid = np.full((block + 1, block + 1), np.nan)
            if len(cells):
                grid[cells["r"].to_numpy() - top, cells["c"].to_numpy() - left] = cells[name].to_numpy()
            out[name] = bilinear(grid, r, c) if name in smooth else grid[np.floor(r + 0.5).astype(int), np.floor(c + 0.5).astype(int)]
        return out

    by = [*keys, "fl_br", "fl_bc"]
    got = asked.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(run, T.StructType(kinds))
    return got.select(*names, *(F.nanvl(F.col(c), F.lit(None)).alias(c) for c in smooth), *(F.nanvl(F.col(c), F.lit(None)).cast(source.schema[c].dataType).alias(c) for c in nearest))
