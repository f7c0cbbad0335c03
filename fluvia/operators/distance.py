"""Exact distances between sets of cells of a frame, by columns and then by rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Heights that a task works on at a time (rows times columns of a band).
HEIGHTS = 2_000_000


def envelope(columns: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower envelopes of the parabolas squares[i, k] + (c - columns[k]) ** 2, for all rows i side by side.

    Returns the parabolas of each row from left to right, where each begins to be lowest, and the last one's place.
    """
    n, width = squares.shape
    at = np.arange(n)
    kept, start, top = np.zeros((n, width), np.int64), np.full((n, width), -np.inf), np.zeros(n, np.int64)
    lifted = squares + columns.astype(float) ** 2
    for k in range(1, width):
        left = kept[at, top]
        meet = (lifted[:, k] - lifted[at, left]) / (2.0 * (columns[k] - columns[left]))
        over = np.flatnonzero(meet <= start[at, top])
        while len(over):  # the first parabola starts at minus infinity and stays
            top[over] -= 1
            left = kept[over, top[over]]
            meet[over] = (lifted[over, k] - lifted[over, left]) / (2.0 * (columns[k] - columns[left]))
            over = over[meet[over] <= start[over, top[over]]]
        top += 1
        kept[at, top], start[at, top] = k, meet
    return kept, start, top


def band_distances(r: np.ndarray, c: np.ndarray, site_r: np.ndarray, site_c: np.ndarray) -> np.ndarray:
    """Distances of cells (r, c) to the nearest site: heights within columns, then lower envelopes along rows."""
    columns, column = np.unique(site_c, return_inverse=True)
    low = min(r.min(), site_r.min())
    span = int(max(r.max(), site_r.max()) - low) + 1
    known = np.sort(column.astype(np.int64) * span + (site_r - low))
    first = np.arange(len(columns), dtype=np.int64) * span
    rows, row = np.unique(r, return_inverse=True)
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(len(rows) + 1))
    out = np.empty(len(r))
    step = max(1, HEIGHTS // len(columns))
    for begin in range(0, len(rows), step):
        asked = first[None] + (rows[begin : begin + step] - low)[:, None]
        at = np.searchsorted(known, asked)
        below, above = known[np.minimum(at, len(known) - 1)], known[np.maximum(at - 1, 0)]
        height = np.where((at < len(known)) & (below // span == asked // span), below - asked, np.inf)
        height = np.minimum(height, np.where((at > 0) & (above // span == asked // span), asked - above, np.inf))
        squares = height**2
        kept, start, top = envelope(columns, squares)
        for i in range(len(asked)):
            own = order[ends[begin + i] : ends[begin + i + 1]]
            place = np.searchsorted(start[i, : top[i] + 1], c[own], side="right") - 1
            best = kept[i, place]
            out[own] = np.sqrt(squares[i, best] + (c[own] - columns[best]).astype(float) ** 2)
    return out


def nearest(cells: DataFrame, sites: DataFrame, keys: list[str], rows: int = 64) -> DataFrame:
    """Rows keys, r, c, d: for each cell the exact distance, in cells, to the nearest site of its frame.

    Repeated cells count once; cells of frames without a site, and cells or sites with a null place, have no row.
    Frames are cut into bands of ``rows`` rows. A band gets its own sites, and of each column the next site above
    and the next below it, so that no pair of a cell and a site is made, however far apart they are: what is
    shuffled are the cells, the sites, and two sites for each band and column. A task holds one band.
    """
    place = lambda x: x.select(*keys, "r", "c").dropna().distinct().withColumn("band", F.floor(F.col("r") / rows))
    x, s = place(cells), place(sites)
    wanted = x.groupBy(*keys).agg(F.collect_set("band").alias("bands"))  # one number for each band of a frame
    ends = s.groupBy(*keys, "c", "band").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    none = F.lit(None).cast(s.schema["r"].dataType)
    asked = ends.select(*keys, "c").distinct().join(wanted, keys).select(*keys, "c", F.explode("bands").alias("band"), none.alias("low"), none.alias("high"), F.lit(True).alias("asked"))
    column = Window.partitionBy(*keys, "c")
    # Both frames run forwards, one of them from the far end: a frame up to the last row is read anew for each row.
    before = lambda order: column.orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    carried = asked.union(ends.select(*keys, "c", "band", "low", "high", F.lit(False))).select(*keys, "c", "band", "asked", F.max("high").over(before(F.asc("band"))).alias("above"), F.min("low").over(before(F.desc("band"))).alias("below"))
    far = carried.where("asked").select(*keys, F.explode(F.array("above", "below")).alias("r"), "c", "band").where("r is not null")
    every = x.withColumn("site", F.lit(False)).union(s.union(far.select(*s.columns)).withColumn("site", F.lit(True)))
    kinds = T.StructType([*x.select(*keys, "r", "c").schema.fields, T.StructField("d", T.DoubleType())])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        site = part["site"].to_numpy(bool)
        own, other = part.loc[~site, [*keys, "r", "c"]], part.loc[site]
        if own.empty or other.empty:
            return own.iloc[:0].assign(d=np.empty(0))
        return own.assign(d=band_distances(*(f[k].to_numpy(np.int64) for f in (own, other) for k in ("r", "c"))))

    return every.groupBy(*keys, "band").applyInPandas(one, kinds)
