"""Operators on frames of cells (frame key, r, c): stencils on blocks, morphology, components, blending."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.operators.distance import nearest
from fluvia.storage import shared_out, stored

#: A cell's number is r * ROW + c: columns are numbers from 0 to ROW - 2, so that neighbours' numbers can't meet.
ROW = 1_000_000
#: Cells on a side of the blocks that stencils work on.
BLOCK = 256
SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def spread(cells: DataFrame, keys: list[str], value: str, steps: list[tuple[int, int]]) -> DataFrame:
    """Each cell's value sent to the cells ``steps`` away: one shuffle on the target cell, no self-join."""
    sent = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    return cells.select(*keys, "r", "c", F.col(value).alias("value"), sent).select(*keys, (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"), "value", "s.i", "s.j")


def by_blocks(cells: DataFrame, keys: list[str], columns: list[str], halo: int, run, out: str, block: int = BLOCK) -> DataFrame:
    """A stencil on arrays: rows keys, r, c and ``out`` (names and types) for each cell.

    Frames are cut into blocks. A cell goes to its block, and to the blocks beside it only if it lies
    within ``halo`` of their border, so that little more than the cells themselves is shuffled, once.
    ``run`` gets arrays of the block's cells and what lies within ``halo`` of them: row and column numbers, whether a cell is there, and the
    columns as doubles (NaN: missing); it returns the arrays of ``out``.
    """
    of = lambda k: F.sequence(F.floor((F.col(k) - halo) / block), F.floor((F.col(k) + halo) / block))
    values = [F.col(c).cast("double").alias(c) for c in columns]
    dealt = cells.select(*keys, "r", "c", *values, F.explode(of("r")).alias("br")).select("*", F.explode(of("c")).alias("bc"))
    made = [x.split() for x in out.split(", ")]
    kinds = [*(cells.schema[k] for k in (*keys, "r", "c")), *(T.StructField(n, {"int": T.IntegerType(), "double": T.DoubleType()}[kind]) for n, kind in made)]

    def one(part: pa.Table) -> pa.Table:
        r, c = part["r"].to_numpy(), part["c"].to_numpy()
        first = [int(part[k][0].as_py()) * block for k in ("br", "bc")]
        own = (r >= first[0]) & (r < first[0] + block) & (c >= first[1]) & (c < first[1] + block)
        top, left = int(r.min()) - halo, int(c.min()) - halo
        r, c = r - top, c - left
        shape = int(r.max()) + halo + 1, int(c.max()) + halo + 1
        there = np.zeros(shape, bool)
        there[r, c] = True
        arrays = []
        for name in columns:
            array = np.full(shape, np.nan)
            array[r, c] = part[name].to_numpy()
            arrays.append(array)
        got = run(np.arange(top, top + shape[0]), np.arange(left, left + shape[1]), there, *arrays)
        rows = part.select([*keys, "r", "c"]).filter(pa.array(own))
        for (n, kind), g in zip(made, got, strict=True):
            rows = rows.append_column(n, pa.array(g[r[own], c[own]], {"int": pa.int32(), "double": pa.float64()}[kind], from_pandas=True))
        return rows

    return shared_out(dealt, *keys, "br", "bc").groupBy(*keys, "br", "bc").applyInArrow(one, T.StructType(kinds))


def _wider(on: np.ndarray, k: int) -> np.ndarray:
    """Cells within ``k`` steps of the 4-neighbour cross."""
    for _ in range(k):
        more = on.copy()
        more[1:] |= on[:-1]
        more[:-1] |= on[1:]
        more[:, 1:] |= on[:, :-1]
        more[:, :-1] |= on[:, 1:]
        on = more
    return on


def dilate(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Cells of the frame within k steps of a cell that is on, as d. cells: keys, r, c, m (0/1)."""
    return by_blocks(cells, keys, ["m"], k, lambda r, c, there, m: [_wider(m == 1, k).astype(int)], "d int")


def erode(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Cells with no cell off within k steps, as e; what lies outside the frame counts as on."""
    return by_blocks(cells, keys, ["m"], k, lambda r, c, there, m: [1 - _wider(m == 0, k).astype(int)], "e int")


def bank_band(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Cells within k steps of the border between on and off: dilated (d) and not eroded (e)."""

    def run(r, c, there, m):
        d, e = _wider(m == 1, k), ~_wider(m == 0, k)
        return [d.astype(int), e.astype(int), (d & ~e).astype(int)]

    return by_blocks(cells, keys, ["m"], k, run, "d int, e int, band int")


def boundary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that are on and have a neighbour that is off inside the frame."""
    return by_blocks(cells, keys, ["m"], 1, lambda r, c, there, m: [((m == 1) & _wider(m == 0, 1)).astype(int)], "edge int").where("edge = 1").drop("edge")


def displacement(a: DataFrame, b: DataFrame, keys: list[str], resolution: float, rows: int = 64) -> DataFrame:
    """The mean of the two mean distances between boundaries a and b of a frame, in metres.

    Frames without a boundary on either side have no row. Distances are exact, however far the boundaries are
    apart (see :func:`fluvia.operators.distance.nearest`); frames are cut into bands of ``rows`` rows.
    """
    mean = lambda x, y, name: nearest(x, y, keys, rows).groupBy(*keys).agg(F.avg("d").alias(name))
    metres = F.round((F.col("ab") + F.col("ba")) / 2 * resolution, 4)
    return mean(a, b, "ab").join(mean(b, a, "ba"), keys).withColumn("metres", metres).drop("ab", "ba")


def median3(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """3 x 3 median, the border repeated; missing cells take the frame's median before and stay missing after."""
    middle = cells.groupBy(*keys).agg(F.median("v").alias("middle"))
    filled = cells.join(middle, keys).withColumn("filled", F.coalesce("v", "middle"))

    def run(r, c, there, x):
        near = lambda at, n, i: np.clip(np.clip(at + i, 0, n - 1) - at[0], 0, len(at) - 1)
        every = np.stack([x[near(r, height, i)][:, near(c, width, j)] for i, j in SQUARE])
        n = (~np.isnan(every)).sum(axis=0)
        every.sort(axis=0)  # missing ones last
        low, high = (np.take_along_axis(every, np.clip(k, 0, 8)[None], axis=0)[0] for k in ((n - 1) // 2, n // 2))
        return [(low + high) / 2]

    smooth = by_blocks(filled, keys, ["filled"], 1, run, "smooth double")
    return cells.join(smooth, [*keys, "r", "c"]).withColumn("smooth", F.when(F.col("v").isNotNull(), F.col("smooth")))


def sobel(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Horizontal and vertical Sobel gradients, gx and gy; cells outside count as 0."""

    def run(r, c, there, x):
        x = np.pad(np.nan_to_num(x), 1)
        across, down = x[:, 2:] - x[:, :-2], x[2:] - x[:-2]
        return [np.round(across[:-2] + 2 * across[1:-1] + across[2:], 6) + 0.0, np.round(down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:], 6) + 0.0]

    return by_blocks(cells, keys, [value], 1, run, "gx double, gy double")


def weighted_bce(rows: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """Mean binary cross-entropy of logit x and truth y (0/1) over valid rows, positives weighted."""
    soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    loss = weight * F.col("y") * soft(-F.col("x")) + (1 - F.col("y")) * soft(F.col("x"))
    return rows.where("valid").groupBy(*keys).agg(F.round(F.avg(loss), 6).alias("loss"))


def gradient_loss(cells: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    """Mean difference of the Sobel gradients of forecast and truth (prob, truth, valid): both directions and the
    magnitude, over the cells whose whole 3 x 3 neighbourhood is valid; beyond the frame counts as valid."""
    at = [*keys, "r", "c"]
    p = sobel(cells, keys, "prob").withColumnsRenamed({"gx": "px", "gy": "py"})
    t = sobel(cells, keys, "truth").withColumnsRenamed({"gx": "tx", "gy": "ty"})

    def odd(r, c, there, valid):
        bad = valid == 0
        bad[:, 1:] |= (valid == 0)[:, :-1]
        bad[:, :-1] |= (valid == 0)[:, 1:]
        rows = bad.copy()
        bad[1:] |= rows[:-1]
        bad[:-1] |= rows[1:]
        return [bad.astype(int)]

    near = by_blocks(cells, keys, ["valid"], 1, odd, "bad int")
    both = cells.select(*at).join(p, at).join(t, at).join(near, at, "left")
    size = lambda x, y: F.sqrt(F.col(x) ** 2 + F.col(y) ** 2 + eps)
    diff = F.abs(F.col("px") - F.col("tx")) + F.abs(F.col("py") - F.col("ty")) + F.abs(size("px", "py") - size("tx", "ty"))
    whole = F.coalesce("bad", F.lit(0)) == 0
    return both.groupBy(*keys).agg(F.round(F.coalesce(F.sum(F.when(whole, diff)), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(whole)), 6).alias("grad"))


def forecast_loss(cells: DataFrame, keys: list[str], weight: float, share: float = 0.3) -> DataFrame:
    """The loss of forecasts x (logits) against truth over valid cells: weighted cross-entropy and ``share`` times the gradient loss."""
    bce = weighted_bce(cells.withColumn("y", F.col("truth")), keys, weight).withColumnRenamed("loss", "bce")
    grad = gradient_loss(cells.withColumn("prob", 1 / (1 + F.exp(-F.col("x")))), keys)
    return bce.join(grad, keys).withColumn("loss", F.round(F.col("bce") + share * F.col("grad"), 5))


def displacement_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median displacement (metres) over frames; frames without a bank have none and don't count."""
    return frames.groupBy(*keys).agg(F.round(F.avg("metres"), 4).alias("mean_m"), F.round(F.median("metres"), 4).alias("median_m"), F.count("metres").alias("n"))


def crop_starts(frames: DataFrame, size: int) -> DataFrame:
    """Frames (height, width) with the starts r0, c0 of crops that don't overlap; a frame below the size has one at 0."""
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - size), F.lit(size))
    return frames.withColumn("r0", F.explode(starts("height"))).withColumn("c0", F.explode(starts("width")))


def block_labels(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each cell the smallest number (see :data:`ROW`) of the cells that it reaches over neighbours, within these cells."""
    if len(c) and not 0 <= c.min() <= c.max() < ROW - 1:
        raise ValueError(f"columns must be numbers from 0 to {ROW - 2}")
    number = r.astype(np.int64) * ROW + c
    order = np.argsort(number)
    known = number[order]
    a, b = [], []
    for step in (1, ROW - 1, ROW, ROW + 1):
        at = np.searchsorted(known, known + step)
        hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == known + step))
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(known))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    out = np.empty(len(number), np.int64)
    out[order] = known[label]
    return out


def joined_labels(links: DataFrame, keys: list[str]) -> DataFrame:
    """Rows keys, zone, least: for each linked label (u, v within keys) the smallest that it reaches.

    Alternating large and small stars: each round points every label at a smaller one, until each
    component is one star, however long its way is. Rounds are written to the shared folder.
    """
    e = stored(links.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct(), "links")
    seen = None
    while True:
        both = e.union(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, [*keys, "u"]).select(*keys, F.col("m").alias("u"), "v").where("u != v").distinct()
        low = large.groupBy(*keys, "v").agg(F.min("u").alias("m"))
        e = stored(large.join(low, [*keys, "v"]).select(*keys, F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u != v").distinct(), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            return e.select(*keys, F.col("v").alias("zone"), F.col("u").alias("least"))
        seen = now


def components(cells: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """8-connected components of cells: the smallest cell number of each (see :data:`ROW`), as ``zone``.

    Cells are labelled within blocks, arrays in one task each; only labels that meet at the blocks'
    borders become links, and only those are joined over rounds. There is no limit on rounds or on a
    component's length. Repeated cells count once.
    """
    at = lambda k: F.floor(F.col(k) / block)
    once = cells.select(*keys, "r", "c").distinct()
    kinds = [*once.schema.fields, T.StructField("zone", T.LongType())]

    def label(part: pd.DataFrame) -> pd.DataFrame:
        return part[[*keys, "r", "c"]].assign(zone=block_labels(part["r"].to_numpy(), part["c"].to_numpy()))

    local = stored(once.withColumn("br", at("r")).withColumn("bc", at("c")).groupBy(*keys, "br", "bc").applyInPandas(label, T.StructType(kinds)), "labels")
    edge = lambda k: F.pmod(F.col(k), F.lit(block)).isin(0, block - 1)
    border = local.where(edge("r") | edge("c"))
    met = spread(border, keys, "zone", SQUARE).join(border, [*keys, "r", "c"]).where("value < zone").select(*keys, F.col("value").alias("u"), F.col("zone").alias("v"))
    return local.join(joined_labels(met, keys), [*keys, "zone"], "left").select(*keys, "r", "c", F.coalesce("least", "zone").alias("zone"))


def hann(k, size: int):
    """Taper of a window of ``size`` cells, at least 0.001."""
    return F.greatest(F.lit(1e-3), 0.5 - 0.5 * F.cos(2 * 3.141592653589793 * k / (size - 1)))


def window_starts(length: int, size: int, step: int) -> list[int]:
    """Starts of overlapping windows; the last one ends at the edge."""
    out = list(range(0, max(1, length - size + 1), step))
    return out if out[-1] + size >= length else [*out, length - size]


def blend(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping predictions p with weights w: their weighted mean."""
    return parts.groupBy(*keys, "r", "c").agg((F.sum(F.col("p") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("p"))
