"""Inference of a forecaster with split space-time attention, with given weights, over blocks of patches.

A row is a frame's block of patches. Attention over time groups the frames of a block (as many as the model takes),
attention over space sends the keys and values of a frame's blocks to each of its blocks, where they are taken in one
after the other with a running maximum and sum. Windows, frames and blocks are all shared out, but a frame of few blocks
(TOGETHER) is one group over space; no group holds more than one frame's vectors, whose number the model fixes. Each
layer costs two shuffles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.operators.forecast import convolved, gelu, logistic, normalized, resized
from fluvia.storage import shared_out, stored

#: Patches of a block.
BLOCK = 64
#: Blocks of a frame that a group takes together over space: small groups are dear.
TOGETHER = 8


def linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return x @ weight.T + bias


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Vectors (last axis) with mean 0 and variance 1, then scaled and shifted."""
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + eps) * scale + shift


def split_heads(x: np.ndarray, heads: int) -> np.ndarray:
    """(..., n, d) as (..., heads, n, d / heads)."""
    return np.moveaxis(x.reshape(*x.shape[:-1], heads, -1), -2, -3)


def attend(q: np.ndarray, blocks, heads: int) -> np.ndarray:
    """Softmax-weighted values for queries (..., n, d), keys and values taken block by block: what was summed before
    is rescaled whenever a larger score comes."""
    q = split_heads(q, heads) / np.sqrt(q.shape[-1] / heads)
    most, total, out = np.full((*q.shape[:-1], 1), -np.inf), 0.0, np.zeros(q.shape)
    for k, v in blocks:
        s = q @ np.swapaxes(split_heads(k, heads), -1, -2)
        larger = np.maximum(most, s.max(axis=-1, keepdims=True))
        kept, w = np.exp(most - larger), np.exp(s - larger)
        most, total, out = larger, total * kept + w.sum(axis=-1, keepdims=True), out * kept + w @ split_heads(v, heads)
    joined = np.moveaxis(out / total, -3, -2)
    return joined.reshape(*joined.shape[:-2], -1)


def over_time(x: np.ndarray, layer: dict, heads: int) -> np.ndarray:
    """Vectors (t, n, d) after each place has attended over its own frames."""
    q, k, v = np.split(linear(layer_norm(np.swapaxes(x, 0, 1), *layer["norm_time"]), *layer["qkv_time"]), 3, axis=-1)
    seen = linear(linear(attend(q, [(k, v)], heads), *layer["out_time"]), *layer["proj_time"])
    return x + np.swapaxes(seen, 0, 1)


def fed_forward(x: np.ndarray, layer: dict) -> np.ndarray:
    """A layer without a feed-forward part ends with its attention."""
    return x + linear(gelu(linear(layer_norm(x, *layer["norm_wide"]), *layer["wide"])), *layer["narrow"]) if "wide" in layer else x


def decoded(x: np.ndarray, weights: dict) -> np.ndarray:
    """Logits (side, side) of a grid (d, g, g): each stage doubles the grid by repetition, convolves and normalises."""
    for kernel, bias, scale, shift in weights["decoder"]:
        x = convolved(x.repeat(2, axis=1).repeat(2, axis=2), kernel, bias)
        x = gelu(normalized(x, min(8, len(x)), scale, shift))
    return convolved(x, *weights["outer"])[0]


class Shape:
    """What the model takes: ``steps`` frames of ``size`` by ``size`` cells in patches of ``patch`` by ``patch``."""

    def __init__(self, steps: int, size: int, patch: int, heads: int, block: int = BLOCK):
        if size % patch:
            raise ValueError(f"{size} cells can't be cut into patches of {patch}")
        self.steps, self.size, self.patch, self.heads, self.block = steps, size, patch, heads, block
        self.grid = size // patch
        self.places = self.grid**2
        self.blocks = -(-self.places // block)


def _kinds(keys: list[T.StructField], *columns: str) -> T.StructType:
    kinds = {"t": T.IntegerType(), "b": T.IntegerType(), "r": T.IntegerType(), "c": T.IntegerType(), "prob": T.DoubleType()}
    return T.StructType([*keys, *(T.StructField(c, kinds.get(c, T.ArrayType(T.DoubleType()))) for c in columns)])


def _vectors(cells: DataFrame, keys: list[T.StructField], shape: Shape, shared) -> DataFrame:
    """Rows keys, t, b, x: the patches' vectors (flattened) with those of their place and frame added."""
    names = [k.name for k in keys]
    side, patch = F.lit(shape.grid), F.lit(shape.patch)
    inside = F.col("t").between(0, shape.steps - 1) & F.col("r").between(0, shape.size - 1) & F.col("c").between(0, shape.size - 1)
    checked = F.when(inside, F.col("t")).otherwise(F.raise_error(F.lit(f"cells lie in {shape.steps} frames of {shape.size} by {shape.size}")).cast("int"))
    place = F.floor(F.col("r") / patch) * side + F.floor(F.col("c") / patch)
    cell = F.col("r") % patch * patch + F.col("c") % patch
    known = cells.select(*names, F.floor(place / shape.block).cast("int").alias("b"), checked.cast("int").alias("t"), (place % shape.block).cast("int").alias("n"), cell.cast("int").alias("cell"), F.col("v").cast("double").alias("v"))
    every = cells.select(*names).distinct().select(*names, F.explode(F.sequence(F.lit(0), F.lit(shape.blocks - 1))).alias("b"))

    def embed(part: pd.DataFrame) -> pd.DataFrame:
        weights, b = shared.value, int(part["b"].iloc[0])
        n = min(shape.block, shape.places - b * shape.block)
        seen = np.full((shape.steps, n, shape.patch**2), -np.inf)
        part = part[part["t"].notna()]
        np.maximum.at(seen, tuple(part[c].to_numpy(dtype=int) for c in ("t", "n", "cell")), part["v"].fillna(0.0).to_numpy())
        places = weights["place"]
        if len(places) != shape.places:  # made for another grid
            old = int(len(places) ** 0.5)
            places = resized(places.reshape(old, old, -1), shape.grid).reshape(shape.places, -1)
        at = places[b * shape.block :][:n]
        x = linear(np.where(np.isinf(seen), 0.0, seen), *weights["embed"]) + at + weights["time"][:, None]
        return pd.DataFrame({"t": range(shape.steps), "b": b, "x": list(x.reshape(shape.steps, -1))})

    return _by_group(known.unionByName(every, allowMissingColumns=True), keys, ["b"], embed, ["t", "b", "x"])


def _by_group(rows: DataFrame, keys: list[T.StructField], by: list[str], f, columns: list[str]) -> DataFrame:
    names = [k.name for k in keys]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        made = f(part)
        for k in names:
            made[k] = [part[k].iloc[0]] * len(made)
        return made[[*names, *columns]]

    return shared_out(rows, *names, *by).groupBy(*names, *by).applyInPandas(run, _kinds(keys, *columns))


def _layer(rows: DataFrame, keys: list[T.StructField], shape: Shape, shared, depth: int) -> DataFrame:
    names = [k.name for k in keys]

    def time(part: pd.DataFrame) -> pd.DataFrame:
        layer, part = shared.value["layers"][depth], part.sort_values("t")
        width = len(layer["out_time"][1])
        x = over_time(np.stack(part["x"]).reshape(len(part), -1, width), layer, shape.heads)
        sides = np.split(linear(layer_norm(x, *layer["norm_space"]), *layer["qkv_space"]), 3, axis=-1)
        flat = {c: list(a.reshape(len(part), -1)) for c, a in zip("xqkv", (x, *sides), strict=True)}
        return pd.DataFrame({"t": part["t"].to_numpy(), "b": part["b"].to_numpy(), **flat})

    sides = _by_group(rows, keys, ["b"], time, ["t", "b", *"xqkv"])

    def frame(part: pd.DataFrame) -> pd.DataFrame:
        layer = shared.value["layers"][depth]
        x, q, k, v = ([a.reshape(-1, len(layer["out_space"][1])) for a in part[c]] for c in "xqkv")
        seen = [linear(attend(own, zip(k, v, strict=True), shape.heads), *layer["out_space"]) for own in q]
        return pd.DataFrame({"t": part["t"].to_numpy(), "b": part["b"].to_numpy(), "x": [fed_forward(a + y, layer).ravel() for a, y in zip(x, seen, strict=True)]})

    if shape.blocks <= TOGETHER:
        return _by_group(sides, keys, ["t"], frame, ["t", "b", "x"])
    sides = stored(sides, "sides")

    def space(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        layer, heads = shared.value["layers"][depth], shape.heads
        width = len(layer["out_space"][1])
        x, q = (own[c].iloc[0].reshape(-1, width) for c in "xq")
        blocks = ((k.reshape(-1, width), v.reshape(-1, width)) for k, v in zip(others["k"], others["v"], strict=True))
        x = fed_forward(x + linear(attend(q, blocks, heads), *layer["out_space"]), layer)
        return own[[*names, "t", "b"]].assign(x=[x.ravel()])

    sent = sides.select(*names, "t", F.explode(F.sequence(F.lit(0), F.lit(shape.blocks - 1))).alias("b"), F.col("b").alias("source"), "k", "v")
    own = sides.select(*names, "t", "b", "x", "q").groupBy(*names, "t", "b")
    return own.cogroup(sent.groupBy(*names, "t", "b")).applyInPandas(space, _kinds(keys, "t", "b", "x"))


def _encoded(cells: DataFrame, keys: list[str], weights: dict, shape: Shape):
    inner = cells.select(*(F.col(k).alias(f"fl_key{i}") for i, k in enumerate(keys)), "t", "r", "c", "v")
    kinds = [T.StructField(f"fl_key{i}", cells.schema[k].dataType) for i, k in enumerate(keys)]
    shared = cells.sparkSession.sparkContext.broadcast(weights)
    rows = _vectors(inner, kinds, shape, shared)
    for depth in range(len(weights["layers"])):
        rows = _layer(rows, kinds, shape, shared, depth)
    return rows, kinds, shared


def encoded(cells: DataFrame, keys: list[str], weights: dict, shape: Shape) -> DataFrame:
    """Rows keys, t, place, x: the vector of each frame's patch after all layers.

    cells: keys, t, r, c, v, numbered from 0. Cells or frames that are missing, and nulls, count as 0; of a repeated
    cell the largest value counts; cells outside the model's frames are refused. Keys may be null.
    weights: embed, layers (norm_time, qkv_time, out_time, proj_time, norm_space, qkv_space, out_space and, with a
    feed-forward part, norm_wide, wide, narrow: matrix and bias, or scale and shift), place and time (vectors that are
    added; those of places are resized if their grid is another).
    """
    rows, kinds, _ = _encoded(cells, keys, weights, shape)
    width = weights["time"].shape[1]
    vectors = F.transform(F.sequence(F.lit(0), (F.size("x") / width - 1).cast("int")), lambda i: F.slice("x", (i * width + 1).cast("int"), width))
    named = [F.col(k.name).alias(name) for k, name in zip(kinds, keys, strict=True)]
    return rows.select(*named, "t", "b", F.posexplode(vectors).alias("n", "x")).select(*keys, "t", (F.col("b") * shape.block + F.col("n")).alias("place"), "x")


def attention_forecast(cells: DataFrame, keys: list[str], weights: dict, shape: Shape) -> DataFrame:
    """Rows keys, h, r, c, prob: the probability of each cell in the frames ahead, h from 1.

    cells and weights as in ``encoded``, and norm, ahead (frames to frames ahead), decoder (kernels, bias, scale, shift
    for each doubling, log2 of the patch's side in number) and outer (kernels, bias).
    """
    if 2 ** len(weights["decoder"]) != shape.patch:
        raise ValueError(f"{len(weights['decoder'])} doublings don't make patches of {shape.patch}")
    rows, kinds, shared = _encoded(cells, keys, weights, shape)

    def ahead(part: pd.DataFrame) -> pd.DataFrame:
        w, part = shared.value, part.sort_values("t")
        x = layer_norm(np.stack(part["x"]).reshape(len(part), -1, w["time"].shape[1]), *w["norm"])
        y = np.einsum("ht,tnd->hnd", w["ahead"][0], x) + w["ahead"][1][:, None, None]
        return pd.DataFrame({"t": range(1, len(y) + 1), "b": part["b"].iloc[0], "x": list(y.reshape(len(y), -1))})

    def image(part: pd.DataFrame) -> pd.DataFrame:
        w, part = shared.value, part.sort_values("b")
        x = np.concatenate(list(part["x"])).reshape(shape.grid, shape.grid, -1)
        prob = logistic(decoded(np.moveaxis(x, -1, 0), w))
        r, c = (i.ravel() for i in np.indices(prob.shape))
        return pd.DataFrame({"t": part["t"].iloc[0], "r": r, "c": c, "prob": prob.ravel()})

    frames = _by_group(_by_group(rows, kinds, ["b"], ahead, ["t", "b", "x"]), kinds, ["t"], image, ["t", "r", "c", "prob"])
    return frames.select(*(F.col(k.name).alias(name) for k, name in zip(kinds, keys, strict=True)), F.col("t").alias("h"), "r", "c", "prob")
