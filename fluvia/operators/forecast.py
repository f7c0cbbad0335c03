"""Inference of a recurrent convolutional forecaster with given weights, one window at a time, on arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def convolved(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Channels (c, h, w) under kernels (out, c, k, k), zeros around: (out, h, w)."""
    k = weight.shape[-1]
    wide = np.pad(x, ((0, 0), (k // 2, k // 2), (k // 2, k // 2)))
    h, w = x.shape[1:]
    out = np.repeat(bias.astype(float), h * w).reshape(-1, h, w)
    for i in range(k):
        for j in range(k):
            out += np.tensordot(weight[:, :, i, j], wide[:, i : i + h, j : j + w], axes=1)
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def remembered(frames: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The top layer's state after all frames (t, c, h, w). Layers: kernels and biases of the four gates (input,
    forget, output, candidate), over a layer's input and its own last state together."""
    states: list = [None] * len(layers)
    for frame in frames:
        x = frame
        for depth, (weight, bias) in enumerate(layers):
            width = len(bias) // 4
            hidden, cell = states[depth] or (np.zeros((width, *x.shape[1:])),) * 2
            gate = convolved(np.concatenate([x, hidden]), weight, bias).reshape(4, width, *x.shape[1:])
            cell = logistic(gate[1]) * cell + logistic(gate[0]) * np.tanh(gate[3])
            x = logistic(gate[2]) * np.tanh(cell)
            states[depth] = (x, cell)
    return x


def normalized(x: np.ndarray, groups: int, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Channels with mean 0 and variance 1 within each group, then scaled and shifted."""
    by = x.reshape(groups, -1)
    by = (by - by.mean(axis=1, keepdims=True)) / np.sqrt(by.var(axis=1, keepdims=True) + eps)
    return by.reshape(x.shape) * scale[:, None, None] + shift[:, None, None]


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def logits(frames: np.ndarray, weights: dict) -> np.ndarray:
    """Logits (steps ahead, h, w) of frames (t, c, h, w). weights: layers, inner and outer (kernels, biases) of the
    head, norm (scale, shift)."""
    x = convolved(remembered(frames, weights["layers"]), *weights["inner"])
    return convolved(gelu(normalized(x, min(8, len(x)), *weights["norm"])), *weights["outer"])


def recurrent_forecast(cells: DataFrame, keys: list[str], weights: dict, steps: int) -> DataFrame:
    """Rows keys, h, r, c, prob of the steps ahead of each window (keys, t, r, c, v: a gap-free array; missing values
    count as 0). A window of another number of frames than ``steps`` is refused. Weights are broadcast."""
    shared = cells.sparkSession.sparkContext.broadcast(weights)
    kinds = [*(cells.schema[k] for k in keys), *(T.StructField(n, k) for n, k in (("h", T.IntegerType()), ("r", T.IntegerType()), ("c", T.IntegerType()), ("prob", T.DoubleType())))]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        t, r, c = (np.unique(part[k], return_inverse=True) for k in ("t", "r", "c"))
        if len(t[0]) != steps:
            raise ValueError(f"{steps} frames are needed, not {len(t[0])}")
        frames = np.zeros((steps, 1, len(r[0]), len(c[0])))
        frames[t[1], 0, r[1], c[1]] = part["v"].fillna(0.0)
        prob = logistic(logits(frames, shared.value))
        h, i, j = (x.ravel() for x in np.indices(prob.shape))
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "h": h + 1, "r": r[0][i], "c": c[0][j], "prob": prob.ravel()})

    return cells.groupBy(*keys).applyInPandas(run, T.StructType(kinds))


def resized(grid: np.ndarray, size: int) -> np.ndarray:
    """A square grid (n, n, d) of vectors at another size, by cubic convolution (a = -0.75) with the border repeated."""
    n = len(grid)
    at = (np.arange(size) + 0.5) * n / size - 0.5
    base = np.floor(at).astype(int)
    x = np.abs(at[:, None] - (base[:, None] + np.arange(-1, 3)))
    a = -0.75
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    weight = np.where(x <= 1, near, np.where(x < 2, far, 0.0))
    pick = np.clip(base[:, None] + np.arange(-1, 3), 0, n - 1)
    rows = np.einsum("sk,sknd->snd", weight, grid[pick])
    return np.einsum("sk,mskd->msd", weight, rows[:, pick])
