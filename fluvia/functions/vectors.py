"""Inner products of array columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.storage import stored


def dot(a: Column, b: Column) -> Column:
    """Null if either is null; of arrays of different lengths, null too."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear_head(vector: Column, weights: list[float], bias: float) -> Column:
    """A probability from a vector: the logistic function of its weighted sum and a bias."""
    return 1 / (1 + F.exp(-(dot(vector, F.array(*map(F.lit, weights))) + bias)))


def _stack(arrays: pd.Series, width: int) -> np.ndarray:
    """Arrays of ``width`` numbers as rows; others, null ones included, as rows of NaN."""
    out = np.full((len(arrays), width), np.nan)
    for i, a in enumerate(arrays):
        if a is not None and len(a) == width:
            out[i] = a
    return out


def _scores(asked: pd.Series, given: pd.Series, scale: float) -> np.ndarray:
    """Inner products over ``scale`` of a block's queries and vectors; NaN where there is none."""
    out = np.full((len(asked), len(given)), np.nan)
    size = lambda x: np.array([-1 if a is None else len(a) for a in x])
    of, to = size(asked), size(given)
    for width in np.intersect1d(of[of >= 0], to):
        i, j = np.flatnonzero(of == width), np.flatnonzero(to == width)
        out[np.ix_(i, j)] = _stack(asked.iloc[i], width) @ _stack(given.iloc[j], width).T / scale
    return out


def softmax_weights(queries: DataFrame, vectors: DataFrame, scale: float, n_queries: int = 256, n_vectors: int = 4096) -> DataFrame:
    """Rows q_id, vec_id, weight: for each of ``queries`` (q_id, q) the softmax of its inner products with all
    ``vectors`` (vec_id, e), over ``scale``.

    A stated set of queries against all rows, in blocks: both sides are dealt to blocks of about ``n_queries`` and
    ``n_vectors`` rows, and a task has one block of each. The first pass gives a row for each query and block of
    vectors, its maximum and sum; those are merged by query, and the second pass writes the weights where it computes
    them, so that no scores are shuffled, stored or broadcast. Rows without an id are left out; rows of one q_id
    share a sum. The weight is null where an array is null, has a null or NaN or another length; such pairs don't
    count in the sum.
    """
    queries, vectors = queries.where("q_id is not null"), vectors.where("vec_id is not null")
    number = lambda x, most: max(1, math.ceil(x.count() / most))
    q_blocks, v_blocks = number(queries, n_queries), number(vectors, n_vectors)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda x, n: F.pmod(F.xxhash64(*x.columns), F.lit(n)).cast("int")
    numbers = lambda c: F.col(c).cast("array<double>").alias(c)
    asked = queries.select("q_id", numbers("q"), block(queries, q_blocks).alias("qb"), every(v_blocks).alias("vb"))
    dealt = vectors.select("vec_id", numbers("e"), block(vectors, v_blocks).alias("vb"), every(q_blocks).alias("qb")).groupBy("qb", "vb")
    q_id, vec_id, real = queries.schema["q_id"].dataType, vectors.schema["vec_id"].dataType, T.DoubleType()
    kinds = lambda **of: T.StructType([T.StructField(k, t) for k, t in of.items()])

    def peak(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s = np.nan_to_num(_scores(a["q"], b["e"], scale), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        most = s.max(axis=1, initial=-np.inf)
        total = np.exp(s - np.where(np.isinf(most), 0, most)[:, None]).sum(axis=1)
        return pd.DataFrame({"q_id": a["q_id"], "most": most, "total": total})

    def weigh(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        w = np.exp(_scores(a["q"], b["e"], scale) - a["peak"].to_numpy()[:, None]) / a["total"].to_numpy()[:, None]
        return pd.DataFrame({"q_id": np.repeat(a["q_id"].to_numpy(), len(b)), "vec_id": np.tile(b["vec_id"].to_numpy(), len(a)), "weight": w.ravel()})

    parts = stored(asked.groupBy("qb", "vb").cogroup(dealt).applyInPandas(peak, kinds(q_id=q_id, most=real, total=real)), "peaks")
    merged = parts.join(parts.groupBy("q_id").agg(F.max("most").alias("peak")), "q_id").groupBy("q_id", "peak").agg(F.sum(F.col("total") * F.exp(F.col("most") - F.col("peak"))).alias("total"))
    known = asked.join(merged, "q_id").groupBy("qb", "vb").cogroup(dealt).applyInPandas(weigh, kinds(q_id=q_id, vec_id=vec_id, weight=real))
    return known.withColumn("weight", F.nullif("weight", F.lit(float("nan"))))
