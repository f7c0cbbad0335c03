"""A learned forecaster of water by cell: logistic regression on lagged frames and neighbours, fitted by executors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.config import DEFAULTS
from fluvia.functions.vectors import linear_head
from fluvia.operators.frames import SQUARE, by_blocks
from fluvia.operators.thresholds import best_cut, cut_sweep, with_f1
from fluvia.storage import stored

#: Cuts of the probability that are tried on the validation rows.
CUTS = [0.05 * k for k in range(1, 20)]
PENALTIES = (0.0, 0.001, 0.01, 0.1)


@dataclass(frozen=True)
class Model:
    weights: list[float]
    bias: float
    cut: float = 0.5
    penalty: float = 0.0
    f1: float = 0.0

    def prob(self, features: Column) -> Column:
        return linear_head(features, self.weights, self.bias)


def examples(series: DataFrame, keys: list[str], lags: int = 3, ahead: int = 1, block: int = 256) -> DataFrame:
    """Rows keys, r, c, t, features, latest, truth: what a cell's last frames and its neighbours tell of a later one.

    series: keys, r, c, t without gaps, water (0, 1, or null: not seen). Features are the cell's water in the
    ``lags`` latest frames and that of its eight neighbours in the latest; what isn't seen, or lies beyond the
    frame, counts as 0, as in the frames that the other forecasters read. Truth is the water ``ahead`` frames
    later, null where it wasn't seen; rows whose lags begin before the series have no row. Two shuffles: by
    frame and block, and by cell.
    """
    around = [s for s in SQUARE if s != (0, 0)]

    def run(r, c, there, water):
        x = np.pad(np.nan_to_num(water), 1)
        return [x[1 + i : x.shape[0] - 1 + i, 1 + j : x.shape[1] - 1 + j] for i, j in around]

    names = [f"b{k}" for k in range(len(around))]
    near = by_blocks(series, [*keys, "t"], ["water"], 1, lambda r, c, there, water: [*run(r, c, there, water), water], ", ".join(f"{n} double" for n in [*names, "water"]), block)
    order = Window.partitionBy(*keys, "r", "c").orderBy("t")
    seen = F.when(~F.isnan("water"), F.col("water"))
    known = near.withColumn("water", seen)
    before = [F.coalesce(F.lag("water", k).over(order), F.lit(0.0)) if k else F.coalesce("water", F.lit(0.0)) for k in range(lags)]
    made = known.select(*keys, "r", "c", "t", F.array(*before, *names).alias("features"), F.coalesce("water", F.lit(0.0)).cast("int").alias("latest"), F.lead("water", ahead).over(order).cast("int").alias("truth"), F.row_number().over(order).alias("n"))
    return made.where(F.col("n") >= lags).drop("n")


#: How often a row counts, where it stands for several.
TIMES = "fl_times"


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows equal in keys, features and truth as one, with their number: features are a few bits, so those are few."""
    return rows.groupBy(*keys, "features", "truth").agg(F.count("*").alias(TIMES))


def _times(rows: DataFrame) -> Column:
    return F.col(TIMES) if TIMES in rows.columns else F.lit(1)


def positive_weight(rows: DataFrame) -> float:
    """Rows with truth 0 for each with 1; 1 without any of those."""
    off, on = rows.agg(*(F.coalesce(F.sum(F.when(F.col("truth") == k, _times(rows))), F.lit(0)) for k in (0, 1))).first()
    return off / on if on else 1.0


def fit(rows: DataFrame, penalty: float = 0.0, weight: float | None = None, rounds: int = 100) -> Model:
    """Logistic regression of truth on features over all rows that have a truth, those with 1 weighted.

    Gradients are summed by executors and merged in a tree; coefficients are all that comes to the driver. The
    weight is :func:`positive_weight` of the rows unless it is given; ``penalty`` is that of squared weights.
    """
    known = rows.where("truth is not null")
    w = positive_weight(known) if weight is None else weight
    data = known.select(array_to_vector("features").alias("x"), F.col("truth").cast("double").alias("y"), (F.when(F.col("truth") == 1, w).otherwise(1.0) * _times(rows)).alias("w"))
    made = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=penalty, standardization=False, maxIter=rounds, tol=1e-7).fit(data)
    return Model([float(v) for v in made.coefficients], float(made.intercept), penalty=penalty)


def train(rows: DataFrame, penalties: tuple[float, ...] = PENALTIES) -> Model:
    """The model, of one for each penalty, and the cut with the best pooled F1 on validation rows; the first of equal ones.

    rows: those of :func:`examples` with split (train, val or test). Only train rows are fitted to, test rows
    aren't read. Fits and cuts work on :func:`counted` rows. Without a validation row with truth the first penalty's model is returned, with a cut of 0.5.
    """
    some = stored(counted(rows.where("split in ('train', 'val')").where("truth is not null"), ["split"]), "examples")
    fitted, val = some.where("split = 'train'"), some.where("split = 'val'")
    if fitted.isEmpty():
        raise ValueError("no train row has a truth")
    if val.isEmpty():
        return fit(fitted, penalties[0])
    best = None
    for penalty in penalties:
        model = fit(fitted, penalty)
        found = best_cut(cut_sweep(val.select(model.prob(F.col("features")).alias("prob"), "truth", TIMES), CUTS, TIMES)).first()
        if best is None or found.f1 > best.f1:
            best = Model(model.weights, model.bias, found.cut, penalty, found.f1)
    return best


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with prob, the learned one, and persist, that of the latest frame as it is."""
    still = 1 / (1 + F.exp(-(F.col("latest") * 2 - 1) * DEFAULTS["logit_scale"]))
    return rows.withColumn("prob", model.prob(F.col("features"))).withColumn("persist", still)


def compared(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """Pooled metrics by ``keys`` of the learned model and of persistence, over rows with a truth, in one pass."""
    s = scored(rows.where("truth is not null"), model)
    each = F.explode(F.array(F.struct(F.lit("learned").alias("model"), (F.col("prob") > model.cut).alias("on")), F.struct(F.lit("persistence").alias("model"), (F.col("persist") > 0.5).alias("on")))).alias("m")
    on, true = F.col("m.on"), F.col("truth") == 1
    counts = s.select(*keys, "truth", each).groupBy(*keys, F.col("m.model").alias("model")).agg(F.count_if(on & true).alias("tp"), F.count_if(on & ~true).alias("fp"), F.count_if(~on & true).alias("fn"), F.count("*").alias("n"))
    return with_f1(counts)
