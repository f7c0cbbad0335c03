"""The learned forecaster: its rows against plain loops, its coefficients against Newton's method, and a drifting river."""

import numpy as np
import pytest
from fluvia.operators import learned
from pyspark.sql import functions as F


def drifting(rng, times, height=14, width=40):
    """A river four cells wide that moves a column to the right each month, its banks winding; some cells unseen."""
    out = []
    for t in range(times):
        for r in range(height):
            left = 2 + t + (r // 4) % 3
            out += [(1, r, c, t, None if rng.random() < 0.03 else int(left <= c < left + 4)) for c in range(width)]
    return out


SERIES = "tile int, r int, c int, t int, water int"


def test_examples_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(k, r, c, t, [None, 0, 1][rng.integers(3)]) for k in (1, 2) for t in range(5) for r in range(6) for c in range(7) if (r, c) != (2, 2)]
    at = {x[:4]: x[4] for x in rows}
    value = lambda *p: float(at.get(p) or 0)
    want = {}
    for k, r, c, t, _ in rows:
        if t >= 2:
            near = [value(k, r + i, c + j, t) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
            want[k, r, c, t] = ([value(k, r, c, t - i) for i in range(3)] + near, int(value(k, r, c, t)), at.get((k, r, c, t + 1)))
    for block in (4, 256):
        got = learned.examples(spark.createDataFrame(rows, SERIES), ["tile"], 3, 1, block).collect()
        assert {(x.tile, x.r, x.c, x.t): (x.features, x.latest, x.truth) for x in got} == want


@pytest.mark.parametrize("penalty", [0.0, 0.05])
def test_coefficients_are_those_of_newton(spark, penalty):
    rng = np.random.default_rng(2)
    x = rng.random((400, 3)).round(2)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -3.0, 0.5])))).astype(int)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)] + [([9.0, 9.0, 9.0], None)], "features array<double>, truth int")
    weight = (y == 0).sum() / (y == 1).sum()
    assert learned.positive_weight(rows) == pytest.approx(weight)
    w, full = np.where(y == 1, weight, 1.0), np.c_[x, np.ones(400)]
    beta, ridge = np.zeros(4), np.diag([penalty] * 3 + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ beta))
        slope = full.T @ (w * (p - y)) / w.sum() + ridge @ beta
        beta -= np.linalg.solve((full * (w * p * (1 - p))[:, None]).T @ full / w.sum() + ridge, slope)
    model = learned.fit(rows, penalty)
    assert [*model.weights, model.bias] == pytest.approx(list(beta), abs=1e-4)
    prob = rows.limit(1).select(model.prob(F.col("features")).alias("p")).first().p
    assert prob == pytest.approx(1 / (1 + np.exp(-full[0] @ beta)), abs=1e-5)


def test_learned_beats_persistence_on_a_drifting_river(spark):
    rows = learned.examples(spark.createDataFrame(drifting(np.random.default_rng(3), 30), SERIES), ["tile"])
    split = F.when(F.col("t") < 15, "train").when(F.col("t") < 20, "val").otherwise("test")
    rows = rows.withColumn("split", split)
    model = learned.train(rows, (0.0, 0.01))
    f1 = {r.model: r.f1 for r in learned.compared(rows.where("split = 'test'"), model, []).collect()}
    assert f1["learned"] > 0.93 and f1["persistence"] < 0.78
    counts = {r.model: (r.tp, r.fp, r.fn, r.n) for r in learned.compared(rows.where("split = 'test'"), model, []).collect()}
    every = [r for r in rows.where("split = 'test' and truth is not null").collect()]
    hit = lambda a, b: sum(r.latest == a and r.truth == b for r in every)
    assert counts["persistence"] == (hit(1, 1), hit(1, 0), hit(0, 1), len(every))


def test_rows_without_truth_or_validation(spark):
    schema = "split string, features array<double>, truth int, latest int"
    with pytest.raises(ValueError):
        learned.train(spark.createDataFrame([("train", [1.0], None, 0), ("test", [1.0], 1, 0)], schema))
    model = learned.train(spark.createDataFrame([("train", [float(k % 3)], int(k % 3 > 1), 0) for k in range(60)], schema))
    assert model.cut == 0.5 and learned.positive_weight(spark.createDataFrame([(0,)], "truth int")) == 1.0
