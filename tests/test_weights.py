"""Softmax weights in blocks against plain loops, and joins beside small sides."""

import math

import numpy as np
import pytest
from fluvia import storage
from fluvia.functions import vectors
from fluvia.operators import thresholds


@pytest.mark.parametrize(("n_queries", "n_vectors"), [(256, 4096), (2, 7), (1, 1)])
def test_weights_in_blocks(spark, n_queries, n_vectors):
    rng = np.random.default_rng(6)
    rows = [(2**60 + k, list(map(float, rng.normal(size=4) * 30))) for k in range(40)] + [(1, None), (2, [1.0, None, 2.0, 3.0]), (3, [1.0]), (4, [])]
    asked = [("a", [1.0, 2.0, -1.0, 0.5]), ("b", [0.0] * 4), ("c", [-40.0, 10.0, 5.0, 9.0]), ("d", None), ("e", [2.0]), (None, [1.0] * 4)]
    q, v = spark.createDataFrame(asked, "q_id string, q array<double>"), spark.createDataFrame([*rows, (None, [9.0] * 4)], "vec_id bigint, e array<double>")
    got = {(r.q_id, r.vec_id): r.weight for r in vectors.softmax_weights(q, v, 2.0, n_queries, n_vectors).collect()}
    want = {}
    for name, a in asked[:5]:
        s = {k: sum(x * y for x, y in zip(a, e, strict=True)) / 2 if a is not None and e is not None and len(a) == len(e) and None not in e else None for k, e in rows}
        most = max((x for x in s.values() if x is not None), default=0)
        total = sum(math.exp(x - most) for x in s.values() if x is not None)
        want |= {(name, k): None if x is None else pytest.approx(math.exp(x - most) / total, abs=1e-12) for k, x in s.items()}
    assert got == want


def test_weights_of_nothing(spark):
    q, v = spark.createDataFrame([(1, [1.0])], "q_id int, q array<double>"), spark.createDataFrame([(1, [1.0])], "vec_id int, e array<double>")
    assert vectors.softmax_weights(q.where("q_id > 1"), v, 1.0).collect() == vectors.softmax_weights(q, v.where("vec_id > 1"), 1.0).collect() == []


def test_sides_few_and_many(spark):
    """The same rows whether the side is broadcast or not."""
    rows, side = spark.createDataFrame([(k % 3, k) for k in range(30)] + [(None, 1)], "k int, v int"), spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    for how, n in (("inner", 20), ("left", 31)):
        few, many = storage.beside(rows, side, ["k"], how), storage.beside(rows, side, ["k"], how, 1)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == n
    assert "BroadcastHashJoin" in storage.beside(rows, side, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_histogram_beside_its_ends(spark):
    values = spark.createDataFrame([(k % 2, float(k)) for k in range(40)], "k int, v double")
    got = {(r.k, r.bin): (r.n, r.lo, r.width) for r in thresholds.histogram(values, ["k"], 0.0, 100.0, 2).collect()}
    assert got == {(0, 0): (10, 0.0, 19.0), (0, 1): (10, 0.0, 19.0), (1, 0): (10, 1.0, 19.0), (1, 1): (10, 1.0, 19.0)}
