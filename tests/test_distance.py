"""Distances by columns and rows, against every pair."""

import numpy as np
import pytest
from fluvia.operators import distance, frames


def pairs(a, b):
    return {p: min(((p[0] - r) ** 2 + (p[1] - c) ** 2) ** 0.5 for r, c in b) for p in set(a)}


@pytest.mark.parametrize(("height", "width", "n", "m", "rows"), [(40, 30, 200, 5, 8), (300, 7, 90, 90, 64), (5, 400, 60, 300, 2), (70, 70, 400, 1, 1), (50, 60, 300, 900, 16)])
def test_nearest_is_that_of_all_pairs(spark, height, width, n, m, rows):
    rng = np.random.default_rng(height)
    draw = lambda k: [(int(r), int(c)) for r, c in zip(rng.integers(-height, height, k), rng.integers(0, width, k), strict=True)]
    frame = {k: (draw(n), draw(m)) for k in (1, 2)}
    table = lambda i: spark.createDataFrame([(k, *p) for k, x in frame.items() for p in x[i]], "f int, r int, c int")
    got = {(x.f, x.r, x.c): x.d for x in distance.nearest(table(0), table(1), ["f"], rows).collect()}
    want = {(k, *p): d for k, x in frame.items() for p, d in pairs(*x).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_boundaries_far_apart(spark):
    """One side 5,000 cells from the other, in both ways; nothing lies between."""
    a = [(r, 0) for r in range(50)] + [(0, c) for c in range(50)]
    b = [(5000 + r, 5000 + (r * 7) % 13) for r in range(50)]
    rows = lambda cells: spark.createDataFrame([("x", *p) for p in cells], "f string, r int, c int")
    got = frames.displacement(rows(a), rows(b), ["f"], 30.0).collect()
    mean = lambda d: sum(d.values()) / len(d)
    assert [(x.f, x.metres) for x in got] == [("x", pytest.approx((mean(pairs(a, b)) + mean(pairs(b, a))) / 2 * 30, abs=1e-3))]


def test_columns_near_the_last_are_exact(spark):
    a, b = [(3, 999_998), (900_000, 12), (0, 500_000)], [(0, 0), (999_999, 999_990), (5, 999_001), (900_001, 0)]
    rows = lambda cells: spark.createDataFrame([(1, *p) for p in cells], "f int, r int, c int")
    got = {(x.r, x.c): x.d for x in distance.nearest(rows(a), rows(b), ["f"]).collect()}
    assert got == {p: pytest.approx(d, abs=1e-9) for p, d in pairs(a, b).items()}


def test_nothing_to_measure(spark):
    none = spark.createDataFrame([], "f int, r int, c int")
    one = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (2, None, 1)], "f int, r int, c int")
    assert distance.nearest(none, one, ["f"]).collect() == distance.nearest(one, none, ["f"]).collect() == []
    assert [tuple(x) for x in distance.nearest(one, one, ["f"]).collect()] == [(1, 2, 3, 0.0)]
    assert distance.nearest(one.where("f = 2"), one, ["f"]).collect() == []


def test_envelope_keeps_the_lowest():
    rng = np.random.default_rng(5)
    for width in (1, 2, 9, 40):
        columns = np.sort(rng.choice(100, width, replace=False))
        squares = rng.integers(0, 60, (30, width)).astype(float) ** 2
        kept, start, top = distance.envelope(columns, squares)
        for i in range(30):
            for c in range(-5, 105):
                k = kept[i, np.searchsorted(start[i, : top[i] + 1], c, side="right") - 1]
                assert squares[i, k] + (c - columns[k]) ** 2 == (squares[i] + (c - columns) ** 2).min()
