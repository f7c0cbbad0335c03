"""Queries of the forecaster with split space-time attention, on frames of 16 by 16 cells that the events fill."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fluvia.operators import attention
from fluvia.plans.registry import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Windows of 4 frames in 16 patches of 4 by 4, in blocks of 5 patches; vectors of 4 numbers, two heads.
SHAPE = attention.Shape(steps=4, size=16, patch=4, heads=2, block=5)
WIDTH = 4


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def numbers(*shape: int, seed: int) -> np.ndarray:
    """Made-up weights: multiples of 1/8 from -3/8 to 3/8."""
    return ((np.arange(np.prod(shape)) * (2 * seed + 3) + seed) % 11 % 7 - 3).reshape(shape) / 8


def pair(out: int, *inner: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return numbers(out, *inner, seed=seed), numbers(out, seed=seed + 1)


def norm(n: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    return 1 + numbers(n, seed=5), numbers(n, seed=2)


def layer(seed: int) -> dict:
    d = WIDTH
    names = {"qkv_time": 3 * d, "out_time": d, "proj_time": d, "qkv_space": 3 * d, "out_space": d}
    return {"norm_time": norm(), "norm_space": norm()} | {name: pair(n, d, seed=seed + 2 * i) for i, (name, n) in enumerate(names.items())}


def wide_layer(seed: int) -> dict:
    return layer(seed) | {"norm_wide": norm(), "wide": pair(4 * WIDTH, WIDTH, seed=seed + 1), "narrow": pair(WIDTH, 4 * WIDTH, seed=seed + 3)}


WEIGHTS = {"embed": pair(WIDTH, SHAPE.patch**2, seed=1), "place": numbers(SHAPE.places, WIDTH, seed=3), "time": numbers(SHAPE.steps, WIDTH, seed=4), "layers": [layer(6)]}


def cells(spark, d):
    """1,024 events a window, 256 a frame."""
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.floor(i / 1024).alias("window"), F.floor(i % 1024 / 256).cast("int").alias("t"), F.floor(i % 256 / 16).cast("int").alias("r"), (i % 16).cast("int").alias("c"), (F.col("value") / 100).alias("v")
    )


def _list(row) -> str:
    return "([" + ", ".join(str(float(x)) for x in row) + "]::DOUBLE[])"


def _linear(x: str, weights) -> str:
    return "[" + ", ".join(f"list_inner_product({_list(row)}, {x}) + {b}" for row, b in zip(*weights, strict=True)) + "]"


def _norm(x: str, weights) -> str:
    scaled = ", ".join(f"({x}[{i + 1}] - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5) * {a} + {b}" for i, (a, b) in enumerate(zip(*weights, strict=True)))
    return f"[{scaled}]"


def _attend(name: str, source: str, place: str) -> str:
    """Rows of ``source`` (win, t, n, x, qkv) that share ``place`` attend over each other: their outcome y."""
    half = WIDTH // 2
    score = lambda h: f"list_inner_product(a.qkv[{h * half + 1}:{h * half + half}], b.qkv[{WIDTH + h * half + 1}:{WIDTH + h * half + half}]) / sqrt({half})"
    weighted = ", ".join(f"sum(w{k // half} * v[{k + 1}]) / sum(w{k // half})" for k in range(WIDTH))
    most = ", ".join(f"exp(s{h} - max(s{h}) OVER (PARTITION BY win, t, n)) AS w{h}" for h in range(2))
    return f"""{name}_s AS (SELECT a.win, a.t, a.n, a.x, b.qkv[{2 * WIDTH + 1}:] AS v, {score(0)} AS s0, {score(1)} AS s1 FROM {source} a JOIN {source} b ON a.win = b.win AND a.{place} = b.{place}),
    {name}_w AS (SELECT win, t, n, x, v, {most} FROM {name}_s),
    {name} AS (SELECT win, t, n, any_value(x) AS x, [{weighted}] AS y FROM {name}_w GROUP BY win, t, n)"""


def _sum(a: str, b: str) -> str:
    return "[" + ", ".join(f"{a}[{k + 1}] + {b}[{k + 1}]" for k in range(WIDTH)) + "]"


def _sql() -> str:
    one, p = WEIGHTS["layers"][0], SHAPE.patch
    embed = ", ".join(f"sum(v * {_list(row)}[cell + 1]) + {b}" for row, b in zip(*WEIGHTS["embed"], strict=True))
    added = "[" + ", ".join(f"x[{k + 1}] + [{', '.join(map(_list, WEIGHTS['place']))}][n + 1][{k + 1}] + [{', '.join(map(_list, WEIGHTS['time']))}][t + 1][{k + 1}]" for k in range(WIDTH)) + "]"
    qkv = lambda part: f"SELECT win, t, n, x, {_linear('z', one[f'qkv_{part}'])} AS qkv FROM (SELECT *, {_norm('x', one[f'norm_{part}'])} AS z FROM {{}})"
    return f"""WITH px AS (SELECT event_id // 1024 AS win, event_id % 1024 // 256 AS t, event_id % 256 // 16 // {p} * {SHAPE.grid} + event_id % 16 // {p} AS n,
                   event_id % 256 // 16 % {p} * {p} + event_id % 16 % {p} AS cell, max(coalesce(value / 100, 0)) AS v FROM events GROUP BY ALL),
    every AS (SELECT win, t, n, cell, 0 AS v FROM (SELECT DISTINCT win FROM px) CROSS JOIN range({SHAPE.steps}) a(t) CROSS JOIN range({SHAPE.places}) b(n) CROSS JOIN range(1) c(cell)),
    e AS (SELECT win, t, n, [{embed}] AS x FROM (SELECT win, t, n, cell, v FROM px UNION ALL FROM every) GROUP BY win, t, n),
    x0 AS (SELECT win, t, n, {added} AS x FROM e),
    t0 AS ({qkv("time").format("x0")}),
    {_attend("t1", "t0", "n")},
    t2 AS (SELECT win, t, n, x, {_linear("y", one["out_time"])} AS y FROM t1),
    t3 AS (SELECT win, t, n, x, {_linear("y", one["proj_time"])} AS y FROM t2),
    t4 AS (SELECT win, t, n, {_sum("x", "y")} AS x FROM t3),
    s0 AS ({qkv("space").format("t4")}),
    {_attend("s1", "s0", "t")},
    s2 AS (SELECT win, t, n, x, {_linear("y", one["out_space"])} AS y FROM s1),
    s3 AS (SELECT win, t, n, {_sum("x", "y")} AS x FROM s2)
    SELECT win AS "window", t::INT AS t, n::INT AS place, k::INT AS k, round(x[k], 6)::DOUBLE AS x FROM s3 CROSS JOIN range(1, {WIDTH + 1}) d(k)"""


@query(_sql())
def space_time_attention(spark, d):
    """The vectors of all patches after a layer of attention over time and then over space."""
    rows = attention.encoded(cells(spark, d), ["window"], WEIGHTS, SHAPE)
    return rows.select("window", "t", "place", F.posexplode("x").alias("k", "x")).select("window", "t", "place", (F.col("k") + 1).alias("k"), F.round("x", 6).alias("x"))


@query(None)
def attention_forecast(spark, d):
    """Two frames ahead of each window, by two layers with feed-forward parts and a decoder, with made-up weights;
    tested against plain loops."""
    stages = [(*pair(8, WIDTH, 3, 3, seed=7), *norm(8)), (*pair(8, 8, 3, 3, seed=9), *norm(8))]
    weights = WEIGHTS | {"layers": [wide_layer(6), wide_layer(11)], "norm": norm(), "ahead": pair(2, SHAPE.steps, seed=8), "decoder": stages, "outer": pair(1, 8, 1, 1, seed=10)}
    return attention.attention_forecast(cells(spark, d), ["window"], weights, SHAPE).withColumn("prob", F.round("prob", 6))
