import math

import numpy as np
import pytest

from fluvia.operators import attention
from fluvia.plans import forecasts


def lin(x, pair):
    return [sum(a * b for a, b in zip(row, x, strict=True)) + c for row, c in zip(*pair, strict=True)]


def norm(x, pair):
    mean = sum(x) / len(x)
    sd = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x) + 1e-5)
    return [(v - mean) / sd * a + b for v, a, b in zip(x, *pair, strict=True)]


def gelu(v):
    return v * (1 + math.erf(v / math.sqrt(2))) / 2


def plain_attention(tokens, qkv, heads):
    """tokens: normalised vectors of one group."""
    d = len(tokens[0])
    w = d // heads
    all_ = [lin(x, qkv) for x in tokens]
    out = []
    for a in all_:
        y = []
        for h in range(heads):
            q = a[h * w : h * w + w]
            score = [sum(i * j for i, j in zip(q, b[d + h * w : d + h * w + w], strict=True)) / math.sqrt(w) for b in all_]
            e = [math.exp(s) for s in score]
            y += [sum(p * b[2 * d + h * w + k] for p, b in zip(e, all_, strict=True)) / sum(e) for k in range(w)]
        out.append(y)
    return out


def plus(a, b):
    return [i + j for i, j in zip(a, b, strict=True)]


def plain_encoded(frames, weights, patch, heads):
    steps, size = frames.shape[:2]
    grid = size // patch
    x = {}
    for t in range(steps):
        for n in range(grid * grid):
            r, c = n // grid * patch, n % grid * patch
            cells = [frames[t, r + i, c + j] for i in range(patch) for j in range(patch)]
            x[t, n] = plus(plus(lin(cells, weights["embed"]), weights["place"][n]), weights["time"][t])
    for one in weights["layers"]:
        for n in range(grid * grid):
            seen = plain_attention([norm(x[t, n], one["norm_time"]) for t in range(steps)], one["qkv_time"], heads)
            for t in range(steps):
                x[t, n] = plus(x[t, n], lin(lin(seen[t], one["out_time"]), one["proj_time"]))
        for t in range(steps):
            seen = plain_attention([norm(x[t, n], one["norm_space"]) for n in range(grid * grid)], one["qkv_space"], heads)
            for n in range(grid * grid):
                y = plus(x[t, n], lin(seen[n], one["out_space"]))
                if "wide" in one:
                    y = plus(y, lin([gelu(v) for v in lin(norm(y, one["norm_wide"]), one["wide"])], one["narrow"]))
                x[t, n] = y
    return x


def plain_convolved(x, kernel, bias):
    d, h, w = len(x), len(x[0]), len(x[0][0])
    k = kernel.shape[-1]
    at = lambda m, i, j: x[m][i][j] if 0 <= i < h and 0 <= j < w else 0.0
    return [[[bias[o] + sum(kernel[o, m, a, b] * at(m, i + a - k // 2, j + b - k // 2) for m in range(d) for a in range(k) for b in range(k)) for j in range(w)] for i in range(h)] for o in range(len(bias))]


def plain_forecast(frames, weights, patch, heads):
    steps, size = frames.shape[:2]
    grid, x = size // patch, plain_encoded(frames, weights, patch, heads)
    made = {}
    for ahead, (mix, bias) in enumerate(zip(*weights["ahead"], strict=True)):
        y = {n: [sum(mix[t] * norm(x[t, n], weights["norm"])[k] for t in range(steps)) + bias for k in range(len(weights["time"][0]))] for n in range(grid * grid)}
        image = [[[y[i * grid + j][k] for j in range(grid)] for i in range(grid)] for k in range(len(weights["time"][0]))]
        for kernel, shift, scale, move in weights["decoder"]:
            side = 2 * len(image[0])
            image = plain_convolved([[[p[i // 2][j // 2] for j in range(side)] for i in range(side)] for p in image], kernel, shift)
            groups = min(8, len(image))
            width = len(image) // groups
            for g in range(groups):
                values = [v for p in image[g * width : (g + 1) * width] for row in p for v in row]
                mean = sum(values) / len(values)
                sd = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values) + 1e-5)
                for m in range(g * width, (g + 1) * width):
                    image[m] = [[gelu((v - mean) / sd * scale[m] + move[m]) for v in row] for row in image[m]]
        logit = plain_convolved(image, *weights["outer"])[0]
        made |= {(ahead + 1, i, j): 1 / (1 + math.exp(-v)) for i, row in enumerate(logit) for j, v in enumerate(row)}
    return made


def random_weights(rng, patch, places, steps, width, depth, ahead):
    pair = lambda out, *inner: (rng.normal(size=(out, *inner)) / 2, rng.normal(size=out) / 2)
    norms = lambda n=width: (rng.normal(size=n) + 1, rng.normal(size=n))
    layers = [
        {"norm_time": norms(), "qkv_time": pair(3 * width, width), "out_time": pair(width, width), "proj_time": pair(width, width), "norm_space": norms(), "qkv_space": pair(3 * width, width),
         "out_space": pair(width, width), "norm_wide": norms(), "wide": pair(4 * width, width), "narrow": pair(width, 4 * width)}
        for _ in range(depth)
    ]
    stages = [(*pair(16 if k == 0 else 4, width if k == 0 else 16, 3, 3), *norms(16 if k == 0 else 4)) for k in range(int(math.log2(patch)))]
    return {"embed": pair(width, patch**2), "place": rng.normal(size=(places, width)), "time": rng.normal(size=(steps, width)), "layers": layers, "norm": norms(), "ahead": pair(ahead, steps), "decoder": stages, "outer": pair(1, 4, 1, 1)}


@pytest.mark.parametrize("block", [4, 64])
def test_forecast_equals_plain_loops(spark, block):
    """Two windows, one of a null key, with missing cells, a missing frame, nulls and repeated cells; blocks that
    don't divide the places."""
    rng = np.random.default_rng(3)
    weights = random_weights(rng, 4, 9, 3, 6, 2, 2)
    frames, rows = {}, []
    for key in ("a", None):
        frames[key] = np.zeros((3, 12, 12))
        for t in range(3) if key else (0, 2):
            for r in range(12):
                for c in range(12):
                    v = None if rng.random() < 0.1 else float(rng.normal())
                    if rng.random() < 0.9:
                        rows.append((key, t, r, c, v))
                        frames[key][t, r, c] = v or 0.0
    rows += [(k, t, r, c, v - 1) for k, t, r, c, v in rows[:40] if v is not None]
    cells = spark.createDataFrame(rows, "x string, t int, r int, c int, v double").repartition(5)
    shape = attention.Shape(steps=3, size=12, patch=4, heads=2, block=block)
    got = attention.attention_forecast(cells, ["x"], weights, shape).collect()
    assert len(got) == 2 * 2 * 144
    expected = {key: plain_forecast(f, weights, 4, 2) for key, f in frames.items()}
    assert max(abs(r.prob - expected[r.x][r.h, r.r, r.c]) for r in got) < 1e-9


def test_vectors_of_a_resized_grid_and_refused_cells(spark):
    rng = np.random.default_rng(5)
    weights = random_weights(rng, 2, 9, 2, 4, 1, 1)
    shape = attention.Shape(steps=2, size=8, patch=2, heads=4, block=3)
    frames = rng.normal(size=(2, 8, 8))
    cells = spark.createDataFrame([(1, t, r, c, float(frames[t, r, c])) for t, r, c in np.ndindex(2, 8, 8)], "k int, t int, r int, c int, v double")
    got = {(r.t, r.place): r.x for r in attention.encoded(cells, ["k"], weights, shape).collect()}
    places = attention.resized(weights["place"].reshape(3, 3, 4), 4).reshape(16, 4)
    expected = plain_encoded(frames, weights | {"place": places}, 2, 4)
    assert got.keys() == expected.keys()
    assert max(abs(np.array(got[k]) - expected[k]).max() for k in got) < 1e-9
    assert attention.encoded(cells.limit(0), ["k"], weights, shape).count() == 0
    for outside in ((1, 2, 0, 0, 1.0), (1, 0, 8, 0, 1.0), (1, 0, 0, -1, 1.0), (1, None, 0, 0, 1.0)):
        with pytest.raises(Exception, match="cells lie in 2 frames of 8 by 8"):
            attention.encoded(cells.union(spark.createDataFrame([outside], cells.schema)), ["k"], weights, shape).collect()
    with pytest.raises(ValueError, match="patches of 3"):
        attention.Shape(steps=2, size=8, patch=3, heads=1)


def test_running_softmax_equals_the_whole_one():
    """Scores far apart: a later block whose scores are larger by hundreds takes over."""
    rng = np.random.default_rng(1)
    q, k, v = rng.normal(size=(7, 4)), rng.normal(size=(11, 4)) * np.array([1, 1, 200, 1]), rng.normal(size=(11, 4))
    whole = attention.attend(q, [(k, v)], 2)
    parts = attention.attend(q, [(k[i : i + 2], v[i : i + 2]) for i in range(0, 11, 2)], 2)
    assert np.allclose(whole, parts, rtol=0, atol=1e-12)
    assert np.isfinite(parts).all()


def test_query_gives_whole_windows(spark):
    rows = forecasts.QUERIES["attention_forecast"](spark, "/root/testdata/sf0.001")
    windows = forecasts.cells(spark, "/root/testdata/sf0.001").select("window").distinct().count()
    assert rows.count() == windows * 2 * 256
    assert rows.where("prob is null or prob < 0 or prob > 1").count() == 0
