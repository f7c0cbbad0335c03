import io
import math
import random
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fluvia.functions import present, raster, text
from fluvia.operators import forecast, frames, order, rings, risk, spatial, thresholds
from fluvia.plans import exchange
from fluvia.sources import places, tables
from fluvia.streaming.composite import run_to_end


@pytest.fixture(scope="module")
def handoff(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("handoff")
    tables.write_handoff(exchange.handoff(spark, SF), f"file://{folder}/good", "2025-03", ["gid_union"])
    return folder


def test_handoff_is_one_file_in_order(spark, handoff):
    (part,) = handoff.glob("good/part-*")
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfforecast_month,division,") and raw.endswith(b"\r\n") and b"\r\n\r\n" not in raw
    lines = raw.decode("utf-8-sig").split("\r\n")[1:-1]
    ids = [x.rsplit("Customer#", 1)[1][:9] for x in lines]
    assert ids == sorted(ids) and all(x.startswith("2025-03,") for x in lines) and '"a, ""b"" Customer#' in lines[0]
    assert sum(tables.handoff_checks(tables.read_handoff(spark, f"file://{handoff}/good"), "2025-03").first()) == 0


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda t: t.replace("osm_mapping,", "", 1), "missing columns"),
        (lambda t: t.replace("division,district", "district,division", 1), "another order"),
        (lambda t: t.replace(",0.7,", ",seven,", 1), "MALFORMED|CANNOT_PARSE|malformed|FAILED_READ"),
    ],
)
def test_strict_reader_refuses(spark, handoff, tmp_path, change, error):
    (part,) = handoff.glob("good/part-*")
    (tmp_path / "bad.csv").write_bytes(change(part.read_bytes().decode()).encode())
    with pytest.raises(Exception, match=error):
        tables.read_handoff(spark, f"file://{tmp_path}/bad.csv").collect()


def test_rules_that_are_broken_are_named(spark):
    rows = exchange.handoff(spark, SF).withColumn("forecast_month", F.lit("2025-04"))
    with pytest.raises(ValueError, match="other_month"):
        risk.require(tables.handoff_checks(rows, "2025-03"))


def test_zipped_units(spark, tmp_path):
    data = io.BytesIO()
    layer = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"NAME_1":"D","NAME_4":"U","GID_4":"g","OTHER":1},"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4.5],[5,6],[1,2]]]}},{"type":"Feature","properties":{"NAME_1":"E"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("read.me", "x")
        z.writestr("units.json", layer)
    (tmp_path / "units.zip").write_bytes(data.getvalue())
    rows = places.read_units(spark, f"file://{tmp_path}/units.zip").collect()
    assert [(r.division, r.district, r.union, r.gid_union) for r in rows] == [("D", None, "U", "g"), ("E", None, None, None)]
    assert rows[0].coordinates == [[[1.0, 2.0], [3.0, 4.5], [5.0, 6.0], [1.0, 2.0]]]


def test_layer_without_features(spark, tmp_path):
    none = spark.createDataFrame([], "id int, feature string")
    places.write_layer(none, f"file://{tmp_path}/none", "id")
    assert places.read_layer(spark, f"file://{tmp_path}/none").count() == 0
    (part,) = tmp_path.glob("none/part-*")
    assert part.read_text().split() == ['{"type":"FeatureCollection","features":[', "]}"]


def test_cacheable_titles(spark):
    rows = spark.createDataFrame([("a", "হলদিয়া"), ("b", "Site is not available"), ("c", None), ("d", "x হ")], "domain string, name string")
    assert {r.domain for r in places.cacheable(rows).collect()} == {"a", "d"}


NUMBERS = [0, 0.3, 0.5, 1, 12, 999.4, 999.5, 1000, 12345, 123456, 1234567, 98765432, -0.2, -0.5, -0.6, -1234]


@pytest.mark.parametrize("lang", ["en", "bn"])
def test_numbers_by_language(spark, lang):
    def whole(n):
        n = int(np.floor(n + 0.5))
        s = str(abs(n))
        if lang == "en":
            s = f"{abs(n):,}"
        elif len(s) > 3:
            head, tail = s[:-3], s[-3:]
            parts = []
            while head:
                parts.insert(0, head[-2:])
                head = head[:-2]
            s = ",".join([*parts, tail])
        s = ("-" if n < 0 else "") + s
        return s.translate(str.maketrans("0123456789", text.DIGITS)) if lang == "bn" else s

    n = F.col("n")
    got = spark.createDataFrame([(float(x),) for x in NUMBERS], "n double").select("n", present.whole(n, lang).alias("w"), present.signed(n, lang).alias("s"), present.hectares(n, lang).alias("h")).collect()
    for r in got:
        assert r.w == whole(r.n)
        assert r.s == ("+" if np.floor(r.n + 0.5) > 0 else "") + whole(r.n)
        assert r.h == ("<" + whole(1) if 0 < r.n < 0.5 else whole(r.n))


def test_small_numbers_and_months(spark):
    row = spark.range(1).select(
        *(present.density(F.lit(x), "en").alias(f"d{k}") for k, x in enumerate((0.0, 0.04, 0.4, 2.5, 9.96, 10.0, 123.4))), present.decimal(F.lit(4.5), "bn").alias("dec"), present.percent(F.lit(0.644), "bn").alias("pct"),
        present.month_name(F.lit("2025-03"), "en").alias("en"), present.month_name(F.lit("2025-03"), "bn").alias("bn"), present.year(F.lit(2024), "bn").alias("year"), present.test_period(F.lit("test 2018-2024"), "bn").alias("period"),
    ).first()
    assert list(row)[:7] == ["0", "<0.1", "0.4", "2.5", "10", "10", "123"]
    assert (row.dec, row.pct, row.en, row.bn, row.year, row.period) == ("৪.৫", "৬৪%", "March 2025", "মার্চ ২০২৫", "২০২৪", "২০১৮–২০২৪")


def test_needle_matches_composed_and_decomposed_names(spark):
    rows = spark.createDataFrame([("a", "Café", 1.0, 1), ("b", "Café", 2.0, 1), ("c", "Cafe", 3.0, 1)], "gid_union string, union string, erosion_ha double, buildings_osm int")
    got = risk.table_query(rows, risk.STATE | {"query": " CAFÉ "}, ["union"]).collect()
    assert [r.gid_union for r in got] == ["b", "a"]


def test_order_of_the_table(spark):
    rng = random.Random(3)
    rows = [(f"g{k:02d}", f"U{rng.randrange(9)}", float(rng.randrange(4)), rng.randrange(2), rng.choice([None, 1, 2])) for k in range(40)]
    df = spark.createDataFrame(rows, "gid_union string, union string, erosion_ha double, buildings_osm int, households_est int").repartition(5)
    for direction in ("asc", "desc"):
        got = [r.gid_union for r in risk.table_query(df, risk.STATE | {"sort": "households_est", "dir": direction}, ["union"]).collect()]
        key = lambda r: None if r[2] > 0 and r[3] == 0 else r[4]  # noqa: E731, B023
        want = sorted(rows, key=lambda r: (key(r) is None, (key(r) or 0) * (1 if direction == "asc" else -1), -r[2], r[0]))  # noqa: B023
        assert got == [r[0] for r in want]
        placed = order.placed(risk.table_query(df, risk.STATE | {"sort": "households_est", "dir": direction}, ["union"])).collect()
        assert [r.gid_union for r in sorted(placed, key=lambda r: r.place)] == got and {r.place for r in placed} == {*range(1, 41)}


def test_month_arithmetic(spark):
    row = spark.range(1).select(raster.shift_month(F.lit("2024-01"), F.lit(-1)).alias("a"), raster.shift_month(F.lit("2023-12"), F.lit(14)).alias("b"), raster.month_range(F.lit("2024-11"), F.lit("2025-02")).alias("c"), raster.month_range(F.lit("2025-02"), F.lit("2025-01")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("2023-12", "2025-02", ["2024-11", "2024-12", "2025-01", "2025-02"], [])


def test_matches_of_names(spark):
    candidates = spark.createDataFrame([(1, 10, "Haldia", "হলদিয়া"), (1, 11, "Bogura Sadar", "বগুড়া সদর"), (1, 12, "Kamalpur", "কমলপুর"), (2, 20, "Char", "চর"), (2, 21, "Chor", "চর"), (3, 30, "Alga", "দমদমা")], "parent int, cand_id int, cand string, cand_bn string")
    names = spark.createDataFrame([(1, 1, "Haldiya"), (2, 1, "Bogura"), (3, 1, "Komolpurr"), (4, 1, "Xyzzy Tmt"), (5, 2, "Chara"), (6, 9, "Haldia"), (7, 3, "Alga")], "id int, parent int, name string")
    got = {r.id: (r.method, r.cand_id) for r in text.best_matches(names, candidates).collect()}
    assert got == {1: ("exact", 10), 2: ("sadar", 11), 3: ("exact", 12), 4: ("rejected", None), 5: ("ambiguous", None), 6: ("no candidates", None), 7: ("rejected", None)}


def test_aliases_of_the_hierarchy(spark):
    level = spark.createDataFrame([(0, 1, "Bogura", "বগুড়া")], "parent int, cand_id int, cand string, cand_bn string")
    units = spark.createDataFrame([("Bogra",), ("Bogura",)], "district string")
    assert [r.district_id for r in text.match_hierarchy(units, [("district", level)], {"Bogra": "Bogura"}).collect()] == [1, 1]


def grid(spark, cells):
    return spark.createDataFrame([(1, r, c) for r, c in cells], "f int, r int, c int")


def snake(n):
    return [(r, c) for r in range(n) for c in range(n) if r % 2 == 0 or c == (n - 1 if r % 4 == 1 else 0)]


def spiral(n):
    out, r, c, way, seen = [], 0, 0, 0, set()
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    free = lambda a, b: 0 <= a < n and 0 <= b < n and (a, b) not in seen
    while True:
        seen.add((r, c))
        out.append((r, c))
        for turn in (0, 1):
            i, j = steps[(way + turn) % 4]
            if free(r + i, c + j) and (r + 2 * i, c + 2 * j) not in seen:
                way, r, c = (way + turn) % 4, r + i, c + j
                break
        else:
            return out


@pytest.mark.parametrize("shape", [snake(256), spiral(256), snake(20) + [(r + 40, c) for r, c in spiral(24)]])
def test_winding_components_are_whole(spark, shape):
    zones = Counter(r.zone for r in frames.components(grid(spark, shape), ["f"]).collect())
    left, want = set(shape), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            r, c = todo.pop()
            n += 1
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        want.append(n)
    assert sorted(zones.values()) == sorted(want)


def test_simplified_line_is_douglas_peucker():
    rng = np.random.default_rng(5)

    def recursive(p, t):
        if len(p) < 3:
            return [*range(len(p))]
        way = p[-1] - p[0]
        d = [abs(way[0] * (q[1] - p[0][1]) - way[1] * (q[0] - p[0][0])) / np.hypot(*way) for q in p[1:-1]]
        k = int(np.argmax(d)) + 1
        if d[k - 1] <= t:
            return [0, len(p) - 1]
        return recursive(p[: k + 1], t)[:-1] + [k + i for i in recursive(p[k:], t)]

    for n in (2, 3, 10, 200):
        points = np.cumsum(rng.normal(size=(n, 2)), axis=0)
        for t in (0.01, 0.7, 5):
            assert np.flatnonzero(spatial.simplified(points, t)).tolist() == recursive(points, t)


def test_clip_to_a_box(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    rows = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring], *box) for box in ((1.0, 1.0, 4.0, 4.0), (2.0, 2.0, 20.0, 20.0), (11.0, 11.0, 12.0, 12.0), (-1.0, -1.0, 30.0, 30.0))], "ring array<struct<x:double,y:double>>, w double, s double, e double, n double")
    got = spatial.clipped(rows, "ring", ("w", "s", "e", "n"), "part").select(F.when(F.size("part") > 2, spatial.ring_area(F.col("part"))).otherwise(0.0).alias("a")).collect()
    assert [round(r.a, 6) for r in got] == [9.0, 18.0, 0.0, 50.0]


def test_offset_of_pooled_pixels(spark):
    rng = np.random.default_rng(6)
    values = [(f"m{m}", c, float(v)) for m in range(5) for c, v in enumerate(np.append(rng.normal(-0.3, 0.05, 900), rng.normal(0.4, 0.05, 300)).clip(-1, 1))]
    rows = spark.createDataFrame(values, "month string, cell int, v double")
    modes = thresholds.land_mode(rows, ["month"], -1.0, 1.0)
    got = thresholds.calibrated_offset(rows, modes, -1.0, 1.0, every=1).first().offset
    v = np.array([x for _, _, x in values])
    edges = np.linspace(v.min(), v.max(), 257)
    n, _ = np.histogram(v, edges)
    mid = (edges[1:] + edges[:-1]) / 2
    between = [0.0 if not n[: k + 1].sum() or not n[k + 1 :].sum() else n[: k + 1].sum() * n[k + 1 :].sum() * (np.average(mid[: k + 1], weights=n[: k + 1]) - np.average(mid[k + 1 :], weights=n[k + 1 :])) ** 2 for k in range(256)]
    middle = np.median([r.mode for r in modes.collect()])
    assert abs(got - (mid[int(np.argmax(between))] - middle)) < 0.02
    assert thresholds.calibrated_offset(rows.where("cell < 3"), modes, -1.0, 1.0).first().offset == 0.15


def test_stream_gives_what_the_batch_gives(spark):
    got = {(str(r.day), r.event_type): (r.n, r["mean"]) for r in run_to_end(spark, f"{SF}/events.parquet").collect()}
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).collect()
    assert got == {(str(r.day), r.event_type): (r.n, r["mean"]) for r in want}


def test_files_are_found_by_month(spark, tmp_path):
    for name in ("at_risk_households_2024-12.csv", "at_risk_households_2025-03.csv", "at_risk_households.csv", "metrics_m_1.json", "metrics_m_2.json", "metrics_n_9.json"):
        (tmp_path / name).write_text("x")
    found = tables.newest(tables.files(spark, f"file://{tmp_path}", "*.csv")).first()
    assert found.month == "2025-03" and Path(found.name).name == "at_risk_households_2025-03.csv"
    assert tables.last_named(tables.files(spark, f"file://{tmp_path}", "*.json"), "metrics_m_").first().name == "metrics_m_2.json"
    assert tables.newest(tables.files(spark, f"file://{tmp_path}", "*.json")).count() == 0


@pytest.mark.parametrize("block", [4, 7, 256])
def test_stencils_do_not_see_the_blocks(spark, block, monkeypatch):
    """Morphology, boundary, median and gradients against plain loops, on frames with holes, whatever the blocks."""
    rng = random.Random(block)
    monkeypatch.setattr(frames.by_blocks, "__defaults__", (block,))
    cells = {(f, r, c): rng.random() < 0.6 for f in (0, 1) for r in range(13) for c in range(11) if rng.random() < 0.95}
    v = {k: None if rng.random() < 0.1 else round(rng.random(), 3) for k in cells}
    df = spark.createDataFrame([(*k, int(m), v[k]) for k, m in cells.items()], "f int, r int, c int, m int, v double")
    ball = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) <= 2]
    near = lambda k, steps: [(k[0], k[1] + i, k[2] + j) for i, j in steps]
    got = {(x.f, x.r, x.c): x for x in frames.bank_band(df, ["f"], 2).collect()}
    assert got.keys() == cells.keys()
    for k, x in got.items():
        d, e = any(cells.get(q) for q in near(k, ball)), not any(cells.get(q) is False for q in near(k, ball))
        assert (x.d, x.e, x.band) == (d, e, d and not e)
    cross = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    assert {(x.f, x.r, x.c) for x in frames.boundary(df, ["f"]).collect()} == {k for k, m in cells.items() if m and any(cells.get(q) is False for q in near(k, cross))}
    assert {(x.f, x.r, x.c): x.d for x in frames.dilate(df, ["f"], 1).collect()} == {k: int(any(cells.get(q) for q in near(k, [*cross, (0, 0)]))) for k in cells}
    for x in frames.sobel(df.withColumn("m", F.col("m").cast("double")), ["f"], "m").collect():
        at = lambda i, j, x=x: float(cells.get((x.f, x.r + i, x.c + j), False))
        assert x.gx == sum((2 - abs(i)) * j * at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)) and x.gy == sum((2 - abs(j)) * i * at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))
    middle = {f: float(np.median([y for k, y in v.items() if k[0] == f and y is not None])) for f in (0, 1)}
    for x in frames.median3(df, ["f"], 13, 11).collect():
        k = (x.f, x.r, x.c)
        ask = [(x.f, min(12, max(0, x.r + i)), min(10, max(0, x.c + j))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        want = np.median([middle[x.f] if v[q] is None else v[q] for q in ask if q in v])
        assert x.smooth is None if v[k] is None else abs(x.smooth - want) < 1e-9


def test_rings_hold_their_cells(spark):
    rng = random.Random(11)
    cells = {(z, r, c) for z in range(4) for r in range(9) for c in range(9) if rng.random() < 0.6} | {(9, r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)} | {(8, 0, 0), (8, 1, 1)}
    rows = rings.zone_rings(spark.createDataFrame(sorted(cells), "zone int, r int, c int"), ["zone"]).collect()
    for z in {z for z, _, _ in cells}:
        assert sum(x.area for x in rows if x.zone == z) == sum(q == z for q, _, _ in cells)
        for x in (x for x in rows if x.zone == z):
            corners = [(p.x, p.y) for p in x.corners]
            assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(corners, corners[1:] + corners[:1], strict=True))
    assert sorted(x.area for x in rows if x.zone == 9) == [-1.0, 25.0] and [len(x.corners) for x in rows if x.zone == 9] == [4, 4]
    assert [x.area for x in rows if x.zone == 8] == [2.0]


def test_recurrent_forecast_is_plain_loops():
    rng = np.random.default_rng(2)
    pair = lambda *shape: (rng.normal(size=shape), rng.normal(size=shape[0]))
    weights = {"layers": [pair(8, 3, 3, 3), pair(8, 4, 3, 3)], "inner": pair(2, 2, 3, 3), "outer": pair(3, 2, 1, 1), "norm": (rng.normal(size=2), rng.normal(size=2))}
    x = rng.normal(size=(4, 1, 5, 6))

    def conv(a, w, b):
        out = np.zeros((len(b), *a.shape[1:]))
        for o in range(len(b)):
            for y in range(a.shape[1]):
                for z in range(a.shape[2]):
                    out[o, y, z] = b[o] + sum(w[o, q, i, j] * a[q, y + i - w.shape[2] // 2, z + j - w.shape[3] // 2] for q in range(len(a)) for i in range(w.shape[2]) for j in range(w.shape[3]) if 0 <= y + i - w.shape[2] // 2 < a.shape[1] and 0 <= z + j - w.shape[3] // 2 < a.shape[2])
        return out

    s = lambda a: 1 / (1 + np.exp(-a))
    state = [(np.zeros((2, 5, 6)), np.zeros((2, 5, 6))) for _ in range(2)]
    for frame in x:
        a = frame
        for d, (w, b) in enumerate(weights["layers"]):
            g = conv(np.concatenate([a, state[d][0]]), w, b)
            cell = s(g[2:4]) * state[d][1] + s(g[:2]) * np.tanh(g[6:])
            a = s(g[4:6]) * np.tanh(cell)
            state[d] = (a, cell)
    y = conv(a, *weights["inner"])
    y = np.stack([(c - c.mean()) / np.sqrt(c.var() + 1e-5) * k + m for c, k, m in zip(y, *weights["norm"], strict=True)])
    y = y * np.vectorize(lambda q: 0.5 * (1 + math.erf(q / math.sqrt(2))))(y)
    assert np.allclose(forecast.logits(x, weights), conv(y, *weights["outer"]))


def test_forecast_refuses_other_spans(spark):
    rows = spark.createDataFrame([(0, t, 0, 0, 1.0) for t in range(2)], "tile int, t int, r int, c int, v double")
    with pytest.raises(Exception, match="3 frames are needed"):
        forecast.recurrent_forecast(rows, ["tile"], {}, 3).collect()


def test_resized_grid():
    rng = np.random.default_rng(3)
    grid = rng.normal(size=(4, 4, 3))
    assert np.allclose(forecast.resized(grid, 4), grid)
    assert np.allclose(forecast.resized(np.ones((3, 3, 2)), 7), 1)
    k = lambda x: 1.25 * x**3 - 2.25 * x**2 + 1 if x <= 1 else -0.75 * (x**3 - 5 * x**2 + 8 * x - 4) if x < 2 else 0
    at = lambda o, n, m: (o + 0.5) * n / m - 0.5
    got = forecast.resized(grid, 6)
    for u in range(6):
        for v in range(6):
            y, z = at(u, 4, 6), at(v, 4, 6)
            want = sum(k(abs(y - p)) * k(abs(z - q)) * grid[min(3, max(0, p)), min(3, max(0, q))] for p in range(-3, 8) for q in range(-3, 8))
            assert np.allclose(got[u, v], want)
