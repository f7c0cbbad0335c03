"""What the findings of round 4 asked for."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from fluvia.llm import setsketch, simhash
from fluvia.llm.graph import connected_components
from fluvia.operators import spatial

KEYS = "key bigint, node bigint, low bigint, n bigint"


def roots(spark, pairs):
    return {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(pairs), "u bigint, v bigint")).collect()}


@pytest.mark.parametrize("slice_bytes", [300, 2 << 20])
def test_blocks_meet_probes_bit_by_bit(spark, monkeypatch, slice_bytes):
    rng = random.Random(17)
    sets = [np.unique(np.array([rng.randrange(15) for _ in range(14)], np.uint64)) for _ in range(90)]
    groups = spark.createDataFrame([(k, i, 0, len(range(k, 90, 2))) for k in (0, 1) for i in range(k, 90, 2)], KEYS)
    grams = spark.createDataFrame([(i, g.tobytes()) for i, g in enumerate(sets)], "node bigint, grams binary")
    none = spark.createDataFrame([], "node bigint, component bigint")
    monkeypatch.setattr(simhash.slices, "__defaults__", (slice_bytes,))
    links = {(min(r), max(r)) for r in simhash.missed_links(groups, none, grams, 0.8, 7).collect()}
    near = {(i, j) for (i, x), (j, y) in combinations(enumerate(sets), 2) if (j - i) % 2 == 0 and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))}
    assert links <= near and roots(spark, links) == roots(spark, near)


def test_hot_keys_do_not_meet_in_one(spark, monkeypatch):
    """Two texts with 40 copies each, far apart among each other; their keys are hot."""
    rng = random.Random(18)
    rows = []
    for _ in range(2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(40):
            w = list(base)
            for k in rng.sample(range(120), 6):
                w[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    made = {}
    store = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: made.setdefault(name, []).append(store(df, name)) or made[name][-1])
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    got = setsketch.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.where("component_id % 80 < 40").count() >= 40 and got.where("(doc_id < 40) != (component_id < 40)").count() == 0
    hot = max(r.probes for k in made["open-keys"] for r in k.collect())
    assert 4 < hot <= 40  # no key of both texts

    nodes = spark.createDataFrame([(i, simhash.bands(simhash.hashes(t.encode(), 4)).tobytes()) for i, t in rows], "node bigint, packed binary")
    groups = simhash.key_groups(nodes)
    grams = spark.createDataFrame([(i, np.unique(simhash.hashes(t.encode(), 4)).tobytes()) for i, t in rows], "node bigint, grams binary")
    simhash.missed_links(groups, spark.createDataFrame([], "node bigint, component bigint"), grams, 0.8, 4, nodes)
    cut = made["longer-keys"][-1]
    assert cut.count() and cut.groupBy("key").agg({"node": "max"}).count() == cut.selectExpr("key", "node < 40").distinct().count()


@pytest.mark.parametrize(("words", "size"), [(40, 30), (9000, 30), (60000, 5000)])
def test_common_elements_are_counted(words, size):
    rng = np.random.default_rng(words)
    left, right = ([np.unique(rng.integers(0, words, rng.integers(0, size), np.uint64) << np.uint64(40)) for _ in range(k)] for k in (12, 17))
    left[3] = right[5] = np.zeros(0, np.uint64)
    assert simhash.in_common(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_keys_of_few_fingerprints_are_linked_side_by_side(monkeypatch):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 64, 400, np.uint64)
    key = np.sort(rng.integers(0, 500, 4000).astype(np.uint64))
    key[-60:] = key[-60]
    fp = np.where(rng.random(4000) < 0.5, seeds[key.astype(int) % 400], rng.integers(0, 1 << 64, 4000, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000, np.uint64))
    for most in (None, 20):
        a, b, _, hot = simhash._key_links(key, fp, 4, most)
        assert all(key[a] == key[b]) and all(np.bitwise_count(fp[a] ^ fp[b]) <= 4)
        for k in np.unique(key):
            rows = np.flatnonzero(key == k)
            mine = [(int(x), int(y)) for x, y in zip(a, b, strict=True) if key[x] == k]
            assert len(mine) < len(rows)
            if most and len(rows) > most:
                assert not mine and {*rows} <= {*hot}
                continue
            label = {x: x for x in rows.tolist()}
            near = {x: x for x in rows.tolist()}
            pairs = [(x, y) for x, y in combinations(rows.tolist(), 2) if int(fp[x] ^ fp[y]).bit_count() <= 4]
            for parts, links in ((label, mine), (near, pairs)):
                for x, y in links:
                    low, high = sorted((parts[x], parts[y]))
                    parts.update({z: low for z, p in parts.items() if p == high})
            assert label == near
    calls = []
    monkeypatch.setattr(simhash, "_forest", lambda *a: calls.append(a))
    simhash._key_links(np.repeat(np.arange(100, dtype=np.uint64), 3), rng.integers(0, 1 << 64, 300, np.uint64), 10, 4096)
    assert not calls


def test_table_rows_travel_as_parts(spark, monkeypatch):
    rng = random.Random(19)
    fp = sorted({rng.getrandbits(63) for _ in range(300)})
    nodes = spark.createDataFrame([(f ^ (7 * flip), 2 * i + flip) for i, f in enumerate(fp) for flip in (0, 1)] + [(fp[0], 1000)], "fp bigint, rep bigint")
    monkeypatch.setattr(simhash, "PART_ROWS", 5000)
    monkeypatch.setattr(simhash, "ENTERED", 100)
    for radius, segments in ((3, simhash.HALVES), (10, simhash.FIFTHS)):
        links = simhash.near_links(nodes, radius, segments, 50)
        got = {(r.u, r.v) for r in links.collect()}
        assert {(2 * i, 2 * i + 1) for i in range(len(fp))} | {(0, 1000)} <= got and len(got) < 320


def test_all_polygons_of_a_key_are_counted(spark):
    ring = lambda x, w: [(x, 0.0), (x + w, 0.0), (x + w, 4.0), (x, 4.0)]
    rows = [(1, ring(0.0, 4.0)), (1, ring(0.0, 4.0)), (1, ring(2.0, 9.0)), (2, ring(2.0, 9.0)), (None, ring(2.0, 9.0)), (None, ring(30.0, 4.0)), (3, ring(50.0, 1.0))]
    polygons = spark.createDataFrame(rows, "k int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(x / 2, y / 2) for x in range(70) for y in range(10) for _ in range(1 + x % 3)], "x double, y double")
    got = sorted(map(tuple, spatial.counts_in_polygons(points, polygons, "k", 3).collect()), key=repr)
    plain = spatial.points_in_polygons(points, polygons, 3).groupBy("k").count()
    assert got == sorted(map(tuple, plain.collect()), key=repr) and len(got) == 3


@pytest.mark.parametrize("name", ["points_in_polygons", "mapping_density", "counts_in_coverage"])
def test_repeated_suppliers_count_as_in_sql(spark, tmp_path, name):
    c = duckdb.connect()
    c.execute("CREATE TABLE supplier AS SELECT range % 40 AS s_suppkey FROM range(55)")
    c.execute("CREATE TABLE customer AS SELECT range * 7 AS c_custkey FROM range(3000)")
    for t in ("supplier", "customer"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = c.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
