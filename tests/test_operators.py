import duckdb
import pytest
from pyspark.sql import functions as F

from fluvia.functions import raster, text
from fluvia.operators import frames, risk, series, spatial, thresholds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("key", "offset", "expected"), [("2024-12", 1, "2025-01"), ("2024-01", -1, "2023-12"), ("2024-03", 12, "2025-03"), ("2024-03", 0, "2024-03")])
def test_month_shift(spark, key, offset, expected):
    assert one(spark, raster.shift_month(F.lit(key), F.lit(offset))) == expected


@pytest.mark.parametrize(("green", "dark", "expected"), [(0.3, 0.1, 0.5), (0.1, 0.3, -0.5), (0.0, 0.0, None), (None, 0.2, None), (0.5, -0.4, 1.0)])
def test_water_index(spark, green, dark, expected):
    got = one(spark, raster.water_index(F.lit(green).cast("double"), F.lit(dark).cast("double")))
    assert got is None if expected is None else abs(got - expected) < 1e-9


def test_codec_truncates_and_marks_missing(spark):
    assert one(spark, raster.pack(F.lit(-0.12349))) == -1234
    assert one(spark, raster.pack(F.lit(None).cast("double"))) == -32768
    assert one(spark, raster.unpack(F.lit(-32768).cast("smallint"))) is None


def test_unknown_platform_raises(spark):
    rows = spark.createDataFrame([("sputnik", ["tm"])], "platform string, instruments array<string>")
    with pytest.raises(Exception, match="unknown platform"):
        raster.with_sensor(rows).collect()


def series_of(spark, values):
    return spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "k int, t int, v double")


def test_gap_fill_is_linear_inside_and_holds_at_the_ends(spark):
    got = series.gap_fill(series_of(spark, [None, 0.0, None, None, None, 1.0, None]), ["k"], 3).orderBy("t").collect()
    assert [r.filled for r in got] == [0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0]
    assert [r.was_filled for r in got] == [True, False, True, True, True, False, True]


def test_gap_fill_refuses_long_gaps(spark):
    got = series.gap_fill(series_of(spark, [0.0] + [None] * 4 + [1.0] + [None] * 5), ["k"], 3).orderBy("t").collect()
    assert [r.filled for r in got] == [0.0, None, None, None, None, 1.0, 1.0, 1.0, 1.0, None, None]


def test_even_subsample(spark):
    rows = spark.range(37).select(F.lit("a").alias("tile"), F.col("id").alias("t0"))
    assert sorted(r.t0 for r in series.even_subsample(rows, 10, ["tile", "t0"]).collect()) == [int(i * 37 / 10) for i in range(10)]


def mask(spark, cells, side=8):
    return spark.createDataFrame([(1, r, c, int((r, c) in cells)) for r in range(side) for c in range(side)], "f int, r int, c int, m int")


def test_displacement_is_shift_times_resolution(spark):
    edge = lambda at: spark.createDataFrame([(1, r, at) for r in range(8)], "k int, r int, c int")
    assert frames.displacement(edge(2), edge(5), ["k"], 30.0, 16).first().metres == 90.0


def test_displacement_has_no_bound(spark):
    """Nearest cells beyond the reach, one of them hidden by a farther cell in a nearer block."""
    a, b = [(0, 0), (15, 15), (40, 7)], [(31, 31), (32, 15), (300, 4)]
    rows = lambda cells: spark.createDataFrame([(1, *p) for p in cells] + ([(2, 0, 0)] if cells is a else []), "k int, r int, c int")
    mean = lambda x, y: sum(min(((p - r) ** 2 + (q - s) ** 2) ** 0.5 for r, s in y) for p, q in x) / len(x)
    got = frames.displacement(rows(a), rows(b), ["k"], 30.0, 16).collect()
    assert [(r.k, r.metres) for r in got] == [(1, pytest.approx((mean(a, b) + mean(b, a)) / 2 * 30, abs=1e-3))]


def test_components_join_diagonals(spark):
    cells = {(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (7, 0)}
    got = frames.components(mask(spark, cells).where("m = 1"), ["f"]).groupBy("zone").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 3]


def test_components_join_long_arms(spark):
    """Two arms of 200 cells that meet at the far end are one component."""
    arms = [(1, r, c) for c in (0, 2) for r in range(200)] + [(1, 200, 1)]
    got = frames.components(spark.createDataFrame(arms, "f int, r int, c int"), ["f"]).groupBy("zone").count().collect()
    assert [tuple(r) for r in got] == [(0, 401)]


def test_erosion_takes_outside_as_on(spark):
    full = {(r, c) for r in range(8) for c in range(8)}
    assert frames.erode(mask(spark, full), ["f"], 2).where("e = 0").isEmpty()
    assert frames.boundary(mask(spark, full), ["f"]).isEmpty()


def test_points_on_an_edge_are_outside(spark):
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)])], "id int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 6.0), (3, 0.0, 5.0), (4, 2.0, 2.0), (5, 5.0, 4.0)], "p int, x double, y double")
    assert sorted(r.p for r in spatial.points_in_polygons(points, ring, 4.0).collect()) == [1, 4]
    assert ring.select(spatial.ring_area(F.col("ring")).alias("a")).first().a == 70.0


def test_overlap_is_counted_once(spark):
    cells = spark.createDataFrame([(1, 0, c) for c in range(6)], "zone int, r int, c int")
    units = spark.createDataFrame([(0, c, "a") for c in range(4)] + [(0, c, "b") for c in range(3, 5)], "r int, c int, unit string")
    pieces = spatial.zone_pieces(spatial.one_unit_per_cell(spatial.identity(cells, units)), 1.0)
    assert {r.unit: r.n_cells for r in pieces.collect()} == {"a": 4, "b": 1, None: 1}


def test_density_bands(spark):
    rows = spark.createDataFrame([(1, 5, 2.0), (2, None, 2.0), (3, 500, 2.0), (4, 9, 0.5), (5, 9, None)], "id int, n int, area_km2 double")
    assert {r.id: r.mapping for r in spatial.density(rows).collect()} == {1: "low", 2: "low", 3: "high", 4: "not measured", 5: "not measured"}


def test_risk_table_keeps_null_keys_and_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("a", "erosion", 2.0), ("a", "accretion", 1.0), (None, "erosion", 3.0), (None, "accretion", 1.0)], "gid_union string, kind string, area_ha double")
    got = {r.gid_union: r for r in risk.risk_table(rows, ["gid_union"], F.lit(1), 0.8).collect()}
    assert got["a"].net_land_change_ha == -1.0 and got[None].erosion_ha == 3.0
    assert got["a"].households_est == 2 and got["a"].persons_est == 9


def test_state_ignores_what_is_not_valid():
    assert risk.parse_state("?min=7&sort=colour&dir=up&q=") == risk.STATE
    assert risk.parse_state("?district=X&min=100&sort=union&dir=asc&q=a+b") == {"district": "X", "query": "a b", "minErosion": 100, "sort": "union", "dir": "asc"}


def test_checks_raise(spark):
    rows = spark.createDataFrame([(1, "low"), (1, None)], "id int, band string")
    with pytest.raises(ValueError, match="repeated_id"):
        risk.require(risk.quality(rows, "id", ["band"], {"band": ["low"]}))


@pytest.mark.parametrize(("a", "b"), [("Raumari", "Rowmari"), ("Haldia", "Holdia"), ("Mohongonj", "Mahanganj"), ("CharBhurungamari", "Char Bhurungamari")])
def test_spellings_share_a_key(spark, a, b):
    assert one(spark, text.latin_key(F.lit(a))) == one(spark, text.latin_key(F.lit(b)))


def test_names(spark):
    assert one(spark, text.bengali_key(F.lit("হলদিয়া"))) == "hld"
    assert one(spark, text.title_name(F.lit("<html><title>হোম | হলদিয়া ইউনিয়ন</title>"))) == "হলদিয়া"
    assert one(spark, text.clean_unit_name(F.lit("১নং বঙ্গসোনাহাট ইউনিয়ন পরিষদ"))) == "বঙ্গসোনাহাট"
    assert one(spark, text.same_name(F.lit("a- b"), F.lit("ab"))) is True
    assert one(spark, text.display_name(F.lit("SaheberAlga(Part)"))) == "Saheber Alga (Part)"


def test_csv_cells(spark):
    for value, cell in (("=1", "'=1"), ('a"b', '"a""b"'), ("a,b", '"a,b"'), (None, "")):
        assert one(spark, text.csv_text(F.lit(value).cast("string"))) == cell
    assert one(spark, text.csv_float(F.lit(3.0))) == "3.0"


def test_otsu_and_mode_need_values(spark):
    rows = spark.range(2000).select(F.lit("a").alias("k"), F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.7).alias("v"))
    assert 0.2 <= thresholds.otsu(rows, ["k"], -1.0, 1.0).first().cut <= 0.7
    assert thresholds.otsu(rows.limit(10), ["k"], -1.0, 1.0).isEmpty()
    assert thresholds.land_mode(rows.limit(10), ["k"], -1.0, 1.0).isEmpty()


def test_registered_sql_agrees(spark):
    """A few queries here; the driver compares all of them."""
    from fluvia.plans import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("customer", "events", "lineitem", "nation", "orders", "region", "supplier", "part", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("risk_table", "gap_fill", "bank_band", "threshold_sweep", "change_components", "points_in_polygons"):
        got = registry.QUERIES[name](spark, sf).toPandas()
        want = con.execute(registry.ORACLE_SQL[name]).df()[list(got.columns)]
        key = lambda rows: sorted(tuple("-" if v != v or v is None else round(float(v), 5) if isinstance(v, int | float) else str(v) for v in r) for r in rows.itertuples(index=False))
        assert key(got) == key(want), name


def test_states_of_a_table_are_parsed_like_one(spark):
    given = ["", None, "?q=a%20b&min=10", "district=X&sort=none&dir=up&min=11", "min=x&q=1&q=2", "sort=union&dir=asc&district=%E0%A6%95&min=1e2"]
    rows = risk.parse_states(spark.createDataFrame([(s,) for s in given], "search string")).collect()
    for r in rows:
        want = risk.parse_state(r.search or "")
        assert (r.district, r["query"], r.min_erosion, r.sort, r.dir) == (want["district"], want["query"], want["minErosion"], want["sort"], want["dir"]), r.search


def test_hierarchy_matches_only_under_the_parent(spark):
    schema = "parent int, cand_id int, cand string, cand_bn string"
    top = spark.createDataFrame([(0, 1, "Rangpur", "রংপুর"), (0, 2, "Bogra", "বগরা")], schema)
    low = spark.createDataFrame([(1, 11, "Kamarpur", "কামারপুর"), (2, 12, "Sonatala", "সোনাতলা")], schema)
    units = spark.createDataFrame([(1, "Rangpur", "Kamarpur"), (2, "Bogra", "Kamarpur"), (3, "Elsewhere", "Kamarpur"), (4, None, "Sonatala"), (5, "Bogra", "Sonatala"), (6, "Rangpur", "Kamarpur")], "n int, district string, unit string")
    got = {r.n: (r.district_id, r.unit_id) for r in text.match_hierarchy(units, [("district", top), ("unit", low)]).collect()}
    assert got == {1: (1, 11), 2: (2, None), 3: (None, None), 4: (None, None), 5: (2, 12), 6: (1, 11)}


def test_markdown_table_marks_missing(spark):
    rows = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    got = text.markdown_table(rows, [F.col("k").cast("string"), F.col("v")], ["k", "v"], ["k"]).first().document
    assert got == "| k | v |\n|---|---|\n| 1 | x |\n| 2 | — |"


def test_answered_cells_are_unique(spark):
    asked = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "i int, j int")
    assert sorted(map(tuple, spatial.answered_cells(asked, asked.where("i = 1"), ["i", "j"]).collect())) == [(1, 1, True), (2, 1, False)]


def test_columns_whose_numbers_would_meet_are_refused(spark):
    from fluvia.operators import frames

    far = spark.createDataFrame([(0, 0, 1_000_064), (0, 1, 64)], "f int, r int, c int")
    for rows in (far, spark.createDataFrame([(0, 0, -1)], "f int, r int, c int")):
        with pytest.raises(Exception, match="columns must be numbers"):
            frames.components(rows, ["f"]).collect()


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from fluvia import storage

    unset = SimpleNamespace(get=lambda key, other=None: other)
    on = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master))
    assert storage.shared_folder(on("local[2]")).startswith("file:")
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            storage.shared_folder(on(master))
