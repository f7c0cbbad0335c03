"""Queries of the presentation: names, numbers, orders, cards and checks of the table's small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import present, raster, text
from fluvia.operators import order, risk
from fluvia.plans.oracle import UR
from fluvia.plans.registry import table, union_rows
from fluvia.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'হলদিয়া' ELSE c_name END AS shown_bn, c_name AS shown_en FROM customer")
def place_names(spark, d):
    bn = F.when(F.col("c_custkey") % 3 == 0, "হলদিয়া")
    return table(spark, d, "customer").select("c_custkey", present.place_name(F.col("c_name"), bn, "bn").alias("shown_bn"), present.place_name(F.col("c_name"), bn, "en").alias("shown_en"))


@query("SELECT p_partkey, nfc_normalize(lower(p_name || ' É' || chr(101) || chr(769))) AS folded FROM part")
def folded_names(spark, d):
    return table(spark, d, "part").select("p_partkey", present.fold(F.concat("p_name", F.lit(" Éé"))).alias("folded"))


def _whole(value: str, lang: str = "en") -> str:
    n = f"(floor({value} + 0.5)::BIGINT)"
    if lang == "en":
        return f"format('{{:,}}', {n})"
    tail = f"right(abs({n})::VARCHAR, 3)"
    head = f"CASE WHEN abs({n}) > 999 THEN regexp_replace(reverse(regexp_replace(reverse((abs({n}) // 1000)::VARCHAR), '(..)', '\\1,', 'g')), '^,', '') || ',' ELSE '' END"
    return f"translate(CASE WHEN {n} < 0 THEN '-' ELSE '' END || {head} || {tail}, '0123456789', '০১২৩৪৫৬৭৮৯')"


def _decimal(value: str) -> str:
    t = f"(floor({value} * 10 + 0.5)::BIGINT)"
    return f"format('{{:,}}', {t} // 10) || CASE WHEN {t} % 10 > 0 THEN '.' || ({t} % 10)::VARCHAR ELSE '' END"


NUM = "o_totalprice * 37 - 3000000"


@query(f"""SELECT o_orderkey, {_whole(NUM)} AS whole_en, {_whole(NUM, 'bn')} AS whole_bn, CASE WHEN floor({NUM} + 0.5) > 0 THEN '+' ELSE '' END || {_whole(NUM)} AS signed_en,
    CASE WHEN o_totalprice / 1e6 > 0 AND o_totalprice / 1e6 < 0.5 THEN '<1' ELSE {_whole('o_totalprice / 1e6')} END AS hectares_en,
    CASE WHEN o_totalprice / 4e6 < 0.05 THEN '<0.1' WHEN o_totalprice / 4e4 < 10 THEN {_decimal('o_totalprice / 4e4')} ELSE {_whole('o_totalprice / 4e4')} END AS density_en,
    {_whole('o_totalprice / 5000')} || '%' AS percent_en FROM orders""")
def number_styles(spark, d):
    """Numbers in the styles of the page; halves go upwards."""
    p = F.col("o_totalprice")
    n = p * 37 - 3_000_000
    return table(spark, d, "orders").select(
        "o_orderkey", present.whole(n, "en").alias("whole_en"), present.whole(n, "bn").alias("whole_bn"), present.signed(n, "en").alias("signed_en"), present.hectares(p / 1e6, "en").alias("hectares_en"),
        F.when(p / 4e6 < 0.05, present.density(p / 4e6, "en")).otherwise(present.density(p / 4e4, "en")).alias("density_en"), present.percent(p / 5000 / 100, "en").alias("percent_en"),
    )



@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%B %Y') AS name_en, ['জানুয়ারি', 'ফেব্রুয়ারি', 'মার্চ', 'এপ্রিল', 'মে', 'জুন', 'জুলাই', 'আগস্ট', 'সেপ্টেম্বর', 'অক্টোবর', 'নভেম্বর', 'ডিসেম্বর'][month(o_orderdate)] || ' ' || translate(year(o_orderdate)::VARCHAR, '0123456789', '০১২৩৪৫৬৭৮৯') AS name_bn, round(year(o_orderdate) + (month(o_orderdate) - 1) / 12, 6) AS at, strftime(date_trunc('month', o_orderdate) - INTERVAL 5 MONTH, '%Y-%m') AS before, strftime(date_trunc('month', o_orderdate) + INTERVAL 14 MONTH, '%Y-%m') AS after FROM orders")
def month_keys(spark, d):
    key = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    rows = table(spark, d, "orders").select(key).distinct()
    m = F.col("month")
    return rows.select("month", present.month_name(m, "en").alias("name_en"), present.month_name(m, "bn").alias("name_bn"), F.round(present.fractional_year(m), 6).alias("at"), raster.shift_month(m, F.lit(-5)).alias("before"), raster.shift_month(m, F.lit(14)).alias("after"))


@query("SELECT c_custkey, strftime(DATE '2024-11-01' + to_months(k::INT), '%Y-%m') AS month FROM customer, range(4) r(k) WHERE k <= c_custkey % 4")
def month_ranges(spark, d):
    """All months from one to another, both included."""
    first = F.lit("2024-11")
    rows = table(spark, d, "customer").select("c_custkey", first.alias("first"), raster.shift_month(first, (F.col("c_custkey") % 4).cast("int")).alias("last"))
    return rows.select("c_custkey", F.explode(raster.month_range(F.col("first"), F.col("last"))).alias("month"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '2018–' || (2019 + n_nationkey)::VARCHAR ELSE 'all years' END AS period FROM nation")
def test_periods(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", present.test_period(F.when(k % 3 == 0, F.concat(F.lit("test 2018-"), (2019 + k).cast("string"))).otherwise("all years"), "en").alias("period"))


@query("SELECT n_nationkey, 'at_risk_2025-03_' || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Cox_s_Bazar_' || n_nationkey::VARCHAR || '_' ELSE n_name || '_' END || 'filtered.csv' AS file FROM nation")
def file_names(spark, d):
    k = F.col("n_nationkey")
    district = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("Cox's Bazar "), k.cast("string"))).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", present.file_name(F.lit("2025-03"), district, "at_risk").alias("file"))


@query(f"WITH {UR}, m AS (SELECT max(erosion_ha) AS most FROM ur) SELECT gid_union, round(CASE WHEN erosion_ha > 0 THEN greatest(2, 100 * erosion_ha / most) ELSE greatest(0, 100 * erosion_ha / most) END, 6)::DOUBLE AS bar FROM ur, m")
def bar_shares(spark, d):
    return present.bar_share(union_rows(spark, d), "erosion_ha").select("gid_union", F.round("bar", 6).alias("bar"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 OR n_nationkey % 5 = 0 AS filtered, k AS new_sort, CASE WHEN k = 'erosion_ha' THEN CASE WHEN n_nationkey % 2 = 0 THEN 'desc' ELSE 'asc' END WHEN k = 'union' THEN 'asc' ELSE 'desc' END AS new_dir FROM nation, (SELECT unnest(['erosion_ha', 'union', 'persons_est']) AS k)")
def table_states(spark, d):
    """Whether a state filters, and what a click on each of three columns makes of its order."""
    k = F.col("n_nationkey")
    states = table(spark, d, "nation").select("n_nationkey", F.when(k % 2 == 0, "x").otherwise("").alias("district"), F.when(k % 3 == 0, "q").otherwise("  ").alias("q"), F.when(k % 5 == 0, 10).otherwise(0).alias("least"), F.when(k % 2 == 0, "asc").otherwise("desc").alias("dir"))
    clicked = states.withColumn("key", F.explode(F.array(*map(F.lit, ("erosion_ha", "union", "persons_est")))))
    sort, direction = present.toggled(F.lit("erosion_ha"), F.col("dir"), F.col("key"))
    return clicked.select("n_nationkey", present.is_filtered(F.col("district"), F.col("q"), F.col("least")).alias("filtered"), sort.alias("new_sort"), direction.alias("new_dir"))


def _zones(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.cast("bigint").alias("zone"), F.when(k % 5 > 0, (k % 30).cast("bigint")).alias("unit"), F.when(k % 2 == 0, "erosion").otherwise("accretion").alias("kind"), (F.col("s_acctbal") / 10000).alias("ha"))


@query("SELECT s_suppkey::BIGINT AS zone FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 30 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def zones_in_view(spark, d):
    units = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("unit"))
    return present.zones_in_view(_zones(spark, d), units).select("zone")


@query(f"""SELECT s_suppkey::BIGINT AS zone, CASE WHEN s_acctbal / 10000 > 0 AND s_acctbal / 10000 < 0.5 THEN '<1' ELSE {_whole('s_acctbal / 10000')} END || ' ha' AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'erosion' ELSE 'accretion' END AS kind, coalesce(n_name, 'outside') AS place,
    CASE WHEN n_name IS NOT NULL THEN {_whole('n_nationkey * 1234.0')} || ' / ' || CASE WHEN n_nationkey % 3 = 0 THEN 'unknown' ELSE {_whole('n_nationkey * 17')} END END AS totals FROM supplier LEFT JOIN nation ON s_suppkey % 5 > 0 AND n_nationkey = s_suppkey % 30""")
def zone_cards(spark, d):
    k = F.col("n_nationkey")
    units = table(spark, d, "nation").select(k.cast("bigint").alias("gid"), F.col("n_name").alias("name"), (k * 1234.0).alias("erosion_ha"), (k * 17).alias("households_est"), (k % 3 == 0).alias("unmapped"))
    return present.zone_cards(_zones(spark, d), units)


@query(f"""WITH {UR}, x AS (SELECT *, CASE WHEN length(gid_union) % 2 = 0 THEN NULL ELSE households_est / 8.0 END AS dens, erosion_ha > 0 AND buildings_osm = 0 AS un FROM ur)
    SELECT gid_union, CASE WHEN un THEN 'none mapped' ELSE buildings_osm::VARCHAR END AS buildings_shown, CASE WHEN un THEN 'unknown' ELSE households_est::VARCHAR END AS households_shown, "union" || coalesce(' ' || CASE WHEN dens > 0 AND dens < 0.05 THEN '<0.1' ELSE {_decimal('dens')} END, '') AS mapping_shown FROM x""")
def unit_cells(spark, d):
    """What a row shows: unknown is said, never 0. Densities here stay below 10."""
    rows = union_rows(spark, d)
    dens = F.when(F.length("gid_union") % 2 != 0, F.col("households_est") / 8.0)
    cells = present.unit_cells(risk.unmapped(F.col("erosion_ha"), F.col("buildings_osm")), F.col("buildings_osm"), F.col("households_est"), dens, F.col("union"))
    return rows.select("gid_union", *(c.alias(name) for name, c in cells.items()))


@query(f"WITH {UR} SELECT gid_union, erosion_ha FROM ur WHERE district IN ('NATION_1', 'NATION_2', 'NATION_17') AND erosion_ha >= 50")
def selected_districts(spark, d):
    return present.selected(union_rows(spark, d), ["NATION_1", "NATION_2", "NATION_17"], 50).select("gid_union", "erosion_ha")


@query(f"WITH {UR} SELECT count(*) AS n, round(sum(erosion_ha), 4) AS erosion_ha FROM ur WHERE gid_union IN (SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey)")
def restricted_units(spark, d):
    """Only units that pieces of change lie in."""
    asked = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("gid_union"))
    return present.restricted(union_rows(spark, d), asked, "gid_union").agg(F.count("*").alias("n"), F.round(F.sum("erosion_ha"), 4).alias("erosion_ha"))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY lower(p_name), p_partkey))::INT AS place FROM part")
def names_in_locale_order(spark, d):
    """The place of each name in the page's order, which sees no difference of case (these names have no accents)."""
    rows = table(spark, d, "part").withColumn("shown", F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name")))
    return order.placed(rows.orderBy(present.by_name(F.col("shown"), "en"), "p_partkey").select("p_partkey")).select("p_partkey", "place")


@query("SELECT n_name AS model, n_regionkey AS f1, (row_number() OVER (ORDER BY n_regionkey DESC, n_name))::INT AS rank, (row_number() OVER (ORDER BY n_regionkey, n_name))::INT AS rank_error FROM nation")
def ranked_models(spark, d):
    runs = table(spark, d, "nation").select(F.col("n_name").alias("model"), F.col("n_regionkey").alias("f1"))
    other = present.ranked_models(runs, "f1", False).select(F.col("model").alias("m"), F.col("rank").alias("rank_error"))
    return present.ranked_models(runs, "f1", True).join(other, F.col("model") == F.col("m")).drop("m")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'upazila' WHEN 1 THEN 'district' WHEN 2 THEN '' END AS of, CASE n_nationkey % 4 WHEN 0 THEN 'হলদিয়া পৌরসভা' WHEN 1 THEN 'বগুড়া পৌরসভা' WHEN 2 THEN 'পৌরসভা' END AS name FROM nation")
def municipalities(spark, d):
    k = F.col("n_nationkey")
    union = F.when(k % 4 == 0, "HaldiaPaurashava").when(k % 4 == 1, "Bogura Paurashava").when(k % 4 == 2, "Paurashava").otherwise("Tongi Paurashava")
    of = present.municipality_of(union, F.lit("Haldia Sadar"), F.lit("Bogura"))
    rows = table(spark, d, "nation").select("n_nationkey", of.alias("of"))
    return rows.withColumn("name", present.municipality_name(F.col("of"), F.lit("হলদিয়া সদর"), F.lit("বগুড়া")))


@query("SELECT p_partkey, p_name AS name, p_partkey % 2 = 0 AS same FROM part")
def title_names(spark, d):
    """Names from whole pages, and whether they are the name known: joiners, blanks and hyphens make no difference."""
    page = F.concat(F.lit("<html><TITLE lang=bn>Home | ১২ নং "), F.lit("হলদিয়া&nbsp;"), F.lit(", x</title>"), F.col("p_name"))
    other = F.when(F.col("p_partkey") % 2 == 0, "হল‍দিয়া").otherwise("বগুড়া")
    name = F.regexp_replace(text.title_name(page), "[\\s ]", "")
    rows = table(spark, d, "part").select("p_partkey", "p_name", text.same_name(name, other).alias("same"), name.alias("title"))
    return rows.select("p_partkey", F.when(text.same_name(F.col("title"), F.lit("হলদিয়া")), F.col("p_name")).alias("name"), "same")


@query("WITH t AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders), s AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem) SELECT month, 'table_' || month || '.csv' AS table_file, 'zones_' || month || '.geojson' AS zone_file FROM t JOIN s USING (month)")
def files_by_month(spark, d):
    """Files of a month that belong together, by the month in their names."""
    name = lambda t, col, form: table(spark, d, t).select(F.format_string(form, F.date_format(col, "yyyy-MM")).alias("name")).distinct()
    left, right = name("orders", "o_orderdate", "table_%s.csv"), name("lineitem", "l_shipdate", "zones_%s.geojson")
    keyed = lambda rows, as_: rows.select(tables.month_of(F.col("name")).alias("month"), F.col("name").alias(as_))
    return keyed(left, "table_file").join(keyed(right, "zone_file"), "month")


@query("SELECT o_orderstatus, array_to_string(list_sort(list(DISTINCT strftime(o_orderdate, '%Y-%m'))), ' ') AS months FROM orders GROUP BY 1")
def month_lists(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM"))), " ").alias("months"))


@query(f"WITH {UR} SELECT count(*) AS units, count(*) FILTER (erosion_ha > 500) AS inside, round(sum(erosion_ha) FILTER (buildings_osm > 2) / sum(erosion_ha), 6) AS share FROM ur")
def kpi_shares(spark, d):
    return risk.share_inside(union_rows(spark, d), F.col("erosion_ha") > 500, F.col("buildings_osm") > 2, "erosion_ha")


@query(f"WITH {UR}, p AS (SELECT gid_union, (row_number() OVER (ORDER BY erosion_ha DESC, gid_union))::INT AS place FROM ur WHERE erosion_ha >= 100) SELECT * FROM p")
def table_order(spark, d):
    """The order that the table's operator gives, as each row's place in it."""
    rows = risk.table_query(union_rows(spark, d), risk.STATE | {"minErosion": 100}, ["union"])
    return order.placed(rows).select("gid_union", "place")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS value FROM orders QUALIFY row_number() OVER (PARTITION BY month ORDER BY value DESC, o_orderkey) = 1")
def first_of_keys(spark, d):
    """Rows with a repeated key: the first in an order stays."""
    from fluvia.sources.places import keep_first

    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("value"), (-F.col("o_totalprice")).alias("down"))
    return keep_first(rows, ["month"], ["down", "o_orderkey"]).drop("down")
