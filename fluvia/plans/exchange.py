"""Queries of the sources and sinks: what is written is read back and compared with the table it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.operators import series
from fluvia.plans.oracle import MK, ST
from fluvia.plans.registry import masks, pixels, stack, table
from fluvia.sources import cubes, places, tables
from fluvia.storage import new_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MONTH = "2025-03"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def handoff(spark, d) -> DataFrame:
    """A hand-off table of customers; some names hold commas, quotes and formula signs."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    level = F.element_at(F.array(*map(F.lit, tables.LEVELS)), (k % 4 + 1).cast("int"))
    union = F.when(k % 11 == 0, F.concat(F.lit('a, "b" '), "c_name")).otherwise(F.col("c_name"))
    return c.select(
        F.col("n_name").alias("division"), F.col("n_name").alias("district"), F.col("c_mktsegment").alias("upazila"), union.alias("union"), F.col("c_name").alias("gid_union"),
        (F.col("c_acctbal") / 7).alias("erosion_ha"), (k % 5).cast("int").alias("buildings_osm"), F.col("c_acctbal").alias("accretion_ha"), (F.col("c_acctbal") * 6 / 7).alias("net_land_change_ha"),
        (k % 50).cast("int").alias("households_est"), (k % 50 * 4).cast("int").alias("persons_est"), F.lit(0.7).alias("osm_completeness_assumed"),
        F.when(k % 4 != 3, k / 3).alias("osm_buildings_per_km2"), (k / 8).alias("osm_measured_km2"), level.alias("osm_mapping"),
        F.lit(None).cast("string").alias("division_bn"), F.lit(None).cast("string").alias("district_bn"), F.lit(None).cast("string").alias("upazila_bn"), F.when(k % 2 == 0, "হলদিয়া").alias("union_bn"),
    )


HO = "ho AS (SELECT '2025-03' AS forecast_month, n_name AS division, n_name AS district, c_mktsegment AS upazila, CASE WHEN c_custkey % 11 = 0 THEN 'a, \"b\" ' || c_name ELSE c_name END AS \"union\", c_name AS gid_union, c_acctbal / 7 AS erosion_ha, (c_custkey % 5)::INT AS buildings_osm, c_acctbal AS accretion_ha, c_acctbal * 6 / 7 AS net_land_change_ha, (c_custkey % 50)::INT AS households_est, (c_custkey % 50 * 4)::INT AS persons_est, 0.7::DOUBLE AS osm_completeness_assumed, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey / 3 END AS osm_buildings_per_km2, c_custkey / 8 AS osm_measured_km2, ['low', 'medium', 'high', 'not measured'][c_custkey % 4 + 1] AS osm_mapping, NULL::VARCHAR AS division_bn, NULL::VARCHAR AS district_bn, NULL::VARCHAR AS upazila_bn, CASE WHEN c_custkey % 2 = 0 THEN 'হলদিয়া' END AS union_bn FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {HO} SELECT * FROM ho")
def handoff_roundtrip(spark, d):
    path = new_folder(spark, "handoff")
    tables.write_handoff(handoff(spark, d), path, MONTH, ["gid_union"])
    return tables.read_handoff(spark, path)


@query(f"""WITH {HO}, b AS (SELECT * REPLACE (CASE WHEN c % 10 = 1 THEN NULL ELSE district END AS district, CASE WHEN c % 10 = 2 THEN 'huge' ELSE osm_mapping END AS osm_mapping,
    CASE WHEN c % 10 = 3 THEN -1.0 ELSE osm_buildings_per_km2 END AS osm_buildings_per_km2, CASE WHEN c % 10 = 4 THEN -1 ELSE persons_est END AS persons_est,
    CASE WHEN c % 10 = 5 THEN '2025-04' ELSE forecast_month END AS forecast_month, CASE WHEN c % 10 = 6 THEN 'same' ELSE gid_union END AS gid_union, CASE WHEN c % 10 = 7 THEN 'inf'::DOUBLE ELSE erosion_ha END AS erosion_ha)
    FROM (SELECT ho.*, length(gid_union) + ascii(right(gid_union, 1)) AS c FROM ho))
    SELECT count(*) FILTER (district IS NULL) AS null_district, count(*) FILTER (osm_mapping NOT IN ('low', 'medium', 'high', 'not measured')) AS unknown_mapping,
    count(*) FILTER ((osm_buildings_per_km2 IS NULL) = (osm_mapping <> 'not measured')) AS density_given_wrongly, count(*) FILTER (osm_buildings_per_km2 < 0) AS negative_density,
    count(gid_union) - count(DISTINCT gid_union) AS repeated_unit, count(*) FILTER (least(buildings_osm, households_est, persons_est) < 0) AS negative_count,
    count(*) FILTER (forecast_month <> '2025-03') AS other_month, count(*) FILTER (isinf(erosion_ha)) AS nonfinite_erosion_ha, count(*) FILTER (upazila IS NULL) AS null_upazila FROM b""")
def handoff_checks(spark, d):
    """A table in which every tenth row breaks one of the rules."""
    c = F.length("gid_union") + F.ascii(F.expr("right(gid_union, 1)"))
    broken = {"district": (1, None), "osm_mapping": (2, "huge"), "osm_buildings_per_km2": (3, -1.0), "persons_est": (4, -1), "forecast_month": (5, "2025-04"), "gid_union": (6, "same"), "erosion_ha": (7, float("inf"))}
    rows = handoff(spark, d).withColumn("forecast_month", F.lit(MONTH)).withColumn("c", c)
    rows = rows.withColumns({name: F.when(F.col("c") % 10 == k, F.lit(value)).otherwise(F.col(name)) for name, (k, value) in broken.items()})
    return tables.handoff_checks(rows, MONTH).select("null_district", "unknown_mapping", "density_given_wrongly", "negative_density", "repeated_unit", "negative_count", "other_month", "nonfinite_erosion_ha", "null_upazila")


@query("SELECT 'at_risk_households_' || strftime(max(o_orderdate), '%Y-%m') || '.csv' AS name, strftime(max(o_orderdate), '%Y-%m') AS month FROM orders")
def newest_table(spark, d):
    names = table(spark, d, "orders").select(F.format_string("at_risk_households_%s.csv", F.date_format("o_orderdate", "yyyy-MM")).alias("path"))
    return tables.newest(names.union(spark.createDataFrame([("notes.csv",)], "path string")))


@query("SELECT max('metrics_' || lower(n_name) || '.json') AS name FROM nation WHERE n_name LIKE 'NATION_1%'")
def last_metrics(spark, d):
    path = new_folder(spark, "metrics")
    rows = table(spark, d, "nation").select(F.concat(F.lit("metrics_"), F.lower("n_name"), F.lit(".json")).alias("name"), F.col("n_nationkey").alias("value"))
    rows.write.partitionBy("name").json(path)
    found = tables.files(spark, path, "*.json").select(F.regexp_extract("path", "name=([^/]+)", 1).alias("path"))
    return tables.last_named(found, "metrics_nation_1")


@query("SELECT ['timesformer', 'convlstm', 'persistence', 'other'][n_nationkey % 4 + 1] AS model, n_name AS file, [0, 1, 2, 9][n_nationkey % 4 + 1]::INT AS place FROM nation")
def ordered_runs(spark, d):
    path = new_folder(spark, "runs")
    model = F.element_at(F.array(*map(F.lit, (*tables.MODELS, "other"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    table(spark, d, "nation").select(model.alias("model"), F.col("n_name").alias("file")).write.json(path)
    return tables.ordered_runs(spark.read.schema("model string, file string").json(path))


@query("SELECT s_suppkey::BIGINT AS item, s_name AS tile, s_acctbal AS cloud FROM supplier")
def manifest_append(spark, d):
    """Two runs add to one manifest."""
    path = new_folder(spark, "manifest")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("item"), F.col("s_name").alias("tile"), F.col("s_acctbal").alias("cloud"))
    for part in (0, 1):
        tables.append_manifest(rows.where(F.col("item") % 2 == part), path)
    return tables.read_manifest(spark, path, "item bigint, tile string, cloud double")


@query(f"WITH {ST} SELECT tile, t::VARCHAR AS month, count(*) AS n, count(v) AS n_valid, sum(CASE WHEN v IS NOT NULL THEN trunc(greatest(-32767, least(32767, v * 10000)))::BIGINT END)::BIGINT AS packed FROM st GROUP BY ALL")
def composite_sink(spark, d):
    path = new_folder(spark, "composites")
    cubes.write_composite(stack(spark, d).select("tile", F.col("t").cast("string").alias("month"), "r", "c", "v", "n_obs"), path)
    back = cubes.read_composite(spark, path)
    return back.groupBy("tile", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), F.sum(F.round(F.col("v") * 10000).cast("bigint")).alias("packed"))


@query(f"WITH {ST} SELECT tile, t, r, c, n_obs FROM st WHERE t BETWEEN 5 AND 9")
def cube_slices(spark, d):
    path = new_folder(spark, "cube")
    cubes.write_cube(stack(spark, d), path)
    return cubes.read_cube(spark, path, 5, 9, ["n_obs"])


def responses(spark, d) -> DataFrame:
    """Answers of cells: customers as elements; each is in its own cell, every third in the next one too."""
    k = F.col("c_custkey")
    center = F.when(k % 4 == 1, F.struct((k % 89).cast("double").alias("lat"), (k % 97).cast("double").alias("lon")))
    element = F.struct(F.lit("way").alias("type"), k.cast("bigint").alias("id"), F.when(k % 4 == 0, (k % 89) + 0.5).alias("lat"), F.when(k % 4 == 0, (k % 97) + 0.5).alias("lon"), center.alias("center"), F.when(k % 5 == 0, F.create_map(F.lit("building"), F.lit("hut"))).alias("tags"))
    rows = table(spark, d, "customer").select((k % 7).cast("int").alias("cell"), element.alias("e"), k)
    twice = rows.select("cell", "e").union(rows.where(k % 3 == 0).select((F.col("cell") + 1).alias("cell"), "e"))
    return twice.groupBy("cell").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("payload"))


EL = "el AS (SELECT (c_custkey % 7)::INT AS cell, c_custkey::BIGINT AS osm_id, 'way' AS osm_type, CASE WHEN c_custkey % 5 = 0 THEN 'hut' ELSE 'yes' END AS building, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 97 + 0.5 WHEN 1 THEN c_custkey % 97 END::DOUBLE AS lon, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 89 + 0.5 WHEN 1 THEN c_custkey % 89 END::DOUBLE AS lat FROM customer WHERE c_custkey % 4 < 2)"


@query(f"WITH {EL} SELECT * FROM el UNION ALL SELECT * REPLACE (cell + 1 AS cell) FROM el WHERE osm_id % 3 = 0")
def element_points(spark, d):
    return places.element_points(responses(spark, d))


@query(f"WITH {EL} SELECT * FROM el")
def building_cells(spark, d):
    """Cells' answers landed as files, read back, put together, buildings of shared edges once."""
    path = new_folder(spark, "cells")
    responses(spark, d).write.partitionBy("cell").json(path)
    return places.buildings(spark.read.schema("payload string, cell int").json(path))


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'NA' ELSE p_name END AS name, 'হলদিয়া' AS bn_name FROM part")
def gazetteer_read(spark, d):
    path = new_folder(spark, "gazetteer")
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.cast("string").alias("id"), F.when(k % 3 == 0, "").when(k % 3 == 1, "NA").otherwise(F.col("p_name")).alias("name"), F.concat(F.lit("১নং "), F.lit("হলদিয়া"), F.lit(" ইউনিয়ন")).alias("bn_name"))
    rows.write.csv(path)
    return places.read_gazetteer(spark, path, ["id", "name", "bn_name"])


@query("SELECT DISTINCT lower(c_mktsegment) || (c_custkey % 40)::VARCHAR || '.gov' AS domain FROM customer WHERE c_custkey % 40 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")
def titles_to_ask(spark, d):
    """Portals whose title isn't cached: of the titles found before, those in Bengali are."""
    segments = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("s")).distinct()
    titles = table(spark, d, "nation").join(segments, F.lit(True)).select(F.concat("s", F.col("n_nationkey").cast("string"), F.lit(".gov")).alias("domain"), F.when(F.col("n_nationkey") % 2 == 0, "হলদিয়া").otherwise("not available").alias("name"))
    wanted = table(spark, d, "customer").select(F.concat(F.lower("c_mktsegment"), (F.col("c_custkey") % 40).cast("string"), F.lit(".gov")).alias("domain")).union(spark.createDataFrame([("",), (None,)], "domain string"))
    return places.titles_to_ask(wanted, places.cacheable(titles).select("domain"))


@query("SELECT s_suppkey::BIGINT AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'e' ELSE 'a' END AS k, sign(round(s_acctbal * 100)::BIGINT) * ((2 * abs(round(s_acctbal * 100)::BIGINT) + 70) // 140) / 10.0::DOUBLE AS ha, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS u, 4::INT AS n_corners, round((s_suppkey % 97) / 9, 5) + round((s_suppkey % 97) / 9 + 1, 5) AS width FROM supplier")
def layer_roundtrip(spark, d):
    """Zones written as one collection and read back; the layer keeps their order."""
    path = new_folder(spark, "zones")
    k = F.col("s_suppkey")
    x, y = (k % 97) / 9, (k % 89) / 9
    ring = F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y + 1))
    rows = table(spark, d, "supplier").select(k.cast("bigint").alias("id"), places.feature(F.when(k % 2 == 0, "erosion").otherwise("accretion"), F.col("s_acctbal") / 7, F.when(k % 5 > 0, F.col("s_name")), F.array(ring)).alias("feature"))
    places.write_layer(rows, path, "id")
    p = lambda name: F.try_element_at("properties", F.lit(name))
    back = places.read_layer(spark, path).withColumn("ring", F.get("coordinates", 0)).withColumn("at", F.monotonically_increasing_id())
    ids = table(spark, d, "supplier").select(k.cast("bigint").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return back.join(F.broadcast(ids), F.lit(True)).select(F.get("ids", F.col("at").cast("int")).alias("id"), p("k").alias("k"), p("ha").cast("double").alias("ha"), p("u").alias("u"), F.size("ring").alias("n_corners"), (F.get(F.get("ring", 0), 0) + F.get(F.get("ring", 1), 0)).alias("width"))


@query(f"WITH {MK} SELECT count(*) FILTER (f = 0) AS unknown_kind, count(*) FILTER (r = 3) AS other_crs, (SELECT count(DISTINCT r) FROM mk WHERE r > 9) AS stray_units FROM mk")
def zone_checks(spark, d):
    kind = F.when(F.col("f") == 0, "flood").when(F.col("f") == 1, "erosion").otherwise("accretion")
    zones = masks(spark, d).select(kind.alias("kind"), F.when(F.col("r") == 3, "EPSG:32645").otherwise("EPSG:4326").alias("crs"), F.col("r").cast("string").alias("gid_union"))
    units = spark.range(10).select(F.col("id").cast("string").alias("gid_union"))
    return tables.zone_checks(zones, units)


@query("SELECT n_nationkey::BIGINT AS id, n_nationkey % 2 <> 0 AS other_month, n_nationkey % 3 = 0 AS no_bands, n_nationkey % 5 = 0 AS other_model, n_nationkey % 7 <> 1 AS other_schema, n_nationkey % 4 = 0 AS no_rows, n_nationkey % 4 <> 2 AS other_row_count, n_nationkey % 6 = 0 AS no_map FROM nation")
def payload_gate(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(
        k.cast("bigint").alias("id"), F.lit(MONTH).alias("table_month"), F.when(k % 2 == 0, MONTH).alias("summary_month"), F.when(k % 3 > 0, F.array(F.lit(1))).alias("bands"), F.lit("m").alias("model"), F.when(k % 5 == 0, "x").otherwise("m").alias("metrics_model"),
        F.lit(2).alias("rows_said"), (k % 4).cast("int").alias("rows_there"), (k % 7).cast("int").alias("schema"), F.lit(1).alias("schema_read"), F.when(k % 6 > 0, F.array(*map(F.lit, range(4)))).alias("box"),
    )
    return tables.payload_checks(rows).select("id", "other_month", "no_bands", "other_model", "other_schema", "no_rows", "other_row_count", "no_map")


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (l_quantity % 7 <> 0) AS n_known FROM lineitem WHERE year(l_shipdate) = 1995 AND l_partkey % 50 BETWEEN 9 AND 30 AND l_suppkey % 20 BETWEEN 3 AND 8 AND (l_quantity % 7 = 0 OR l_discount * 1000 < 50) GROUP BY 1")
def search_year(spark, d):
    """Two collections together: scenes of a year that touch a box, a missing cloud cover kept."""
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 20).cast("double")
    at = F.when(F.col("l_linenumber") < 3, F.col("l_shipdate").cast("string")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = table(spark, d, "lineitem").select("l_returnflag", at.alias("at"), F.when(F.col("l_quantity") % 7 != 0, F.col("l_discount") * 1000).alias("cloud"), x.alias("west"), (x + 1).alias("east"), y.alias("south"), (y + 1).alias("north"))
    odd = spark.createDataFrame([("R", "not a time", 1.0, 10.0, 11.0, 4.0, 5.0)], rows.schema)
    parts = [rows.where("l_returnflag = 'R'").union(odd), rows.where("l_returnflag <> 'R'")]
    return series.search_year(parts, (10.0, 4.0, 30.0, 8.0), 1995, 50.0).groupBy("month").agg(F.count("*").alias("n"), F.count("cloud").alias("n_known"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem WHERE l_quantity % 7 <> 0 AND l_discount * 1000 < 50 GROUP BY 1")
def server_side_search(spark, d):
    """The other search, whose comparison drops scenes without a known cloud cover."""
    cloud = F.when(F.col("l_quantity") % 7 != 0, F.col("l_discount") * 1000)
    rows = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), cloud.alias("cloud"))
    return series.search(rows, 50.0, keep_unknown=False).groupBy("month").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, round(avg((l_quantity % 7 > 2)::INT), 4) AS share FROM lineitem GROUP BY 1 HAVING share > 0")
def scene_projection(spark, d):
    """Scenes (orders) with the share of their valid pixels; scenes without any are dropped."""
    v = F.when(F.col("l_quantity") % 7 > 2, F.col("l_tax"))
    return series.usable_scenes(table(spark, d, "lineitem").select("l_orderkey", v.alias("v")), ["l_orderkey"])


@query("WITH px AS (SELECT user_id % 4 AS tile, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, event_type AS family, event_id FROM events), n AS (SELECT tile, t, family, count(*) AS n FROM px GROUP BY ALL), top AS (SELECT tile, t, min(family) AS main FROM n a WHERE n = (SELECT max(n) FROM n b WHERE b.tile = a.tile AND b.t = a.t) GROUP BY ALL) SELECT event_id, main FROM px JOIN top USING (tile, t)")
def month_majority(spark, d):
    """Each pixel with the commonest sensor family of its tile and month."""
    rows = pixels(spark, d).select("event_id", "tile", "t", "family")
    main = rows.groupBy("tile", "t").agg(F.mode("family", True).alias("main"))
    return rows.join(main, ["tile", "t"]).select("event_id", "main")


@query(f"WITH {ST} SELECT tile, t FROM st GROUP BY ALL HAVING sum(n_obs) < 50 AND sum(CASE WHEN r < 2 THEN n_obs ELSE 0 END) = 0")
def empty_months(spark, d):
    """Months of a tile in which no pixel of the first two rows was observed, of those with few observations."""
    rows = stack(spark, d)
    few = rows.groupBy("tile", "t").agg(F.sum("n_obs").alias("n")).where("n < 50").select("tile", "t")
    part = rows.withColumn("n_obs", F.when(F.col("r") < 2, F.col("n_obs")).otherwise(0)).join(few, ["tile", "t"])
    return series.rows_without(part.withColumn("key", F.struct("tile", "t")), "key", "n_obs").select("key.tile", "key.t")


@query(f"WITH {MK} SELECT f, CASE WHEN m = 1 THEN 'water' ELSE 'land' END AS kind, round(sum(r * 0.25 + c), 4)::DOUBLE AS area, count(*) AS n FROM mk GROUP BY ALL")
def totals_by_kind(spark, d):
    rows = masks(spark, d).select("f", F.when(F.col("m") == 1, "water").otherwise("land").alias("kind"), (F.col("r") * 0.25 + F.col("c")).alias("area"))
    return series.totals(rows, ["f", "kind"], "area")



@query(f"WITH {HO} SELECT '2025-04' AS month, count(*) AS rows, round(sum(erosion_ha), 4) AS erosion_ha, sum(households_est)::BIGINT AS households, 1::BIGINT AS months_there FROM ho")
def published(spark, d):
    """Two months published one after the other: the second is there, the first is gone."""
    out = new_folder(spark, "site")
    for month in ("2025-03", "2025-04"):
        source = new_folder(spark, f"handoff-{month}")
        tables.write_handoff(handoff(spark, d), source, month, ["gid_union"])
        tables.publish(spark, source, out, month)
    there = tables.files(spark, out, "part-*").where(F.col("path").contains("/at_risk_")).agg(F.count_distinct(F.regexp_extract("path", "at_risk_([^/]+)", 1)).alias("months_there"))
    return spark.read.schema("month string, rows bigint, erosion_ha double, households bigint").json(f"{out}/summary_*").join(there, F.lit(True))
