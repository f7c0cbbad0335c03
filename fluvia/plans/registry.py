"""All queries on the driver's tables: each applies an operator to columns that stand for its inputs.

tile: user_id mod 4; cell: event_id mod 16 and the next four bits; time: day of ts; index: value, scaled;
scene: a lineitem row, its discount standing for cloud cover; units: nations; points: customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvia.functions import raster, text, vectors
from fluvia.operators import frames, risk, series, spatial, thresholds
from fluvia.plans.oracle import ORACLE_SQL as ORACLE_SQL

SIDE = 16
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark, d) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, d, "events").select(
        (F.col("user_id") % 4).cast("int").alias("tile"), (F.col("event_id") % SIDE).cast("int").alias("r"), (F.floor(F.col("event_id") / SIDE) % SIDE).cast("int").alias("c"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("t"), F.least(F.lit(1.0), (cents - 5000) / F.lit(10000.0)).alias("v"), F.col("event_type").alias("family"), "event_id", "value",
    )


def masks(spark, d) -> DataFrame:
    """Three frames f of 16 x 16 cells: m is 1 where the values sum above 0."""
    made = pixels(spark, d).withColumn("f", F.floor(F.col("t") / 10).cast("int")).where("f < 3").groupBy("f", "r", "c").agg((F.sum(F.round(F.col("v") * 10000).cast("bigint")) > 0).cast("int").alias("m"))
    grid = spark.range(3 * SIDE * SIDE).select(F.floor(F.col("id") / (SIDE * SIDE)).cast("int").alias("f"), (F.floor(F.col("id") / SIDE) % SIDE).cast("int").alias("r"), (F.col("id") % SIDE).cast("int").alias("c"))
    return grid.join(made, ["f", "r", "c"], "left").withColumn("m", F.coalesce("m", F.lit(0)))


def risk_pieces(spark, d) -> DataFrame:
    orders = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_custkey", "o_orderstatus", "o_totalprice")
    placed = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.select(F.col("n_name").alias("gid_union"), F.col("n_regionkey").alias("district"), F.when(F.col("o_orderstatus") == "F", "erosion").otherwise("accretion").alias("kind"), (F.col("o_totalprice") / 10000).alias("area_ha"))


@query
def risk_table(spark, d):
    return risk.by_households(risk.risk_table(risk_pieces(spark, d), ["gid_union", "district"], F.when(F.col("kind") == "erosion", 1).otherwise(0), 0.7), ["gid_union"])


@query
def risk_enriched(spark, d):
    region = table(spark, d, "region")
    return risk_table(spark, d).join(F.broadcast(region), F.col("district") == F.col("r_regionkey"), "left").select("gid_union", F.col("r_name").alias("region"), "erosion_ha", "net_land_change_ha", "persons_est")


@query
def severity_bands(spark, d):
    return table(spark, d, "orders").groupBy(risk.severity(F.col("o_totalprice") / 5000).alias("band")).agg(F.count("*").alias("n"))


@query
def kpi_summary(spark, d):
    return risk.summary(risk_table(spark, d))


def union_rows(spark, d) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    bal = F.col("c_acctbal")
    return c.select(F.col("c_name").alias("gid_union"), F.col("c_mktsegment").alias("union"), F.col("n_name").alias("district"), bal.alias("erosion_ha"), (F.col("c_custkey") % 5).cast("int").alias("buildings_osm"), (F.col("c_custkey") % 50).cast("int").alias("households_est"))


@query
def table_query_default(spark, d):
    return risk.table_query(union_rows(spark, d), risk.parse_state(""), ["union", "district", "gid_union"])


@query
def table_query_filtered(spark, d):
    return risk.table_query(union_rows(spark, d), risk.parse_state("?district=NATION_3&q=mach&min=100&sort=households_est&dir=asc"), ["union", "district", "gid_union"])


@query
def table_query_sorted_nulls_last(spark, d):
    state = risk.parse_state("?sort=households_est")
    rows = risk.table_query(union_rows(spark, d), state, ["union"])
    known = F.when(~risk.unmapped(F.col("erosion_ha"), F.col("buildings_osm")), F.col("households_est"))
    place = F.row_number().over(Window.partitionBy("district").orderBy(known.desc_nulls_last(), F.desc("erosion_ha"), "gid_union"))
    return rows.select("district", "gid_union", place.alias("place"), known.alias("known"))


@query
def state_query_strings(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("district"), F.when(F.col("n_nationkey") % 2 == 0, "char alga").otherwise(" ").alias("query"), F.element_at(F.array(*map(F.lit, risk.STEPS)), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("min_erosion"), F.when(F.col("n_nationkey") % 3 == 0, "union").otherwise("erosion_ha").alias("sort"), F.when(F.col("n_nationkey") % 5 == 0, "asc").otherwise("desc").alias("dir"))
    return risk.state_query(rows).select("district", "search")


@query
def units_in_view(spark, d):
    inside = risk.table_query(union_rows(spark, d), risk.STATE | {"district": "NATION_4"}, ["union"]).select(F.col("gid_union").alias("u"))
    points = table(spark, d, "customer").select("c_name", (F.col("c_custkey") % 97).alias("x"), (F.col("c_custkey") % 89).alias("y"))
    return points.join(inside, F.col("c_name") == F.col("u"), "left_semi").agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"), F.count("*").alias("n"))


@query
def district_options(spark, d):
    return union_rows(spark, d).groupBy("district").agg(F.count("*").alias("n")).orderBy("district")


@query
def topk_erosion(spark, d):
    top = table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)
    low, high = F.min("o_totalprice").over(Window.partitionBy()), F.max("o_totalprice").over(Window.partitionBy())
    return top.withColumn("bucket", F.least(F.lit(6), F.floor(6 * (F.col("o_totalprice") - low) / (high - low))).cast("int"))


@query
def data_quality(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    return risk.quality(rows, "o_orderkey", ["o_custkey", "o_orderstatus"], {"o_orderstatus": ["F", "O"]})


def scenes(spark, d) -> DataFrame:
    cloud = F.when(F.col("l_quantity") % 7 != 0, F.col("l_discount") * 1000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM").alias("month"), cloud.alias("cloud"))


@query
def scene_search_month(spark, d):
    return series.search(scenes(spark, d), 50.0).groupBy("month").agg(F.count("*").alias("n"), F.count("cloud").alias("n_known"))


@query
def least_cloudy_topk(spark, d):
    rows = scenes(spark, d).withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber")).groupBy("month", "id").agg(F.min("cloud").alias("cloud"))
    return series.least_cloudy(rows, 10, ["month"], "id").select("month", "id", "cloud", "rank")


@query
def overview_level(spark, d):
    return table(spark, d, "part").select("p_partkey", raster.overview_level(F.lit(30.0), F.col("p_size") * F.lit(40.0)).alias("level"))


@query
def resume_pending(spark, d):
    planned = table(spark, d, "customer").select("c_custkey").crossJoin(spark.range(1992, 1995).select(F.col("id").cast("int").alias("year")))
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    return series.pending(planned, done, ["c_custkey", "year"])


@query
def water_index(spark, d):
    level = F.when(F.col("l_returnflag") == "A", "L2").otherwise("L1")
    green, dark = raster.reflectance((F.col("l_quantity") * 400) % 20000, level), raster.reflectance((F.col("l_tax") * 100000) % 7000, level)
    v = raster.water_index(green, dark)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raster.usable(F.col("l_orderkey")).alias("usable"), v.alias("v"))
    return rows.groupBy("usable").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), F.round(F.avg("v"), 6).alias("mean"), F.sum(raster.pack(F.col("v")).cast("bigint")).alias("packed"), F.round(F.sum(raster.unpack(raster.pack(F.col("v")))), 3).alias("unpacked"))


@query
def sensor_lookup(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("landsat-"), (F.col("event_id") % 10).cast("string")).alias("platform"), F.when(F.col("event_id") % 11 == 0, F.array(F.lit("MSS"))).otherwise(F.array(F.lit("tm"))).alias("instruments"))
    return raster.with_sensor(rows, strict=False).groupBy("family", "level", "native_m").agg(F.count("*").alias("n"))


@query
def monthly_median_composite(spark, d):
    return series.composite(pixels(spark, d), ["tile", "r", "t"]).withColumn("v", F.round("v", 6))


@query
def family_mode(spark, d):
    return pixels(spark, d).groupBy("tile", "t").agg(F.mode("family", True).alias("family"))


CELL = ["tile", "r", "c"]


def stack(spark, d) -> DataFrame:
    """The calendar of all events: a tile of 16 x 16 cells for each 4,096 of them, so that tiles grow with the
    table and some cells of each month stay without a value."""
    every = pixels(spark, d).withColumn("tile", F.floor(F.col("event_id") / 4096).cast("int"))
    first, last = every.agg(F.min("t"), F.max("t")).first()
    return series.calendar_stack(series.composite(every, [*CELL, "t"]), CELL, first, last)


@query
def calendar_stack(spark, d):
    return stack(spark, d).withColumn("v", F.round("v", 6))


@query
def gap_fill(spark, d):
    return series.gap_fill(stack(spark, d), CELL, 2).select(*CELL, "t", F.round("filled", 6).alias("filled"), "was_filled")


@query
def temporal_smooth(spark, d):
    return series.smooth(stack(spark, d), CELL).select(*CELL, "t", F.round("smoothed", 6).alias("smoothed"))


@query
def median_filter_3x3(spark, d):
    cells = masks(spark, d).withColumn("v", F.when(F.col("m") == 1, ((F.col("r") * 7 + F.col("c") * 3) % 11).cast("double")))
    return frames.median3(cells, ["f"], SIDE, SIDE).select("f", "r", "c", F.round("smooth", 6).alias("smooth"))


@query
def land_mode(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("family"), (F.col("l_extendedprice") / 100000).alias("v"))
    return thresholds.land_mode(rows, ["family"], 0.0, 0.9).select("family", F.round("mode", 6).alias("mode"))


@query
def otsu_threshold(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("family"), (F.col("l_extendedprice") / 100000).alias("v"))
    return thresholds.otsu(rows, ["family"], 0.0, 0.9).select("family", F.round("cut", 6).alias("cut"))


@query
def calibrate_delta(spark, d):
    rows = pixels(spark, d).select("family", F.col("tile").alias("month"), "v")
    modes = rows.select("family").distinct().withColumn("mode", F.lit(0.0))
    return thresholds.calibrate(rows, modes, 0.30)


@query
def threshold_stack(spark, d):
    cuts = spark.createDataFrame([("view", 0.1), ("click", 0.0), ("error", -0.2)], "family string, cut double")
    return thresholds.binary_water(pixels(spark, d), cuts, ["family"]).groupBy("tile", "t").agg(F.round(F.avg("water"), 6).alias("water"), F.count("*").alias("n"))


@query
def water_fraction(spark, d):
    return thresholds.water_fraction(stack(spark, d), ["tile", "t"], F.lit(0.0)).withColumn("fraction", F.round("fraction", 6))


@query
def temporal_split(spark, d):
    return table(spark, d, "orders").groupBy(series.split_of(F.year("o_orderdate"), 1994, 1996).alias("split")).agg(F.count("*").alias("n"))


def coverage(spark, d) -> DataFrame:
    return stack(spark, d).groupBy("tile", "t").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("observed"))


@query
def sliding_windows(spark, d):
    return series.sliding_windows(coverage(spark, d), 15, 3, 0.3, 2).withColumn("target_observed", F.round("target_observed", 6))


@query
def even_subsample(spark, d):
    return series.even_subsample(series.sliding_windows(coverage(spark, d), 15, 3, 0.0), 10, ["tile", "t0"]).select("tile", "t0")


@query
def class_balance(spark, d):
    return table(spark, d, "labels").agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("toxic") == 0).cast("double"), F.count_if(F.col("toxic") == 1)), F.lit(1.0)), 6).alias("pos_weight"))


@query
def persistence_forecast(spark, d):
    rows = masks(spark, d).select("r", "c", F.col("f").alias("t"), F.col("m").alias("water"))
    return series.persistence(rows, ["r", "c"]).select("r", "c", "h", "water", F.round("prob", 6).alias("prob"))


@query
def change_masks(spark, d):
    m = masks(spark, d)
    now, later = m.where("f = 0").select("r", "c", F.col("m").alias("a")), m.where("f = 2").select("r", "c", F.col("m").alias("b"))
    return now.join(later, ["r", "c"]).select("r", "c", ((F.col("a") == 0) & (F.col("b") == 1)).alias("erosion"), ((F.col("a") == 1) & (F.col("b") == 0)).alias("accretion"))


@query
def seasonal_reference(spark, d):
    rows = stack(spark, d).withColumn("water", (F.col("v") > 0).cast("int"))
    at = series.anchors(coverage(spark, d).withColumnRenamed("observed", "usable"), 0.2, 12)
    return series.seasonal_reference(rows, at, CELL, 3, 12)


@query
def change_components(spark, d):
    zones = frames.components(masks(spark, d).where("m = 1"), ["f"])
    return zones.groupBy("f", "zone").agg(F.count("*").alias("n_cells"), F.round(F.count("*") * 1.44, 6).alias("area_ha"))


@query
def bank_band(spark, d):
    return frames.bank_band(masks(spark, d), ["f"], 2).select("f", "r", "c", "d", "e", "band")


@query
def boundary_pixels(spark, d):
    return frames.boundary(masks(spark, d), ["f"])


@query
def boundary_displacement(spark, d):
    edge = frames.boundary(masks(spark, d), ["f"])
    return frames.displacement(edge.where("f = 0").drop("f").withColumn("k", F.lit(1)), edge.where("f = 2").drop("f").withColumn("k", F.lit(1)), ["k"], 120.0, SIDE)


def scored(spark, d) -> DataFrame:
    m = masks(spark, d)
    return m.where("f = 2").select("r", "c", F.col("m").alias("truth")).join(m.where("f < 2").groupBy("r", "c").agg((F.sum("m") * 0.4 + F.max("r") * 0.01).alias("prob")), ["r", "c"])


@query
def confusion_metrics(spark, d):
    p, t = F.col("prob") > 0.5, F.col("truth") == 1
    return thresholds.with_f1(scored(spark, d).groupBy((F.col("r") % 2).alias("half")).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")))


@query
def horizon_metrics(spark, d):
    p, t = F.col("prob") > 0.5, F.col("truth") == 1
    batches = thresholds.with_f1(scored(spark, d).groupBy(F.col("r").alias("batch"), (F.col("c") % 3 + 1).alias("h")).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")))
    return batches.groupBy("h").agg(F.round(F.avg("f1"), 5).alias("f1"), F.count("*").alias("batches"))


@query
def threshold_sweep(spark, d):
    return thresholds.cut_sweep(scored(spark, d), [0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7])


@query
def sobel_gradient(spark, d):
    return frames.sobel(masks(spark, d), ["f"], "m")


@query
def bce_loss(spark, d):
    rows = masks(spark, d).select("f", ((F.col("r") - F.col("c")) / 4.0).alias("x"), F.col("m").alias("y"), (F.col("r") > 0).alias("valid"))
    return frames.weighted_bce(rows, ["f"], 2.5)


@query
def tile_blend(spark, d):
    starts = frames.window_starts(SIDE, 8, 4)
    at = spark.createDataFrame([(i, j) for i in starts for j in starts], "r0 int, c0 int")
    parts = masks(spark, d).join(F.broadcast(at), (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r0") + 8) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c0") + 8))
    w = frames.hann(F.col("r") - F.col("r0"), 8) * frames.hann(F.col("c") - F.col("c0"), 8)
    return frames.blend(parts.withColumn("w", w).withColumn("p", F.col("m") * 0.5 + (F.col("r0") + F.col("c0")) * 0.01), ["f"]).withColumn("p", F.round("p", 6))


def places(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", (88 + (F.col("s_suppkey") % 97) / 50).alias("lon"), (24 + (F.col("s_suppkey") % 89) / 50).alias("lat"))


@query
def utm_project(spark, d):
    east, north = spatial.utm45(F.col("lon"), F.col("lat"))
    return places(spark, d).select("s_suppkey", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query
def study_grid(spark, d):
    box = table(spark, d, "supplier").agg(((F.min("s_suppkey") + 740) * 1000.5).alias("left"), (F.max("s_suppkey") * 10 + 2_950_000.0).alias("top"), ((F.min("s_suppkey") + 740) * 1000.5 + 130_000).alias("right"), (F.max("s_suppkey") * 10 + 2_700_000.0).alias("bottom"))
    return spatial.study_grid(box)


@query
def lattice_cells(spark, d):
    box = places(spark, d).select("s_suppkey", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 0.13).alias("east"), (F.col("lat") + 0.08).alias("north"))
    return spatial.lattice_cells(box, 0.1).select("s_suppkey", "i", "j", "cell_west", "cell_south")


def rings(spark, d) -> DataFrame:
    x, y = (F.col("s_suppkey") % 97).cast("double"), (F.col("s_suppkey") % 89).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    return table(spark, d, "supplier").select("s_suppkey", F.array(corner(0, 0), corner(9, 0), corner(9, 7), corner(0, 7)).alias("ring"))


def points(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 97).cast("double").alias("x"), (F.col("c_custkey") % 89).cast("double").alias("y"))


@query
def points_in_polygons(spark, d):
    return spatial.counts_in_polygons(points(spark, d), rings(spark, d), "s_suppkey", 8)


@query
def mapping_density(spark, d):
    units = rings(spark, d).select("s_suppkey", (spatial.ring_area(F.col("ring")) * F.when(F.col("s_suppkey") % 4 == 0, 0.0).otherwise(0.05)).alias("area_km2"))
    counted = units.join(points_in_polygons(spark, d), "s_suppkey", "left")
    return spatial.density(counted).select("s_suppkey", F.round("area_km2", 6).alias("area_km2"), "density", "mapping")


def overlap_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    zones = masks(spark, d).where("m = 1").select(F.col("f").alias("zone"), "r", "c")
    units = spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).cast("int").alias("r"), (F.col("id") % SIDE).cast("int").alias("c"))
    both = units.where("r < 9").withColumn("unit", F.lit("a")).union(units.where("r > 6 and r < 14").withColumn("unit", F.lit("b")))
    return zones, both


def overlap(spark, d) -> DataFrame:
    return spatial.identity(*overlap_sides(spark, d))


@query
def overlay_identity(spark, d):
    return spatial.zone_pieces(overlap(spark, d), 1.44)


@query
def one_unit_per_place(spark, d):
    return spatial.zone_pieces(spatial.one_unit_per_cell(overlap(spark, d)), 1.44)


@query
def year_sensor_pivot(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"), "l_returnflag").dropDuplicates(["l_orderkey", "l_linenumber", "year", "l_returnflag"])
    years = rows.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    return years.join(rows.groupBy("year").pivot("l_returnflag", ["A", "N", "R"]).count(), "year", "left").fillna(0)


@query
def latin_skeleton(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", text.latin_key(F.col("p_name")).alias("key"))


@query
def best_match(spark, d):
    """Rows only: the similarity is not in SQL."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("parent"), F.col("p_name").alias("name"))
    known = spark.createDataFrame([("ECONOMY", 1, "red widgit", "রেদ উইদগিত"), ("ECONOMY", 2, "smol rang", "স্মল রিং"), ("SMALL", 3, "blu bolt", "ব্লু বল্ত")], "parent string, cand_id int, cand string, cand_bn string")
    return text.best_matches(names, known)


@query
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query
def display_names(spark, d):
    return table(spark, d, "part").select("p_partkey", text.display_name(F.concat(F.initcap("p_type"), F.initcap("p_brand"), F.lit("(Part)"))).alias("name"))


@query
def csv_cells(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.csv_text(F.concat(F.element_at(F.array(*map(F.lit, ["=", '"', ",", "x"])), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_mktsegment"))).alias("cell"), text.csv_float(F.round("c_acctbal", 0)).alias("number"))


@query
def csv_document(spark, d):
    rows = table(spark, d, "nation")
    return text.csv_document(rows, [F.col("n_nationkey").cast("string"), text.csv_text(F.col("n_name"))], ["n_nationkey", "n_name"], ["n_nationkey"])


@query
def number_format(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.bengali_number(F.col("s_acctbal"), 2).alias("bengali"), text.roughly(F.col("s_acctbal"), 10.0).alias("roughly"))


@query
def manuscript_words(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")).alias("n_words"))


@query
def hash_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), spatial.cell_key((F.col("doc_id") % 7) / 10, (F.col("doc_id") % 5) / 10).alias("cell"))


@query
def attention_scores(spark, d):
    """Softmax weights of all vectors for each query vector, the rows with an id divisible by 100."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("e").alias("q"))
    return vectors.softmax_weights(q, v, 8.0).select("q_id", "vec_id", F.round("weight", 6).alias("weight"))


@query
def cube_rollup(spark, d):
    """Extension: grouping sets over the change areas."""
    return risk_pieces(spark, d).cube("district", "kind").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query
def asof_prev(spark, d):
    """Extension: the latest earlier event of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev_id"))


@query
def stream_composite(spark, d):
    """Extension: the composite as a stream over landed files, read to the end."""
    from fluvia.streaming.composite import run_to_end

    return run_to_end(spark, f"{d}/events.parquet")


@query
def value_counts(spark, d):
    return risk.value_counts(table(spark, d, "orders"), risk.severity(F.col("o_totalprice") / 5000))


@query
def state_roundtrip(spark, d):
    parsed = risk.parse_states(state_query_strings(spark, d).select(F.col("district").alias("n_name"), "search"))
    return parsed.select("n_name", "district", "query", "min_erosion", "sort", "dir")


@query
def coverage_cells(spark, d):
    asked = lattice_cells(spark, d).select("i", "j")
    return spatial.answered_cells(asked, asked.where("(i * 7 + j) % 5 != 0"), ["i", "j"])


@query
def overlay_intersection(spark, d):
    zones, units = overlap_sides(spark, d)
    return spatial.zone_pieces(spatial.intersection(zones, units), 1.44)


@query
def error_area(spark, d):
    return thresholds.error_area(scored(spark, d).withColumn("half", F.col("r") % 2), ["half"], 0.5, 1.44)


@query
def bengali_skeleton(spark, d):
    name = F.translate(F.col("p_name"), "bdgklmnrt", "বদগকলমনরত")
    return table(spark, d, "part").select("p_name").distinct().select("p_name", text.bengali_key(name).alias("key"))


@query
def clean_names(spark, d):
    name = F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(" নং "), "n_name", F.lit(" ইউনিয়ন পরিষদ, x"))
    return table(spark, d, "nation").select("n_nationkey", text.clean_unit_name(name).alias("name"), text.is_bengali_name(F.lit("নদী")).alias("bengali"), text.is_bengali_name(F.col("n_name")).alias("latin_is"))


@query
def hierarchy_match(spark, d):
    """Rows only: the similarity is not in SQL."""
    units = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("district"), F.col("p_name").alias("unit"))
    schema = "parent int, cand_id int, cand string, cand_bn string"
    districts = spark.createDataFrame([(0, 1, "Economy", "ইকনমি"), (0, 2, "Small", "সমল")], schema)
    within = spark.createDataFrame([(1, 11, "red widgit", "রেদ উইদগিত"), (1, 12, "smol rang", "স্মল রিং"), (2, 13, "blu bolt", "ব্লু বল্ত")], schema)
    return text.match_hierarchy(units, [("district", districts), ("unit", within)])


@query
def markdown_tables(spark, d):
    rows = table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return text.markdown_table(rows, [F.col(c).cast("string") for c in ("quality", "n", "toxic")], ["quality", "n", "toxic"], ["quality"])


@query
def linear_head(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.linear_head(e, [(k % 7 - 3) / 10 for k in range(64)], 0.25), 6).alias("prob"))


@query
def approx_distinct(spark, d):
    """Extension: a sketch of distinct users; true where it is within a tenth of the exact number."""
    rows = table(spark, d, "events").select("event_type", "user_id")
    # In one aggregation with the exact number, each user would have a sketch of their own.
    sketch = rows.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"))
    exact = rows.distinct().groupBy(F.col("event_type").alias("kind")).agg(F.count("user_id").alias("n"))
    return sketch.join(exact, F.col("event_type").eqNullSafe(F.col("kind"))).select("event_type", (F.abs(F.col("a") - F.col("n")) <= F.col("n") * 0.1).alias("close"))
