"""Queries of geometry, losses and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import text
from fluvia.operators import forecast, frames, spatial, thresholds
from fluvia.operators import rings as rings_of
from fluvia.plans.oracle import F1, MK, PX, SD, SUP
from fluvia.plans.registry import masks, pixels, places, points, rings, scored, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SUP} SELECT s_suppkey, round(lon, 6)::DOUBLE AS lon, round(lat, 6)::DOUBLE AS lat FROM pl")
def utm_inverse(spark, d):
    """Places projected and projected back."""
    lon, lat = spatial.lonlat45(*spatial.utm45(F.col("lon"), F.col("lat")))
    return places(spark, d).select("s_suppkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT s_suppkey, true AS holds_corners, true AS edges_bend FROM supplier")
def projected_boxes(spark, d):
    """The projected box of each place's surroundings: it holds the box's corners, and reaches farther than they do."""
    box = places(spark, d).select("s_suppkey", (F.col("lon") - 4).alias("west"), (F.col("lat") - 2).alias("south"), (F.col("lon") + 4).alias("east"), (F.col("lat") + 2).alias("north"))
    got = spatial.projected_box(box, ["s_suppkey"])
    corners = [spatial.utm45(F.col(x), F.col(y)) for x in ("west", "east") for y in ("south", "north")]
    low, high = F.least(*(c[1] for c in corners)), F.greatest(*(c[1] for c in corners))
    holds = (F.col("left") <= F.least(*(c[0] for c in corners)) + 1e-3) & (F.col("right") >= F.greatest(*(c[0] for c in corners)) - 1e-3) & (F.col("bottom") <= low + 1e-3) & (F.col("top") >= high - 1e-3)
    return got.join(box, "s_suppkey").select("s_suppkey", holds.alias("holds_corners"), (F.col("bottom") < low - 1).alias("edges_bend"))


@query("SELECT s_suppkey, round((s_suppkey % 40) * 61440.0 + 61440, 2)::DOUBLE AS right, round((s_suppkey % 30) * 1000 + 2700000, 2)::DOUBLE AS top, true AS ordered FROM supplier")
def tile_corners(spark, d):
    """Tiles with their corners in degrees, projected back at the north-east corner."""
    k = F.col("s_suppkey")
    tiles = table(spark, d, "supplier").select("s_suppkey", ((k % 40) * 61440.0).alias("origin_x"), ((k % 30) * 1000 + 2_700_000.0).alias("origin_y"))
    lon, lat = spatial.lonlat45(F.col("origin_x") + 61440.0, F.col("origin_y"))
    x, y = spatial.utm45(lon, lat)
    got = spatial.tile_corners(tiles)
    return got.select("s_suppkey", F.round(x, 2).alias("right"), F.round(y, 2).alias("top"), ((F.col("west") < F.col("east")) & (F.col("south") < F.col("north")) & (lon <= F.col("east")) & (lat <= F.col("north"))).alias("ordered"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 97 BETWEEN 11 AND 50 AND s_suppkey % 89 BETWEEN 3 AND 40")
def boxes_touching(spark, d):
    x, y = F.col("s_suppkey") % 97, F.col("s_suppkey") % 89
    rows = table(spark, d, "supplier").select("s_suppkey", x.alias("west"), y.alias("south"), (x + 9).alias("east"), (y + 7).alias("north"))
    return spatial.touching(rows, (20, 10, 50, 40)).select("s_suppkey")


@query("SELECT c_nationkey, min(c_custkey % 97) - 0.5::DOUBLE AS west, min(c_custkey % 89) - 0.5::DOUBLE AS south, max(c_custkey % 97) + 0.5::DOUBLE AS east, max(c_custkey % 89) + 0.5::DOUBLE AS north FROM customer GROUP BY 1")
def buffered_extents(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 97).cast("double").alias("x"), (F.col("c_custkey") % 89).cast("double").alias("y"))
    return spatial.extent(rows, 0.5, ["c_nationkey"])


@query("WITH c AS (SELECT DISTINCT (c_custkey % 97 // 5)::INT AS i, (c_custkey % 89 // 5)::INT AS j FROM customer), f AS (SELECT DISTINCT s_suppkey % 97 // 5 AS i, s_suppkey % 89 // 5 AS j FROM supplier) SELECT i, j, true AS restricted FROM c WHERE (i, j) IN (SELECT i, j FROM f) UNION ALL SELECT i, j, false FROM c")
def restricted_cells(spark, d):
    """Cells that a footprint touches; of a footprint that touches none, all."""
    cell = lambda k: (F.floor(k % 97 / 5).cast("int").alias("i"), F.floor(k % 89 / 5).cast("int").alias("j"))
    cells = table(spark, d, "customer").select(*cell(F.col("c_custkey"))).distinct()
    near = table(spark, d, "supplier").select(*cell(F.col("s_suppkey")))
    far = near.select((F.col("i") + 1000).alias("i"), "j")
    return spatial.restrict_cells(cells, near, ["i", "j"]).withColumn("restricted", F.lit(True)).union(spatial.restrict_cells(cells, far, ["i", "j"]).withColumn("restricted", F.lit(False)))


Z = MK + ", z AS (SELECT f, r, c, c // 4 AS zone FROM mk WHERE m = 1)"


def _zones(spark, d) -> DataFrame:
    return masks(spark, d).where("m = 1").select("f", "r", "c", F.floor(F.col("c") / 4).cast("int").alias("zone"))


@query(f"WITH {Z}, a AS (SELECT f, zone, count(*) * 1.44 AS ha FROM z GROUP BY ALL) SELECT z.f, z.zone, count(*) AS n FROM z JOIN a ON a.f = z.f AND a.zone = z.zone WHERE ha >= 42 GROUP BY ALL")
def large_zones(spark, d):
    return spatial.large_zones(_zones(spark, d), ["f", "zone"], 42, 1.44).groupBy("f", "zone").agg(F.count("*").alias("n"))


@query(f"WITH {Z} SELECT zone, count(*) AS n FROM (SELECT DISTINCT zone, r, c FROM z) GROUP BY 1")
def dissolved_zones(spark, d):
    return spatial.dissolved(_zones(spark, d), ["zone"]).groupBy("zone").agg(F.count("*").alias("n"))


@query(f"WITH {Z} SELECT a.f, a.zone, sum(4 - (SELECT count(*) FROM z b WHERE b.f = a.f AND b.zone = a.zone AND abs(a.r - b.r) + abs(a.c - b.c) = 1))::BIGINT AS sides FROM z a GROUP BY ALL")
def zone_outlines(spark, d):
    return spatial.outline(_zones(spark, d), ["f", "zone"]).groupBy("f", "zone").agg(F.count("*").alias("sides"))


@query("WITH b AS (SELECT s_suppkey, s_suppkey % 97 AS x, s_suppkey % 89 AS y FROM supplier) SELECT s_suppkey, round(greatest(0, least(x + 9, 60) - greatest(x, 20)) * greatest(0, least(y + 7, 50) - greatest(y, 10)), 6)::DOUBLE AS inside, round(greatest(0, least(x + 9, 60) - greatest(x, 20)) * greatest(0, least(y + 7, 50) - greatest(y, 10)) / 1e6, 12)::DOUBLE AS km2, x + 4.5::DOUBLE AS cx, y + 3.5::DOUBLE AS cy FROM b")
def unit_in_coverage(spark, d):
    """The area of each unit within the coverage, a box here, and each unit's label point."""
    rows = rings(spark, d).select("*", F.lit(20.0).alias("w"), F.lit(10.0).alias("s"), F.lit(60.0).alias("e"), F.lit(50.0).alias("n"))
    got = spatial.clipped(rows, "ring", ("w", "s", "e", "n"), "part")
    area = F.when(F.size("part") > 2, spatial.ring_area(F.col("part"))).otherwise(0.0)
    middle = spatial.centroid(F.col("ring"))
    return got.select("s_suppkey", F.round(area, 6).alias("inside"), F.round(spatial.square_kilometres(area), 12).alias("km2"), F.round(middle.x, 6).alias("cx"), F.round(middle.y, 6).alias("cy"))


@query("WITH p AS (SELECT c_custkey % 97 AS x, c_custkey % 89 AS y FROM customer WHERE c_custkey % 97 < 60 AND c_custkey % 89 < 50) SELECT s_suppkey, (SELECT count(*) FROM p WHERE x > s_suppkey % 97 AND x < s_suppkey % 97 + 9 AND y > s_suppkey % 89 AND y < s_suppkey % 89 + 7) AS n FROM supplier")
def counts_in_coverage(spark, d):
    """Points of each unit that lie in the coverage; a unit without any has 0."""
    covered = points(spark, d).where("x < 60 and y < 50")
    counts = spatial.counts_in_polygons(covered, rings(spark, d).distinct(), "s_suppkey", 8)
    return table(spark, d, "supplier").select("s_suppkey").join(counts, "s_suppkey", "left").fillna(0, ["n"])


@query("SELECT s_suppkey, 4::INT AS n_corners, round(s_suppkey % 97 + 9 + s_suppkey % 89, 6)::DOUBLE AS corner FROM supplier")
def simplified_rings(spark, d):
    """Rings with corners of a few hundredths along their sides lose those, and no others."""
    x, y = F.col("s_suppkey") % 97, F.col("s_suppkey") % 89
    at = lambda a, b: F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y"))
    ring = F.array(at(0, 0), at(3, 0.02), at(6, -0.01), at(9, 0), at(9.01, 3), at(9, 7), at(5, 7.02), at(0, 7), at(-0.02, 4))
    got = table(spark, d, "supplier").select("s_suppkey", spatial.simplify(ring, 0.1).alias("ring"))
    return got.select("s_suppkey", F.size("ring").alias("n_corners"), F.round(F.get("ring", 1).x + F.get("ring", 1).y, 6).alias("corner"))


GR = MK + """, pt AS (SELECT f, r, c, 1 / (1 + exp(-((r - c) / 4.0)::DOUBLE)) AS prob, m::DOUBLE AS truth, r > 2 OR c > 2 AS valid FROM mk),
    nb AS (SELECT a.f, a.r, a.c, b.r - a.r AS i, b.c - a.c AS j, b.prob, b.truth, b.valid FROM pt a JOIN pt b ON a.f = b.f AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
    sb AS (SELECT f, r, c, round(sum(j * (2 - abs(i)) * prob), 6) AS px, round(sum(i * (2 - abs(j)) * prob), 6) AS py, round(sum(j * (2 - abs(i)) * truth), 6) AS tx, round(sum(i * (2 - abs(j)) * truth), 6) AS ty, bool_and(valid) AS whole FROM nb GROUP BY ALL),
    gl AS (SELECT f, round(avg(abs(px - tx) + abs(py - ty) + abs(sqrt(px * px + py * py + 1e-6) - sqrt(tx * tx + ty * ty + 1e-6))), 6) AS grad FROM sb WHERE whole GROUP BY f)"""


@query(f"WITH {GR} SELECT f, round(grad, 4) AS grad FROM gl")
def masked_gradient_loss(spark, d):
    return frames.gradient_loss(_forecast(spark, d).withColumn("prob", 1 / (1 + F.exp(-F.col("x")))), ["f"]).select("f", F.round("grad", 4).alias("grad"))


@query(f"""WITH {GR},
    bc AS (SELECT f, round(avg(2.5 * m * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) + (1 - m) * (greatest(x, 0) + ln(1 + exp(-abs(x))))), 6) AS bce FROM (SELECT *, ((r - c) / 4.0)::DOUBLE AS x FROM mk WHERE r > 2 OR c > 2) GROUP BY f)
    SELECT f, round(bce + 0.3 * grad, 4) AS loss FROM gl JOIN bc USING (f)""")
def forecast_loss(spark, d):
    return frames.forecast_loss(_forecast(spark, d), ["f"], 2.5).select("f", F.round("loss", 4).alias("loss"))


def _forecast(spark, d) -> DataFrame:
    return masks(spark, d).select("f", "r", "c", ((F.col("r") - F.col("c")) / 4.0).alias("x"), F.col("m").cast("double").alias("truth"), ((F.col("r") > 2) | (F.col("c") > 2)).alias("valid"))


@query("SELECT p_partkey, (p_size + 10)::INT AS height, (p_partkey % 70)::INT AS width, a::INT AS r0, b::INT AS c0 FROM part, (SELECT unnest(range(0, 80, 16)) AS a), (SELECT unnest(range(0, 80, 16)) AS b) WHERE (a = 0 OR a + 16 <= p_size + 10) AND (b = 0 OR b + 16 <= p_partkey % 70)")
def crop_grid(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 10).cast("int").alias("height"), (F.col("p_partkey") % 70).cast("int").alias("width"))
    return frames.crop_starts(rows, 16)


@query("SELECT o_orderstatus, round(avg(v), 4) AS mean_m, round(median(v), 4) AS median_m, count(v) AS n FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 1000 END AS v FROM orders) GROUP BY 1")
def displacement_summary(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") / 1000).alias("metres"))
    return frames.displacement_summary(rows, ["o_orderstatus"])


@query(f"WITH {SD}, s AS (SELECT cut, count(*) FILTER (prob > cut AND truth = 1) AS tp, count(*) FILTER (prob > cut AND truth = 0) AS fp, count(*) FILTER (prob <= cut AND truth = 1) AS fn FROM sd, (SELECT unnest([0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7]::DOUBLE[]) AS cut) GROUP BY cut), g AS (SELECT cut, {F1} FROM s) SELECT cut, f1 FROM g ORDER BY f1 DESC, cut LIMIT 1")
def best_threshold(spark, d):
    """The cut with the best F1, the first of equal ones."""
    return thresholds.best_cut(thresholds.cut_sweep(scored(spark, d), [0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7])).select("cut", "f1")


@query(f"WITH {PX}, m AS (SELECT family, t, avg(v) AS v FROM px GROUP BY ALL) SELECT family, round(median(v), 6) AS median, round(avg(v), 6) AS mean FROM m GROUP BY 1")
def monthly_levels(spark, d):
    return thresholds.monthly_levels(pixels(spark, d).withColumnRenamed("t", "month"), ["family"])


@query(None)
def calibrated_offset(spark, d):
    """Otsu's cut of pooled prices less the median of the months' land modes; tested against a brute force."""
    rows = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("cell"), (F.col("l_extendedprice") / 100000).alias("v"))
    return thresholds.calibrated_offset(rows, thresholds.land_mode(rows, ["month"], 0.0, 0.9, least=20), 0.0, 0.9, every=3)


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), p AS (SELECT *, sum((trim(text) = '')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS paragraph FROM l) SELECT doc_id, min(n) AS n, string_agg(trim(text), ' ' ORDER BY n) AS text FROM p WHERE trim(text) <> '' GROUP BY doc_id, paragraph")
def paragraphs(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return text.paragraphs(lines.withColumn("n", F.col("n").cast("bigint")), ["doc_id"])


@query(r"SELECT p_partkey, len(regexp_extract_all(regexp_replace('# ' || p_name || ' ![a-b](c d) *' || p_type || '* | x-y_z', '!\[.*?\]\(.*?\)|[#*`|>_\-]', ' ', 'g'), '\S+')) AS n FROM part")
def markdown_words(spark, d):
    """Words without Markdown's images and marks."""
    body = F.concat(F.lit("# "), "p_name", F.lit(" ![a-b](c d) *"), "p_type", F.lit("* | x-y_z"))
    return table(spark, d, "part").select("p_partkey", text.word_count(body).alias("n"))




@query(f"WITH {Z} SELECT f, zone, count(*)::DOUBLE AS area FROM z GROUP BY ALL")
def zone_rings(spark, d):
    """The rings' areas, holes taken off, are the zones' numbers of cells."""
    return rings_of.zone_rings(_zones(spark, d), ["f", "zone"]).groupBy("f", "zone").agg(F.sum("area").alias("area"))


@query(None)
def recurrent_forecast(spark, d):
    """A small forecaster with made-up weights over the frames; tested against plain loops."""
    rng = np.random.default_rng(7)
    pair = lambda *shape: (rng.normal(size=shape) / 4, rng.normal(size=shape[0]) / 4)
    weights = {"layers": [pair(16, 5, 3, 3), pair(16, 8, 3, 3)], "inner": pair(4, 4, 3, 3), "outer": pair(3, 4, 1, 1), "norm": (np.ones(4), np.zeros(4))}
    rows = masks(spark, d).select(F.lit(0).alias("tile"), F.col("f").alias("t"), "r", "c", F.col("m").cast("double").alias("v"))
    return forecast.recurrent_forecast(rows, ["tile"], weights, 3).withColumn("prob", F.round("prob", 6))
