"""Queries of points in polygons by load, and of the learned forecaster."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvia.operators import learned, quadtree, series
from fluvia.plans.oracle import ST
from fluvia.plans.registry import CELL, stack, table
from fluvia.storage import stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    "WITH p AS (SELECT vendor_id * 3 + item_id % 7 AS x, sale_id % 12 AS y, count(*) AS n FROM sale_lines GROUP BY ALL), v AS (SELECT DISTINCT vendor_id, vendor_id * 3 AS l FROM vendors WHERE vendor_id IS NOT NULL) "
    "SELECT v.vendor_id, sum(n)::BIGINT AS n_points FROM p JOIN v ON x > l AND x < l + 9 WHERE y > 0 AND (y < 4 OR (y < 10 AND x < l + 5)) GROUP BY 1"
)
def points_by_load(spark, d):
    """Sale lines within the angular district of each vendor; a hot vendor's lines lie in few places, and are counted there first."""
    at = F.col("vendor_id") * 3 + F.col("item_id") % 7, F.col("sale_id") % 12
    points = table(spark, d, "sale_lines").groupBy(*(v.cast("double").alias(k) for k, v in zip("xy", at, strict=True))).agg(F.count("*").alias("n"))
    points = stored(points, "places")
    corner = lambda x, y: F.struct((F.col("vendor_id") * 3 + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(*(corner(x, y) for x, y in ((0, 0), (9, 0), (9, 4), (5, 4), (5, 10), (0, 10))))
    districts = table(spark, d, "vendors").where("vendor_id is not null").select("vendor_id").distinct().withColumn("ring", ring)
    return quadtree.points_in_polygons(points, districts).groupBy("vendor_id").agg(F.sum("n").alias("n_points"))


def months(spark, d):
    """Whether each cell of the calendar has water, where it was seen."""
    return stack(spark, d).select(*CELL, "t", (F.col("v") > 0).cast("int").alias("water"))


_AROUND = ", ".join(f"({i}, {j}, {k})" for k, (i, j) in enumerate(s for s in ((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if s != (0, 0)))


@query(
    f"WITH {ST}, w AS (SELECT tile, r, c, t, coalesce((v > 0)::INT, 0) AS w, (v > 0)::INT AS seen FROM st), k(i, j, k) AS (VALUES {_AROUND}), "
    "nb AS (SELECT a.tile, a.r, a.c, a.t, sum(b.w * (1 << (k.k + 3))) AS code FROM w a CROSS JOIN k JOIN w b ON b.tile = a.tile AND b.t = a.t AND b.r = a.r + k.i AND b.c = a.c + k.j GROUP BY ALL), "
    "o AS (SELECT tile, r, c, t, w, lag(w) OVER s AS w1, lag(w, 2) OVER s AS w2, lead(seen) OVER s AS truth, row_number() OVER s AS n FROM w WINDOW s AS (PARTITION BY tile, r, c ORDER BY t)) "
    "SELECT o.tile, o.r, o.c, o.t, (w + 2 * w1 + 4 * w2 + coalesce(code, 0))::BIGINT AS code, w AS latest, truth FROM o LEFT JOIN nb USING (tile, r, c, t) WHERE n >= 3"
)
def lagged_examples(spark, d):
    """The features of each cell and month as the bits of a number."""
    rows = learned.examples(months(spark, d), ["tile"])
    code = F.aggregate(F.transform("features", lambda x, i: F.shiftleft(x.cast("bigint"), 1) * F.pow(F.lit(2), i).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x) / 2
    return rows.select(*CELL, "t", code.cast("bigint").alias("code"), "latest", "truth")


@query(None)
def learned_forecast(spark, d):
    """Metrics on the last days of the learned forecaster, fitted on the first, and of persistence."""
    split = series.split_of(F.col("t"), 14, 20)
    rows = stored(learned.examples(months(spark, d), ["tile"]).select("tile", "features", "latest", "truth", split.alias("split")), "split-examples")
    return learned.compared(rows.where("split = 'test'"), learned.train(rows), ["tile"])
