"""Queries of polygon overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvia.operators import overlay
from fluvia.plans.registry import rings, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Side of the cells of the grid.
SPAN = 8.0


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _zones(spark, d):
    """A zone for each customer: 6 wide and 5 high, with a hole of 2 by 1, and a notch of 1 by 2 at its upper edge."""
    x, y = F.col("c_custkey") % 97, F.col("c_custkey") % 89
    ring = lambda *corners: F.array(*(F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in corners))
    outer, hole = ring((0, 0), (6, 0), (6, 5), (5, 5), (5, 3), (4, 3), (4, 5), (0, 5)), ring((1, 1), (3, 1), (3, 2), (1, 2))
    return table(spark, d, "customer").select("c_custkey", F.array(outer, hole).alias("rings"))


def _units(spark, d):
    return rings(spark, d).select("s_suppkey", F.array("ring").alias("rings"))


#: The cells of 1 by 1 that zones and units hold.
CELLS = """z AS (SELECT c_custkey, c_custkey % 97 + a AS x, c_custkey % 89 + b AS y FROM customer CROSS JOIN range(6) s(a) CROSS JOIN range(5) t(b)
                 WHERE NOT (a IN (1, 2) AND b = 1) AND NOT (a = 4 AND b >= 3)),
    u AS (SELECT s_suppkey, s_nationkey, s_suppkey % 97 + a AS x, s_suppkey % 89 + b AS y FROM supplier CROSS JOIN range(9) s(a) CROSS JOIN range(7) t(b)),
    p AS (SELECT c_custkey, s_suppkey, count(*) AS n FROM z JOIN u USING (x, y) GROUP BY ALL)"""


@query(f"WITH {CELLS} SELECT c_custkey, s_suppkey, n::DOUBLE AS area FROM p")
def polygon_intersections(spark, d):
    """The area that each zone shares with each unit, every overlap counted for each of its units."""
    return overlay.intersections(_zones(spark, d), _units(spark, d), "c_custkey", "s_suppkey", SPAN).select("c_custkey", "s_suppkey", F.round("area", 6).alias("area"))


@query(
    f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, s_suppkey) AS place FROM p),
    t AS (SELECT z.c_custkey, z.x, z.y, arg_min(r.s_suppkey, r.place) AS s_suppkey FROM z LEFT JOIN u USING (x, y) LEFT JOIN r ON r.c_custkey = z.c_custkey AND r.s_suppkey = u.s_suppkey GROUP BY ALL)
    SELECT c_custkey, s_suppkey, count(*)::DOUBLE AS area FROM t GROUP BY ALL"""
)
def polygon_identity(spark, d):
    """Zones split by units: a place that several units hold goes to the one with the larger part of the zone; what no unit holds stays."""
    return overlay.split_areas(_zones(spark, d), _units(spark, d), "c_custkey", "s_suppkey", SPAN).select("c_custkey", "s_suppkey", F.round("area", 6).alias("area"))


@query(
    f"""WITH {CELLS}, g AS (SELECT DISTINCT s_nationkey, x, y FROM u)
    SELECT s_nationkey, count(*)::DOUBLE AS area, sum(4 - (SELECT count(*) FROM g b WHERE b.s_nationkey = g.s_nationkey AND abs(b.x - g.x) + abs(b.y - g.y) = 1))::DOUBLE AS border FROM g GROUP BY 1"""
)
def dissolved_polygons(spark, d):
    """The union of each nation's units: its area, by its rings (holes taken off), and the length of its border."""
    units = _units(spark, d).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    ring = overlay.rings(overlay.dissolve(units, "s_nationkey", SPAN), ["s_nationkey"], SPAN)
    n = F.size("ring")
    side = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.abs(F.get("ring", k).x - F.get("ring", F.pmod(k + 1, n)).x) + F.abs(F.get("ring", k).y - F.get("ring", F.pmod(k + 1, n)).y))
    length = F.aggregate(side, F.lit(0.0), lambda a, b: a + b)
    return ring.groupBy("s_nationkey").agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum(length), 6).alias("border"))
