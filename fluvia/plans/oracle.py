"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from fluvia.functions.text import DIGRAPHS

PX = "px AS (SELECT (user_id % 4)::INT AS tile, (event_id % 16)::INT AS r, ((event_id // 16) % 16)::INT AS c, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, least(1.0, (round(value * 100)::BIGINT - 5000) / 10000.0)::DOUBLE AS v, event_type AS family, event_id FROM events)"
MK = PX + ", ag AS (SELECT (t // 10)::INT AS f, r, c, (sum(round(v * 10000)::BIGINT) > 0)::INT AS m FROM px GROUP BY ALL), gr AS (SELECT f::INT AS f, r::INT AS r, c::INT AS c FROM range(3) a(f), range(16) b(r), range(16) d(c)), mk AS (SELECT gr.f, gr.r, gr.c, coalesce(m, 0) AS m FROM gr LEFT JOIN ag ON gr.f = ag.f AND gr.r = ag.r AND gr.c = ag.c)"
RK = "pc AS (SELECT n_name AS gid_union, n_regionkey AS district, o_orderstatus AS s, o_totalprice / 10000 AS a FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('F', 'O')), rk AS (SELECT *, round(accretion_ha - erosion_ha, 4) AS net_land_change_ha, round_even(buildings_osm / 0.7, 0)::INT AS households_est, round_even(round_even(buildings_osm / 0.7, 0) * 4.5::DOUBLE, 0)::INT AS persons_est FROM (SELECT gid_union, district, round(coalesce(sum(a) FILTER (s = 'F'), 0), 4) AS erosion_ha, round(coalesce(sum(a) FILTER (s = 'O'), 0), 4) AS accretion_ha, count(*) FILTER (s = 'F')::INT AS buildings_osm FROM pc GROUP BY ALL))"
UR = "ur AS (SELECT c_name AS gid_union, c_mktsegment AS \"union\", n_name AS district, c_acctbal AS erosion_ha, (c_custkey % 5)::INT AS buildings_osm, (c_custkey % 50)::INT AS households_est FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SC = "sc AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN l_quantity % 7 <> 0 THEN l_discount * 1000 END AS cloud FROM lineitem)"
ST = PX + ", md AS (SELECT event_id // 4096 AS tile, r, c, t, median(v) AS v, count(v) AS n FROM px GROUP BY ALL), st AS (SELECT k.tile::INT AS tile, k.r, k.c, d.t::INT AS t, md.v, least(255, coalesce(n, 0))::INT AS n_obs FROM (SELECT DISTINCT tile, r, c FROM md) k CROSS JOIN (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM px) d LEFT JOIN md ON md.tile = k.tile AND md.r = k.r AND md.c = k.c AND md.t = d.t), cv AS (SELECT tile, t, avg((v IS NOT NULL)::INT) AS observed FROM st GROUP BY ALL)"
SW = ST + ", sw AS (SELECT tile, t AS t0, avg(observed) OVER (w ROWS BETWEEN 12 FOLLOWING AND 14 FOLLOWING) AS target_observed, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS n FROM cv WINDOW w AS (PARTITION BY tile ORDER BY t))"
SD = MK + ", sd AS (SELECT a.r, a.c, a.m AS truth, sum(b.m) * 0.4::DOUBLE + a.r * 0.01::DOUBLE AS prob FROM mk a JOIN mk b ON a.r = b.r AND a.c = b.c AND b.f < 2 WHERE a.f = 2 GROUP BY a.r, a.c, a.m)"
F1 = "round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE END, 6) AS iou, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS \"precision\", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1"
COUNTS = "count(*) FILTER (prob > 0.5 AND truth = 1) AS tp, count(*) FILTER (prob > 0.5 AND truth = 0) AS fp, count(*) FILTER (prob <= 0.5 AND truth = 1) AS fn"
ED = MK + ", ed AS (SELECT * FROM mk a WHERE m = 1 AND EXISTS (SELECT 1 FROM mk b WHERE b.f = a.f AND b.m = 0 AND abs(a.r - b.r) + abs(a.c - b.c) = 1))"
SUP = "pl AS (SELECT s_suppkey, 88 + (s_suppkey % 97) / 50 AS lon, 24 + (s_suppkey % 89) / 50 AS lat FROM supplier)"
PIP = "pip AS (SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON c_custkey % 97 > s_suppkey % 97 AND c_custkey % 97 < s_suppkey % 97 + 9 AND c_custkey % 89 > s_suppkey % 89 AND c_custkey % 89 < s_suppkey % 89 + 7 GROUP BY 1)"
OV = MK + ", un AS (SELECT r::INT AS r, c::INT AS c, 'a' AS unit FROM range(9) x(r), range(16) y(c) UNION ALL SELECT r::INT, c::INT, 'b' FROM range(7, 14) x(r), range(16) y(c)), ov AS (SELECT f AS zone, mk.r, mk.c, unit FROM mk LEFT JOIN un ON mk.r = un.r AND mk.c = un.c WHERE m = 1)"
FIL = "(SELECT l_returnflag AS family, greatest(0.0, least(0.9, l_extendedprice / 100000)) AS v FROM lineitem)"


def _hist(bins: int) -> str:
    return f"v AS {FIL}, mm AS (SELECT family, min(v) AS lo, max(v) AS hi, count(*) AS total FROM v GROUP BY 1), h AS (SELECT family, lo, hi, total, (hi - lo) / {bins} AS w, least({bins - 1}, floor((v - lo) / ((hi - lo) / {bins})))::INT AS bin, count(*) AS n FROM v JOIN mm USING (family) WHERE total >= 1000 GROUP BY ALL)"


def _latin() -> str:
    s = "regexp_replace(lower(p_name), '[^a-z]', '', 'g')"
    for a, b in DIGRAPHS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"regexp_replace(translate({s}, 'qzv', 'kjb'), '[aeiouyw]', '', 'g')"
    for x in "bcdfghjklmnprstx":
        s = f"regexp_replace({s}, '{x}+', '{x}', 'g')"
    return s



def _squeezed(s: str) -> str:
    for letter in "bdgklmnrt" * 2:
        s = f"replace({s}, '{letter * 2}', '{letter}')"
    return s


ORACLE_SQL = {
    "stream_composite": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "risk_table": f"WITH {RK} SELECT * FROM rk",
    "risk_enriched": f"WITH {RK} SELECT gid_union, r_name AS region, erosion_ha, net_land_change_ha, persons_est FROM rk LEFT JOIN region ON district = r_regionkey",
    "severity_bands": "SELECT CASE WHEN o_totalprice / 5000 >= 50 THEN 'very high' WHEN o_totalprice / 5000 >= 20 THEN 'high' WHEN o_totalprice / 5000 >= 5 THEN 'moderate' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1",
    "kpi_summary": f"WITH {RK} SELECT count(*) AS units, count(*) FILTER (erosion_ha > 0) AS eroding, round(sum(erosion_ha), 4) AS erosion_ha, round(sum(accretion_ha), 4) AS accretion_ha, sum(buildings_osm)::BIGINT AS buildings, count(*) FILTER (erosion_ha > 0 AND buildings_osm = 0) AS unmapped FROM rk",
    "table_query_default": f"WITH {UR} SELECT * FROM ur ORDER BY erosion_ha DESC, gid_union",
    "table_query_filtered": f"WITH {UR} SELECT * FROM ur WHERE district = 'NATION_3' AND erosion_ha >= 100 AND (lower(\"union\") LIKE '%mach%' OR lower(district) LIKE '%mach%' OR lower(gid_union) LIKE '%mach%')",
    "table_query_sorted_nulls_last": f"WITH {UR}, k AS (SELECT *, CASE WHEN NOT (erosion_ha > 0 AND buildings_osm = 0) THEN households_est END AS known FROM ur) SELECT district, gid_union, (row_number() OVER (PARTITION BY district ORDER BY known DESC NULLS LAST, erosion_ha DESC, gid_union))::INT AS place, known FROM k",
    "state_query_strings": "SELECT n_name AS district, concat_ws('&', 'district=' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'q=char+alga' END, CASE n_nationkey % 4 WHEN 1 THEN 'min=10' WHEN 2 THEN 'min=100' WHEN 3 THEN 'min=500' END, CASE WHEN n_nationkey % 3 = 0 THEN 'sort=union' END, CASE WHEN n_nationkey % 5 = 0 THEN 'dir=asc' END) AS search FROM nation",
    "units_in_view": "SELECT min(c_custkey % 97) AS west, min(c_custkey % 89) AS south, max(c_custkey % 97) AS east, max(c_custkey % 89) AS north, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_4'",
    "district_options": f"WITH {UR} SELECT district, count(*) AS n FROM ur GROUP BY 1",
    "topk_erosion": "WITH t AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) SELECT *, least(6, floor(6 * (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())))::INT AS bucket FROM t",
    "data_quality": "SELECT count(*) FILTER (o_custkey IS NULL) AS null_o_custkey, count(*) FILTER (o_orderstatus IS NULL) AS null_o_orderstatus, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS unknown_o_orderstatus, count(o_orderkey) - count(DISTINCT o_orderkey) AS repeated_o_orderkey, count(*) FILTER (isnan(o_totalprice) OR isinf(o_totalprice)) AS nonfinite_o_totalprice FROM orders",
    "scene_search_month": f"WITH {SC} SELECT month, count(*) AS n, count(cloud) AS n_known FROM sc WHERE cloud IS NULL OR cloud < 50 GROUP BY 1",
    "least_cloudy_topk": f"WITH {SC}, s AS (SELECT month, l_orderkey * 100 + l_linenumber AS id, min(cloud) AS cloud FROM sc GROUP BY ALL) SELECT month, id, cloud, (row_number() OVER (PARTITION BY month ORDER BY coalesce(cloud, 101), id))::INT AS rank FROM s QUALIFY rank <= 10",
    "overview_level": "SELECT p_partkey, CASE WHEN p_size * 40 >= 60 THEN least(5, greatest(0, floor(log2(p_size * 40 / 30.0)) - 1))::INT END AS level FROM part",
    "resume_pending": "SELECT c_custkey, y::INT AS year FROM customer, range(1992, 1995) x(y) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y)",
    "water_index": "WITH b AS (SELECT l_orderkey & 63 = 0 AS usable, l_returnflag = 'A' AS l2, nullif((l_quantity * 400) % 20000, 0) AS g, nullif((l_tax * 100000) % 7000, 0) AS d FROM lineitem), r AS (SELECT usable, CASE WHEN l2 THEN g * 0.0000275::DOUBLE - 0.2::DOUBLE ELSE g END AS g, CASE WHEN l2 THEN d * 0.0000275::DOUBLE - 0.2::DOUBLE ELSE d END AS d FROM b), x AS (SELECT usable, CASE WHEN abs(g + d) >= 1e-6 THEN greatest(-1, least(1, (g - d) / (g + d))) END AS v FROM r), p AS (SELECT *, coalesce(trunc(v * 10000), -32768)::BIGINT AS k FROM x) SELECT usable, count(*) AS n, count(v) AS n_valid, round(avg(v), 6) AS mean, sum(k)::BIGINT AS packed, round(sum(CASE WHEN k <> -32768 THEN k / 10000.0::DOUBLE END), 3) AS unpacked FROM p GROUP BY 1",
    "sensor_lookup": "WITH e AS (SELECT event_id % 10 AS p, event_id % 11 = 0 AS mss FROM events) SELECT CASE WHEN mss OR p IN (1, 2, 3) THEN 'NDWI' WHEN p IN (4, 5, 7, 8, 9) THEN 'MNDWI' END AS family, CASE WHEN mss OR p IN (1, 2, 3) THEN 'L1' WHEN p IN (4, 5, 7, 8, 9) THEN 'L2' END AS level, CASE WHEN mss OR p IN (1, 2, 3) THEN 60.0 WHEN p IN (4, 5, 7, 8, 9) THEN 30.0 END::DOUBLE AS native_m, count(*) AS n FROM e GROUP BY ALL",
    "monthly_median_composite": f"WITH {PX} SELECT tile, r, t, round(median(v), 6) AS v, count(v) AS n_obs FROM px GROUP BY ALL",
    "family_mode": f"WITH {PX}, n AS (SELECT tile, t, family, count(*) AS k FROM px GROUP BY ALL) SELECT tile, t, family FROM n QUALIFY row_number() OVER (PARTITION BY tile, t ORDER BY k DESC, family) = 1",
    "calendar_stack": f"WITH {ST} SELECT tile, r, c, t, round(v, 6) AS v, n_obs FROM st",
    "gap_fill": f"WITH {ST}, a AS (SELECT *, max(t) FILTER (v IS NOT NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0, min(t) FILTER (v IS NOT NULL) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM st WINDOW w AS (PARTITION BY tile, r, c ORDER BY t)), j AS (SELECT a.*, p.v AS v0, q.v AS v1 FROM a LEFT JOIN st p ON p.tile = a.tile AND p.r = a.r AND p.c = a.c AND p.t = t0 LEFT JOIN st q ON q.tile = a.tile AND q.r = a.r AND q.c = a.c AND q.t = t1), g AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN CASE WHEN t1 - t0 - 1 <= 2 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END WHEN t - t0 <= 2 THEN v0 WHEN t1 - t <= 2 THEN v1 END AS x FROM j) SELECT tile, r, c, t, round(x, 6) AS filled, v IS NULL AND x IS NOT NULL AS was_filled FROM g",
    "temporal_smooth": f"WITH {ST} SELECT a.tile, a.r, a.c, a.t, round(median(b.v), 6) AS smoothed FROM st a JOIN st b ON a.tile = b.tile AND a.r = b.r AND a.c = b.c AND abs(a.t - b.t) <= 1 GROUP BY ALL",
    "median_filter_3x3": f"WITH {MK}, v AS (SELECT f, r, c, CASE WHEN m = 1 THEN ((r * 7 + c * 3) % 11)::DOUBLE END AS v FROM mk), fl AS (SELECT f, r, c, v, coalesce(v, median(v) OVER (PARTITION BY f)) AS x FROM v) SELECT a.f, a.r, a.c, CASE WHEN max(a.v) IS NOT NULL THEN round(median(b.x), 6) END AS smooth FROM fl a CROSS JOIN range(-1, 2) i(i) CROSS JOIN range(-1, 2) j(j) JOIN fl b ON b.f = a.f AND b.r = greatest(0, least(15, a.r + i)) AND b.c = greatest(0, least(15, a.c + j)) GROUP BY a.f, a.r, a.c",
    "land_mode": f"WITH {_hist(200)} SELECT family, round(lo + (bin + 0.5::DOUBLE) * w, 6) AS mode FROM h QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, bin) = 1",
    "otsu_threshold": f"WITH {_hist(256)}, c AS (SELECT *, lo + (bin + 0.5::DOUBLE) * w AS x FROM h), s AS (SELECT *, sum(n) OVER k AS w0, sum(n * x) OVER k AS s0, sum(n * x) OVER (PARTITION BY family) AS s FROM c WINDOW k AS (PARTITION BY family ORDER BY bin)), b AS (SELECT *, round(w0 * (total - w0) * power(s0 / w0 - (s - s0) / (total - w0), 2), 6) AS between_ FROM s WHERE w0 < total) SELECT family, round(x, 6) AS cut FROM b QUALIFY row_number() OVER (PARTITION BY family ORDER BY between_ DESC, bin) = 1",
    "calibrate_delta": f"WITH {PX}, g AS (SELECT k, -0.1::DOUBLE + k * 0.005::DOUBLE AS d FROM range(110) x(k)), fr AS (SELECT family, tile, k, avg((v > d)::INT) AS f FROM px CROSS JOIN g GROUP BY ALL), m AS (SELECT family, k, abs(median(f) - 0.3::DOUBLE) AS gap FROM fr GROUP BY ALL) SELECT family, round(-0.1::DOUBLE + k * 0.005::DOUBLE, 6) AS delta, round(gap, 6) AS gap FROM m QUALIFY row_number() OVER (PARTITION BY family ORDER BY round(gap, 9), k) = 1",
    "threshold_stack": f"WITH {PX} SELECT tile, t, round(avg(coalesce(v > CASE family WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.0 WHEN 'error' THEN -0.2 END, false)::INT), 6) AS water, count(*) AS n FROM px GROUP BY ALL",
    "water_fraction": f"WITH {ST} SELECT tile, t, round(avg(coalesce(v > 0, false)::INT), 6) AS fraction FROM st GROUP BY ALL",
    "temporal_split": "SELECT CASE WHEN year(o_orderdate) <= 1994 THEN 'train' WHEN year(o_orderdate) <= 1996 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1",
    "sliding_windows": f"WITH {SW} SELECT tile, t0, round(target_observed, 6) AS target_observed FROM sw WHERE n = 15 AND target_observed >= 0.3 AND t0 % 2 = 0",
    "even_subsample": f"WITH {SW}, w AS (SELECT tile, t0, row_number() OVER (ORDER BY tile, t0) - 1 AS i, count(*) OVER () AS n FROM sw WHERE n = 15) SELECT tile, t0 FROM w WHERE n <= 10 OR i IN (SELECT k * (SELECT max(n) FROM w) // 10 FROM range(10) x(k))",
    "class_balance": "SELECT round(coalesce(count(*) FILTER (toxic = 0) / nullif(count(*) FILTER (toxic = 1), 0), 1.0)::DOUBLE, 6) AS pos_weight FROM labels",
    "persistence_forecast": f"WITH {MK} SELECT r, c, h::INT AS h, m AS water, round(1 / (1 + exp(-8 * (2 * m - 1))), 6) AS prob FROM mk, range(1, 4) x(h) WHERE f = 2",
    "change_masks": f"WITH {MK} SELECT a.r, a.c, a.m = 0 AND b.m = 1 AS erosion, a.m = 1 AND b.m = 0 AS accretion FROM mk a JOIN mk b ON a.r = b.r AND a.c = b.c WHERE a.f = 0 AND b.f = 2",
    "seasonal_reference": f"WITH {ST}, an AS (SELECT tile, max(t) FILTER (observed > 0.2) AS anchor, min(t) AS first FROM cv GROUP BY 1), x AS (SELECT st.tile, r, c, max((v > 0)::INT) FILTER (t = anchor - 9) AS seasonal, max((v > 0)::INT) FILTER (t = anchor) AS latest FROM st JOIN an ON st.tile = an.tile WHERE anchor - first >= 12 GROUP BY ALL) SELECT *, coalesce(seasonal, latest) AS reference FROM x",
    "change_components": f"WITH RECURSIVE {MK}, w AS (SELECT f, r, c, r * 1000000 + c AS id FROM mk WHERE m = 1), e AS (SELECT a.f, a.id AS a, b.id AS b FROM w a JOIN w b ON a.f = b.f AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1), x(f, id, z) AS (SELECT f, id, id FROM w UNION SELECT x.f, x.id, e.b FROM x JOIN e ON e.f = x.f AND e.a = x.z), l AS (SELECT f, id, min(z) AS zone FROM x GROUP BY ALL) SELECT f, zone, count(*) AS n_cells, round(count(*) * 1.44, 6)::DOUBLE AS area_ha FROM l GROUP BY ALL",
    "bank_band": f"WITH {MK}, x AS (SELECT a.f, a.r, a.c, max(b.m) AS d, min(b.m) AS e FROM mk a JOIN mk b ON a.f = b.f AND abs(a.r - b.r) + abs(a.c - b.c) <= 2 GROUP BY ALL) SELECT *, (d = 1 AND e = 0)::INT AS band FROM x",
    "boundary_pixels": f"WITH {ED} SELECT f, r, c FROM ed",
    "boundary_displacement": f"WITH {ED}, p AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2, sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) AS d FROM ed a, ed b WHERE a.f = 0 AND b.f = 2), x AS (SELECT avg(d) AS d FROM (SELECT min(d) AS d FROM p GROUP BY r, c)), y AS (SELECT avg(d) AS d FROM (SELECT min(d) AS d FROM p GROUP BY r2, c2)) SELECT 1 AS k, round((x.d + y.d) / 2 * 120, 4) AS metres FROM x, y WHERE x.d IS NOT NULL AND y.d IS NOT NULL",
    "confusion_metrics": f"WITH {SD}, n AS (SELECT r % 2 AS half, {COUNTS} FROM sd GROUP BY 1) SELECT *, {F1} FROM n",
    "horizon_metrics": f"WITH {SD}, n AS (SELECT r, c % 3 + 1 AS h, {COUNTS} FROM sd GROUP BY ALL), m AS (SELECT h, {F1} FROM n) SELECT h, round(avg(f1), 5) AS f1, count(*) AS batches FROM m GROUP BY 1",
    "threshold_sweep": f"WITH {SD}, q AS (SELECT unnest([0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7])::DOUBLE AS cut), n AS (SELECT cut, count(*) FILTER (prob > cut AND truth = 1) AS tp, count(*) FILTER (prob > cut AND truth = 0) AS fp, count(*) FILTER (prob <= cut AND truth = 1) AS fn FROM sd, q GROUP BY 1) SELECT *, {F1} FROM n",
    "sobel_gradient": f"WITH {MK}, w(i, j, x, y) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) SELECT a.f, a.r, a.c, sum(b.m * x)::DOUBLE AS gx, sum(b.m * y)::DOUBLE AS gy FROM mk a CROSS JOIN w JOIN mk b ON b.f = a.f AND b.r = a.r + i AND b.c = a.c + j GROUP BY ALL",
    "bce_loss": f"WITH {MK} SELECT f, round(avg(2.5::DOUBLE * m * ln(1 + exp(-(r - c) / 4.0)) + (1 - m) * ln(1 + exp((r - c) / 4.0))), 6) AS loss FROM mk WHERE r > 0 GROUP BY 1",
    "tile_blend": f"WITH {MK}, s AS (SELECT unnest([0, 4, 8]) AS s), q AS (SELECT f, r, c, m * 0.5::DOUBLE + (a.s + b.s) * 0.01::DOUBLE AS p, greatest(1e-3, 0.5 - 0.5 * cos(2 * pi() * (r - a.s) / 7)) * greatest(1e-3, 0.5 - 0.5 * cos(2 * pi() * (c - b.s) / 7)) AS w FROM mk, s a, s b WHERE r >= a.s AND r < a.s + 8 AND c >= b.s AND c < b.s + 8) SELECT f, r, c, round(sum(p * w) / greatest(sum(w), 1e-6), 6) AS p FROM q GROUP BY ALL",
    "study_grid": "WITH b AS (SELECT floor((min(s_suppkey) + 740) * 1000.5 / 61440) * 61440 AS x0, ceil((max(s_suppkey) * 10 + 2950000) / 61440) * 61440 AS y0, (min(s_suppkey) + 740) * 1000.5 + 130000 AS r, max(s_suppkey) * 10 + 2700000 AS t FROM supplier) SELECT i::INT AS row, j::INT AS col, (x0 + j * 61440)::DOUBLE AS origin_x, (y0 - i * 61440)::DOUBLE AS origin_y FROM b, range(20) x(i), range(20) y(j) WHERE i < greatest(1, ceil((y0 - t) / 61440)) AND j < greatest(1, ceil((r - x0) / 61440))",
    "utm_project": f"WITH {SUP}, k AS (SELECT 1 / 298.257223563 AS fl), n AS (SELECT fl / (2 - fl) AS n FROM k), g AS (SELECT s_suppkey, radians(lat) AS p, radians(lon - 87) AS l, n, 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a, 2 * sqrt(n) / (1 + n) AS s FROM pl, n), t AS (SELECT *, sinh(atanh(sin(p)) - s * atanh(s * sin(p))) AS t FROM g), x AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM t) SELECT s_suppkey, round(500000 + 0.9996::DOUBLE * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS east, round(0.9996::DOUBLE * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS north FROM x",
    "lattice_cells": f"WITH {SUP}, b AS (SELECT s_suppkey, floor(round(lon / 0.1, 6)) AS i0, greatest(floor(round(lon / 0.1, 6)), ceil(round((lon + 0.13) / 0.1, 6)) - 1) AS i1, floor(round(lat / 0.1, 6)) AS j0, greatest(floor(round(lat / 0.1, 6)), ceil(round((lat + 0.08) / 0.1, 6)) - 1) AS j1 FROM pl) SELECT s_suppkey, i::INT AS i, j::INT AS j, round(i * 0.1::DOUBLE, 6) AS cell_west, round(j * 0.1::DOUBLE, 6) AS cell_south FROM b, range(800, 1000) x(i), range(200, 300) y(j) WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1",
    "points_in_polygons": f"WITH {PIP} SELECT * FROM pip",
    "mapping_density": f"WITH {PIP}, u AS (SELECT s_suppkey, 63 * CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE 0.05 END::DOUBLE AS a FROM supplier), d AS (SELECT u.s_suppkey, a, round(CASE WHEN a >= 1 THEN coalesce(n, 0) / a END, 6) AS density FROM u LEFT JOIN pip ON u.s_suppkey = pip.s_suppkey) SELECT s_suppkey, round(a, 6) AS area_km2, density, CASE WHEN density IS NULL THEN 'not measured' WHEN density < 10 THEN 'low' WHEN density < 100 THEN 'medium' ELSE 'high' END AS mapping FROM d",
    "overlay_identity": f"WITH {OV} SELECT zone, unit, count(*) AS n_cells, round(count(*) * 1.44, 6)::DOUBLE AS area_ha FROM ov GROUP BY ALL",
    "one_unit_per_place": f"WITH {OV}, s AS (SELECT *, count(*) OVER (PARTITION BY zone, unit) AS k FROM ov), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY zone, r, c ORDER BY k DESC, unit) = 1) SELECT zone, unit, count(*) AS n_cells, round(count(*) * 1.44, 6)::DOUBLE AS area_ha FROM o GROUP BY ALL",
    "year_sensor_pivot": "WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, year(l_shipdate) AS y, l_returnflag AS k FROM lineitem), c AS (SELECT y::INT AS y FROM range((SELECT min(y) FROM r), (SELECT max(y) FROM r) + 1) x(y)) SELECT c.y AS year, count(*) FILTER (k = 'A') AS \"A\", count(*) FILTER (k = 'N') AS \"N\", count(*) FILTER (k = 'R') AS \"R\" FROM c LEFT JOIN r ON r.y = c.y GROUP BY 1",
    "latin_skeleton": f"SELECT p_name, {_latin()} AS key FROM (SELECT DISTINCT p_name FROM part)",
    "page_titles": "SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM pages",
    "display_names": "SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' ' || p_brand || ' (Part)' AS name FROM part",
    "csv_cells": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '''=' || c_mktsegment WHEN 1 THEN '\"\"\"' || c_mktsegment || '\"' WHEN 2 THEN '\",' || c_mktsegment || '\"' ELSE 'x' || c_mktsegment END AS cell, round(c_acctbal, 0)::BIGINT || '.0' AS number FROM customer",
    "csv_document": "SELECT chr(65279) || 'n_nationkey,n_name' || chr(13) || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(13) || chr(10) ORDER BY n_nationkey) || chr(13) || chr(10) AS document FROM nation",
    "number_format": "SELECT s_suppkey, translate(format('{:,.2f}', s_acctbal), '0123456789', '০১২৩৪৫৬৭৮৯') AS bengali, floor(s_acctbal / 10.0 + 0.5) * 10.0::DOUBLE AS roughly FROM supplier",
    "manuscript_words": "SELECT lang, sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')))::BIGINT AS n_words FROM documents GROUP BY 1",
    "hash_keys": "SELECT doc_id, sha256(text) AS digest, substr(sha1(format('{:.6f}_{:.6f}', (doc_id % 7) / 10, (doc_id % 5) / 10)), 1, 16) AS cell FROM documents",
    "attention_scores": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS q_id, v.vec_id, list_inner_product(v.e, q.e) / 8 AS s FROM e v, e q WHERE q.vec_id % 100 = 0), x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY q_id)) AS x FROM s) SELECT q_id, vec_id, round(x / sum(x) OVER (PARTITION BY q_id), 6) AS weight FROM x",
    "cube_rollup": f"WITH {RK}, p AS (SELECT district, CASE s WHEN 'F' THEN 'erosion' ELSE 'accretion' END AS kind FROM pc) SELECT district, kind, count(*) AS n, grouping(district, kind)::INT AS level FROM p GROUP BY CUBE (district, kind)",
    "asof_prev": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id FROM events",
    "value_counts": "WITH b AS (SELECT CASE WHEN o_totalprice / 5000 >= 50 THEN 'very high' WHEN o_totalprice / 5000 >= 20 THEN 'high' WHEN o_totalprice / 5000 >= 5 THEN 'moderate' ELSE 'low' END AS k FROM orders), n AS (SELECT k, count(*) AS n FROM b GROUP BY 1) SELECT '{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}' AS counts FROM n",
    "state_roundtrip": "SELECT n_name, n_name AS district, CASE WHEN n_nationkey % 2 = 0 THEN 'char alga' ELSE '' END AS query, [0, 10, 100, 500][n_nationkey % 4 + 1]::INT AS min_erosion, CASE WHEN n_nationkey % 3 = 0 THEN 'union' ELSE 'erosion_ha' END AS sort, CASE WHEN n_nationkey % 5 = 0 THEN 'asc' ELSE 'desc' END AS dir FROM nation",
    "coverage_cells": f"WITH {SUP}, b AS (SELECT floor(round(lon / 0.1, 6)) AS i0, greatest(floor(round(lon / 0.1, 6)), ceil(round((lon + 0.13) / 0.1, 6)) - 1) AS i1, floor(round(lat / 0.1, 6)) AS j0, greatest(floor(round(lat / 0.1, 6)), ceil(round((lat + 0.08) / 0.1, 6)) - 1) AS j1 FROM pl) SELECT DISTINCT i::INT AS i, j::INT AS j, (i * 7 + j) % 5 <> 0 AS answered FROM b, range(800, 1000) x(i), range(200, 300) y(j) WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1",
    "overlay_intersection": f"WITH {OV} SELECT zone, unit, count(*) AS n_cells, round(count(*) * 1.44, 6)::DOUBLE AS area_ha FROM ov WHERE unit IS NOT NULL GROUP BY ALL",
    "error_area": f"WITH {SD}, n AS (SELECT r % 2 AS half, {COUNTS} FROM sd GROUP BY 1) SELECT half, round(tp * 1.44, 6)::DOUBLE AS hit_ha, round(fp * 1.44, 6)::DOUBLE AS false_ha, round(fn * 1.44, 6)::DOUBLE AS missed_ha FROM n",
    "bengali_skeleton": f"SELECT p_name, {_squeezed("regexp_replace(p_name, '[^bdgklmnrt]', '', 'g')")} AS key FROM (SELECT DISTINCT p_name FROM part)",
    "clean_names": "SELECT n_nationkey, n_name AS name, true AS bengali, false AS latin_is FROM nation",
    "markdown_tables": "WITH n AS (SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY 1) SELECT '| quality | n | toxic |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || coalesce(quality::VARCHAR, '—') || ' | ' || n || ' | ' || toxic || ' |', chr(10) ORDER BY quality NULLS FIRST) AS document FROM n",
    "linear_head": "SELECT vec_id, round(1 / (1 + exp(-(list_inner_product(embedding::DOUBLE[], [(k % 7 - 3) / 10::DOUBLE FOR k IN range(64)]) + 0.25))), 6) AS prob FROM embeddings",
    "approx_distinct": "SELECT DISTINCT event_type, true AS close FROM events",
}
