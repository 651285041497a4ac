"""Dataset-building queries: integrity checks, local services, feed integration."""

from __future__ import annotations

from pyspark.sql import functions as F

from demo.adapter import driver_table, network, source_sql
from demo.lookups import nz
from demo.registry import query
from netloom.functions import codes, kana, text
from netloom.operators import common as C
from netloom.operators import integrity as I
from netloom.plans import build as B
from netloom.plans import patterns as P
from netloom.plans import stop_groups as G
from netloom.plans import stop_order as O

# ------------------------------------------------------------------ feed tables over events

EV = """SELECT event_id, value, user_id,
  CASE user_id % 5 WHEN 0 THEN 'toei' WHEN 1 THEN 'seibu' WHEN 2 THEN 'keio' WHEN 3 THEN 'tokyu_json' ELSE 'other' END AS p,
  user_id % 5 AS pi, CAST(floor(user_id / 10) AS BIGINT) AS r, CAST(floor(user_id / 50) AS BIGINT) AS a,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor((day(ts) - 1) / 6) AS BIGINT) AS wk FROM events"""
G_ROUTES = """SELECT DISTINCT concat(p, ':', r) AS route_id, CASE WHEN r % 3 = 0 THEN NULL ELSE concat('R', r) END AS route_short_name,
  CASE WHEN r % 4 = 0 THEN NULL ELSE concat('Line ', r) END AS route_long_name,
  CASE WHEN r % 4 = 1 THEN concat('Roman ', r) END AS route_long_name_r, 3 AS route_type,
  CASE WHEN r % 3 = 0 THEN NULL WHEN r % 3 = 1 THEN 'AABBCC' ELSE '#DDEEFF' END AS route_color, r * 10 + pi AS ord FROM ev"""
G_STOPS = """SELECT DISTINCT concat(p, ':stop-', a, '-', k) AS stop_id, concat('停', k % 40) AS stop_name,
  CASE WHEN k % 4 = 0 THEN NULL ELSE 'てい' END AS stop_name_k, CASE WHEN k % 3 = 0 THEN NULL ELSE concat('Tei ', k % 40) END AS stop_name_r,
  CAST(NULL AS VARCHAR(9)) AS stop_name_zh, CAST(NULL AS VARCHAR(9)) AS stop_name_ko,
  35 + a / 2e1 + (k * 37 % 100) / 1e4 AS stop_lat, 139 + (k * 11 % 100) / 1e5 AS stop_lon,
  CASE WHEN k % 10 = 3 THEN concat(p, ':stop-', a, '-', k - 1) END AS parent_station, a * 1000 + k * 10 + pi AS ord FROM ev"""
G_TRIPS = """SELECT DISTINCT concat(p, ':trip-', user_id, '-', wk) AS trip_id, concat(p, ':', r) AS route_id,
  CASE WHEN wk % 3 = 0 THEN NULL ELSE concat('停', user_id % 40) END AS trip_headsign,
  CASE WHEN wk % 3 < 2 THEN CAST(wk % 3 AS INT) END AS direction_id,
  CASE WHEN wk = 4 THEN NULL ELSE concat(p, ':shape-', r, '-', wk % 4) END AS shape_id, user_id * 10 + wk AS ord FROM ev"""
G_TIMES = """SELECT concat(p, ':trip-', user_id, '-', wk) AS trip_id, concat(p, ':stop-', a, '-', k) AS stop_id,
  CAST(event_id AS INT) AS stop_sequence, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS shape_dist_traveled, event_id AS ord FROM ev"""

FEED_SQL = f"""
, ev AS ({EV}), g_routes AS ({G_ROUTES}), g_stops0 AS ({G_STOPS}), g_trips AS ({G_TRIPS}), g_times AS ({G_TIMES}),
g_stops AS (SELECT s.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM g_stops0 q WHERE q.stop_id = s.parent_station) THEN s.parent_station END AS parent_station) FROM g_stops0 s),
tr AS (SELECT t.*, coalesce(s.parent_station, s.stop_id) AS parent, g.route_id, g.direction_id, g.shape_id
  FROM g_times t JOIN g_trips g ON g.trip_id = t.trip_id JOIN g_stops s ON s.stop_id = t.stop_id),
sh AS (SELECT route_id, shape_id, direction_id, count(DISTINCT stop_id) AS stops, max(shape_dist_traveled) AS dist
  FROM tr WHERE shape_id IS NOT NULL GROUP BY 1, 2, 3),
ca AS (SELECT route_id, shape_id AS canonical_shape_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY stops DESC,
    dist DESC NULLS LAST, CASE WHEN direction_id = 0 THEN 0 WHEN direction_id IS NULL THEN 1 ELSE 2 END, shape_id) AS rn FROM sh) WHERE rn = 1),
tp AS (SELECT route_id, trip_id, shape_id, direction_id, count(DISTINCT stop_id) AS stops, max(shape_dist_traveled) AS dist, count(*) AS n
  FROM tr GROUP BY 1, 2, 3, 4),
mt AS (SELECT route_id, trip_id AS main_trip_id, direction_id AS main_direction FROM (SELECT tp.*, row_number() OVER (PARTITION BY tp.route_id
    ORDER BY CASE WHEN tp.shape_id = ca.canonical_shape_id THEN 0 ELSE 1 END, CASE WHEN tp.direction_id = 0 THEN 0 ELSE 1 END,
    tp.stops DESC, tp.dist DESC NULLS LAST, tp.n DESC, tp.trip_id) AS rn FROM tp LEFT JOIN ca ON ca.route_id = tp.route_id) WHERE rn = 1),
ms AS (SELECT tr.route_id, tr.parent, min(tr.stop_sequence) AS seq FROM tr JOIN mt ON mt.route_id = tr.route_id AND mt.main_trip_id = tr.trip_id GROUP BY 1, 2),
nb AS (SELECT *, lag(parent) OVER w AS prev, lead(parent) OVER w AS nxt FROM tr WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence))"""


def feed(spark, sf) -> B.Feed:
    """The feed over the driver's events, cleaned and written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FEEDS:
        C.configure(spark)
        ev = source_sql(spark, sf, EV.replace("FROM events", "FROM {events}"), "events")
        tables = [spark.sql(q.replace("FROM ev", "FROM {ev}"), ev=ev) for q in (G_ROUTES, G_STOPS, G_TRIPS, G_TIMES)]
        _FEEDS[key] = B.Feed(*tables).cleaned().materialized()
    return _FEEDS[key]


_FEEDS: dict = {}


def rows(spark, sf):
    f = feed(spark, sf)
    return O.trip_rows(f.stop_times, f.trips, f.stops)


def mains(spark, sf):
    r = rows(spark, sf)
    return O.main_trip(O.trip_stats(r), O.canonical_shape(O.shape_stats(r)))


@query("feed_stops_cleaned", FEED_SQL + """
SELECT stop_id, stop_name, coalesce(parent_station, '') AS parent_station, round(stop_lat, 6) AS lat FROM g_stops""")
def feed_stops_cleaned(spark, sf):
    return feed(spark, sf).stops.select("stop_id", "stop_name", F.coalesce("parent_station", F.lit("")).alias("parent_station"),
                                        F.round("stop_lat", 6).alias("lat"))


@query("shape_stats", FEED_SQL + """
SELECT route_id, shape_id, coalesce(direction_id, -1) AS direction_id, stops, coalesce(dist, -1) AS dist FROM sh""")
def shape_stats(spark, sf):
    return O.shape_stats(rows(spark, sf)).select("route_id", "shape_id", *nz("direction_id"), "stops", F.coalesce("dist", F.lit(-1.0)).alias("dist"))


@query("trip_stats", FEED_SQL + "SELECT route_id, trip_id, stops, coalesce(dist, -1) AS dist, n AS rows FROM tp")
def trip_stats(spark, sf):
    return O.trip_stats(rows(spark, sf)).select("route_id", "trip_id", "stops", F.coalesce("dist", F.lit(-1.0)).alias("dist"), "rows")


@query("canonical_shape", FEED_SQL + "SELECT * FROM ca")
def canonical_shape(spark, sf):
    return O.canonical_shape(O.shape_stats(rows(spark, sf)))


@query("main_trip", FEED_SQL + "SELECT route_id, main_trip_id, coalesce(main_direction, -1) AS main_direction FROM mt")
def main_trip(spark, sf):
    return mains(spark, sf).select("route_id", "main_trip_id", *nz("main_direction"))


@query("main_stops", FEED_SQL + "SELECT * FROM ms")
def main_stops(spark, sf):
    return O.main_stops(rows(spark, sf), mains(spark, sf))


@query("stop_neighbours", FEED_SQL + """
SELECT trip_id, stop_sequence, parent, coalesce(prev, '') AS prev, coalesce(nxt, '') AS next FROM nb""")
def stop_neighbours(spark, sf):
    bound = C.largest_group(feed(spark, sf).stop_times, ["trip_id"])
    return O.neighbours(rows(spark, sf), bound).select(
        "trip_id", "stop_sequence", "parent", F.coalesce("prev", F.lit("")).alias("prev"), F.coalesce("next", F.lit("")).alias("next"))


VARIANT_SQL = FEED_SQL + """
, vo AS (SELECT * FROM (SELECT nb.route_id, nb.parent, nb.direction_id, nb.prev, nb.nxt, pm.seq AS prev_seq, nm.seq AS next_seq,
    row_number() OVER (PARTITION BY nb.route_id, nb.parent ORDER BY
      CASE WHEN pm.seq IS NULL THEN 1 ELSE 0 END + CASE WHEN nm.seq IS NULL THEN 1 ELSE 0 END, nb.stop_sequence, nb.trip_id) AS rn
  FROM nb LEFT JOIN ms pm ON pm.route_id = nb.route_id AND pm.parent = nb.prev LEFT JOIN ms nm ON nm.route_id = nb.route_id AND nm.parent = nb.nxt
  WHERE nb.trip_id NOT IN (SELECT main_trip_id FROM mt) AND NOT EXISTS (SELECT 1 FROM ms WHERE ms.route_id = nb.route_id AND ms.parent = nb.parent)) WHERE rn = 1)"""


@query("variant_only_stops", VARIANT_SQL + """
SELECT route_id, parent, coalesce(direction_id, -1) AS direction_id, coalesce(prev, '') AS prev, coalesce(nxt, '') AS next,
       coalesce(prev_seq, -1) AS prev_seq, coalesce(next_seq, -1) AS next_seq FROM vo""")
def variant_only_stops(spark, sf):
    r, m = rows(spark, sf), mains(spark, sf)
    return O.variant_only(r, m, O.main_stops(r, m)).select(
        "route_id", "parent", *nz("direction_id"), F.coalesce("prev", F.lit("")).alias("prev"),
        F.coalesce("next", F.lit("")).alias("next"), *nz("prev_seq", "next_seq"))


ORDER_SQL = """WITH RECURSIVE """ + "{network}" + VARIANT_SQL.replace("\n, ev AS", "\n, ev AS", 1) + """
, ptr AS (SELECT route_id, parent, 'p' AS side, prev AS t FROM vo UNION ALL SELECT route_id, parent, 'n', nxt FROM vo),
walk AS (SELECT route_id, parent, side, t, CAST(1 AS BIGINT) AS depth, [parent] AS seen FROM ptr WHERE t IS NOT NULL
  UNION ALL SELECT w.route_id, w.parent, w.side, q.t, w.depth + 1, list_append(w.seen, w.t) FROM walk w
  JOIN ptr q ON q.route_id = w.route_id AND q.side = w.side AND q.parent = w.t
  WHERE q.t IS NOT NULL AND NOT list_contains(w.seen, w.t)),
hit AS (SELECT w.route_id, w.parent, w.side, ms.seq, w.depth FROM walk w JOIN ms ON ms.route_id = w.route_id AND ms.parent = w.t),
mx AS (SELECT route_id, max(seq) AS mseq FROM ms GROUP BY 1),
e AS (SELECT vo.*, mx.mseq, hp.seq AS cp, hp.depth AS dp, hn.seq AS cn, hn.depth AS dn,
    CASE WHEN vo.direction_id IS NULL OR vo.direction_id = mt.main_direction THEN 1 ELSE -1 END AS sg
  FROM vo JOIN mt ON mt.route_id = vo.route_id JOIN mx ON mx.route_id = vo.route_id
  LEFT JOIN hit hp ON hp.route_id = vo.route_id AND hp.parent = vo.parent AND hp.side = 'p'
  LEFT JOIN hit hn ON hn.route_id = vo.route_id AND hn.parent = vo.parent AND hn.side = 'n'),
pos AS (SELECT route_id, parent, CAST(seq AS DOUBLE) AS position FROM ms UNION ALL
  SELECT route_id, parent, CASE WHEN prev_seq IS NOT NULL AND next_seq IS NOT NULL THEN (prev_seq + next_seq) / 2.0
    WHEN prev_seq IS NOT NULL THEN prev_seq + sg * 0.5 WHEN next_seq IS NOT NULL THEN next_seq - sg * 0.5
    WHEN cp IS NOT NULL AND cn IS NOT NULL THEN (cp + cn) / 2.0 + (dp - dn) * 0.01
    WHEN cp IS NOT NULL THEN cp + sg * 0.1 * dp WHEN cn IS NOT NULL THEN cn - sg * 0.1 * dn
    WHEN nxt IS NULL THEN CASE WHEN sg = 1 THEN mseq + 0.5 ELSE 0.5 END
    WHEN prev IS NULL THEN CASE WHEN sg = 1 THEN 0.5 ELSE mseq + 0.5 END ELSE mseq + 9999.0 END FROM e)
SELECT route_id, parent, row_number() OVER (PARTITION BY route_id ORDER BY round(position, 6), parent) AS stop_order FROM pos"""


@query("stop_route_order", ORDER_SQL.replace("{network},", "").replace("{network}\n, ", ""), raw=True)
def stop_route_order(spark, sf):
    f = feed(spark, sf)
    return O.renumber(O.stop_route_positions(f.stop_times, f.trips, f.stops)
                      .withColumn("position", F.round("position", 6)))


@query("stop_groups")
def stop_groups(spark, sf):
    return G.stop_groups(feed(spark, sf).stops)


VARIATION_SQL = FEED_SQL + """
, rep AS (SELECT g.route_id, g.shape_id, min(g.trip_id) AS trip_id FROM g_trips g WHERE g.shape_id IS NOT NULL
  AND g.trip_id IN (SELECT trip_id FROM g_times) GROUP BY 1, 2),
va AS (SELECT rep.*, g.direction_id, g.trip_headsign, x.* EXCLUDE (trip_id) FROM rep JOIN g_trips g ON g.trip_id = rep.trip_id
  JOIN (SELECT trip_id, count(*) AS stop_count, arg_min(parent, stop_sequence) = arg_max(parent, stop_sequence) AS is_loop,
    arg_min(stop_id, stop_sequence) AS first_stop_id, arg_max(stop_id, stop_sequence) AS last_stop_id,
    array_to_string(list_sort(list(DISTINCT parent)), '|') AS set_key FROM tr GROUP BY 1) x ON x.trip_id = rep.trip_id),
co AS (SELECT * FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY route_id, set_key) AS shapes FROM va
  WINDOW w AS (PARTITION BY route_id, set_key ORDER BY stop_count DESC, shape_id)) WHERE rn = 1),
pt AS (SELECT co.*, shapes > 1 AS both_ways, CASE WHEN shapes > 1 THEN 0 ELSE coalesce(direction_id, 0) END AS direction,
    f.stop_name AS fn, nullif(f.stop_name_r, '') AS fr, l.stop_name AS ln, nullif(l.stop_name_r, '') AS lr, g.route_short_name AS rs,
    g.route_long_name AS rl, g.route_long_name_r AS rr, g.route_color AS rc,
    coalesce(nullif(trip_headsign, ''), nullif(g.route_long_name, ''), nullif(g.route_short_name, '')) AS head
  FROM co JOIN g_stops f ON f.stop_id = first_stop_id JOIN g_stops l ON l.stop_id = last_stop_id JOIN g_routes g ON g.route_id = co.route_id)"""


@query("trip_variations", VARIATION_SQL + """
SELECT route_id, shape_id, trip_id, stop_count, is_loop, first_stop_id, last_stop_id FROM va""")
def trip_variations(spark, sf):
    f = feed(spark, sf)
    return P.trip_variations(f.stop_times, f.trips, f.stops, f.routes).select(
        "route_id", "shape_id", "trip_id", "stop_count", "is_loop", "first_stop_id", "last_stop_id")


NAMES_SQL = VARIATION_SQL + """
, lp AS (SELECT route_id, shape_id, trip_id, coalesce(head, nullif(fn, '')) AS sign FROM pt WHERE is_loop),
ls AS (SELECT lp.route_id, lp.shape_id, lp.sign, t.parent, min(t.stop_sequence) AS sq, arg_min(s.stop_name, t.stop_sequence) AS nm,
    arg_min(s.stop_name_r, t.stop_sequence) FILTER (WHERE true) AS nr, arg_min(t.stop_id, t.stop_sequence) AS sid
  FROM lp JOIN tr t ON t.trip_id = lp.trip_id JOIN g_stops s ON s.stop_id = t.stop_id WHERE lp.sign IS NOT NULL GROUP BY 1, 2, 3, 4),
lq AS (SELECT ls.*, s.stop_name_r AS nr2, row_number() OVER (PARTITION BY route_id, shape_id ORDER BY sq) - 1 AS pos, count(*) OVER (PARTITION BY route_id, shape_id) AS n,
    count(*) OVER (PARTITION BY route_id, sign, parent) AS sib FROM ls JOIN g_stops s ON s.stop_id = ls.sid),
vi AS (SELECT route_id, shape_id, nm AS via, nullif(nr2, '') AS via_r FROM (SELECT *, row_number() OVER (PARTITION BY route_id, shape_id ORDER BY
    CASE WHEN sib = 1 THEN 0 ELSE 1 END, abs(pos - CAST(floor(n / 2) AS BIGINT)), pos) AS rn FROM lq WHERE n >= 3) WHERE rn = 1 AND nm <> sign),
hd AS (SELECT pt.*, vi.via, vi.via_r, CASE WHEN trip_headsign = ln AND lr IS NOT NULL THEN lr WHEN is_loop AND nullif(trip_headsign, '') IS NOT NULL THEN fr
    WHEN nullif(trip_headsign, '') IS NULL AND rl IS NOT NULL THEN nullif(rr, '') END AS hr FROM pt LEFT JOIN vi USING (route_id, shape_id)),
nm AS (SELECT *, CASE WHEN is_loop THEN coalesce(head, fn) || CASE WHEN via IS NULL THEN ' (循環)' ELSE '（' || via || '経由・循環）' END
    WHEN fn <> head THEN fn || CASE WHEN both_ways THEN ' ⇔ ' ELSE ' → ' END || head ELSE coalesce(head, fn) END AS base,
  CASE WHEN is_loop THEN CASE WHEN via IS NULL THEN coalesce(hr, fr) || ' (Loop)' WHEN via_r IS NULL THEN NULL
      ELSE coalesce(hr, fr) || ' via ' || via_r || ' (Loop)' END
    WHEN fr <> hr THEN fr || CASE WHEN both_ways THEN ' ⇔ ' ELSE ' → ' END || hr ELSE coalesce(hr, fr) END AS base_r FROM hd),
nn AS (SELECT *, row_number() OVER (PARTITION BY route_id, base ORDER BY stop_count DESC, shape_id) AS c FROM nm)"""


@query("service_patterns", NAMES_SQL + """
SELECT route_id, shape_id, direction, both_ways, CASE WHEN c > 1 THEN base || ' (' || stop_count || '停)' ELSE base END AS type_name,
       coalesce(CASE WHEN c > 1 THEN base_r || ' (' || stop_count || ' stops)' ELSE base_r END, '') AS type_name_r,
       coalesce(CASE WHEN rc LIKE '#%' THEN rc ELSE '#' || rc END, '#000000') AS color FROM nn""")
def service_patterns(spark, sf):
    f = feed(spark, sf)
    return P.service_patterns(f.stop_times, f.trips, f.stops, f.routes).select(
        "route_id", "shape_id", "direction", "both_ways", "type_name", "type_name_r", "color")


@query("pattern_stop_rows", VARIATION_SQL + """
SELECT co.route_id, co.shape_id, tr.parent, min(tr.stop_sequence) AS seq FROM co JOIN tr ON tr.trip_id = co.trip_id GROUP BY 1, 2, 3""")
def pattern_stop_rows(spark, sf):
    f = feed(spark, sf)
    patterns = P.collapse_variations(P.trip_variations(f.stop_times, f.trips, f.stops, f.routes)).withColumn("neg_count", -F.col("stop_count"))
    return P.pattern_stop_rows(patterns, f.stop_times, f.stops).drop("neg_count")


FNV = ("(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, strlen({t})), "
       "lambda i: ('0x' || substr(hex(encode({t})), 2 * i + 1, 2))::UHUGEINT)), "
       "lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % {span}::UHUGEINT)::BIGINT + {base}")


@query("hash_codes", "SELECT c_custkey, " + FNV.format(t="c_name", span="100000000", base="200000000") + " AS code FROM customer", raw=True)
def hash_codes(spark, sf):
    return driver_table(spark, sf, "customer").select(
        "c_custkey", codes.fnv_code(F.col("c_name"), codes.STATION_GROUP_CODES).alias("code"))


@query("routes_to_lines", FEED_SQL + "SELECT " + FNV.format(t="route_id", span="10000000", base="100000000") + """ AS line_cd,
  CASE WHEN route_id LIKE 'toei:%' THEN 119 WHEN route_id LIKE 'seibu:%' THEN 253 WHEN route_id LIKE 'keio:%' THEN 254 ELSE 255 END AS company_cd,
  coalesce(route_short_name, route_long_name, '') AS line_name, coalesce(route_long_name, '') AS line_name_r,
  coalesce(CASE WHEN route_color LIKE '#%' THEN route_color ELSE '#' || route_color END, '#1f63c6') AS line_color_c
FROM g_routes WHERE route_id NOT LIKE 'other:%'""")
def routes_to_lines(spark, sf):
    f = feed(spark, sf)
    # Routes of other operators get their codes after these and displace none.
    known = f.routes.where(codes.company_for_route(F.col("route_id")).isNotNull())
    given = codes.allocate(known, "route_id", ["ord"], codes.LINE_CODES, "line_cd")
    return B.routes_to_lines(f.routes, given).select("line_cd", "company_cd", "line_name", "line_name_r", "line_color_c")


@query("integrated_lines", FEED_SQL + ", added AS (SELECT " + FNV.format(t="route_id", span="10000000", base="100000000") + """ AS line_cd,
  CASE WHEN route_id LIKE 'toei:%' THEN 119 WHEN route_id LIKE 'seibu:%' THEN 253 WHEN route_id LIKE 'keio:%' THEN 254 ELSE 255 END AS company_cd,
  coalesce(route_short_name, route_long_name, '') AS line_name, coalesce(route_long_name, '') AS line_name_r,
  coalesce(CASE WHEN route_color LIKE '#%' THEN route_color ELSE '#' || route_color END, '#1f63c6') AS line_color_c, route_type
FROM g_routes WHERE route_id NOT LIKE 'other:%')
SELECT * FROM lines UNION ALL BY NAME
SELECT line_cd, company_cd, line_name, line_name AS line_name_k, line_name AS line_name_h, line_name_r, line_color_c, route_type AS line_type,
       0 AS e_status, line_cd AS e_sort, 0.0::DOUBLE AS average_distance, 1 AS transport_type FROM added""")
def integrated_lines(spark, sf):
    return B.integrate_feed(network(spark, sf), feed(spark, sf)).lines


@query("integrated_pattern_rows")
def integrated_pattern_rows(spark, sf):
    return B.integrate_feed(network(spark, sf), feed(spark, sf)).sst


# -------------------------------------------------------------------------- local services

LOCAL_SQL = """
, rs AS (SELECT * FROM stations WHERE e_status = 0 AND transport_type = 0),
cn AS (SELECT rs.line_cd, t.type_cd, count(*) AS n FROM sst t JOIN rs ON rs.station_cd = t.station_cd WHERE t.type_cd IN (100, 101) GROUP BY 1, 2),
lt AS (SELECT line_cd, type_cd FROM (SELECT *, row_number() OVER (PARTITION BY line_cd ORDER BY n DESC, type_cd) AS rn FROM cn) WHERE rn = 1)"""


@query("default_local_type", LOCAL_SQL + "SELECT * FROM lt")
def default_local_type(spark, sf):
    return B.default_local_type(network(spark, sf))


VIRTUAL_SQL = LOCAL_SQL + """
, tl AS (SELECT l.line_cd, coalesce(lt.type_cd, CASE WHEN l.line_cd IN (11309, 11318, 11345, 99101, 99102, 99103, 99301, 99305, 99342, 99649) THEN 101 ELSE 100 END) AS type_cd
  FROM lines l LEFT JOIN lt ON lt.line_cd = l.line_cd WHERE l.e_status = 0 AND l.transport_type = 0
  AND EXISTS (SELECT 1 FROM rs WHERE rs.line_cd = l.line_cd AND NOT EXISTS (SELECT 1 FROM sst t WHERE t.station_cd = rs.station_cd))),
vr AS (SELECT rs.station_cd, tl.type_cd, 1000000000 + tl.line_cd AS line_group_cd, rs.line_cd, rs.e_sort FROM rs JOIN tl ON tl.line_cd = rs.line_cd)"""


@query("virtual_local_services", VIRTUAL_SQL + """
SELECT (SELECT count(*) FROM sst) + row_number() OVER (ORDER BY line_cd, e_sort, station_cd) AS id, station_cd, type_cd, line_group_cd, 0 AS pass FROM vr""")
def virtual_local_services(spark, sf):
    out = B.virtual_local_services(network(spark, sf)).sst
    return out.where(F.col("line_group_cd") >= B.VIRTUAL_GROUP_BASE)


# ------------------------------------------------------------------------------- integrity

@query("pk_first_wins", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""", raw=True)
def pk_first_wins(spark, sf):
    return I.dedup_first(driver_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                         ["l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("serial_ids", """
SELECT id, station_cd, type_cd, coalesce(line_group_cd, -1) AS line_group_cd, coalesce(pass, -1) AS pass FROM sst""")
def serial_ids(spark, sf):
    return network(spark, sf).sst.select("id", "station_cd", "type_cd", *nz("line_group_cd", "pass"))


@query("serial_gaps", """
SELECT count(*) AS rows, min(id) AS lowest, max(id) AS highest, count(DISTINCT id) AS distinct_ids, true AS gap_free FROM sst""")
def serial_gaps(spark, sf):
    return I.serial_gaps(network(spark, sf).sst)


@query("fk_violations", """
SELECT id, 'unknown station_cd' AS problem, station_cd AS code FROM sst WHERE station_cd NOT IN (SELECT station_cd FROM stations)
UNION ALL SELECT id, 'unknown type_cd', type_cd FROM sst WHERE type_cd NOT IN (SELECT type_cd FROM types)""")
def fk_violations(spark, sf):
    return I.validate_fk(network(spark, sf))


RUNS = """SELECT p_partkey AS run_id, p_partkey AS line_cd, p_partkey AS a, p_partkey + (SELECT count(*) FROM {part}) AS b,
  p_partkey + 2 * (SELECT count(*) FROM {part}) AS c FROM {part}"""


@query("order_violations", f"""
, ex AS MATERIALIZED ({RUNS.format(part='part').replace("(SELECT count(*) FROM part)", "count(*) OVER ()")}),
o AS MATERIALIZED (SELECT line_cd, station_cd AS a, lead(station_cd) OVER w AS b, lead(station_cd, 2) OVER w AS c
  FROM stations WHERE e_status = 0 WINDOW w AS (PARTITION BY line_cd ORDER BY e_sort, station_cd))
SELECT ex.run_id, ex.line_cd, CASE WHEN o.a IS NULL THEN 'first station missing' ELSE 'stations are not consecutive' END AS problem
FROM ex LEFT JOIN o ON o.line_cd = ex.line_cd AND o.a = ex.a
WHERE o.a IS NULL OR o.b IS DISTINCT FROM ex.b OR o.c IS DISTINCT FROM ex.c""")
def order_violations(spark, sf):
    expected = source_sql(spark, sf, RUNS, "part").select("run_id", "line_cd", F.array("a", "b", "c").alias("station_cds"))
    return I.validate_order(network(spark, sf).stations, expected)


@query("group_collisions", """
SELECT DISTINCT line_group_cd FROM sst WHERE line_group_cd IN (SELECT 1000 + s_suppkey * 11 FROM supplier)""")
def group_collisions(spark, sf):
    generated = source_sql(spark, sf, "SELECT 1000 + s_suppkey * 11 AS line_group_cd FROM {supplier}", "supplier")
    return I.group_collisions(network(spark, sf).sst, generated)


@query("snapshot_counts", "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {s}" for t, s in [
    ("companies", "companies"), ("lines", "lines"), ("stations", "stations"), ("types", "types"),
    ("station_station_types", "sst"), ("aliases", "aliases"), ("line_aliases", "line_aliases")]))
def snapshot_counts(spark, sf):
    return I.snapshot_counts(network(spark, sf))


# ------------------------------------------------------------------------------------ text

_KANA = "translate(substr(c_name, 10), '0123456789', 'アイウエオカキクケコ')"
_ROMAJI_SQL = "regexp_replace(regexp_replace(" + _KANA + ", '([オコ])[ーウオ]+', '\\1ー', 'g'), 'ー+', 'ー', 'g')"
for _k, _r in [("アイウエオ", "a i u e o"), ("カキクケコ", "ka ki ku ke ko")]:
    for _c, _s in zip(_k, _r.split()):
        _ROMAJI_SQL = f"replace({_ROMAJI_SQL}, '{_c}', '{_s}')"
_ROMAJI_SQL = f"replace({_ROMAJI_SQL}, 'oー', 'ō')"


@query("kana_romaji", f"""SELECT c_custkey, {_KANA} AS kana, upper(substr({_ROMAJI_SQL}, 1, 1)) || substr({_ROMAJI_SQL}, 2) AS romaji FROM customer""", raw=True)
def kana_romaji(spark, sf):
    reading = F.translate(F.substr("c_name", F.lit(10)), "0123456789", "アイウエオカキクケコ")
    return driver_table(spark, sf, "customer").select("c_custkey", reading.alias("kana"), kana.romaji_display_name(reading).alias("romaji"))


@query("search_keys", """
SELECT c_custkey, translate(c_name, '0123456789', 'アイウエオカキクケコ') AS search_key,
       translate(c_name, '0123456789', 'アイウエオカキクケコ') AS wide_kana FROM customer""", raw=True)
def search_keys(spark, sf):
    return driver_table(spark, sf, "customer").select(
        "c_custkey", text.normalize_for_search(F.translate("c_name", "0123456789", "あいうえおかきくけこ")).alias("search_key"),
        kana.to_fullwidth_katakana(F.translate("c_name", "0123456789", "ｱｲｳｴｵｶｷｸｹｺ")).alias("wide_kana"))


@query("title_case", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part""", raw=True)
def title_case(spark, sf):
    return driver_table(spark, sf, "part").select("p_partkey", text.title_case(F.col("p_name")).alias("title"))
