"""Enrichment and public projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from demo.adapter import network, source_sql
from demo.lookups import GROUP_REQ, LINES_REQ, LINES_SQL, PATTERN_REQ, PATTERN_SQL, STATION_REQ, nz
from demo.registry import query
from demo.spatial import HAV
from netloom.operators import enrich as N
from netloom.operators import lookup as L

_SYM = """concat_ws('|', CASE WHEN {l}.line_symbol1 IS NOT NULL AND {l}.line_symbol1_shape IS NOT NULL
    THEN concat({l}.line_symbol1, ',', coalesce({l}.line_symbol1_color, {c}, ''), ',', {l}.line_symbol1_shape) END,
  CASE WHEN {l}.line_symbol2 IS NOT NULL AND {l}.line_symbol2_shape IS NOT NULL
    THEN concat({l}.line_symbol2, ',', coalesce({l}.line_symbol2_color, ''), ',', {l}.line_symbol2_shape) END,
  CASE WHEN {l}.line_symbol3 IS NOT NULL AND {l}.line_symbol3_shape IS NOT NULL
    THEN concat({l}.line_symbol3, ',', coalesce({l}.line_symbol3_color, ''), ',', {l}.line_symbol3_shape) END)"""
_NUM = "concat_ws('|', " + ", ".join(
    f"CASE WHEN coalesce(s.station_number{i}, '') <> '' THEN concat(CASE WHEN l.line_symbol{i} IS NULL THEN '' "
    f"ELSE concat(l.line_symbol{i}, '-') END, s.station_number{i}, ',', coalesce(l.line_symbol{i}_color, '')) END"
    for i in range(1, 5)) + ")"


def joined(structs, *fields):
    return F.concat_ws("|", F.transform(structs, lambda x: F.concat_ws(",", *[x[f] for f in fields])))


def wide(net):
    return L.to_wide(net, L.active(net.stations), L.active_lines(net))


@query("station_numbers", f"""
SELECT s.station_cd, {_NUM} AS numbers FROM ast s JOIN lines l ON l.line_cd = s.line_cd""")
def station_numbers(spark, sf):
    return wide(network(spark, sf)).select(
        "station_cd", joined(N.station_numbers(), "station_number", "line_symbol_color").alias("numbers"))


@query("line_symbols", f"""
SELECT l.line_cd, {_SYM.format(l='l', c='l.line_color_c')} AS symbols FROM lines l""")
def line_symbols(spark, sf):
    return network(spark, sf).lines.select("line_cd", joined(N.line_symbols(), "symbol", "color", "shape").alias("symbols"))


@query("line_of_station", f"""
SELECT s.station_cd, coalesce(s.w_line_name_h, '') AS line_name_h, s.w_line_name_ko AS line_name_ko,
       {_SYM.format(l='l', c='s.w_line_color_c')} AS symbols FROM ast s JOIN lines l ON l.line_cd = s.line_cd""")
def line_of_station(spark, sf):
    return wide(network(spark, sf)).select("station_cd", N.line_struct().alias("l")).select(
        "station_cd", "l.line_name_h", "l.line_name_ko", joined(F.col("l.line_symbols"), "symbol", "color", "shape").alias("symbols"))


@query("station_struct", f"""
SELECT s.station_cd, s.station_name, s.lat, {_NUM} AS numbers, s.company_cd, true AS no_type
FROM ast s JOIN lines l ON l.line_cd = s.line_cd""")
def station_struct(spark, sf):
    return wide(network(spark, sf)).select(N.station_struct().alias("s")).select(
        "s.station_cd", "s.station_name", "s.lat", joined(F.col("s.station_numbers"), "station_number", "line_symbol_color")
        .alias("numbers"), "s.line.company_cd", F.col("s.train_type").isNull().alias("no_type"))


@query("public_stations", """
SELECT a.station_cd AS req_id, a.station_cd AS id, a.station_g_cd AS group_id, a.station_name AS name, a.pref_cd AS prefecture_id,
       a.open_ymd AS opened_at, a.transport_type + 1 AS transport_type, fp.first_group IS NOT NULL AS has_train_types
FROM ast a LEFT JOIN fp ON fp.station_cd = a.station_cd""")
def public_stations(spark, sf):
    req = source_sql(spark, sf, "SELECT o_orderkey AS req_id, array(o_orderkey) AS ids FROM {orders}", "orders")
    return N.to_public_station(L.stations_by_ids(network(spark, sf), req)).select(
        "req_id", "id", "group_id", "name", "prefecture_id", "opened_at", "transport_type", "has_train_types")


@query("public_lines", """
SELECT line_cd AS id, line_name AS name_short, coalesce(line_name_r, '') AS name_roman, coalesce(line_color_c, '') AS color,
       CASE WHEN transport_type = 1 THEN 0 ELSE line_type END AS line_type, e_status AS status, transport_type + 1 AS transport_type FROM lines""")
def public_lines(spark, sf):
    return N.to_public_line(network(spark, sf).lines).select(
        "id", "name_short", "name_roman", "color", "line_type", "status", "transport_type")


@query("public_train_types", """
SELECT t.id, t.type_cd AS type_id, coalesce(t.line_group_cd, 0) AS group_id, y.type_name AS name, y.direction, y.kind
FROM stops t JOIN types y ON y.type_cd = t.type_cd""")
def public_train_types(spark, sf):
    return N.to_public_train_type(L.train_type_stops(network(spark, sf))).select(
        "id", "type_id", "group_id", "name", "direction", "kind")


@query("public_companies", """
SELECT company_cd AS id, rr_cd AS railroad_id, company_name AS name, company_url AS url, company_type AS type FROM companies""")
def public_companies(spark, sf):
    return N.to_public_company(network(spark, sf).companies).select("id", "railroad_id", "name", "url", "type")


# ------------------------------------------------------------------------------ enrichment

ENRICH_SQL = f"""
, rl AS (SELECT v.station_g_cd, v.line_cd, min(v.station_cd) AS alias_station FROM served v GROUP BY 1, 2),
ls AS (SELECT line_cd, station_g_cd, max(station_cd) AS group_station FROM ast GROUP BY 1, 2),
own AS (SELECT a.station_g_cd AS req_id, a.station_cd, a.station_g_cd, 0 AS group_rank, rl.alias_station, rl.line_cd, CAST(NULL AS BIGINT) AS bus_stop
  FROM ast a JOIN rl ON rl.station_g_cd = a.station_g_cd),
anchor AS (SELECT station_g_cd, arg_min(lat, station_cd) AS lat, arg_min(lon, station_cd) AS lon FROM ast WHERE transport_type = 0 GROUP BY 1),
close AS (SELECT a.station_cd, a.station_g_cd, s.station_cd AS stop_cd, s.station_g_cd AS stop_g, s.line_cd,
    row_number() OVER (PARTITION BY a.station_cd ORDER BY {HAV.format(a='n.lat', b='s.lat', c='n.lon', d='s.lon')}, s.station_cd) AS rank
  FROM ast a JOIN anchor n ON n.station_g_cd = a.station_g_cd
  JOIN stations s ON s.e_status = 0 AND s.transport_type = 1 AND s.lat BETWEEN a.lat - 0.003 AND a.lat + 0.003
  JOIN lines l ON l.line_cd = s.line_cd AND l.e_status = 0
  WHERE a.transport_type = 0 AND 1000 * {HAV.format(a='a.lat', b='s.lat', c='a.lon', d='s.lon')} <= 300),
gr AS (SELECT station_cd, station_g_cd, stop_g, min(rank) AS group_rank FROM close GROUP BY 1, 2, 3),
bl AS (SELECT gr.station_cd, gr.station_g_cd, v.line_cd, min((gr.group_rank, v.station_cd)) AS o
  FROM gr JOIN served v ON v.station_g_cd = gr.stop_g JOIN lines l ON l.line_cd = v.line_cd AND l.transport_type = 1 GROUP BY 1, 2, 3),
bs AS (SELECT station_cd, line_cd, arg_min(stop_cd, rank) AS bus_stop FROM close GROUP BY 1, 2),
bus AS (SELECT bl.station_g_cd AS req_id, bl.station_cd, bl.station_g_cd, bl.o[1] AS group_rank, bl.o[2] AS alias_station, bl.line_cd, bs.bus_stop
  FROM bl LEFT JOIN bs ON bs.station_cd = bl.station_cd AND bs.line_cd = bl.line_cd
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.station_cd = bl.station_cd AND o.line_cd = bl.line_cd)),
allr AS (SELECT * FROM own UNION ALL SELECT * FROM bus)
SELECT r.req_id, r.station_cd, r.group_rank, r.alias_station, r.line_cd, coalesce(c.company_name, '') AS company_name,
       coalesce(nullif(al.line_name, ''), l.line_name) AS line_name,
       {_SYM.format(l='l', c="coalesce(nullif(al.line_color_c, ''), l.line_color_c)")} AS symbols,
       coalesce(ls.group_station, r.bus_stop, -1) AS line_station
FROM allr r JOIN lines l ON l.line_cd = r.line_cd LEFT JOIN al ON al.station_cd = r.alias_station
LEFT JOIN companies c ON c.company_cd = l.company_cd
LEFT JOIN ls ON ls.line_cd = r.line_cd AND ls.station_g_cd = r.station_g_cd
WHERE r.req_id IN (SELECT c_custkey FROM customer)"""


@query("enrich_group_stations", ENRICH_SQL)
def enrich_group_stations(spark, sf):
    net = network(spark, sf)
    stations = L.stations_by_group_no_types(net, source_sql(spark, sf, GROUP_REQ, "customer")).withColumn("ord", F.col("station_cd"))
    return N.enrich(net, stations).lines.select(
        "req_id", "station_cd", "group_rank", "alias_station", "line_cd", F.coalesce("company_name", F.lit("")).alias("company_name"),
        "line_name", joined(F.col("line_symbols"), "symbol", "color", "shape").alias("symbols"), *nz("line_station"))


@query("enrich_pattern_stations", PATTERN_SQL + """
, tt AS (SELECT t.line_group_cd, t.station_cd, arg_min(t.id, y.priority * 1000000000 - t.id) AS tt_id FROM stops t JOIN types y ON y.type_cd = t.type_cd
  WHERE t.line_group_cd IS NOT NULL GROUP BY 1, 2)
SELECT s.req_id, t.sst_id, t.station_cd, coalesce(c.company_name, '') AS company_name, coalesce(tt.tt_id, -1) AS tt_id
FROM pat s JOIN ts t ON t.line_group_cd = s.req_id LEFT JOIN companies c ON c.company_cd = t.company_cd
LEFT JOIN tt ON tt.line_group_cd = t.line_group_cd AND tt.station_cd = t.station_cd""")
def enrich_pattern_stations(spark, sf):
    net = network(spark, sf)
    stops = L.stations_by_line_group(net, source_sql(spark, sf, PATTERN_REQ, "supplier"))
    stops = stops.withColumns({"ord": F.col("sst_id"), "want_line_group": F.col("line_group_cd")})
    return N.enrich(net, stops, line_group=True).stations.select(
        "req_id", "sst_id", "station_cd", F.coalesce("company_name", F.lit("")).alias("company_name"),
        F.coalesce("train_type.sst_id", F.lit(-1)).alias("tt_id"))


@query("enrich_prefetched", LINES_SQL + """
, g AS (SELECT DISTINCT r.req_id, s.station_g_cd FROM req r JOIN stations s ON s.line_cd = r.line_cd AND s.e_status = 0),
kept AS (SELECT DISTINCT r.req_id, a.station_cd, a.station_g_cd FROM req r JOIN ast a ON a.line_cd = r.line_cd WHERE a.transport_type = 0),
ls AS (SELECT g.req_id, a.line_cd, a.station_g_cd, max(a.station_cd) AS line_station FROM g JOIN ast a ON a.station_g_cd = g.station_g_cd GROUP BY 1, 2, 3)
SELECT k.req_id, k.station_cd, v.line_cd, min(v.station_cd) AS alias_station, any_value(ls.line_station) AS line_station
FROM kept k JOIN served v ON v.station_g_cd = k.station_g_cd JOIN lines l ON l.line_cd = v.line_cd AND l.transport_type = 0
LEFT JOIN ls ON ls.req_id = k.req_id AND ls.line_cd = v.line_cd AND ls.station_g_cd = k.station_g_cd GROUP BY 1, 2, 3""")
def enrich_prefetched(spark, sf):
    net = network(spark, sf)
    req = source_sql(spark, sf, LINES_REQ, "supplier").withColumn("transport", F.lit("Rail"))
    kept, expanded = L.stations_by_lines_expanded(net, req)
    kept = kept.withColumn("ord", F.struct("ordinal", "e_sort", "station_cd"))
    return N.enrich(net, kept, transport="Rail", group_stations=expanded).lines.select(
        "req_id", "station_cd", "line_cd", "alias_station", "line_station")


@query("station_train_types", """
SELECT s.station_cd AS req_id, t.id AS sst_id, t.type_cd, CASE WHEN t.line_group_cd IS NULL THEN -1 ELSE l.line_cd END AS own_line_cd,
       CASE WHEN t.line_group_cd IS NULL THEN '' ELSE coalesce(nullif(al.line_name, ''), l.line_name) END AS own_line_name
FROM stations s JOIN stops t ON t.station_cd = s.station_cd JOIN types y ON y.type_cd = t.type_cd
JOIN lines l ON l.line_cd = s.line_cd LEFT JOIN al ON al.station_cd = s.station_cd""")
def station_train_types(spark, sf):
    types, _ = N.station_train_types(network(spark, sf), source_sql(spark, sf, STATION_REQ, "orders"))
    return types.select("req_id", "sst_id", "type_cd", *nz("own_line_cd"),
                        F.coalesce("own_line_name", F.lit("")).alias("own_line_name"))


@query("station_train_type_lines", """
, ft AS (SELECT t.line_group_cd, s.line_cd, min(t.id) AS first_id FROM stp t JOIN stations s ON s.station_cd = t.station_cd AND s.e_status = 0
  WHERE t.line_group_cd IS NOT NULL GROUP BY 1, 2)
SELECT t.station_cd AS req_id, t.id AS tt_id, p.id AS sst_id, p.line_cd, coalesce(nullif(al.line_name, ''), l.line_name) AS line_name,
       coalesce(c.company_name, '') AS company_name, coalesce(ft.first_id, -1) AS line_type_sst
FROM stops t JOIN types y ON y.type_cd = t.type_cd JOIN lines own ON own.line_cd = t.line_cd
JOIN stops p ON p.line_group_cd = t.line_group_cd JOIN lines l ON l.line_cd = p.line_cd AND l.e_status = 0
LEFT JOIN al ON al.station_cd = p.station_cd LEFT JOIN companies c ON c.company_cd = l.company_cd
LEFT JOIN ft ON ft.line_group_cd = p.line_group_cd AND ft.line_cd = p.line_cd""")
def station_train_type_lines(spark, sf):
    _, lines = N.station_train_types(network(spark, sf), source_sql(spark, sf, STATION_REQ, "orders"))
    return lines.select("req_id", "tt_id", "sst_id", "line_cd", "line_name",
                        F.coalesce("company_name", F.lit("")).alias("company_name"), *nz("line_type_sst"))
