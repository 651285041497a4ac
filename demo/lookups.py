"""Lookup queries over the whole network, one request per driver row."""

from __future__ import annotations

from pyspark.sql import functions as F

from demo.adapter import network, source_sql
from demo.registry import query
from netloom.operators import lookup as L
from netloom.schema import ENUMS, decode_enum

TRANSPORT = ("CASE WHEN {0} % 3 = 0 THEN 'Rail' WHEN {0} % 3 = 1 THEN 'Bus' ELSE 'RailAndBus' END")


def nz(*cols):
    """Nullable integer columns with a visible marker."""
    return [F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in cols]


# ------------------------------------------------------------------------- table level

@query("alias_by_station", "SELECT station_cd, line_name, line_name_k, line_color_c FROM al")
def alias_by_station(spark, sf):
    return L.alias_by_station(network(spark, sf)).select(
        "station_cd", "alias.line_name", "alias.line_name_k", "alias.line_color_c")


@query("first_pattern", """
SELECT station_cd, arg_min(id, id) AS first_id, arg_min(type_cd, id) AS first_type,
       coalesce(arg_min(line_group_cd, id) FILTER (WHERE line_group_cd IS NOT NULL), -1) AS first_group,
       coalesce(min(id) FILTER (WHERE pass IS DISTINCT FROM 1), -1) AS first_stop_id,
       coalesce(bool_or(line_group_cd IS NOT NULL), false) AS has_group,
       coalesce(bool_or(line_group_cd IS NOT NULL AND pass IS DISTINCT FROM 1), false) AS stops_in_group
FROM sst GROUP BY station_cd""")
def first_pattern(spark, sf):
    return L.station_patterns(network(spark, sf)).select(
        "station_cd", F.col("first_sst.id").alias("first_id"), F.col("first_sst.type_cd").alias("first_type"),
        F.coalesce("first_line_group_cd", F.lit(-1)).alias("first_group"),
        F.coalesce("first_stop.id", F.lit(-1)).alias("first_stop_id"), "has_group", "stops_in_group")


@query("wide_stations", """
SELECT station_cd, station_g_cd, line_cd, company_cd, w_line_name AS line_name, w_line_name_k AS line_name_k,
       w_line_name_h AS line_name_h, w_line_name_r AS line_name_r, w_line_name_zh AS line_name_zh,
       w_line_name_ko AS line_name_ko, w_line_color_c AS line_color_c, line_type, average_distance FROM ast""")
def wide_stations(spark, sf):
    net = network(spark, sf)
    return L.to_wide(net, L.active(net.stations), L.active_lines(net)).select(
        "station_cd", "station_g_cd", "line_cd", "company_cd", "line_name", "line_name_k", "line_name_h",
        "line_name_r", "line_name_zh", "line_name_ko", "line_color_c", "line_type", "average_distance")


@query("typed_stops", """
SELECT sst_id, coalesce(line_group_cd, -1) AS line_group_cd, station_cd, type_id, kind, stop_condition,
       line_group_cd IS NOT NULL AS has_train_types FROM ts""")
def typed_stops(spark, sf):
    return L.typed_stops(network(spark, sf)).select(
        "sst_id", *nz("line_group_cd"), "station_cd", "type_id", "kind", "stop_condition", "has_train_types")


def _label(column, enum):
    labels, default = ENUMS[enum]
    return "CASE " + " ".join(f"WHEN {column} = {k} THEN '{v}'" for k, v in labels.items()) + f" ELSE '{default}' END"


@query("decode_enums", f"""
SELECT l.line_cd, {_label('l.line_type', 'LineType')} AS line_type,
       {_label('l.e_status', 'OperationStatus')} AS status,
       {_label('c.company_type', 'CompanyType')} AS company_type
FROM lines l LEFT JOIN companies c ON c.company_cd = l.company_cd""")
def decode_enums(spark, sf):
    net = network(spark, sf)
    return net.lines.join(net.companies.select("company_cd", "company_type"), "company_cd", "left").select(
        "line_cd", decode_enum(F.col("line_type"), "LineType").alias("line_type"),
        decode_enum(F.col("e_status"), "OperationStatus").alias("status"),
        decode_enum(F.col("company_type"), "CompanyType").alias("company_type"))


@query("rejected_requests", """
SELECT s_suppkey AS req_id, CASE WHEN s_acctbal < 0 THEN 'balance' ELSE 'offset_cd' END AS rejected_argument
FROM supplier WHERE s_acctbal < 0 OR s_nationkey - 3 < 0""", raw=True)
def rejected_requests(spark, sf):
    req = source_sql(spark, sf, "SELECT s_suppkey AS req_id, s_acctbal AS balance, s_nationkey - 3 AS offset_cd "
                                "FROM {supplier}", "supplier")
    return L.validate_requests(req, ["balance", "offset_cd"])[1].select("req_id", "rejected_argument")


# ----------------------------------------------------------------------- stations by key

@query("stations_by_id", f"""
, req AS (SELECT o_orderkey AS req_id, o_orderkey AS station_cd, {TRANSPORT.format('o_custkey')} AS transport FROM orders),
f AS (SELECT station_cd, arg_min(type_cd, id) AS t, min(id) AS i FROM sst GROUP BY 1),
g AS (SELECT f.*, s.line_group_cd AS lg, s.pass AS p FROM f JOIN sst s ON s.id = f.i)
SELECT r.req_id, a.station_cd, a.w_line_name AS line_name, coalesce(g.i, -1) AS sst_id,
       coalesce(g.t, -1) AS type_cd, coalesce(g.lg, -1) AS line_group_cd, coalesce(y.id, -1) AS type_id,
       g.lg IS NOT NULL AS has_train_types,
       CASE WHEN y.id IS NOT NULL AND g.p BETWEEN 1 AND 5 THEN g.p ELSE 0 END AS stop_condition
FROM req r JOIN ast a ON a.station_cd = r.station_cd LEFT JOIN g ON g.station_cd = a.station_cd
LEFT JOIN types y ON y.type_cd = g.t
WHERE r.transport = 'RailAndBus' OR a.transport_type = CASE r.transport WHEN 'Bus' THEN 1 ELSE 0 END""")
def stations_by_id(spark, sf):
    req = source_sql(spark, sf, "SELECT o_orderkey AS req_id, o_orderkey AS station_cd, "
                     f"{TRANSPORT.format('o_custkey')} AS transport FROM {{orders}}", "orders")
    return L.stations_by_id(network(spark, sf), req).select(
        "req_id", "station_cd", "line_name", *nz("sst_id", "type_cd", "line_group_cd", "type_id"),
        "has_train_types", "stop_condition")


IDS = "SELECT c_custkey AS req_id, array(c_custkey * 3, c_custkey + 5, c_custkey * 7 + 1, c_custkey * 3) AS ids FROM {customer}"
IDS_SQL = """, req AS (
  SELECT c_custkey AS req_id, 0 AS ordinal, c_custkey * 3 AS id FROM customer UNION ALL
  SELECT c_custkey, 1, c_custkey + 5 FROM customer UNION ALL
  SELECT c_custkey, 2, c_custkey * 7 + 1 FROM customer UNION ALL
  SELECT c_custkey, 3, c_custkey * 3 FROM customer)"""


@query("stations_by_ids", IDS_SQL + """
SELECT r.req_id, r.ordinal, a.station_cd, coalesce(fp.first_group, -1) AS line_group_cd
FROM req r JOIN ast a ON a.station_cd = r.id LEFT JOIN fp ON fp.station_cd = a.station_cd""")
def stations_by_ids(spark, sf):
    return L.stations_by_ids(network(spark, sf), source_sql(spark, sf, IDS, "customer")).select(
        "req_id", "ordinal", "station_cd", *nz("line_group_cd"))


@query("lines_by_ids", IDS_SQL + """
SELECT r.req_id, min(r.ordinal) AS ordinal, l.line_cd, any_value(l.line_name) AS line_name
FROM req r JOIN lines l ON l.line_cd = r.id AND l.e_status = 0 GROUP BY r.req_id, l.line_cd""")
def lines_by_ids(spark, sf):
    return L.lines_by_ids(network(spark, sf), source_sql(spark, sf, IDS, "customer")).select(
        "req_id", "ordinal", "line_cd", "line_name")


@query("companies_by_ids", """
, req AS (SELECT s_suppkey AS req_id, s_nationkey + 1 AS id FROM supplier UNION
          SELECT s_suppkey, s_suppkey % 30 FROM supplier)
SELECT r.req_id, c.company_cd, c.company_name FROM req r JOIN companies c ON c.company_cd = r.id""")
def companies_by_ids(spark, sf):
    req = source_sql(spark, sf, "SELECT s_suppkey AS req_id, array(cast(s_nationkey + 1 as bigint), s_suppkey % 30) AS ids "
                     "FROM {supplier}", "supplier")
    return L.companies_by_ids(network(spark, sf), req).select("req_id", "company_cd", "company_name")


GROUP_REQ = "SELECT c_custkey AS req_id, c_custkey AS station_g_cd FROM {customer}"


@query("stations_of_groups", """
SELECT station_g_cd AS req_id, station_cd, line_cd, w_line_name AS line_name FROM ast
WHERE station_g_cd IN (SELECT c_custkey FROM customer)""")
def stations_of_groups(spark, sf):
    return L.stations_of_groups(network(spark, sf), source_sql(spark, sf, GROUP_REQ, "customer")).select(
        "req_id", "station_cd", "line_cd", "line_name")


@query("stations_by_group", """
SELECT a.station_g_cd AS req_id, a.station_cd, coalesce(t.id, -1) AS sst_id, coalesce(t.type_id, -1) AS type_id,
       coalesce(t.stop_condition, 0) AS stop_condition, coalesce(t.line_group_cd IS NOT NULL, false) AS has_train_types
FROM ast a LEFT JOIN stp t ON t.station_cd = a.station_cd
WHERE a.station_g_cd IN (SELECT c_custkey FROM customer)""")
def stations_by_group(spark, sf):
    return L.stations_by_group(network(spark, sf), source_sql(spark, sf, GROUP_REQ, "customer")).select(
        "req_id", "station_cd", *nz("sst_id", "type_id"), "stop_condition", "has_train_types")


@query("stations_by_group_no_types", """
SELECT a.station_g_cd AS req_id, a.station_cd, coalesce(fp.first_group, -1) AS line_group_cd,
       fp.first_group IS NOT NULL AS has_train_types
FROM ast a LEFT JOIN fp ON fp.station_cd = a.station_cd WHERE a.station_g_cd IN (SELECT c_custkey FROM customer)""")
def stations_by_group_no_types(spark, sf):
    return L.stations_by_group_no_types(network(spark, sf), source_sql(spark, sf, GROUP_REQ, "customer")).select(
        "req_id", "station_cd", *nz("line_group_cd"), "has_train_types")


# ------------------------------------------------------------------------ stations by line

LINES_REQ = """SELECT s_suppkey AS req_id, array(s_suppkey * 3, s_suppkey + 11, s_suppkey * 3) AS line_cds,
  CASE WHEN s_nationkey % 2 = 0 THEN 'RailAndBus' ELSE 'Rail' END AS transport FROM {supplier}"""
LINES_SQL = """, req AS (
  SELECT s_suppkey AS req_id, 0 AS ordinal, s_suppkey * 3 AS line_cd, s_nationkey FROM supplier UNION ALL
  SELECT s_suppkey, 1, s_suppkey + 11, s_nationkey FROM supplier UNION ALL
  SELECT s_suppkey, 2, s_suppkey * 3, s_nationkey FROM supplier)"""


@query("stations_by_lines", LINES_SQL + """
SELECT r.req_id, r.ordinal, a.e_sort, a.station_cd, coalesce(fp.first_group, -1) AS line_group_cd
FROM req r JOIN ast a ON a.line_cd = r.line_cd LEFT JOIN fp ON fp.station_cd = a.station_cd""")
def stations_by_lines(spark, sf):
    return L.stations_by_lines(network(spark, sf), source_sql(spark, sf, LINES_REQ, "supplier")).select(
        "req_id", "ordinal", "e_sort", "station_cd", *nz("line_group_cd"))


@query("stations_by_lines_expanded", LINES_SQL + """
SELECT r.req_id, min(r.ordinal) AS ordinal, a.e_sort, a.station_cd
FROM req r JOIN ast a ON a.line_cd = r.line_cd
WHERE r.s_nationkey % 2 = 0 OR a.transport_type = 0 GROUP BY 1, 3, 4""")
def stations_by_lines_expanded(spark, sf):
    kept, _ = L.stations_by_lines_expanded(network(spark, sf), source_sql(spark, sf, LINES_REQ, "supplier"))
    return kept.select("req_id", "ordinal", "e_sort", "station_cd")


@query("group_expansion", LINES_SQL + """
, g AS (SELECT DISTINCT r.req_id, s.station_g_cd FROM req r JOIN stations s ON s.line_cd = r.line_cd AND s.e_status = 0)
SELECT g.req_id, a.station_g_cd, a.station_cd, a.line_cd FROM g JOIN ast a ON a.station_g_cd = g.station_g_cd""")
def group_expansion(spark, sf):
    return L.group_expansion(network(spark, sf), source_sql(spark, sf, LINES_REQ, "supplier")).select(
        "req_id", "station_g_cd", "station_cd", "line_cd")


LINE_REQ = """SELECT p_partkey AS req_id, p_partkey AS line_cd,
  CASE WHEN p_size % 3 = 0 THEN p_partkey END AS station_cd,
  CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 5 = 1 THEN 2 WHEN p_size % 5 = 2 THEN 0 END AS direction FROM {part}"""


@query("line_stations", f"""
, req AS ({LINE_REQ.format(part='part')}),
cand AS (SELECT s.line_cd, s.station_cd, t.priority, t.id, t.line_group_cd
  FROM stations s JOIN stp t ON t.station_cd = s.station_cd
  WHERE t.line_group_cd IS NOT NULL AND ((t.priority > 0 AND t.pass IS DISTINCT FROM 1) OR t.kind IN (0, 1))),
tgt AS (SELECT * FROM (SELECT r.req_id, r.line_cd, r.direction, c.line_group_cd, row_number() OVER (
    PARTITION BY r.req_id ORDER BY c.priority DESC, c.station_cd, c.id) AS rn
  FROM req r JOIN cand c ON c.line_cd = r.line_cd AND (r.station_cd IS NULL OR r.station_cd = c.station_cd)) WHERE rn = 1),
typed AS (SELECT g.req_id, CASE WHEN g.direction IN (1, 2) THEN -t.sst_id ELSE t.sst_id END AS sort_major,
    CAST(0 AS BIGINT) AS sort_minor, t.station_cd, t.line_group_cd, t.stop_condition
  FROM tgt g JOIN ts t ON t.line_group_cd = g.line_group_cd),
plain AS (SELECT r.req_id, CASE WHEN r.direction IN (1, 2) THEN -a.e_sort ELSE a.e_sort END AS sort_major,
    CASE WHEN r.direction IN (1, 2) THEN -a.station_cd ELSE a.station_cd END AS sort_minor,
    a.station_cd, fp.first_group AS line_group_cd, 0 AS stop_condition
  FROM req r JOIN ast a ON a.line_cd = r.line_cd LEFT JOIN fp ON fp.station_cd = a.station_cd
  WHERE r.req_id NOT IN (SELECT req_id FROM typed))
SELECT req_id, sort_major, sort_minor, station_cd, coalesce(line_group_cd, -1) AS line_group_cd, stop_condition
FROM (SELECT * FROM typed UNION ALL SELECT * FROM plain)""")
def line_stations(spark, sf):
    return L.line_stations(network(spark, sf), source_sql(spark, sf, LINE_REQ, "part")).select(
        "req_id", "sort_major", "sort_minor", "station_cd", *nz("line_group_cd"), "stop_condition")


# ------------------------------------------------------------------------ stations by pattern

# A request for every pattern, and one for all patterns of each supplier.
PATTERN_REQ = """SELECT 1000 + s_suppkey * 8 + k AS req_id, 1000 + s_suppkey * 8 + k AS line_group_cd
  FROM {supplier} LATERAL VIEW explode(sequence(1, 7)) AS k"""
PATTERN_SQL = """, pat AS (SELECT 1000 + s_suppkey * 8 + k AS req_id FROM supplier, (SELECT unnest(range(1, 8)) AS k))"""
PATTERNS_REQ = """SELECT s_suppkey AS req_id, transform(sequence(1, 7), k -> 1000 + s_suppkey * 8 + k) AS line_group_cds
  FROM {supplier}"""
PATTERNS_SQL = """, req AS (SELECT s_suppkey AS req_id, CAST(k - 1 AS INTEGER) AS ordinal, 1000 + s_suppkey * 8 + k AS lg
  FROM supplier, (SELECT unnest(range(1, 8)) AS k))"""


@query("stations_by_line_group", PATTERN_SQL + """
SELECT s.req_id, t.sst_id, t.station_cd, t.w_line_name AS line_name, t.kind, t.stop_condition
FROM pat s JOIN ts t ON t.line_group_cd = s.req_id""")
def stations_by_line_group(spark, sf):
    return L.stations_by_line_group(network(spark, sf), source_sql(spark, sf, PATTERN_REQ, "supplier")).select(
        "req_id", "sst_id", "station_cd", "line_name", "kind", "stop_condition")


@query("stations_by_line_groups", PATTERNS_SQL + """
, tt AS (SELECT r.req_id, t.station_cd, max(t.id) AS id, arg_max(t.type_cd, t.id) AS type_cd
  FROM req r JOIN stops t ON t.line_group_cd = r.lg JOIN types y ON y.type_cd = t.type_cd GROUP BY 1, 2)
SELECT r.req_id, r.ordinal, t.sst_id, t.station_cd, coalesce(tt.id, -1) AS tt_id, coalesce(tt.type_cd, -1) AS tt_type_cd
FROM req r JOIN ts t ON t.line_group_cd = r.lg LEFT JOIN tt ON tt.req_id = r.req_id AND tt.station_cd = t.station_cd""")
def stations_by_line_groups(spark, sf):
    return L.stations_by_line_groups(network(spark, sf), source_sql(spark, sf, PATTERNS_REQ, "supplier")).select(
        "req_id", "ordinal", "sst_id", "station_cd", *nz("tt_id", "tt_type_cd"))


@query("pattern_stops", """
SELECT line_group_cd, sst_id, station_g_cd, coalesce(pass, -1) AS pass FROM ts WHERE line_group_cd IS NOT NULL""")
def pattern_stops(spark, sf):
    return L.pattern_stops(network(spark, sf)).select("line_group_cd", "sst_id", "station_g_cd", *nz("pass"))


OD_GROUPS = """SELECT c_custkey AS req_id, c_custkey AS from_group, c_custkey + 1 AS to_group,
  CASE WHEN c_nationkey % 5 = 0 THEN array(c_custkey % 20, c_custkey % 50, c_custkey % 50 + 1) END AS via_lines FROM {customer}"""
OD_GROUPS_SQL = """, req AS (SELECT c_custkey AS req_id, c_custkey AS from_group, c_custkey + 1 AS to_group,
  c_nationkey % 5 = 0 AS has_via, c_custkey % 20 AS v1, c_custkey % 50 AS v2, c_custkey % 50 + 1 AS v3 FROM customer),
sg AS (SELECT DISTINCT station_g_cd, line_group_cd FROM stops WHERE line_group_cd IS NOT NULL),
shared AS (SELECT r.*, a.line_group_cd AS lg FROM req r JOIN sg a ON a.station_g_cd = r.from_group
  JOIN sg b ON b.station_g_cd = r.to_group AND b.line_group_cd = a.line_group_cd),
rs AS (SELECT s.req_id, s.from_group, s.to_group, t.* FROM shared s JOIN ts t ON t.line_group_cd = s.lg
  WHERE NOT s.has_via OR t.line_cd IN (s.v1, s.v2, s.v3))"""


@query("route_stops", OD_GROUPS_SQL + """
SELECT req_id, line_group_cd, sst_id, station_cd, stop_condition FROM rs""")
def route_stops(spark, sf):
    return L.route_stops(network(spark, sf), source_sql(spark, sf, OD_GROUPS, "customer")).select(
        "req_id", "line_group_cd", "sst_id", "station_cd", "stop_condition")


OD_STATIONS = """SELECT l_orderkey * 1000000 + l_partkey AS req_id, min(l_orderkey) AS from_station, max(l_orderkey + l_linenumber * 2000) AS to_station,
  CASE WHEN l_partkey % 2 = 0 THEN 1 END AS direction FROM {lineitem} GROUP BY l_orderkey, l_partkey"""


@query("route_stops_by_station", f"""
, req AS ({OD_STATIONS.format(lineitem='lineitem')}),
sc AS (SELECT DISTINCT station_cd, line_group_cd FROM sst WHERE line_group_cd IS NOT NULL AND pass IS DISTINCT FROM 1),
shared AS (SELECT r.*, a.line_group_cd AS lg FROM req r
  JOIN stations f ON f.station_cd = r.from_station JOIN stations t ON t.station_cd = r.to_station
  JOIN sc a ON a.station_cd = r.from_station
  JOIN sc b ON b.station_cd = r.to_station AND b.line_group_cd = a.line_group_cd),
typed AS (SELECT s.req_id, 1 AS part, CASE WHEN s.direction = 1 THEN -t.sst_id ELSE t.sst_id END AS sort_major,
    CAST(0 AS BIGINT) AS sort_minor, t.station_cd FROM shared s JOIN ts t ON t.line_group_cd = s.lg),
covered AS (SELECT DISTINCT s.req_id, x.station_cd FROM shared s JOIN sst x ON x.line_group_cd = s.lg),
untyped AS (SELECT r.req_id, 0 AS part, CASE WHEN r.direction = 1 THEN -a.e_sort ELSE a.e_sort END AS sort_major,
    CASE WHEN r.direction = 1 THEN -a.station_cd ELSE a.station_cd END AS sort_minor, a.station_cd
  FROM req r JOIN stations f ON f.station_cd = r.from_station AND f.e_status = 0
  JOIN stations t ON t.station_cd = r.to_station AND t.e_status = 0 AND t.line_cd = f.line_cd
  JOIN ast a ON a.line_cd = f.line_cd
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.req_id = r.req_id AND c.station_cd = a.station_cd))
SELECT * FROM typed UNION ALL SELECT * FROM untyped""")
def route_stops_by_station(spark, sf):
    return L.route_stops_by_station(network(spark, sf), source_sql(spark, sf, OD_STATIONS, "lineitem"), True).select(
        "req_id", "part", "sort_major", "sort_minor", "station_cd")


# --------------------------------------------------------------------------------- lines

@query("lines_by_group", """
SELECT station_g_cd AS req_id, station_cd, line_cd, a_line_name AS line_name, a_line_name_ko AS line_name_ko,
       a_line_color_c AS line_color_c FROM served_lines WHERE station_g_cd IN (SELECT c_custkey FROM customer)""")
def lines_by_group(spark, sf):
    return L.lines_by_group(network(spark, sf), source_sql(spark, sf, GROUP_REQ, "customer")).select(
        "req_id", "station_cd", "line_cd", "line_name", "line_name_ko", "line_color_c")


STATION_REQ = "SELECT o_orderkey AS req_id, o_orderkey AS station_cd FROM {orders}"


@query("line_by_station", """
, f AS (SELECT station_cd, min(id) AS i FROM sst WHERE pass IS DISTINCT FROM 1 GROUP BY 1)
SELECT s.station_cd AS req_id, l.line_cd, coalesce(nullif(al.line_name, ''), l.line_name) AS line_name,
       coalesce(x.line_group_cd, -1) AS line_group_cd, coalesce(x.type_cd, -1) AS type_cd
FROM stations s JOIN lines l ON l.line_cd = s.line_cd LEFT JOIN al ON al.station_cd = s.station_cd
LEFT JOIN f ON f.station_cd = s.station_cd LEFT JOIN sst x ON x.id = f.i""")
def line_by_station(spark, sf):
    return L.line_by_station(network(spark, sf), source_sql(spark, sf, STATION_REQ, "orders")).select(
        "req_id", "line_cd", "line_name", *nz("line_group_cd", "type_cd"))


@query("lines_by_line_group", PATTERNS_SQL + """
SELECT r.req_id, r.ordinal, t.id AS sst_id, l.line_cd, t.type_cd, coalesce(nullif(al.line_name, ''), l.line_name) AS line_name
FROM req r JOIN stops t ON t.line_group_cd = r.lg JOIN lines l ON l.line_cd = t.line_cd AND l.e_status = 0
LEFT JOIN al ON al.station_cd = t.station_cd""")
def lines_by_line_group(spark, sf):
    return L.lines_by_line_group(network(spark, sf), source_sql(spark, sf, PATTERNS_REQ, "supplier")).select(
        "req_id", "ordinal", "sst_id", "line_cd", "type_cd", "line_name")


@query("lines_by_line_group_routes", PATTERNS_SQL + """
SELECT DISTINCT r.req_id, t.id AS sst_id, l.line_cd, t.station_cd
FROM req r JOIN stops t ON t.line_group_cd = r.lg JOIN lines l ON l.line_cd = t.line_cd AND l.e_status = 0""")
def lines_by_line_group_routes(spark, sf):
    return L.lines_by_line_group_routes(network(spark, sf), source_sql(spark, sf, PATTERNS_REQ, "supplier")).select(
        "req_id", "sst_id", "line_cd", "station_cd")


# --------------------------------------------------------------------------- train types

TYPE_STATIONS = """SELECT c_custkey AS req_id, array(c_custkey * 2, c_custkey + 9) AS station_cds,
  CASE WHEN c_nationkey % 2 = 0 THEN 1000 + (c_custkey % 100) * 8 + 1 END AS line_group_cd FROM {customer}"""
TYPE_STATIONS_SQL = """, req AS (
  SELECT c_custkey AS req_id, 0 AS ordinal, c_custkey * 2 AS station_cd, c_nationkey, c_custkey FROM customer UNION ALL
  SELECT c_custkey, 1, c_custkey + 9, c_nationkey, c_custkey FROM customer)"""


@query("train_types_by_station", TYPE_STATIONS_SQL + """
SELECT r.req_id, r.ordinal, t.id AS sst_id, t.type_cd, y.kind FROM req r
JOIN stops t ON t.station_cd = r.station_cd JOIN types y ON y.type_cd = t.type_cd
WHERE r.c_nationkey % 2 = 1 OR t.line_group_cd = 1000 + (r.c_custkey % 100) * 8 + 1""")
def train_types_by_station(spark, sf):
    return L.train_types_by_station(network(spark, sf), source_sql(spark, sf, TYPE_STATIONS, "customer")).select(
        "req_id", "ordinal", "sst_id", "type_cd", "kind")


IN_GROUP = """SELECT l_orderkey * 10 + l_linenumber AS req_id, array(l_orderkey, l_orderkey + 1) AS station_cds,
  CASE WHEN l_linenumber < 7 THEN 1000 + min(l_suppkey) * 8 + l_linenumber END AS line_group_cd
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


@query("types_by_station_in_group", """
, r0 AS (SELECT l_orderkey * 10 + l_linenumber AS req_id, l_orderkey AS s, 1000 + min(l_suppkey) * 8 + l_linenumber AS lg
  FROM lineitem WHERE l_linenumber < 7 GROUP BY l_orderkey, l_linenumber),
req AS (SELECT req_id, 0 AS ordinal, s, lg FROM r0 UNION ALL SELECT req_id, 1, s + 1, lg FROM r0)
SELECT r.req_id, r.ordinal, t.id AS sst_id, t.type_cd, y.priority FROM req r
JOIN stops t ON t.station_cd = r.s AND t.line_group_cd = r.lg JOIN types y ON y.type_cd = t.type_cd""")
def types_by_station_in_group(spark, sf):
    return L.types_by_station_in_group(network(spark, sf), source_sql(spark, sf, IN_GROUP, "lineitem")).select(
        "req_id", "ordinal", "sst_id", "type_cd", "priority")


@query("train_types_by_line_group", PATTERN_SQL + """
SELECT s.req_id, t.id AS sst_id, t.type_cd, y.kind FROM pat s
JOIN stops t ON t.line_group_cd = s.req_id JOIN types y ON y.type_cd = t.type_cd""")
def train_types_by_line_group(spark, sf):
    return L.train_types_by_line_group(network(spark, sf), source_sql(spark, sf, PATTERN_REQ, "supplier")).select(
        "req_id", "sst_id", "type_cd", "kind")


@query("line_groups_by_group", """
SELECT station_g_cd AS req_id, line_group_cd, min(station_cd) AS first_station FROM stops
WHERE line_group_cd IS NOT NULL AND station_g_cd IN (SELECT c_custkey FROM customer) GROUP BY 1, 2""")
def line_groups_by_group(spark, sf):
    return L.line_groups_by_group(network(spark, sf), source_sql(spark, sf, GROUP_REQ, "customer")).select(
        "req_id", "line_group_cd", F.col("encounter.station_cd").alias("first_station"))


GROUP_LINE = """SELECT DISTINCT 1000 + l_suppkey * 8 + l_linenumber AS line_group_cd,
  l_orderkey % 2000 AS line_cd FROM {lineitem}"""


@query("type_by_group_line", f"""
, req AS ({GROUP_LINE.format(lineitem='lineitem')}),
f AS (SELECT t.line_group_cd, s.line_cd, min(t.id) AS sst_id, arg_min(t.type_cd, t.id) AS type_cd
  FROM stp t JOIN stations s ON s.station_cd = t.station_cd AND s.e_status = 0
  WHERE t.line_group_cd IS NOT NULL GROUP BY 1, 2)
SELECT f.line_group_cd, f.line_cd, f.sst_id, f.type_cd FROM f JOIN req r ON r.line_group_cd = f.line_group_cd AND r.line_cd = f.line_cd""")
def type_by_group_line(spark, sf):
    return L.type_by_group_line(network(spark, sf), source_sql(spark, sf, GROUP_LINE, "lineitem")).select(
        "line_group_cd", "line_cd", "sst_id", "type_cd")


# ---------------------------------------------------------------------------- name search

NAME_REQ = """SELECT s_suppkey AS req_id, CASE WHEN s_nationkey % 4 = 0 THEN translate(right(s_name, 3), '0123456789', '０１２３４５６７８９')
    WHEN s_nationkey % 4 = 1 THEN translate(right(s_name, 4), '0123456789', 'あいうえおかきくけこ')
    WHEN s_nationkey % 4 = 2 THEN concat('CUSTOMER#', right(s_name, 7)) ELSE right(s_name, 3) END AS name,
  CASE WHEN s_nationkey % 3 = 0 THEN 7 END AS limit,
  CASE WHEN s_nationkey % 5 = 3 THEN s_suppkey END AS from_group,
  CASE WHEN s_nationkey % 2 = 0 THEN 'RailAndBus' ELSE 'Rail' END AS transport FROM {supplier}"""


@query("search_stations", f"""
, req AS ({NAME_REQ.format(supplier='supplier').replace('AS limit', 'AS lim')}),
norm AS (SELECT *, translate(name, '０１２３４５６７８９あいうえおかきくけこ', '0123456789アイウエオカキクケコ') AS kana FROM req),
hits AS (SELECT n.*, a.station_cd, a.station_g_cd, a.station_name, a.line_cd FROM norm n JOIN ast a ON
  (a.station_name LIKE concat('%', n.name, '%') OR lower(a.station_name_rn) LIKE concat('%', lower(n.name), '%')
   OR a.station_name_k LIKE concat('%', n.kana, '%') OR a.station_name_zh LIKE concat('%', n.name, '%')
   OR a.station_name_ko LIKE concat('%', n.name, '%'))
  AND (n.transport = 'RailAndBus' OR a.transport_type = 0)),
orig AS (SELECT s.station_g_cd AS from_group, s.station_cd, s.line_cd,
    EXISTS (SELECT 1 FROM sst x WHERE x.station_cd = s.station_cd) AS typed FROM stations s WHERE s.e_status = 0),
fg AS (SELECT DISTINCT o.from_group, x.line_group_cd FROM orig o JOIN sst x ON x.station_cd = o.station_cd
  WHERE x.line_group_cd IS NOT NULL),
sh AS (SELECT h.req_id, h.station_cd, arg_min(x.line_group_cd, x.id) AS lg FROM hits h
  JOIN sst x ON x.station_cd = h.station_cd AND x.pass IS DISTINCT FROM 1
  JOIN fg ON fg.from_group = h.from_group AND fg.line_group_cd = x.line_group_cd GROUP BY 1, 2),
kept AS (SELECT h.*, sh.lg FROM hits h LEFT JOIN sh ON sh.req_id = h.req_id AND sh.station_cd = h.station_cd
  WHERE h.from_group IS NULL OR sh.lg IS NOT NULL OR EXISTS (SELECT 1 FROM orig o WHERE o.from_group = h.from_group
    AND o.line_cd = h.line_cd AND (NOT o.typed OR NOT EXISTS (SELECT 1 FROM sst x WHERE x.station_cd = h.station_cd))))
SELECT req_id, rank, station_cd, coalesce(lg, -1) AS line_group_cd FROM (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY station_g_cd, station_name, station_cd) AS rank FROM kept)
WHERE rank <= least(coalesce(lim, 10000), 10000)""")
def search_stations(spark, sf):
    # The query's SQL ends every request at 10,000 stations.
    req = source_sql(spark, sf, NAME_REQ, "supplier").withColumn("limit", F.least(F.coalesce("limit", F.lit(10000)), F.lit(10000)))
    return L.search_stations(network(spark, sf), req).select(
        "req_id", "rank", "station_cd", *nz("line_group_cd"))


LINE_NAME = """SELECT c_custkey AS req_id, CASE WHEN c_nationkey % 4 = 0 THEN 'red' WHEN c_nationkey % 4 = 1 THEN 'ＢＯＬＴ'
   WHEN c_nationkey % 4 = 2 THEN concat('Brand#', c_nationkey) ELSE '' END AS name,
   CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 3 * 6 END AS limit FROM {customer}"""


@query("search_lines", f"""
, req AS ({LINE_NAME.format(customer='customer').replace('AS limit', 'AS lim')}),
norm AS (SELECT *, translate(name, 'ＢＯＬＴ', 'BOLT') AS q FROM req),
qs AS (SELECT DISTINCT q FROM norm),
hits AS (SELECT q, line_cd, line_name, row_number() OVER (PARTITION BY q ORDER BY line_cd) AS rank FROM qs JOIN lines l
  ON l.e_status = 0 AND (contains(l.line_name, q) OR contains(l.line_name_rn, q) OR contains(l.line_name_k, q)
     OR contains(l.line_name_zh, q) OR contains(l.line_name_ko, q)))
SELECT n.req_id, h.rank, h.line_cd, h.line_name FROM norm n JOIN hits h ON h.q = n.q AND h.rank <= coalesce(n.lim, 1)""")
def search_lines(spark, sf):
    return L.search_lines(network(spark, sf), source_sql(spark, sf, LINE_NAME, "customer")).select(
        "req_id", "rank", "line_cd", "line_name")
