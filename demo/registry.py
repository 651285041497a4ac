"""Registry of demo queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demo.adapter import oracle_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register a query; ``sql`` continues the network CTEs unless ``raw``."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if raw else f"{oracle_ctes()},\n{HELPERS.strip()}\n{sql}"
        return fn

    return wrap


_PICK = ",\n".join(
    f"       coalesce(nullif(al.{c}, ''), nullif(l.{c}, '')) AS w_{c}"
    for c in ("line_name", "line_name_k", "line_name_h", "line_name_r",
              "line_name_zh", "line_name_ko", "line_color_c"))

# Helper tables shared by the oracles.
HELPERS = f"""
al AS (
  SELECT * FROM (
    SELECT la.station_cd, a.*, row_number() OVER (PARTITION BY la.station_cd ORDER BY la.id DESC) AS rn
    FROM line_aliases la JOIN aliases a ON a.id = la.alias_cd) WHERE rn = 1),
ast AS (
  SELECT s.*, l.company_cd, l.line_type, l.average_distance,
{_PICK}
  FROM stations s JOIN lines l ON l.line_cd = s.line_cd
  LEFT JOIN al ON al.station_cd = s.station_cd
  WHERE s.e_status = 0 AND l.e_status = 0),
fp AS (
  SELECT station_cd, arg_min(line_group_cd, id) FILTER (WHERE line_group_cd IS NOT NULL) AS first_group
  FROM sst GROUP BY station_cd),
stp AS (
  SELECT t.*, y.id AS type_id, y.kind, y.priority, y.direction, y.type_name,
         CASE WHEN t.pass BETWEEN 1 AND 5 THEN t.pass ELSE 0 END AS stop_condition
  FROM sst t JOIN types y ON y.type_cd = t.type_cd),
ts AS (
  SELECT t.id AS sst_id, t.line_group_cd, t.type_cd, t.pass, t.type_id, t.kind, t.priority, t.type_name,
         t.direction, t.stop_condition, a.*
  FROM stp t JOIN ast a ON a.station_cd = t.station_cd),
stops AS (
  SELECT t.*, s.station_g_cd, s.line_cd FROM sst t
  JOIN stations s ON s.station_cd = t.station_cd AND s.e_status = 0
  WHERE t.pass IS DISTINCT FROM 1),
allpass AS (
  SELECT station_cd FROM sst WHERE line_group_cd IS NOT NULL GROUP BY station_cd
  HAVING min(CASE WHEN pass IS NOT DISTINCT FROM 1 THEN 1 ELSE 0 END) = 1),
served AS (
  SELECT a.* FROM ast a WHERE NOT EXISTS (SELECT 1 FROM allpass p WHERE p.station_cd = a.station_cd)),
served_lines AS (
  SELECT v.station_cd, v.station_g_cd, v.e_sort AS s_sort, l.*,
         coalesce(nullif(al.line_name, ''), l.line_name) AS a_line_name,
         coalesce(nullif(al.line_name_k, ''), l.line_name_k) AS a_line_name_k,
         coalesce(nullif(al.line_name_ko, ''), l.line_name_ko) AS a_line_name_ko,
         coalesce(nullif(al.line_color_c, ''), l.line_color_c) AS a_line_color_c
  FROM served v JOIN lines l ON l.line_cd = v.line_cd
  LEFT JOIN al ON al.station_cd = v.station_cd)"""
