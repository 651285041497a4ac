"""Batch lookups: stations, lines, companies, patterns and train types by request.

Every function takes the network and a request table with ``req_id`` and returns one flat
row per hit.  Ordering is carried in columns (request ordinals, ``sst_id`` and signed sort
keys), never in row order, so no global sort is forced on the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import normalize_for_search
from netloom.operators import common as C
from netloom.schema import ALIAS_COLUMNS, BUS, RAIL, Network

UNLIMITED = 2_147_483_647

_LINE_EXTRA = (
    ["line_type"] + [f"line_symbol{i}" for i in range(1, 5)]
    + [f"line_symbol{i}_color" for i in range(1, 5)]
    + [f"line_symbol{i}_shape" for i in range(1, 5)] + ["average_distance"]
)
_TYPE_COLUMNS = ["type_name", "type_name_k", "type_name_r", "type_name_zh", "type_name_ko",
                 "color", "direction", "kind"]


# ------------------------------------------------------------------ predicates and requests

def active(df: DataFrame) -> DataFrame:
    return df.where("e_status = 0")


def transport_matches(transport_type: Column, wanted: Column) -> Column:
    """``wanted`` is Rail, Bus or RailAndBus; NULL means no filter."""
    return (F.coalesce(wanted, F.lit("RailAndBus")) == "RailAndBus") | (
        transport_type == F.when(wanted == "Bus", BUS).otherwise(RAIL))


def validate_requests(req: DataFrame, non_negative: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split requests into valid ones and rejected ones with the offending argument."""
    reason = F.coalesce(*[F.when(F.col(c) < 0, F.lit(c)) for c in non_negative])
    marked = req.withColumn("rejected_argument", reason)
    return (marked.where("rejected_argument is null").drop("rejected_argument"),
            marked.where("rejected_argument is not null"))


def explode_ids(req: DataFrame, ids: str, out: str) -> DataFrame:
    """One row per requested id with its request ordinal."""
    others = [c for c in req.columns if c != ids]
    return req.select(*others, F.posexplode(ids).alias("ordinal", out))


# --------------------------------------------------------------------- building blocks

def alias_by_station(net: Network) -> DataFrame:
    """The alias in force per station: the last line_alias row whose alias exists."""
    aliases = (net.aliases.groupBy("id")
               .agg(F.max_by(F.struct(*ALIAS_COLUMNS), F.col("id")).alias("alias"))
               .withColumnRenamed("id", "alias_cd"))
    return (net.line_aliases.join(aliases, "alias_cd")
            .groupBy("station_cd").agg(F.max_by("alias", "id").alias("alias")))


def station_patterns(net: Network) -> DataFrame:
    """Per station, in one pass over the stop patterns: its first row, the first row with a
    pattern, the first row it is served by, and whether any pattern stops there."""
    row = F.struct("id", "type_cd", "line_group_cd", "pass")
    grouped = F.col("line_group_cd").isNotNull()
    return net.sst.groupBy("station_cd").agg(
        F.min_by(row, F.col("id")).alias("first_sst"),
        F.min_by("line_group_cd", F.when(grouped, F.col("id"))).alias("first_line_group_cd"),
        F.min_by(row, F.when(C.not_passing(), F.col("id"))).alias("first_stop"),
        F.max(grouped).alias("has_group"),
        F.max(grouped & C.not_passing()).alias("stops_in_group"),
    )


def stop_allowed(patterns: DataFrame) -> DataFrame:
    """Stations every one of whose patterns passes them; to be removed with an anti join."""
    return patterns.where("has_group and not stops_in_group").select("station_cd")


def active_lines(net: Network) -> DataFrame:
    return active(net.lines)


def with_line(stations: DataFrame, lines: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the line's columns as ``l_*`` (station columns keep their names)."""
    picked = lines.select(F.col("line_cd"), F.col("company_cd"),
                          *[F.col(c).alias(f"l_{c}") for c in ALIAS_COLUMNS],
                          *[F.col(c) for c in _LINE_EXTRA])
    return stations.join(picked, "line_cd", how)


def to_wide(net: Network, stations: DataFrame, lines: DataFrame | None = None,
            how: str = "inner") -> DataFrame:
    """Station row plus line columns; seven line columns come from the alias if it has a
    value, else from the line, and blank becomes NULL."""
    joined = (with_line(stations, net.lines if lines is None else lines, how)
              .join(alias_by_station(net), "station_cd", "left"))
    return joined.withColumns({
        c: F.coalesce(C.blank_to_null(F.col(f"alias.{c}")), C.blank_to_null(F.col(f"l_{c}")))
        for c in ALIAS_COLUMNS
    }).drop("alias", *[f"l_{c}" for c in ALIAS_COLUMNS])


def apply_alias(net: Network, lines_of_station: DataFrame) -> DataFrame:
    """Alias override on line rows that carry ``station_cd``; without an alias value the
    current value stays, blank or not."""
    joined = lines_of_station.join(alias_by_station(net), "station_cd", "left")
    return joined.withColumns({
        c: F.coalesce(C.blank_to_null(F.col(f"alias.{c}")), F.col(c)) for c in ALIAS_COLUMNS
    }).drop("alias")


def stop_condition(pass_col: Column) -> Column:
    return F.when(pass_col.between(1, 5), pass_col).otherwise(0)


def typed_patterns(net: Network) -> DataFrame:
    """Pattern rows whose type resolves, with the type's columns."""
    types = net.types.select("type_cd", F.col("id").alias("type_id"), *_TYPE_COLUMNS, "priority")
    return (net.sst.withColumnRenamed("id", "sst_id").join(types, "type_cd")
            .withColumns({
                "stop_condition": stop_condition(F.col("pass")),
                "has_train_types": F.col("line_group_cd").isNotNull(),
            }))


def typed_stops(net: Network) -> DataFrame:
    """Pattern stops whose station, line and type all resolve and are active."""
    return with_line(active(net.stations), active_lines(net)).join(typed_patterns(net), "station_cd")


def wide_typed_stops(net: Network) -> DataFrame:
    return to_wide(net, active(net.stations), active_lines(net)).join(typed_patterns(net), "station_cd")


def asked_rows(net: Network, wanted: DataFrame, key: str = "line_group_cd") -> Network:
    """The network with only those pattern rows whose ``key`` is in ``wanted``.

    Requests meet the narrow pattern rows first, so stations, lines and types are joined to what is asked for and not to all
    patterns.  Patterns (or stations) stay whole; keys are made distinct before they meet the rows, however often one is asked.
    """
    return net.with_tables(station_station_types=net.sst.join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi"))


#: Groups whose largest size is measured: the pattern, the line, the station group.
BOUNDS = ("pattern", "line", "group")


def measure_bound(net: Network, name: str) -> int:
    if name == "pattern":
        return C.largest_group(net.sst.where("line_group_cd is not null"), ["line_group_cd"])
    return C.largest_group(net.stations, [{"line": "line_cd", "group": "station_g_cd"}[name]])


def measure_bounds(net: Network) -> dict[str, int]:
    """Sizes of the largest groups, measured once when a snapshot is taken."""
    return {name: measure_bound(net, name) for name in BOUNDS}


# ------------------------------------------------------------------------ stations by id

def stations_by_id(net: Network, req: DataFrame) -> DataFrame:
    """Active stations on active lines, with their first pattern row attached.

    ``req(req_id, station_cd, transport?)``.
    """
    hits = req.join(to_wide(net, active(net.stations), active_lines(net)), "station_cd")
    types = net.types.select("type_cd", F.col("id").alias("type_id"), *_TYPE_COLUMNS)
    first = station_patterns(net).select(
        "station_cd", F.col("first_sst.id").alias("sst_id"), F.col("first_sst.type_cd").alias("type_cd"),
        F.col("first_sst.line_group_cd").alias("line_group_cd"), F.col("first_sst.pass").alias("pass"))
    out = (hits.join(first, "station_cd", "left").join(types, "type_cd", "left")
           .withColumns({
               "has_train_types": F.col("line_group_cd").isNotNull(),
               "stop_condition": F.when(F.col("type_id").isNotNull(),
                                        stop_condition(F.col("pass"))).otherwise(0)}))
    return _filter_transport(out)


def _filter_transport(df: DataFrame) -> DataFrame:
    if "transport" not in df.columns:
        return df
    return df.where(transport_matches(F.col("transport_type"), F.col("transport")))


def _with_first_group(net: Network, stations: DataFrame) -> DataFrame:
    first = station_patterns(net).select("station_cd", F.col("first_line_group_cd").alias("line_group_cd"))
    return stations.join(first, "station_cd", "left").withColumn(
        "has_train_types", F.col("line_group_cd").isNotNull())


def stations_by_ids(net: Network, req: DataFrame) -> DataFrame:
    """``req(req_id, ids, transport?)``; duplicates kept, ``ordinal`` is the request order."""
    wanted = explode_ids(req, "ids", "station_cd")
    hits = wanted.join(to_wide(net, active(net.stations), active_lines(net)), "station_cd")
    return _filter_transport(_with_first_group(net, hits))


def stations_of_groups(net: Network, req: DataFrame) -> DataFrame:
    """Active stations on active lines of the requested groups. ``req(req_id, station_g_cd)``."""
    return req.join(to_wide(net, active(net.stations), active_lines(net)), "station_g_cd")


def stations_by_group(net: Network, req: DataFrame) -> DataFrame:
    """One row per pattern of each station; a station no pattern type resolves for stays."""
    hits = stations_of_groups(net, req)
    here = (req.select("station_g_cd").distinct().join(active(net.stations).select("station_g_cd", "station_cd"), "station_g_cd"))
    patterns = typed_patterns(asked_rows(net, here, "station_cd")).drop("priority")
    out = hits.join(patterns, "station_cd", "left").withColumns({
        "stop_condition": F.coalesce("stop_condition", F.lit(0)),
        "has_train_types": F.coalesce("has_train_types", F.lit(False))})
    return _filter_transport(out)


def stations_by_group_no_types(net: Network, req: DataFrame) -> DataFrame:
    return _with_first_group(net, stations_of_groups(net, req))


# ------------------------------------------------------------------------- stations by line

def stations_by_lines(net: Network, req: DataFrame) -> DataFrame:
    """Active stations of each requested line; order is (ordinal, e_sort, station_cd)."""
    wanted = explode_ids(req, "line_cds", "line_cd")
    return _with_first_group(net, wanted.join(to_wide(net, active(net.stations), active_lines(net)), "line_cd"))


def group_expansion(net: Network, req: DataFrame) -> DataFrame:
    """All active stations sharing a group with any active station of the requested lines
    (the lines themselves may be inactive)."""
    wanted = explode_ids(req, "line_cds", "line_cd").select("req_id", "line_cd").distinct()
    groups = (wanted.join(active(net.stations).select("line_cd", "station_g_cd"), "line_cd")
              .select("req_id", "station_g_cd").distinct())
    return _with_first_group(net, groups.join(
        to_wide(net, active(net.stations), active_lines(net)), "station_g_cd"))


def stations_by_lines_expanded(net: Network, req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requested lines' stations (first-occurrence order) and the whole expansion, which
    the enrichment step reuses instead of fetching the groups again."""
    expanded = group_expansion(net, req)
    order = (explode_ids(req, "line_cds", "line_cd")
             .groupBy("req_id", "line_cd", *[c for c in ("transport",) if c in req.columns])
             .agg(F.min("ordinal").alias("ordinal")))
    return _filter_transport(expanded.join(order, ["req_id", "line_cd"])), expanded


def line_stations(net: Network, req: DataFrame) -> DataFrame:
    """Stations of a line along its best pattern, or all its stations when it has none.

    ``req(req_id, line_cd, station_cd?, direction?)``; the order of a request's rows is
    (sort_major, sort_minor).
    """
    seeds = net.stations.select("station_cd", "line_cd").join(req.select("line_cd").distinct(), "line_cd", "left_semi")
    qualifies = ((F.col("priority") > 0) & C.not_passing()) | F.col("kind").isin(0, 1)
    candidates = (seeds.join(typed_patterns(asked_rows(net, seeds, "station_cd")), "station_cd")
                  .where(qualifies & F.col("line_group_cd").isNotNull())
                  .select("line_cd", "station_cd", "priority", "sst_id", "line_group_cd"))
    order = [F.col("priority").desc(), F.col("station_cd"), F.col("sst_id")]
    per_station = C.first_by(candidates, ["line_cd", "station_cd"], order)
    per_line = C.first_by(per_station, ["line_cd"], order)

    wants = req.select("req_id", "line_cd", F.col("station_cd").alias("want_station"),
                       F.coalesce(F.col("direction").isin(1, 2), F.lit(False)).alias("reverse"))
    target = (
        wants.where("want_station is null")
        .join(per_line.select("line_cd", "line_group_cd"), "line_cd")
        .unionByName(
            wants.where("want_station is not null")
            .join(per_station.select("line_cd", F.col("station_cd").alias("want_station"), "line_group_cd"),
                  ["line_cd", "want_station"])))
    sign = F.when(F.col("reverse"), F.lit(-1)).otherwise(F.lit(1))
    asked = asked_rows(net, target)
    typed = (target.select("req_id", "reverse", "line_group_cd")
             .join(wide_typed_stops(asked), "line_group_cd")
             .withColumns({"sort_major": sign * F.col("sst_id"), "sort_minor": F.lit(0).cast("bigint")}))
    # Requests answered by a pattern: decided on keys only, before wide rows are joined.
    answered = (target.select("req_id", "line_group_cd")
                .join(typed_stops(asked).select("line_group_cd").distinct(), "line_group_cd", "left_semi")
                .select("req_id"))
    rest = wants.join(answered, "req_id", "left_anti").drop("want_station")
    plain = (_with_first_group(net, rest.join(
        to_wide(net, active(net.stations), active_lines(net)), "line_cd"))
        .withColumns({"sort_major": sign * F.col("e_sort"), "sort_minor": sign * F.col("station_cd"),
                      "stop_condition": F.lit(0)}))
    return typed.unionByName(plain, allowMissingColumns=True).drop("reverse")


# ------------------------------------------------------------------- stations by pattern

def stations_by_line_group(net: Network, req: DataFrame) -> DataFrame:
    """Active stops of the requested patterns; order is (ordinal, sst_id).

    ``req(req_id, line_group_cds)`` or ``req(req_id, line_group_cd)``.
    """
    wanted = (explode_ids(req, "line_group_cds", "line_group_cd")
              if "line_group_cds" in req.columns else req.withColumn("ordinal", F.lit(0)))
    return _filter_transport(wanted.join(wide_typed_stops(asked_rows(net, wanted)), "line_group_cd"))


def stations_by_line_groups(net: Network, req: DataFrame) -> DataFrame:
    """As above for lists, plus ``tt_id``/``tt_type_cd``: the request's train type at the
    station, the last pattern row winning."""
    stops = stations_by_line_group(net, req)
    wanted = explode_ids(req, "line_group_cds", "line_group_cd").select("req_id", "line_group_cd").distinct()
    types = (wanted.join(train_type_stops(asked_rows(net, wanted)), "line_group_cd")
             .groupBy("req_id", "station_cd")
             .agg(F.max_by(F.struct("sst_id", "type_cd", "line_group_cd"), F.col("sst_id")).alias("tt")))
    return stops.join(types, ["req_id", "station_cd"], "left").withColumns({
        "tt_id": F.col("tt.sst_id"), "tt_type_cd": F.col("tt.type_cd"),
        "tt_line_group_cd": F.col("tt.line_group_cd")}).drop("tt")


def pattern_stops(net: Network, req: DataFrame | None = None) -> DataFrame:
    """Narrow pattern stops for route search: pattern, row id, station group, pass."""
    narrow = typed_stops(net if req is None else asked_rows(net, req)).where("line_group_cd is not null").select(
        "line_group_cd", "sst_id", "station_cd", "station_g_cd", "pass")
    return narrow if req is None else req.join(narrow, "line_group_cd")


def _stopping_groups(net: Network, key: str, station_filter: str | None) -> DataFrame:
    stations = net.stations if station_filter is None else net.stations.where(station_filter)
    return (stations.select("station_cd", "station_g_cd")
            .join(net.sst.where(C.not_passing() & F.col("line_group_cd").isNotNull())
                  .select("station_cd", "line_group_cd"), "station_cd")
            .select(key, "line_group_cd").distinct())


def shared_patterns(net: Network, req: DataFrame, key: str, station_filter: str | None,
                    origin: str, destination: str) -> DataFrame:
    """Patterns stopping at both ends of each request."""
    stops = _stopping_groups(net, key, station_filter)
    return (req.join(stops.withColumnRenamed(key, origin), origin)
            .join(stops.withColumnRenamed(key, destination), [destination, "line_group_cd"], "left_semi"))


def _via_ok(df: DataFrame, via: str) -> DataFrame:
    if via not in df.columns:
        return df
    v = F.col(via)
    return df.where(v.isNull() | (F.size(v) == 0) | F.array_contains(v, F.col("line_cd")))


def route_stops(net: Network, req: DataFrame, wide: bool = True, only: DataFrame | None = None) -> DataFrame:
    """All active stops of the patterns stopping in both groups, in ``sst_id`` order.

    ``req(req_id, from_group, to_group, via_lines?)``; ``only(req_id, line_group_cd)`` leaves other routes out.
    """
    shared = shared_patterns(net, req, "station_g_cd", "e_status = 0", "from_group", "to_group")
    if only is not None:
        shared = shared.join(only, ["req_id", "line_group_cd"], "left_semi")
    asked = asked_rows(net, shared)
    stops = wide_typed_stops(asked) if wide else typed_stops(asked).select(
        "line_group_cd", "sst_id", "station_cd", "station_g_cd", "line_cd", "pass", "kind", "type_cd")
    return _via_ok(shared.join(stops, "line_group_cd"), "via_lines")


def known_ends(net: Network, req: DataFrame) -> DataFrame:
    """Requests both of whose stations exist."""
    known = net.stations.select("station_cd")
    return (req.join(known.withColumnRenamed("station_cd", "from_station"), "from_station", "left_semi")
            .join(known.withColumnRenamed("station_cd", "to_station"), "to_station", "left_semi"))


def route_stops_by_station(net: Network, req: DataFrame, include_untyped: bool = False) -> DataFrame:
    """Stops of the patterns serving both stations; optionally also the stations of the
    common line no such pattern covers.  Rows order by (part, sort_major, sort_minor).

    ``req(req_id, from_station, to_station, direction, via_lines?)``; the request's direction
    comes back as ``req_direction``.
    """
    req = known_ends(net, req).withColumnRenamed("direction", "req_direction")
    shared = shared_patterns(net, req, "station_cd", None, "from_station", "to_station")
    sign = F.when(F.col("req_direction").eqNullSafe(F.lit(1)), F.lit(-1)).otherwise(F.lit(1))
    typed = _via_ok(shared.join(wide_typed_stops(asked_rows(net, shared)), "line_group_cd"), "via_lines").withColumns({
        "part": F.lit(1), "sort_major": sign * F.col("sst_id"), "sort_minor": F.lit(0).cast("bigint")})
    if not include_untyped:
        return typed
    ends = active(net.stations).select("station_cd", "line_cd")
    covered = (shared.select("req_id", "line_group_cd")
               .join(net.sst.select("line_group_cd", "station_cd"), "line_group_cd")
               .select("req_id", "station_cd").distinct())
    common = (req.join(ends.withColumnsRenamed({"station_cd": "from_station"}), "from_station")
              .join(ends.withColumnsRenamed({"station_cd": "to_station", "line_cd": "_to_line"}), "to_station")
              .where("line_cd = _to_line").drop("_to_line"))
    untyped = (_via_ok(common, "via_lines")
               .join(to_wide(net, active(net.stations), active_lines(net)), "line_cd")
               .join(covered, ["req_id", "station_cd"], "left_anti")
               .withColumns({"part": F.lit(0), "sort_major": sign * F.col("e_sort"),
                             "sort_minor": sign * F.col("station_cd"), "stop_condition": F.lit(0),
                             "has_train_types": F.lit(False)}))
    return untyped.unionByName(typed, allowMissingColumns=True)


# --------------------------------------------------------------------------------- lines

def lines_by_ids(net: Network, req: DataFrame) -> DataFrame:
    """Active lines, each once per request at its first position. ``req(req_id, ids)``."""
    wanted = (explode_ids(req, "ids", "line_cd").groupBy("req_id", "line_cd")
              .agg(F.min("ordinal").alias("ordinal")))
    return wanted.join(active_lines(net), "line_cd")


def companies_by_ids(net: Network, req: DataFrame) -> DataFrame:
    """Companies of each request in table order. ``req(req_id, ids)``."""
    wanted = explode_ids(req, "ids", "company_cd").select("req_id", "company_cd").distinct()
    return wanted.join(net.companies, "company_cd")


def _line_rows(net: Network, stations: DataFrame) -> DataFrame:
    """Line rows for the given station rows, alias applied; station keys attached."""
    lines = active_lines(net)
    return apply_alias(net, stations.join(lines, "line_cd"))


def served_stations(net: Network) -> DataFrame:
    """Active stations except those that every one of their patterns passes."""
    return (active(net.stations).select("station_cd", "station_g_cd", "line_cd")
            .join(stop_allowed(station_patterns(net)), "station_cd", "left_anti"))


def lines_by_group(net: Network, req: DataFrame) -> DataFrame:
    """Lines of the requested station groups, one row per station. ``req(req_id, station_g_cd)``."""
    return _line_rows(net, req.join(served_stations(net), "station_g_cd"))


def line_by_station(net: Network, req: DataFrame) -> DataFrame:
    """A station's line, whatever the status of either, with its first served pattern row."""
    first = station_patterns(net).select(
        "station_cd", F.col("first_stop.line_group_cd").alias("line_group_cd"),
        F.col("first_stop.type_cd").alias("type_cd"))
    keys = net.stations.select("station_cd", "station_g_cd", "line_cd")
    return apply_alias(net, req.join(keys, "station_cd").join(net.lines, "line_cd")) \
        .join(first, "station_cd", "left")


def pattern_line_stops(net: Network) -> DataFrame:
    """Served active stops of every pattern with their station keys (types not required)."""
    return (net.sst.where(C.not_passing() & F.col("line_group_cd").isNotNull())
            .select(F.col("id").alias("sst_id"), "station_cd", "type_cd", "line_group_cd")
            .join(active(net.stations).select("station_cd", "station_g_cd", "line_cd"), "station_cd"))


def lines_by_line_group(net: Network, req: DataFrame) -> DataFrame:
    """Line of every served stop of the requested patterns, in (ordinal, sst_id) order.

    ``req(req_id, line_group_cds)`` or ``req(req_id, line_group_cd)``.
    """
    wanted = (explode_ids(req, "line_group_cds", "line_group_cd")
              if "line_group_cds" in req.columns else req.withColumn("ordinal", F.lit(0)))
    return _line_rows(net, wanted.join(pattern_line_stops(asked_rows(net, wanted)), "line_group_cd"))


def lines_by_line_group_routes(net: Network, req: DataFrame) -> DataFrame:
    """As above, each (sst_id, line_cd) once per request; order is (sst_id, line_cd)."""
    wanted = (explode_ids(req, "line_group_cds", "line_group_cd") if "line_group_cds" in req.columns
              else req).select("req_id", "line_group_cd").distinct()
    return _line_rows(net, wanted.join(pattern_line_stops(asked_rows(net, wanted)), "line_group_cd"))


# --------------------------------------------------------------------------- train types

def train_type_stops(net: Network) -> DataFrame:
    """Pattern rows served at active stations, with type columns."""
    return (typed_patterns(net).where(C.not_passing())
            .join(active(net.stations).select("station_cd", "station_g_cd", "line_cd"), "station_cd"))


def train_types_by_station(net: Network, req: DataFrame) -> DataFrame:
    """``req(req_id, station_cds, line_group_cd?)``; order is sst_id."""
    wanted = explode_ids(req, "station_cds", "station_cd")
    if "line_group_cd" in wanted.columns:
        wanted = wanted.withColumnRenamed("line_group_cd", "_want")
        return (wanted.join(train_type_stops(asked_rows(net, wanted, "station_cd")), "station_cd")
                .where("_want is null or line_group_cd = _want").drop("_want"))
    return wanted.join(train_type_stops(asked_rows(net, wanted, "station_cd")), "station_cd")


def types_by_station_in_group(net: Network, req: DataFrame) -> DataFrame:
    """Types at stations within one pattern; order is (priority desc, sst_id); requests
    that name no pattern get nothing."""
    wanted = explode_ids(req.where("line_group_cd is not null"), "station_cds", "station_cd")
    return wanted.join(train_type_stops(asked_rows(net, wanted)), ["station_cd", "line_group_cd"])


def train_types_by_line_group(net: Network, req: DataFrame) -> DataFrame:
    """Types of patterns, one row per served stop; order is sst_id."""
    wanted = (explode_ids(req, "line_group_cds", "line_group_cd") if "line_group_cds" in req.columns
              else req).select("req_id", "line_group_cd").distinct()
    return wanted.join(train_type_stops(asked_rows(net, wanted)), "line_group_cd")


def pattern_encounters(net: Network) -> DataFrame:
    """Patterns stopping in each station group with the first encounter (station, row id)."""
    return (net.sst.where(C.not_passing() & F.col("line_group_cd").isNotNull())
            .join(active(net.stations).select("station_cd", "station_g_cd"), "station_cd")
            .groupBy("station_g_cd", "line_group_cd")
            .agg(F.min(F.struct("station_cd", F.col("id").alias("sst_id"))).alias("encounter")))


def line_groups_by_group(net: Network, req: DataFrame) -> DataFrame:
    """Distinct patterns per requested group; ``encounter`` gives their order."""
    return req.select("req_id", "station_g_cd").distinct().join(pattern_encounters(net), "station_g_cd")


def type_by_group_line(net: Network, req: DataFrame) -> DataFrame:
    """Train type of (pattern, line): the first pattern row on that line whose type
    resolves. ``req(req_id, line_group_cd, line_cd)``."""
    return req.join(first_type_by_group_line(net), ["line_group_cd", "line_cd"])


def first_type_by_group_line(net: Network) -> DataFrame:
    rows = typed_patterns(net).where("line_group_cd is not null").join(
        active(net.stations).select("station_cd", "line_cd"), "station_cd")
    cols = ["sst_id", "station_cd", "type_cd", "pass", *_TYPE_COLUMNS]
    return (rows.groupBy("line_group_cd", "line_cd")
            .agg(F.min_by(F.struct(*cols), F.col("sst_id")).alias("t"))
            .select("line_group_cd", "line_cd", "t.*"))


# --------------------------------------------------------------------------- name search

def _grams(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))))


@dataclass(frozen=True)
class NameIndex:
    """Runs of one to three characters of all names of a table, written once and kept with the snapshot.

    keys (key, field, value), grams (field, gram, value_id), frequency (field, gram, df) and values (field, value_id, value).
    """

    keys: DataFrame
    values: DataFrame
    grams: DataFrame
    frequency: DataFrame


def name_index(keys: DataFrame) -> NameIndex:
    """The index of ``keys(key, field, value)``; null and empty values are in it nowhere."""
    kept = C.materialize(keys.where("value IS NOT NULL AND value <> ''"), "names")
    values = C.materialize(kept.select("field", F.xxhash64("value").alias("value_id"), "value").distinct(), "name-values")
    grams = values.select("field", "value_id", F.explode(F.array_distinct(F.concat(
        *[F.coalesce(_grams(F.col("value"), n), F.array().cast("array<string>")) for n in (1, 2, 3)]))).alias("gram"))
    grams = C.materialize(grams.repartitionByRange("field", "gram").sortWithinPartitions("field", "gram"), "name-grams")
    return NameIndex(kept, values, grams, C.materialize(grams.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("df")), "gram-frequency"))


def station_names(net: Network) -> DataFrame:
    """key, field, value: the searched names of active stations on active lines."""
    stations = (active(net.stations).withColumn("station_name_rn_lower", F.lower("station_name_rn"))
                .join(active_lines(net).select("line_cd"), "line_cd", "left_semi"))
    return stations.select(F.col("station_cd").alias("key"), F.explode(F.create_map(
        *[x for f in _STATION_FIELDS for x in (F.lit(f), F.col(f))])).alias("field", "value"))


def line_names(net: Network) -> DataFrame:
    return active_lines(net).select(F.col("line_cd").alias("key"), F.explode(F.create_map(
        *[x for f in _LINE_FIELDS for x in (F.lit(f), F.col(f))])).alias("field", "value"))


class NameIndexes(dict):
    """The name indexes by table, each made when a search first reads it."""

    def __init__(self, net: Network) -> None:
        super().__init__()
        self._net = net

    def __bool__(self) -> bool:
        return True

    def __missing__(self, table: str) -> NameIndex:
        self[table] = name_index({"stations": station_names, "lines": line_names}[table](self._net))
        return self[table]


def with_names(net: Network) -> Network:
    """The snapshot with its name indexes, which the searches then read instead of all names."""
    names = NameIndexes(net)
    return net.with_tables(names={table: names[table] for table in ("stations", "lines")})


def substring_matches(index: NameIndex, queries: DataFrame) -> DataFrame:
    """Pairs (field, value, needle) with ``value`` containing ``needle``, per field.

    ``queries(field, needle)`` is distinct.  A needle is looked up by its rarest run of up to three characters, so the
    comparison is an equi-join plus an exact check instead of every needle against every value.
    """
    needles = queries.where(F.char_length("needle") > 0)
    size = F.least(F.char_length("needle"), F.lit(3))
    runs = needles.select("field", "needle", F.explode(F.when(size == 1, _grams(F.col("needle"), 1))
                                                       .when(size == 2, _grams(F.col("needle"), 2))
                                                       .otherwise(_grams(F.col("needle"), 3))).alias("gram"))
    # A run absent from the index means no value can contain the needle.
    scored = runs.join(index.frequency, ["field", "gram"], "left").na.fill({"df": 0})
    rarest = C.first_by(scored, ["field", "needle"], [F.col("df"), F.col("gram")]).where("df > 0").drop("df")
    return (rarest.join(index.grams, ["field", "gram"]).join(index.values, ["field", "value_id"])
            .where(F.contains(F.col("value"), F.col("needle")))
            .select("field", "value", "needle"))


_STATION_FIELDS = ["station_name", "station_name_rn_lower", "station_name_k",
                   "station_name_zh", "station_name_ko"]


def search_stations(net: Network, req: DataFrame) -> DataFrame:
    """Stations whose name contains the query; order is (station_g_cd, station_name,
    station_cd) in ``rank``; the limit applies after the reachability test.

    ``req(req_id, name, limit?, from_group?, transport?)``.  Requests without an origin take their stations by rank from the hits of
    their name, which are ranked once, up to the largest limit asked for.  Requests with one compare the names of the stations that
    can be reached from it, which are few whatever the name.
    """
    stations = active(net.stations).join(active_lines(net).select("line_cd"), "line_cd", "left_semi")
    keys = stations.select("station_cd", "station_g_cd", "station_name", "line_cd", "transport_type")
    order = ["station_g_cd", "station_name", "station_cd"]
    limited = "limit" in req.columns
    free, bound = (req, None) if "from_group" not in req.columns else (req.where("from_group IS NULL"), req.where("from_group IS NOT NULL"))

    wanted = F.coalesce(F.col("transport"), F.lit("RailAndBus")) if "transport" in req.columns else F.lit("RailAndBus")
    asked = free.select("name", wanted.alias("_transport"), *(["limit"] if limited else []))
    settings = asked.select("name", "_transport").distinct()
    needles = settings.select("name", *_needles()).where("name <> ''").distinct()
    index = net.names["stations"] if net.names else name_index(station_names(net))
    pairs = substring_matches(index, needles.select("field", "needle").distinct())
    hits = (needles.join(pairs, ["field", "needle"]).select("name", "field", "value").distinct()
            .join(index.keys.withColumnRenamed("key", "station_cd"), ["field", "value"]).select("name", "station_cd").distinct())
    hits = settings.join(hits.join(keys, "station_cd"), "name").where(transport_matches(F.col("transport_type"), F.col("_transport")))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("name", "_transport").orderBy(*order)))
    if limited:
        most = asked.agg(F.max("limit").alias("most"), F.max(F.col("limit").isNull()).alias("open")).first()  # two numbers
        if not most["open"]:
            hits = hits.where(F.col("rank") <= F.lit(int(most["most"] or 0)))
    found = free.withColumn("_transport", wanted).join(hits, ["name", "_transport"]).drop("_transport")
    if limited:
        found = found.where(F.col("limit").isNull() | (F.col("rank") <= F.col("limit")))
    found = found.withColumn("line_group_cd", F.lit(None).cast("bigint"))
    if bound is not None:
        near = reachable(net, bound.select("from_group").distinct())
        named = keys.join(active(net.stations).select("station_cd", *[f for f in _STATION_FIELDS if f not in ("station_name", "station_name_rn_lower")],
                                                      F.lower("station_name_rn").alias("station_name_rn_lower")), "station_cd")
        texts = dict(_needle_texts())
        met = _filter_transport(bound.join(near.join(named, "station_cd"), "from_group")).where(
            (F.col("name") != "") & F.coalesce(*[F.when(F.contains(F.col(f), texts[f]), True) for f in _STATION_FIELDS], F.lit(False)))
        met = met.withColumn("rank", F.row_number().over(Window.partitionBy("req_id").orderBy(*order)))
        if limited:
            met = met.where(F.col("limit").isNull() | (F.col("rank") <= F.col("limit")))
        found = found.unionByName(met.drop(*[f for f in _STATION_FIELDS if f != "station_name"]))
    return found.withColumn("has_train_types", F.col("line_group_cd").isNotNull())


def _needle_texts() -> list[tuple[str, Column]]:
    """Each searched field with what a request's name is looked up as in it."""
    name = F.col("name")
    as_is = {"station_name_rn_lower": F.lower(name), "station_name_k": normalize_for_search(name)}
    return [(f, as_is.get(f, name)) for f in _STATION_FIELDS]


def _needles() -> list[Column]:
    return [F.explode(F.create_map(*[x for f, text in _needle_texts() for x in (F.lit(f), text)])).alias("field", "needle")]


def reachable(net: Network, origins: DataFrame) -> DataFrame:
    """from_group, station_cd, line_group_cd: the stations reachable without a transfer from each of the distinct groups
    ``origins(from_group)``, with the first pattern shared, or null where only the line is."""
    stations = active(net.stations)
    here = stations.select(F.col("station_g_cd").alias("from_group"), "station_cd", "line_cd").join(origins, "from_group", "left_semi")
    patterns = (here.select("from_group", "station_cd").join(net.sst.where("line_group_cd is not null").select("station_cd", "line_group_cd"), "station_cd")
                .select("from_group", "line_group_cd").distinct())
    stops = net.sst.where(C.not_passing() & F.col("line_group_cd").isNotNull()).select("station_cd", "line_group_cd", F.col("id").alias("_id"))
    shared = patterns.join(stops, "line_group_cd").select("from_group", "station_cd", "line_group_cd", "_id")
    # A station with pattern rows shares a line only with origins on it that have none.
    any_row = net.sst.select("station_cd").distinct().withColumn("has_rows", F.lit(True))
    lines = (here.join(any_row, "station_cd", "left").groupBy("from_group", "line_cd")
             .agg(F.max(F.col("has_rows").isNull()).alias("line_without_types")))
    same_line = (lines.join(stations.select("station_cd", "line_cd").join(any_row, "station_cd", "left"), "line_cd")
                 .where("has_rows IS NULL OR line_without_types")
                 .select("from_group", "station_cd", F.lit(None).cast("bigint").alias("line_group_cd"), F.lit(None).cast("bigint").alias("_id")))
    return (shared.unionByName(same_line).groupBy("from_group", "station_cd")
            .agg(F.min_by("line_group_cd", "_id").alias("line_group_cd")))


_LINE_FIELDS = ["line_name", "line_name_rn", "line_name_k", "line_name_zh", "line_name_ko"]


def search_lines(net: Network, req: DataFrame) -> DataFrame:
    """Active lines containing the normalised query in any of five name columns, in
    ``line_cd`` order; the limit defaults to one. ``req(req_id, name, limit?)``."""
    lines = active_lines(net)
    index = net.names["lines"] if net.names else name_index(line_names(net))
    asked = req.withColumn("needle", normalize_for_search(F.col("name")))
    fields = F.explode(F.array(*[F.lit(f) for f in _LINE_FIELDS])).alias("field")
    pairs = substring_matches(index, asked.select("needle", fields).distinct())
    hits = pairs.join(index.keys.withColumnRenamed("key", "line_cd"), ["field", "value"]).select("needle", "line_cd").distinct()
    # Hits are ranked once for each needle, up to the largest limit asked for; requests then take theirs by rank.
    limit = F.coalesce(F.col("limit"), F.lit(1)) if "limit" in req.columns else F.lit(1)
    most = asked.agg(F.max(limit).alias("most")).first()["most"] or 0
    w = Window.partitionBy("needle").orderBy("line_cd")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(int(most)))
    ranked = ranked.withColumn("rank", F.col("rank").cast("bigint"))
    found = asked.join(ranked, "needle").where(F.col("rank") <= limit)
    if not asked.where("needle = ''").isEmpty():  # only a blank query needs all lines numbered
        found = found.unionByName(_blank_line_queries(lines, asked))
    return found.join(lines, "line_cd").drop("needle")


def _blank_line_queries(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """An empty query is contained in every name: the first ``limit`` lines."""
    numbered = C.assign_serial(lines.select("line_cd"), ["line_cd"], "rank")
    total = lines.agg(F.count(F.lit(1)).alias("_total"))  # one row
    limit = F.coalesce(F.col("limit"), F.lit(1)) if "limit" in asked.columns else F.lit(1)
    ranks = (asked.where("needle = ''").crossJoin(F.broadcast(total))
             .where(limit.cast("bigint").between(1, UNLIMITED) & (F.col("_total") > 0))
             .withColumn("rank", F.explode(F.sequence(F.lit(1).cast("bigint"),
                                                      F.least(limit.cast("bigint"), F.col("_total")))))
             .drop("_total"))
    return ranks.join(numbered, "rank")
