"""Direct routes between station groups and their train types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import common as C
from netloom.operators import lookup as L
from netloom.schema import Network


def group_routes(stops: DataFrame, order: str = "sst_id", bound: int | None = None,
                 chunk: int = C.CHUNK) -> DataFrame:
    """Stops as routes: rows without a pattern dropped, ``pos`` counting along each pattern."""
    return C.number_in_group(stops.where("line_group_cd is not null"), ["req_id", "line_group_cd"],
                             order, "pos", bound, chunk)


def pattern_lines(net: Network) -> DataFrame:
    """Distinct lines a pattern is served on, with the first and last stop on each."""
    rows = (L.pattern_line_stops(net)
            .join(L.active_lines(net).select("line_cd"), "line_cd", "left_semi"))
    stop = F.struct("sst_id", "station_cd", "type_cd")
    return (rows.groupBy("line_group_cd", "line_cd")
            .agg(F.min_by(stop, F.col("sst_id")).alias("first"), F.max_by(stop, F.col("sst_id")).alias("last")))


def routes(net: Network, req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes without a transfer: stops per route, and the lines of each route.

    A route keeps its pattern's code as id.  On each stop ``tt_line_station`` names the
    station whose line row represents the stop's line (the last served one) and is NULL when
    the pattern does not serve that line; ``type_id`` is then NULL as well.  The line list
    takes the first served stop of every line.  ``req(req_id, from_group, to_group, via_lines?)``.
    """
    ends = (L.route_stops(net, req, wide=False).groupBy("req_id", "line_group_cd")
            .agg(F.max(F.col("station_g_cd") == F.col("from_group")).alias("has_from"),
                 F.max(F.col("station_g_cd") == F.col("to_group")).alias("has_to"))
            .where("has_from and has_to").select("req_id", "line_group_cd"))
    # Decided on narrow rows and written once; wide columns are joined to the routes that remain.
    ends = C.materialize(ends, "routes")
    stops = L.route_stops(net, req, only=ends)
    lines = pattern_lines(L.asked_rows(net, ends))
    last = lines.select("line_group_cd", "line_cd", F.col("last.station_cd").alias("tt_line_station"))
    out = (stops.join(last, ["line_group_cd", "line_cd"], "left")
           .withColumn("type_id", F.when(F.col("tt_line_station").isNotNull(), F.col("type_id")))
           .withColumnRenamed("line_group_cd", "route_id"))
    route_lines = ends.join(lines, "line_group_cd").select(
        "req_id", F.col("line_group_cd").alias("route_id"), "line_cd",
        F.col("first.sst_id").alias("line_ord"), F.col("first.station_cd").alias("line_station"))
    return out, route_lines


def segment_signatures(stops: DataFrame, bound: int | None = None, chunk: int = C.CHUNK) -> DataFrame:
    """Digest of the set of station groups served between the ends of each request and
    pattern; no row when an end is missing.

    Equal sets give equal digests; see ``common.set_digest``.
    """
    rows = group_routes(stops, bound=bound, chunk=chunk)
    rows = C.group_totals(rows, ["req_id", "line_group_cd"], {
        "_a": F.min(F.when(F.col("station_g_cd") == F.col("from_group"), F.col("pos"))),
        "_b": F.min(F.when(F.col("station_g_cd") == F.col("to_group"), F.col("pos")))}, bound, chunk)
    inside = rows.where("_a is not null and _b is not null and pos between least(_a, _b) and greatest(_a, _b)")
    served = F.col("station_g_cd")
    distinct = (inside.select("req_id", "line_group_cd", F.when(C.not_passing(), served).alias("g")).distinct())
    return (distinct.groupBy("req_id", "line_group_cd").agg(*C.set_digest(F.col("g")))
            .select("req_id", "line_group_cd", F.struct(*C.SET_DIGEST).alias("signature")))


def route_types(net: Network, req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train types of the direct patterns, without those that stop at the same groups with
    the same kind as an earlier one, and the lines of each kept type with their own type.

    ``req(req_id, from_group, to_group, via_lines?)``; order is ``sst_id``.
    """
    bound = net.bound("pattern")
    stops = L.route_stops(net, req, wide=False)
    wanted = stops.select("req_id", "line_group_cd").distinct()
    asked = L.asked_rows(net, wanted)
    types = wanted.join(L.train_type_stops(asked), "line_group_cd")
    first = C.first_by(types, ["req_id", "line_group_cd"], ["sst_id"])
    full = L.route_stops(net, req.drop("via_lines"), wide=False) if "via_lines" in req.columns else stops
    signed = first.join(segment_signatures(full, bound), ["req_id", "line_group_cd"], "left")
    kept = (C.first_by(signed.where("signature is not null"), ["req_id", "kind", "signature"], ["sst_id"])
            .unionByName(signed.where("signature is null")).drop("signature"))
    # Type shown on a line row: the request's last train type with the row's type code.
    by_code = (types.groupBy("req_id", "type_cd")
               .agg(F.max("sst_id").alias("line_type_sst")))
    lines = (kept.select("req_id", "line_group_cd").join(pattern_lines(asked), "line_group_cd")
             .select("req_id", "line_group_cd", "line_cd", F.col("first.sst_id").alias("line_ord"),
                     F.col("first.station_cd").alias("line_station"), F.col("first.type_cd").alias("type_cd"))
             .join(by_code, ["req_id", "type_cd"], "left"))
    return kept, lines
