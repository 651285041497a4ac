"""Enrichment: what a response attaches to each station, line and train type.

Nested objects of the service model are kept as child tables with an order column; short
fixed-size lists (up to four numbers, three symbols) are arrays on the row itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geo
from netloom.operators import common as C
from netloom.operators import lookup as L
from netloom.operators import spatial as S
from netloom.schema import ALIAS_COLUMNS, BUS, RAIL, Network


# ------------------------------------------------------------------- structs on a wide row

def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def station_numbers() -> Column:
    """Numbers 1..4 with the line symbol of the same index; blank numbers are left out."""
    def one(i: int) -> Column:
        symbol, number = F.col(f"line_symbol{i}"), F.col(f"station_number{i}")
        return F.when(_text(f"station_number{i}") != "", F.struct(
            F.coalesce(symbol, F.lit("")).alias("line_symbol"),
            _text(f"line_symbol{i}_color").alias("line_symbol_color"),
            _text(f"line_symbol{i}_shape").alias("line_symbol_shape"),
            F.when(symbol.isNotNull(), F.concat_ws("-", symbol, number)).otherwise(number)
            .alias("station_number")))
    return F.filter(F.array(*[one(i) for i in range(1, 5)]), lambda x: x.isNotNull())


def line_symbols() -> Column:
    """Symbols 1..3 that have a shape; the first falls back to the line's colour."""
    def one(i: int) -> Column:
        symbol, shape = F.col(f"line_symbol{i}"), F.col(f"line_symbol{i}_shape")
        color = F.col(f"line_symbol{i}_color")
        if i == 1:
            color = F.coalesce(color, F.col("line_color_c"))
        return F.when(symbol.isNotNull() & shape.isNotNull(), F.struct(
            symbol.alias("symbol"), F.coalesce(color, F.lit("")).alias("color"), shape.alias("shape")))
    return F.filter(F.array(*[one(i) for i in range(1, 4)]), lambda x: x.isNotNull())


def line_struct() -> Column:
    """The line of a wide station row; missing names become blank, status and sort are 0."""
    blank = ["line_name", "line_name_k", "line_name_h"]
    keep = ["line_name_r", "line_name_zh", "line_name_ko", "line_color_c", "line_type", "average_distance"]
    return F.struct(
        "line_cd", F.coalesce("company_cd", F.lit(0)).alias("company_cd"),
        *[_text(c).alias(c) for c in blank], *keep, line_symbols().alias("line_symbols"),
        F.lit(0).alias("e_status"), F.lit(0).alias("e_sort"),
        "station_cd", "station_g_cd", "transport_type")


def station_struct(train_type: Column | None = None) -> Column:
    """A station rebuilt from a wide row with its numbers, line and, if given, train type."""
    keep = ["station_cd", "station_g_cd", "station_name", "station_name_k", "station_name_r",
            "station_name_zh", "station_name_ko", "three_letter_code", "line_cd", "pref_cd", "post",
            "address", "lon", "lat", "open_ymd", "close_ymd", "e_status", "e_sort", "transport_type"]
    return F.struct(*keep, station_numbers().alias("station_numbers"), line_struct().alias("line"),
                    (F.lit(None) if train_type is None else train_type).alias("train_type"))


# ----------------------------------------------------------------------- public projections

def public_transport(transport_type: Column) -> Column:
    """Stored 0/1 to public 1/2."""
    return F.when(transport_type == BUS, F.lit(2)).otherwise(F.lit(1))


def to_public_station(wide: DataFrame) -> DataFrame:
    extra = [c for c in ("req_id", "ordinal", "rank") if c in wide.columns]
    distance = F.col("distance") if "distance" in wide.columns else F.lit(None).cast("double")
    condition = F.coalesce("stop_condition", F.lit(0)) if "stop_condition" in wide.columns else F.lit(0)
    typed = F.col("has_train_types") if "has_train_types" in wide.columns else F.lit(False)
    return wide.select(
        *extra, F.col("station_cd").alias("id"), F.col("station_g_cd").alias("group_id"),
        F.col("station_name").alias("name"), F.col("station_name_k").alias("name_katakana"),
        F.col("station_name_r").alias("name_roman"), F.col("station_name_zh").alias("name_chinese"),
        F.col("station_name_ko").alias("name_korean"), "three_letter_code",
        F.col("pref_cd").alias("prefecture_id"), F.col("post").alias("postal_code"), "address",
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.col("open_ymd").alias("opened_at"), F.col("close_ymd").alias("closed_at"),
        F.col("e_status").alias("status"), station_numbers().alias("station_numbers"),
        condition.alias("stop_condition"), distance.alias("distance"), typed.alias("has_train_types"),
        public_transport(F.col("transport_type")).alias("transport_type"))


def to_public_line(lines: DataFrame) -> DataFrame:
    extra = [c for c in ("req_id", "ordinal", "rank") if c in lines.columns]
    return lines.select(
        *extra, F.col("line_cd").alias("id"), F.col("line_name").alias("name_short"),
        F.col("line_name_k").alias("name_katakana"), F.col("line_name_h").alias("name_full"),
        _text("line_name_r").alias("name_roman"), F.col("line_name_zh").alias("name_chinese"),
        F.col("line_name_ko").alias("name_korean"), _text("line_color_c").alias("color"),
        F.when(F.col("transport_type") == BUS, 0).otherwise(F.coalesce("line_type", F.lit(0))).alias("line_type"),
        line_symbols().alias("line_symbols"), F.col("e_status").alias("status"),
        F.coalesce("average_distance", F.lit(0.0)).alias("average_distance"),
        public_transport(F.col("transport_type")).alias("transport_type"))


def to_public_train_type(types: DataFrame) -> DataFrame:
    extra = [c for c in ("req_id", "ordinal") if c in types.columns]
    return types.select(
        *extra, F.coalesce("sst_id", F.lit(0)).alias("id"), F.coalesce("type_cd", F.lit(0)).alias("type_id"),
        F.coalesce("line_group_cd", F.lit(0)).alias("group_id"), F.col("type_name").alias("name"),
        F.col("type_name_k").alias("name_katakana"), F.col("type_name_r").alias("name_roman"),
        F.col("type_name_zh").alias("name_chinese"), F.col("type_name_ko").alias("name_korean"), "color",
        F.coalesce("direction", F.lit(0)).alias("direction"), F.coalesce("kind", F.lit(0)).alias("kind"))


def to_public_company(companies: DataFrame) -> DataFrame:
    extra = [c for c in ("req_id",) if c in companies.columns]
    return companies.select(
        *extra, F.col("company_cd").alias("id"), F.col("rr_cd").alias("railroad_id"),
        F.col("company_name").alias("name_short"), F.col("company_name_k").alias("name_katakana"),
        F.col("company_name_h").alias("name_full"), F.col("company_name_en").alias("name_english_short"),
        F.col("company_name_full_en").alias("name_english_full"), F.col("company_url").alias("url"),
        F.col("company_type").alias("type"), F.col("e_status").alias("status"),
        F.col("company_name").alias("name"))


# ------------------------------------------------------------------------------ enrichment

@dataclass(frozen=True)
class Enriched:
    """``stations``: the input rows with numbers, line struct, company and train type.
    ``lines``: (req_id, station_cd, station_g_cd, line_ord..., line, company, line station)."""

    stations: DataFrame
    lines: DataFrame


def _group_lines(net: Network, groups: DataFrame) -> DataFrame:
    """Distinct lines of each group, first station on each line giving order and alias."""
    served = L.served_stations(net).join(groups, "station_g_cd", "left_semi")
    return served.groupBy("station_g_cd", "line_cd").agg(F.min("station_cd").alias("alias_station"))


def _line_station(net: Network) -> DataFrame:
    """The station standing for a line in a group: the last active one on it."""
    return (L.with_line(L.active(net.stations), L.active_lines(net))
            .groupBy("line_cd", "station_g_cd").agg(F.max("station_cd").alias("group_station")))


def nearby_bus_lines(net: Network, stations: DataFrame) -> DataFrame:
    """Bus lines around rail stations.

    All active stops within 300 m of the station count, on active lines.  Lines come in the order of their stop groups, by
    distance from the group's first coordinate; each line once, with the nearest stop of that line attached.
    """
    rail = stations.where(F.col("transport_type") == RAIL)
    # One probe per coordinate, however many requests and stations share it.
    anchors = C.first_by(rail.select("req_id", "station_g_cd", "ord", F.col("lat").alias("a_lat"),
                                     F.col("lon").alias("a_lon")), ["req_id", "station_g_cd"], ["ord"]).drop("ord")
    spots = (rail.select("req_id", "station_cd", "station_g_cd", "lat", "lon").distinct()
             .join(anchors, ["req_id", "station_g_cd"]))
    stops = (L.active(net.stations).where(F.col("transport_type") == BUS)
             .join(L.active_lines(net).select("line_cd"), "line_cd", "left_semi")
             .select(F.col("station_cd").alias("stop_cd"), F.col("station_g_cd").alias("stop_g_cd"), F.col("line_cd").alias("stop_line_cd"), "lat", "lon"))
    around = S.within_radius(spots.select(F.col("lat").alias("qlat"), F.col("lon").alias("qlon")).distinct(), stops, S.BUS_STOP_RADIUS_M)
    around = around.select(F.col("qlat").alias("lat"), F.col("qlon").alias("lon"), "stop_cd", "stop_g_cd", "stop_line_cd",
                           F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    places = spots.select("a_lat", "a_lon", "lat", "lon").distinct()
    far = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("s_lat"), F.col("s_lon"))
    place = ["a_lat", "a_lon", "lat", "lon"]
    order = Window.partitionBy(*place).orderBy(far, "stop_cd")
    # Used for the lines and for the stop shown with each, so the search result is kept.
    near = C.materialize(places.join(around, ["lat", "lon"]).withColumn("rank", F.row_number().over(order)), "near-stops")
    groups = near.groupBy(*place, "stop_g_cd").agg(F.min("rank").alias("group_rank"))
    bus_rows = (L.served_stations(net).select(F.col("station_cd").alias("alias_station"),
                                              F.col("station_g_cd").alias("stop_g_cd"), "line_cd")
                .join(L.active_lines(net).where(F.col("transport_type") == BUS).select("line_cd"),
                      "line_cd", "left_semi"))
    order = F.struct("group_rank", "alias_station")
    lines = (groups.join(bus_rows, "stop_g_cd").groupBy(*place, "line_cd")
             .agg(F.min(order).alias("bus_ord")))
    nearest = near.groupBy(*place, F.col("stop_line_cd").alias("line_cd")).agg(
        F.min_by("stop_cd", "rank").alias("bus_stop"))
    found = lines.join(nearest, [*place, "line_cd"], "left")
    return spots.join(found, place).select(
        "req_id", "station_cd", "station_g_cd", "line_cd", F.col("bus_ord.group_rank").alias("group_rank"),
        F.col("bus_ord.alias_station").alias("alias_station"), "bus_stop")


def enrich(net: Network, stations: DataFrame, transport: str = "RailAndBus",
           line_group: bool = False, group_stations: DataFrame | None = None) -> Enriched:
    """Attach everything a station response carries.

    ``stations`` are wide rows with ``req_id`` and ``ord``.  With ``line_group`` the rows'
    ``want_line_group`` names the pattern whose train type is shown (else none is).
    ``group_stations``, when the caller already expanded the groups, provides the stations
    standing for lines instead of a new lookup.
    """
    keys = stations.select("req_id", "ord", "station_cd", "station_g_cd", "lat", "lon", "transport_type")
    want = {"Rail": [RAIL], "Bus": [BUS], "RailAndBus": [RAIL, BUS]}[transport]
    companies = net.companies.select("company_cd", "company_name")
    types = None
    if line_group:
        # Several rows of one station in the pattern: lowest priority, latest row is shown.
        types = (L.train_type_stops(net).where("line_group_cd is not null")
                 .groupBy("station_cd", F.col("line_group_cd").alias("want_line_group"))
                 .agg(F.max_by(F.struct("sst_id", "type_cd", "kind"),
                               F.struct(-F.col("priority"), F.col("sst_id"))).alias("train_type")))

    out = stations.withColumns({"station_numbers": station_numbers(), "line": line_struct()})
    out = out.join(companies, "company_cd", "left")
    if types is not None:
        out = out.join(types, ["station_cd", "want_line_group"], "left")

    groups = keys.select("station_g_cd").distinct()
    own = (_group_lines(net, groups)
           .join(L.active_lines(net).where(F.col("transport_type").isin(want)).select("line_cd"),
                 "line_cd", "left_semi"))
    pairs = keys.select("req_id", "station_cd", "station_g_cd").distinct()
    rail_lines = pairs.join(own, "station_g_cd").withColumns(
        {"group_rank": F.lit(0), "bus_stop": F.lit(None).cast("bigint")})
    lines = rail_lines
    if transport == "RailAndBus":
        bus = nearby_bus_lines(net, keys)
        extra = bus.join(rail_lines.select("req_id", "station_cd", "line_cd"),
                         ["req_id", "station_cd", "line_cd"], "left_anti")
        lines = rail_lines.unionByName(extra)
    if group_stations is None:
        standing = _line_station(net)
        lines = lines.join(standing, ["line_cd", "station_g_cd"], "left")
    else:
        standing = (group_stations.groupBy("req_id", "line_cd", "station_g_cd")
                    .agg(F.max("station_cd").alias("group_station")))
        lines = lines.join(standing, ["req_id", "line_cd", "station_g_cd"], "left")
    lines = lines.withColumn("line_station", F.coalesce("group_station", "bus_stop"))
    named = L.apply_alias(net, lines.withColumnsRenamed({"station_cd": "of_station", "alias_station": "station_cd"})
                          .join(net.lines, "line_cd"))
    named = (named.withColumn("line_symbols", line_symbols())
             .join(companies, "company_cd", "left")
             .select("req_id", F.col("of_station").alias("station_cd"), "station_g_cd", "group_rank",
                     F.col("station_cd").alias("alias_station"), "line_cd", "company_cd", "company_name",
                     *ALIAS_COLUMNS, "line_type", "transport_type", "line_symbols", "line_station"))
    if types is not None:
        wanted = stations.select("req_id", "want_line_group").distinct()
        shown = types.withColumnRenamed("station_cd", "line_station")
        named = named.join(wanted, "req_id").join(shown, ["line_station", "want_line_group"], "left")
    return Enriched(out, named)


def station_train_types(net: Network, req: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train types of a station with the station's own line, and the lines of every pattern.

    A station whose line does not exist has no train types.  ``req(req_id, station_cd)``.
    """
    companies = net.companies.select("company_cd", "company_name")
    own = (L.line_by_station(net, req).withColumn("line_symbols", line_symbols())
           .join(companies, "company_cd", "left")
           .select("req_id", F.col("line_cd").alias("own_line_cd"), F.col("line_name").alias("own_line_name"),
                   F.col("company_name").alias("own_company"), F.col("line_symbols").alias("own_symbols")))
    stops = L.train_type_stops(net).select(
        "station_cd", "sst_id", "type_cd", "line_group_cd", "pass", "type_name", "kind", "direction")
    types = req.join(stops, "station_cd").join(own, "req_id")
    grouped = F.col("line_group_cd").isNotNull()
    types = types.withColumns({c: F.when(grouped, F.col(c)) for c in
                               ("own_line_cd", "own_line_name", "own_company", "own_symbols")})
    patterns = types.where(grouped).select("req_id", F.col("sst_id").alias("tt_id"), "line_group_cd")
    by_line = L.first_type_by_group_line(net).select(
        "line_group_cd", "line_cd", F.col("sst_id").alias("line_type_sst"))
    # Everything a pattern's row carries is joined once a row, before the rows are repeated for each train type of a request.
    pattern_lines = (L._line_rows(net, L.pattern_line_stops(net)).withColumn("line_symbols", line_symbols())
                     .select("line_group_cd", "sst_id", "line_cd", "company_cd", "line_name", "line_symbols", "station_cd")
                     .join(companies, "company_cd", "left").join(by_line, ["line_group_cd", "line_cd"], "left"))
    return types, patterns.join(pattern_lines, "line_group_cd")
