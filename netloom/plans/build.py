"""Jobs that build the network dataset: local services, feed integration, snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import codes, text
from netloom.operators import common as C
from netloom.operators import integrity as I
from netloom.plans import patterns as P
from netloom.plans.stop_groups import stop_groups
from netloom.plans.stop_order import stop_route_order, trip_rows
from netloom.schema import BUS, COLUMNS, RAIL, DeferredNetwork, Network

# Fixed values of the build.
DEFAULT_TYPE, LOCAL_TYPE = 100, 101
VIRTUAL_GROUP_BASE = 1_000_000_000
LOCAL_SERVICE_LINES = [11309, 11318, 11345, 99101, 99102, 99103, 99301, 99305, 99342, 99649]
DEFAULT_BUS_COLOR = "#1f63c6"
BUS_PREFECTURE = 13
BUS_KIND = 7


@dataclass(frozen=True)
class Feed:
    """Feed tables; ``ord`` columns give source order."""

    routes: DataFrame
    stops: DataFrame
    trips: DataFrame
    stop_times: DataFrame

    def cleaned(self) -> "Feed":
        """Unique ids (first wins), referenced rows only, parents that exist."""
        routes = I.dedup_first(self.routes, ["route_id"], ["ord"])
        stops = I.drop_dangling_parents(I.dedup_first(self.stops, ["stop_id"], ["ord"]))
        trips = I.dedup_first(I.fk_semi(self.trips, routes, "route_id"), ["trip_id"], ["ord"])
        times = I.fk_semi(I.fk_semi(self.stop_times, trips, "trip_id"), stops, "stop_id")
        return Feed(routes, stops, trips, I.dedup_first(times, ["trip_id", "stop_sequence"], ["ord"]))

    def materialized(self) -> "Feed":
        return Feed(*[C.materialize(df, n) for n, df in vars(self).items()])


# ------------------------------------------------------------------- virtual local services

def default_local_type(net: Network) -> DataFrame:
    """Most frequent of the two local types per line of active rail stations; smaller on a tie."""
    stations = net.stations.where((F.col("e_status") == 0) & (F.col("transport_type") == RAIL))
    counts = (net.sst.where(F.col("type_cd").isin(DEFAULT_TYPE, LOCAL_TYPE)).select("station_cd", "type_cd")
              .join(stations.select("station_cd", "line_cd"), "station_cd")
              .groupBy("line_cd", "type_cd").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("line_cd").agg(
        F.max_by("type_cd", F.struct(F.col("n"), -F.col("type_cd"))).alias("type_cd"))


def virtual_local_rows(net: Network) -> DataFrame:
    """All-stops patterns for active rail lines with a station no pattern serves."""
    stations = net.stations.where((F.col("e_status") == 0) & (F.col("transport_type") == RAIL))
    lines = net.lines.where((F.col("e_status") == 0) & (F.col("transport_type") == RAIL)).select("line_cd")
    uncovered = (stations.join(net.sst.select("station_cd"), "station_cd", "left_anti").select("line_cd").distinct())
    fallback = F.when(F.col("line_cd").isin(LOCAL_SERVICE_LINES), LOCAL_TYPE).otherwise(DEFAULT_TYPE)
    targets = (lines.join(uncovered, "line_cd", "left_semi").join(default_local_type(net), "line_cd", "left")
               .withColumn("type_cd", F.coalesce("type_cd", fallback).cast("bigint")))
    return stations.select("line_cd", "station_cd", "e_sort").join(targets, "line_cd").select(
        "station_cd", "type_cd", (F.lit(VIRTUAL_GROUP_BASE) + F.col("line_cd")).cast("bigint").alias("line_group_cd"),
        F.lit(0).alias("pass"), "line_cd", "e_sort")


def virtual_local_services(net: Network) -> Network:
    """Append the generated patterns in (line, e_sort, station) order and renumber the rows."""
    present = {r[0] for r in net.types.where(F.col("type_cd").isin(DEFAULT_TYPE, LOCAL_TYPE))
               .select("type_cd").distinct().collect()}  # at most two rows
    missing = [t for t in (DEFAULT_TYPE, LOCAL_TYPE) if t not in present]
    if missing:
        raise ValueError(f"cannot generate local services: types lack {missing}")
    rows = C.materialize(virtual_local_rows(net), "virtual")
    clash = I.group_collisions(net.sst, rows)
    if not clash.isEmpty():
        raise ValueError("generated pattern codes already exist")
    existing = net.sst.select("station_cd", "type_cd", "line_group_cd", "pass", F.lit(0).alias("_src"),
                              F.col("id").alias("_a"), F.lit(0).cast("bigint").alias("_b"),
                              F.lit(0).cast("bigint").alias("_c"))
    added = rows.select("station_cd", "type_cd", "line_group_cd", "pass", F.lit(1).alias("_src"),
                        F.col("line_cd").alias("_a"), F.coalesce("e_sort", F.lit(0)).alias("_b"),
                        F.col("station_cd").alias("_c"))
    return net.with_tables(station_station_types=renumber_sst(existing.unionByName(added), ["_src", "_a", "_b", "_c"]),
                           bounds=None)


def renumber_sst(rows: DataFrame, order: list[str]) -> DataFrame:
    return C.assign_serial(rows, order, "id").select(*[c for c, _ in COLUMNS["station_station_types"]])


# -------------------------------------------------------------------------- feed integration

def routes_to_lines(routes: DataFrame, line_codes: DataFrame) -> DataFrame:
    """Feed routes of known operators as bus lines."""
    name = F.coalesce("route_short_name", "route_long_name", F.lit(""))
    color = F.coalesce(text.hash_prefixed_color(F.col("route_color")), F.lit(DEFAULT_BUS_COLOR))
    return (routes.withColumn("company_cd", codes.company_for_route(F.col("route_id")))
            .where("company_cd is not null").join(line_codes, "route_id")
            .select("line_cd", "company_cd", name.alias("line_name"), name.alias("line_name_k"),
                    name.alias("line_name_h"), F.coalesce("route_long_name", F.lit("")).alias("line_name_r"),
                    color.alias("line_color_c"), F.col("route_type").alias("line_type"), F.lit(0).alias("e_status"),
                    F.col("line_cd").alias("e_sort"), F.lit(0.0).alias("average_distance"),
                    F.lit(BUS).alias("transport_type"), "ord"))


def stops_on_routes(stops: DataFrame, order: DataFrame) -> DataFrame:
    """Physical stops paired with the routes visiting them."""
    return stops.where("parent_station is null").join(order.withColumnRenamed("parent", "stop_id"), "stop_id")


def stops_to_stations(pairs: DataFrame, groups: DataFrame, line_codes: DataFrame,
                      station_codes: DataFrame) -> DataFrame:
    """One station row per physical stop and route."""
    return (pairs.join(groups, "stop_id").join(line_codes, "route_id")
            .join(station_codes, ["stop_id", "route_id"])
            .select("station_cd", "station_g_cd", F.col("stop_name").alias("station_name"),
                    F.coalesce(text.hiragana_to_katakana(F.col("stop_name_k")), F.col("stop_name")).alias("station_name_k"),
                    F.col("stop_name_r").alias("station_name_r"),
                    text.strip_macrons(F.col("stop_name_r")).alias("station_name_rn"),
                    F.col("stop_name_zh").alias("station_name_zh"), F.col("stop_name_ko").alias("station_name_ko"),
                    "line_cd", F.lit(BUS_PREFECTURE).alias("pref_cd"), F.lit("").alias("post"), F.lit("").alias("address"),
                    F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"), F.lit("").alias("open_ymd"),
                    F.lit("").alias("close_ymd"), F.lit(0).alias("e_status"), F.col("stop_order").alias("e_sort"),
                    F.lit(BUS).alias("transport_type"), "ord"))


def known_routes(routes: DataFrame) -> DataFrame:
    """Routes of known operators with their place in the source."""
    return routes.where(codes.company_for_route(F.col("route_id")).isNotNull()).select("route_id", F.col("ord").alias("_o"))


def allocate_line_codes(routes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Routes of known operators in source order, then any other visited route by stop."""
    known = known_routes(routes).select("route_id", F.lit(0).alias("_src"), "_o")
    other = pairs.groupBy("route_id").agg(F.min("ord").alias("_o")).select("route_id", F.lit(1).alias("_src"), "_o")
    return codes.allocate(known.unionByName(other), "route_id", ["_src", "_o", "route_id"],
                          codes.LINE_CODES, "line_cd")


def patterns_to_types(patterns: DataFrame, type_codes: DataFrame) -> DataFrame:
    return patterns.join(type_codes, ["route_id", "shape_id"]).select(
        "route_id", "neg_count", "shape_id", "type_cd", "type_name", F.col("type_name").alias("type_name_k"),
        "type_name_r", F.lit("").alias("type_name_zh"), F.lit("").alias("type_name_ko"), "color", "direction",
        F.lit(BUS_KIND).alias("kind"), F.lit(0).alias("priority"))


def _code_table(pairs: DataFrame, key: str, expr, order: list[str], code_range, out: str) -> DataFrame:
    """Codes for a text built from several columns, joined back to those columns."""
    keyed = pairs.withColumn(key, expr)
    given = codes.allocate(keyed, key, order, code_range, out)
    return keyed.select(*pairs.columns, key).join(given, key).drop(key)


def _append(existing: DataFrame, added: DataFrame, table: str) -> DataFrame:
    """Existing rows win over added ones with the same key; of those the first in source order."""
    key = {"lines": "line_cd", "stations": "station_cd", "types": "type_cd"}[table]
    fresh = C.first_by(added, [key], [F.col("ord")]).join(existing.select(key), key, "left_anti")
    typed = dict(COLUMNS[table])
    return existing.unionByName(fresh.select(*[F.col(c).cast(typed[c]) for c in fresh.columns if c in typed]),
                                allowMissingColumns=True)


class _FeedParts:
    """What a cleaned feed adds to a network; each part is made once, when a table that needs it is first read.

    The lines need codes of known operators' routes only, which come first and are displaced by none; codes of stations need the stops
    a route visits, not their order.
    """

    _ORDERING = ["route_id", "neg_count", "shape_id"]

    def __init__(self, net: Network, feed: Feed, chunk: int) -> None:
        self.net, self.feed, self.chunk = net, feed, chunk

    @cached_property
    def visits(self) -> DataFrame:
        """Physical stops with the routes that visit them."""
        rows = trip_rows(self.feed.stop_times, self.feed.trips, self.feed.stops)
        return C.materialize(stops_on_routes(self.feed.stops, rows.select("route_id", "parent").distinct()), "stop-routes")

    @cached_property
    def station_codes(self) -> DataFrame:
        return C.materialize(_code_table(
            self.visits.select("stop_id", "route_id", "ord"), "_text", F.concat_ws("-", "stop_id", "route_id"),
            ["ord", "route_id"], codes.STATION_CODES, "station_cd").select("stop_id", "route_id", "station_cd"), "station-codes")

    @cached_property
    def patterns(self) -> DataFrame:
        return C.materialize(P.service_patterns(self.feed.stop_times, self.feed.trips, self.feed.stops, self.feed.routes), "named-patterns")

    def _pattern_codes(self, prefix: str, code_range: tuple[int, int], out: str) -> DataFrame:
        text = F.concat(F.lit(prefix), "route_id", F.lit("-"), "shape_id")
        given = _code_table(self.patterns.select(*self._ORDERING), "_text", text, self._ORDERING, code_range, out)
        return C.materialize(given.select("route_id", "shape_id", out), "pattern-codes")

    @cached_property
    def type_codes(self) -> DataFrame:
        return self._pattern_codes("type-", codes.TYPE_CODES, "type_cd")

    @cached_property
    def group_codes(self) -> DataFrame:
        return self._pattern_codes("lg-", codes.LINE_GROUP_CODES, "line_group_cd")

    def lines(self) -> DataFrame:
        given = codes.allocate(known_routes(self.feed.routes), "route_id", ["_o", "route_id"], codes.LINE_CODES, "line_cd")
        return _append(self.net.lines, routes_to_lines(self.feed.routes, given), "lines")

    def stations(self) -> DataFrame:
        feed = self.feed
        order = C.materialize(stop_route_order(feed.stop_times, feed.trips, feed.stops, self.chunk), "stop-order")
        line_codes = allocate_line_codes(feed.routes, self.visits)
        return _append(self.net.stations, stops_to_stations(stops_on_routes(feed.stops, order), stop_groups(feed.stops),
                                                            line_codes, self.station_codes), "stations")

    def types(self) -> DataFrame:
        new_types = patterns_to_types(self.patterns, self.type_codes)
        old_types = self.net.types.withColumns({"_src": F.lit(0), "_o": F.col("id"), "route_id": F.lit(""),
                                                "neg_count": F.lit(0).cast("bigint"), "shape_id": F.lit("")})
        fresh = new_types.join(self.net.types.select("type_cd"), "type_cd", "left_anti").withColumns(
            {"_src": F.lit(1), "_o": F.lit(0).cast("bigint"), "id": F.lit(None).cast("bigint")})
        both = old_types.unionByName(fresh, allowMissingColumns=True).drop("id")
        return C.assign_serial(both, ["_src", "_o", *self._ORDERING], "id").select(*[F.col(c).cast(t) for c, t in COLUMNS["types"]])

    def pattern_rows(self) -> DataFrame:
        stops = (P.pattern_stop_rows(self.patterns, self.feed.stop_times, self.feed.stops)
                 .join(self.type_codes, ["route_id", "shape_id"]).join(self.group_codes, ["route_id", "shape_id"])
                 .join(self.station_codes.withColumnRenamed("stop_id", "parent"), ["parent", "route_id"]))
        old = self.net.sst.select("station_cd", "type_cd", "line_group_cd", "pass", F.lit(0).alias("_src"), F.col("id").alias("_o"),
                                  F.lit("").alias("route_id"), F.lit(0).cast("bigint").alias("neg_count"), F.lit("").alias("shape_id"),
                                  F.lit("").alias("parent"))
        new = stops.select("station_cd", "type_cd", "line_group_cd", F.lit(0).alias("pass"), F.lit(1).alias("_src"),
                           F.col("seq").cast("bigint").alias("_o"), "route_id", "neg_count", "shape_id", "parent")
        return renumber_sst(old.unionByName(new), ["_src", "route_id", "neg_count", "shape_id", "_o", "parent"])


def integrate_feed(net: Network, feed: Feed, chunk: int = C.CHUNK) -> Network:
    """Add a cleaned feed's routes, stops and service patterns to the network; a table is made when it is first read."""
    parts = _FeedParts(net, feed, chunk)
    makers = {name: lambda _, name=name: getattr(net, name) for name in COLUMNS}
    makers |= {"lines": lambda _: parts.lines(), "stations": lambda _: parts.stations(), "types": lambda _: parts.types(),
               "station_station_types": lambda _: parts.pattern_rows()}
    return DeferredNetwork(makers, bounds=None, tree=None, names=None)


def build_snapshot(net: Network, feed: Feed | None = None, chunk: int = C.CHUNK) -> Network:
    """The whole build: local services, then the feed if buses are wanted."""
    out = virtual_local_services(net)
    if feed is None:
        return out
    cleaned = feed.cleaned().materialized()
    problems = I.snapshot_problems({}, cleaned.routes)
    if problems:
        raise ValueError("; ".join(problems))
    return integrate_feed(out, cleaned, chunk)
