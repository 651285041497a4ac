"""k nearest and within-radius joins over points on the globe.

Nearest points are found by descending a count-refined cell tree (``celltree``), which a snapshot keeps; pairs within a radius by an
equi-join on the grid cells of that size.  An exact distance test follows.  Requests and points at one coordinate are collapsed
first, so a crowded spot costs one row, not one per copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geo
from netloom.operators import celltree
from netloom.operators import common as C
from netloom.operators import lookup as L
from netloom.schema import BUS, RAIL, Network

BUS_STOP_RADIUS_M = 300.0
#: Stops a caller of ``bus_stops_near`` gets if it names no number. (fixed value)
BUS_CANDIDATES = 50
#: Kinds of points in a snapshot's tree beside rail and bus stations on a line: all active bus stops.
ANY_STOP = 2


def station_points(net: Network) -> DataFrame:
    """point_id, kind, lat, lon: active stations whose line exists by transport, and all active bus stops."""
    known = (L.active(net.stations).join(net.lines.select("line_cd"), "line_cd", "left_semi")
             .select(F.col("station_cd").alias("point_id"), F.col("transport_type").alias("kind"), "lat", "lon"))
    stops = (L.active(net.stations).where(F.col("transport_type") == BUS)
             .select(F.col("station_cd").alias("point_id"), F.lit(ANY_STOP).alias("kind"), "lat", "lon"))
    return known.unionByName(stops)


def with_tree(net: Network) -> Network:
    """The snapshot with its cell tree, which the nearest joins then share."""
    return net.with_tables(tree=celltree.build(station_points(net)))


def k_nearest(points: DataFrame, asks: DataFrame, cap: int, tree: celltree.CellTree | None = None) -> DataFrame:
    """The ``k`` nearest points per ask, ties broken by ``point_id``.

    ``points(point_id, kind, lat, lon)``, ``asks(ask_id, kind, qlat, qlon, k)`` with
    ``k <= cap``; only points of the ask's kind count.  Adds ``distance_km`` and ``rank``.  ``tree`` is the points' own, built here if
    none is given.
    """
    # At one coordinate all distances tie and ids decide, so `cap` copies are enough.
    here = C.top_by(points, ["kind", "lat", "lon"], ["point_id"], F.lit(cap), cap, "_copy")
    close = celltree.nearest_spots(tree or celltree.build(points), asks)
    # Points strictly nearer than a spot: where they are `k` or more it cannot contribute, else no more of its copies than are missing.
    upto = Window.partitionBy("ask_id").orderBy("distance_km").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy("ask_id", "distance_km")
    kept = (close.withColumn("_missing", F.col("k") - F.sum("copies").over(upto) + F.sum("copies").over(tied))
            .where("_missing > 0").drop("copies"))
    found = kept.join(here, ["kind", "lat", "lon"]).where(F.col("_copy") <= F.col("_missing")).drop("_copy", "_missing")
    return C.top_by(found, ["ask_id"], ["distance_km", "point_id"], F.col("k"), cap, "rank")


def stations_nearby(net: Network, req: DataFrame) -> DataFrame:
    """Nearest active stations whose line exists; rail before bus when unfiltered.

    ``req(req_id, lat, lon, limit?, transport?)``; limit defaults to 1 and is honoured whatever it is.
    ``rank`` orders a request's rows, ``distance`` is in metres.
    """
    points = station_points(net)

    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in req.columns else F.lit(default)

    spots = req.select("req_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"),
                       given("limit", 1).cast("bigint").alias("want"),
                       given("transport", "RailAndBus").alias("transport"))
    # Requests for one place and setting are answered once.
    keys = ["qlat", "qlon", "want", "transport"]
    rails = points.where(F.col("kind") == RAIL).agg(F.count(F.lit(1)).alias("rails"))  # one row

    def part(kind: int, k: Column, base: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), k.alias("k"), base.alias("base"))

    none = F.lit(0).cast("bigint")
    rail_part, bus_part = part(RAIL, F.col("want"), none), part(BUS, F.col("want"), none)
    rest = part(BUS, F.col("want") - F.col("rails"), F.col("rails"))
    asks = (spots.select(*keys).distinct().crossJoin(F.broadcast(rails))
            .withColumn("_part", F.explode(F.when(F.col("transport") == "Rail", F.array(rail_part))
                                           .when(F.col("transport") == "Bus", F.array(bus_part))
                                           .otherwise(F.array(rail_part, rest))))
            .select(*keys, "_part.*").where("k > 0")
            .withColumn("ask_id", F.struct(*keys, "kind", "base")))
    largest = spots.agg(F.max("want")).first()[0] or 1  # one number
    found = k_nearest(points, asks.select("ask_id", "kind", "qlat", "qlon", "k"), int(largest), net.tree)
    return (spots.join(found.select("ask_id.*", "point_id", "distance_km", "rank"), keys)
            .select("req_id", F.col("point_id").alias("station_cd"),
                    (F.col("rank") + F.col("base")).alias("rank"),
                    (F.col("distance_km") * 1000.0).alias("distance")))


def nearby_details(net: Network, nearby: DataFrame) -> DataFrame:
    """Wide rows for the stations found, with their first pattern."""
    wide = L.to_wide(net, net.stations, net.lines)
    return L._with_first_group(net, nearby.join(wide, "station_cd"))


def bus_stops_near(net: Network, coords: DataFrame, k: int = BUS_CANDIDATES) -> DataFrame:
    """The ``k`` nearest active bus stops per coordinate; stops of inactive lines are
    dropped after the cut, so fewer than ``k`` may remain.

    ``coords(source_g_cd, lat, lon)``; returns keys, stop station and ``rank``.
    """
    points = station_points(net).where(F.col("kind") == ANY_STOP)
    # One search per coordinate, however many groups share it.
    at = [F.col("lat").alias("qlat"), F.col("lon").alias("qlon")]
    asks = coords.select(*at).distinct().select(
        F.struct("qlat", "qlon").alias("ask_id"), F.lit(ANY_STOP).alias("kind"), "qlat", "qlon", F.lit(k).alias("k"))
    stops = (net.stations.select(F.col("station_cd").alias("point_id"), "line_cd", "station_g_cd")
             .join(L.active_lines(net).select("line_cd"), "line_cd", "left_semi"))
    found = (k_nearest(points, asks, k, net.tree).join(stops, "point_id")
             .select(F.col("ask_id.qlat").alias("_lat"), F.col("ask_id.qlon").alias("_lon"), F.col("point_id").alias("stop_cd"),
                     F.col("station_g_cd").alias("stop_g_cd"), F.col("line_cd").alias("stop_line_cd"),
                     "lat", "lon", "rank", "distance_km"))
    groups = coords.select("source_g_cd", *at)
    return (groups.join(found, F.col("qlat").eqNullSafe(F.col("_lat")) & F.col("qlon").eqNullSafe(F.col("_lon")))
            .drop("qlat", "qlon", "_lat", "_lon"))


def within_radius(left: DataFrame, right: DataFrame, radius_m: float,
                  level: int | None = None) -> DataFrame:
    """Pairs at most ``radius_m`` apart: ``left(qlat, qlon, ...)`` with ``right(lat, lon, ...)``.
    The cell is the finest one at least as wide as the circle's radius in latitude."""
    if level is None:
        level = next(lv for lv in range(24, 0, -1) if geo.cell_size(lv) * 111_000.0 >= radius_m)
    size, wrap = geo.cell_size(level), 1 << level
    lat_r = geo.lat_reach(F.lit(radius_m))
    lon_r = geo.lon_reach(F.col("qlat"), F.lit(radius_m))
    x0 = F.floor((F.col("qlon") - lon_r + 180.0) / size)
    x1 = F.least(F.floor((F.col("qlon") + lon_r + 180.0) / size), x0 + (wrap - 1))
    cells = (left.withColumn("_cy", F.explode(F.sequence(
        F.floor((F.col("qlat") - lat_r + 90.0) / size), F.floor((F.col("qlat") + lat_r + 90.0) / size))))
        .withColumn("_x", F.explode(F.sequence(x0, x1)))
        .withColumn("_cx", F.pmod(F.col("_x"), F.lit(wrap))).drop("_x"))
    keyed = right.withColumns({"_cx": geo.cell_x(F.col("lon"), level), "_cy": geo.cell_y(F.col("lat"), level)})
    return (cells.join(keyed, ["_cx", "_cy"])
            .withColumn("distance_m", geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")))
            .where(F.col("distance_m") <= radius_m).drop("_cx", "_cy"))
