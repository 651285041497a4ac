"""Order of physical stops along a route from its trips.

The main trip gives integer positions; stops that only variants visit are placed between
their neighbours, following chains of variant-only stops to the nearest main stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import common as C


def parent_stops(stops: DataFrame) -> DataFrame:
    """Physical stop of every stop: its parent, or itself."""
    return stops.select("stop_id", F.coalesce("parent_station", "stop_id").alias("parent"))


def trip_rows(stop_times: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    return (stop_times.join(trips.select("trip_id", "route_id", "direction_id", "shape_id"), "trip_id")
            .join(parent_stops(stops), "stop_id"))


def shape_stats(rows: DataFrame) -> DataFrame:
    """Distinct stops and longest distance per (route, shape, direction)."""
    return (rows.where("shape_id is not null").groupBy("route_id", "shape_id", "direction_id")
            .agg(F.countDistinct("stop_id").alias("stops"), F.max("shape_dist_traveled").alias("dist")))


def trip_stats(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("route_id", "trip_id", "shape_id", "direction_id")
            .agg(F.countDistinct("stop_id").alias("stops"), F.max("shape_dist_traveled").alias("dist"),
                 F.count(F.lit(1)).alias("rows")))


def canonical_shape(shapes: DataFrame) -> DataFrame:
    """The fullest shape per route: stops, then distance, outbound before unknown before
    inbound, then name."""
    rank = F.when(F.col("direction_id") == 0, 0).when(F.col("direction_id").isNull(), 1).otherwise(2)
    return C.first_by(shapes, ["route_id"], [
        F.col("stops").desc(), F.col("dist").desc_nulls_last(), rank, F.col("shape_id")]).select(
        "route_id", F.col("shape_id").alias("canonical_shape_id"))


def main_trip(trips: DataFrame, canonical: DataFrame) -> DataFrame:
    joined = trips.join(canonical, "route_id", "left")
    off_shape = (~F.coalesce(F.col("shape_id") == F.col("canonical_shape_id"), F.lit(False))).cast("int")
    not_outbound = (~F.col("direction_id").eqNullSafe(F.lit(0))).cast("int")
    return C.first_by(joined, ["route_id"], [
        off_shape, not_outbound, F.col("stops").desc(), F.col("dist").desc_nulls_last(),
        F.col("rows").desc(), F.col("trip_id")]).select(
        "route_id", F.col("trip_id").alias("main_trip_id"), F.col("direction_id").alias("main_direction"))


def main_stops(rows: DataFrame, mains: DataFrame) -> DataFrame:
    """First sequence of each physical stop on the main trip."""
    return (rows.join(mains.select("route_id", "main_trip_id"), "route_id")
            .where("trip_id = main_trip_id").groupBy("route_id", "parent")
            .agg(F.min("stop_sequence").alias("seq")))


def neighbours(rows: DataFrame, bound: int | None = None, chunk: int = C.CHUNK) -> DataFrame:
    """Previous and next physical stop along each trip."""
    rows = C.lag_in_group(rows, ["trip_id"], "stop_sequence", {"prev": "parent"}, bound, chunk)
    rows = rows.withColumn("_neg", -F.col("stop_sequence"))
    return C.lag_in_group(rows, ["trip_id"], "_neg", {"next": "parent"}, bound, chunk).drop("_neg")


def variant_only(rows: DataFrame, mains: DataFrame, on_main: DataFrame, bound: int | None = None,
                 chunk: int = C.CHUNK) -> DataFrame:
    """Stops no main trip visits, each with its best context: main stops on both sides,
    then on one, then none; earlier in the trip; smaller trip id."""
    seen = on_main.select("route_id", "parent", F.col("seq"))
    around = (neighbours(rows, bound, chunk)
              .join(mains.select("route_id", F.col("main_trip_id").alias("trip_id")), ["route_id", "trip_id"], "left_anti")
              .join(seen, ["route_id", "parent"], "left_anti")
              .join(seen.withColumnsRenamed({"parent": "prev", "seq": "prev_seq"}), ["route_id", "prev"], "left")
              .join(seen.withColumnsRenamed({"parent": "next", "seq": "next_seq"}), ["route_id", "next"], "left"))
    missing = F.col("prev_seq").isNull().cast("int") + F.col("next_seq").isNull().cast("int")
    return C.first_by(around, ["route_id", "parent"], [missing, F.col("stop_sequence"), F.col("trip_id")]).select(
        "route_id", "parent", "direction_id", "prev", "next", "prev_seq", "next_seq")


def resolve_chains(variants: DataFrame, on_main: DataFrame) -> DataFrame:
    """Nearest main stop behind and ahead of every variant-only stop and the number of hops.

    Pointers are doubled: after r rounds a pointer spans 2**r hops, so chains of length n
    need log2(n) joins.  Pointers still open after that lie on a cycle and stay unresolved.
    """
    main = on_main.select("route_id", F.col("parent").alias("to"), F.col("seq"))
    links = (variants.select("route_id", "parent", F.lit("prev").alias("side"), F.col("prev").alias("to"))
             .unionByName(variants.select("route_id", "parent", F.lit("next").alias("side"), F.col("next").alias("to")))
             .where("to is not null").join(main, ["route_id", "to"], "left")
             .withColumn("depth", F.lit(1).cast("bigint")))
    links = C.materialize(links.select("route_id", "side", "parent", "to", "seq", "depth"), "chains")
    longest = C.largest_group(variants, ["route_id"])
    span = 1
    while span < longest + 1:
        ahead = links.select("route_id", "side", F.col("parent").alias("to"), F.col("to").alias("_to"),
                             F.col("seq").alias("_seq"), F.col("depth").alias("_depth"))
        joined = links.join(ahead, ["route_id", "side", "to"], "left")
        is_open = F.col("seq").isNull()
        # An open pointer whose target has no pointer of its own ends nowhere.
        links = C.materialize(joined.select(
            "route_id", "side", "parent",
            F.when(is_open, F.col("_to")).otherwise(F.col("to")).alias("to"),
            F.when(is_open, F.col("_seq")).otherwise(F.col("seq")).alias("seq"),
            F.when(is_open, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth")), "chains")
        span *= 2
    found = links.where("seq is not null")

    def side(name: str) -> DataFrame:
        return found.where(F.col("side") == name).select(
            "route_id", "parent", F.col("seq").alias(f"chain_{name}"), F.col("depth").alias(f"depth_{name}"))

    return (variants.join(side("prev"), ["route_id", "parent"], "left")
            .join(side("next"), ["route_id", "parent"], "left"))


def estimated_position(max_seq: Column) -> Column:
    """Position of a variant-only stop relative to the main trip's sequence numbers."""
    half, sign = 0.5, F.when(F.col("same_direction"), 1.0).otherwise(-1.0)
    prev, nxt = F.col("prev_seq").cast("double"), F.col("next_seq").cast("double")
    cprev, cnext = F.col("chain_prev").cast("double"), F.col("chain_next").cast("double")
    dprev, dnext = F.col("depth_prev"), F.col("depth_next")
    both = F.col("prev_seq").isNotNull() & F.col("next_seq").isNotNull()
    both_chains = F.col("chain_prev").isNotNull() & F.col("chain_next").isNotNull()
    at_end, at_start = max_seq + half, F.lit(half)
    return (F.when(both, (prev + nxt) / 2.0)
            .when(prev.isNotNull(), prev + sign * half)
            .when(nxt.isNotNull(), nxt - sign * half)
            .when(both_chains, (cprev + cnext) / 2.0 + (dprev - dnext) * 0.01)
            .when(cprev.isNotNull(), cprev + sign * (dprev * 0.1))
            .when(cnext.isNotNull(), cnext - sign * (dnext * 0.1))
            .when(F.col("next").isNull(), F.when(F.col("same_direction"), at_end).otherwise(at_start))
            .when(F.col("prev").isNull(), F.when(F.col("same_direction"), at_start).otherwise(at_end))
            .otherwise(max_seq + 9999.0))


def renumber(positions: DataFrame) -> DataFrame:
    """Positions per route as 1..n by (estimate, stop): one global numbering, then each
    route's smallest number is subtracted, so a long route is not sorted in one task."""
    numbered = C.assign_serial(positions, ["route_id", "position", "parent"], "_n")
    first = numbered.groupBy("route_id").agg(F.min("_n").alias("_first"))
    return numbered.join(first, "route_id").select(
        "route_id", "parent", (F.col("_n") - F.col("_first") + 1).alias("stop_order"))


def stop_route_positions(stop_times: DataFrame, trips: DataFrame, stops: DataFrame,
                         chunk: int = C.CHUNK) -> DataFrame:
    """(route_id, parent, position) for every physical stop a route visits."""
    rows = C.materialize(trip_rows(stop_times, trips, stops), "trip-rows")
    bound = C.largest_group(stop_times, ["trip_id"])
    mains = C.materialize(main_trip(trip_stats(rows), canonical_shape(shape_stats(rows))), "main-trips")
    on_main = C.materialize(main_stops(rows, mains), "main-stops")
    ends = on_main.groupBy("route_id").agg(F.max("seq").cast("double").alias("max_seq"))
    variants = resolve_chains(C.materialize(variant_only(rows, mains, on_main, bound, chunk), "variants"), on_main)
    same = F.col("direction_id").isNull() | F.coalesce(
        F.col("direction_id") == F.col("main_direction"), F.lit(False))
    placed = (variants.join(mains, "route_id").join(ends, "route_id").withColumn("same_direction", same)
              .select("route_id", "parent", estimated_position(F.col("max_seq")).alias("position")))
    return on_main.select("route_id", "parent", F.col("seq").cast("double").alias("position")).unionByName(placed)


def stop_route_order(stop_times: DataFrame, trips: DataFrame, stops: DataFrame,
                     chunk: int = C.CHUNK) -> DataFrame:
    """(route_id, parent, stop_order): the stop order of every route."""
    return renumber(stop_route_positions(stop_times, trips, stops, chunk))
