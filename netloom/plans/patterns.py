"""Service patterns of feed routes: one per distinct stop set, named and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import common as C
from netloom.plans.stop_order import trip_rows

DEFAULT_TYPE_COLOR = "#000000"


def _filled(c: str) -> Column:
    return C.blank_to_null(F.col(c))


def trip_variations(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per (route, shape): its representative trip (smallest id), end stops, loop
    flag and the digest of its set of physical stops."""
    rows = trip_rows(stop_times, trips, stops)
    timed = trips.join(stop_times.select("trip_id").distinct(), "trip_id", "left_semi").where("shape_id is not null")
    rep = (timed.join(routes.select("route_id"), "route_id", "left_semi").groupBy("route_id", "shape_id")
           .agg(F.min_by(F.struct("trip_id", "direction_id", "trip_headsign"), F.col("trip_id")).alias("t"))
           .select("route_id", "shape_id", "t.*"))
    mine = rows.join(rep.select("trip_id"), "trip_id", "left_semi")
    at = F.struct("stop_id", "parent")
    ends = mine.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("stop_count"), F.min_by(at, F.col("stop_sequence")).alias("first"),
        F.max_by(at, F.col("stop_sequence")).alias("last"))
    sets = mine.select("trip_id", "parent").distinct().groupBy("trip_id").agg(*C.set_digest(F.col("parent")))
    names = stops.select("stop_id", "stop_name", "stop_name_r")

    def named(prefix: str) -> DataFrame:
        return names.select(F.col("stop_id").alias(f"{prefix}_stop_id"), F.col("stop_name").alias(f"{prefix}_stop_name"),
                            F.col("stop_name_r").alias(f"{prefix}_stop_name_r"))

    return (rep.join(ends, "trip_id").join(sets, "trip_id")
            .withColumns({"first_stop_id": F.col("first.stop_id"), "last_stop_id": F.col("last.stop_id"),
                          "is_loop": F.col("first.parent") == F.col("last.parent")})
            .drop("first", "last").join(named("first"), "first_stop_id", "left").join(named("last"), "last_stop_id", "left")
            .join(routes.select("route_id", "route_short_name", "route_long_name", "route_long_name_r", "route_color"),
                  "route_id"))


def collapse_variations(variations: DataFrame) -> DataFrame:
    """The longest shape of every stop set per route; sets seen on several shapes run both ways."""
    keys = ["route_id", *C.SET_DIGEST]
    counted = variations.groupBy(*keys).agg(F.count(F.lit(1)).alias("shapes"))
    first = C.first_by(variations, keys, [F.col("stop_count").desc(), F.col("shape_id")])
    return (first.join(counted, keys).withColumn("both_ways", F.col("shapes") > 1)
            .withColumn("direction", F.when(F.col("both_ways"), 0).otherwise(F.coalesce("direction_id", F.lit(0)))))


def headsign() -> Column:
    return F.coalesce(*[_filled(c) for c in ("trip_headsign", "route_long_name", "route_short_name", "first_stop_name")])


def via_stops(patterns: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """The stop that tells a loop from its siblings of the same headsign: one they do not
    serve, nearest the middle of the loop, else the middle stop; none if it equals the
    headsign or the loop has fewer than three stops."""
    loops = patterns.where("is_loop").withColumn("sign", headsign()).where("sign is not null").select(
        "route_id", "shape_id", "trip_id", "sign")
    served = (loops.join(stop_times, "trip_id")
              .join(stops.select("stop_id", F.coalesce("parent_station", "stop_id").alias("parent"),
                                 "stop_name", "stop_name_r"), "stop_id")
              .groupBy("route_id", "shape_id", "sign", "parent")
              .agg(F.min_by(F.struct("stop_sequence", "stop_name", "stop_name_r"), F.col("stop_sequence")).alias("s"))
              .select("route_id", "shape_id", "sign", "parent", "s.*"))
    # Position among the loop's distinct stops, without sorting a loop in one task.
    numbered = C.assign_serial(served, ["route_id", "shape_id", "stop_sequence", "parent"], "_n")
    size = numbered.groupBy("route_id", "shape_id").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("size"))
    shared = numbered.groupBy("route_id", "sign", "parent").agg(F.count(F.lit(1)).alias("siblings"))
    placed = (numbered.join(size.where("size >= 3"), ["route_id", "shape_id"])
              .join(shared, ["route_id", "sign", "parent"])
              .withColumn("pos", F.col("_n") - F.col("_first")))
    middle = F.floor(F.col("size") / 2)
    away = F.abs(F.col("pos") - middle)
    # Unshared stops win by closeness to the middle; without any, the middle stop itself does.
    rank = F.struct(F.when(F.col("siblings") == 1, 0).otherwise(1), away, F.col("pos"))
    best = (placed.groupBy("route_id", "shape_id", "sign")
            .agg(F.min_by(F.struct("stop_name", "stop_name_r"), rank).alias("v")))
    return (best.where(F.col("v.stop_name") != F.col("sign"))
            .select("route_id", "shape_id", F.col("v.stop_name").alias("via_name"),
                    C.blank_to_null(F.col("v.stop_name_r")).alias("via_name_r")))


def type_name() -> Column:
    head = F.coalesce(_filled("trip_headsign"), _filled("route_long_name"), _filled("route_short_name"))
    first = _filled("first_stop_name")
    label = F.coalesce(head, first)
    loop = F.when(F.col("via_name").isNotNull(), F.concat(label, F.lit("（"), F.col("via_name"), F.lit("経由・循環）"))) \
        .otherwise(F.concat(label, F.lit(" (循環)")))
    arrow = F.when(F.col("both_ways"), F.lit(" ⇔ ")).otherwise(F.lit(" → "))
    return F.coalesce(
        F.when(F.col("is_loop"), loop),
        F.when(first != head, F.concat(first, arrow, head)),
        head, first, F.concat(F.lit("shape "), F.col("shape_id")))


def type_name_roman() -> Column:
    """The romanised name, or NULL when a needed part has no romanisation."""
    sign, last_r, first_r = _filled("trip_headsign"), _filled("last_stop_name_r"), _filled("first_stop_name_r")
    to_last = (sign == F.col("last_stop_name")) & last_r.isNotNull()
    head = (F.when(F.coalesce(to_last, F.lit(False)), last_r)
            .when(F.col("is_loop") & sign.isNotNull(), first_r)
            .when(sign.isNull() & F.col("route_long_name").isNotNull(), _filled("route_long_name_r")))
    label = F.coalesce(head, first_r)
    loop = (F.when(F.col("via_name").isNull(), F.concat(label, F.lit(" (Loop)")))
            .when(F.col("via_name_r").isNotNull(), F.concat(label, F.lit(" via "), F.col("via_name_r"), F.lit(" (Loop)"))))
    arrow = F.when(F.col("both_ways"), F.lit(" ⇔ ")).otherwise(F.lit(" → "))
    straight = F.coalesce(F.when(first_r != head, F.concat(first_r, arrow, head)), head, first_r)
    return F.when(F.col("is_loop"), loop).otherwise(straight)


def disambiguate(patterns: DataFrame) -> DataFrame:
    """Second and later patterns of one name per route carry their stop count."""
    rank = F.struct(-F.col("stop_count"), F.col("shape_id"))
    firsts = patterns.groupBy("route_id", "base_name").agg(F.min(rank).alias("_first"))
    joined = patterns.join(firsts, ["route_id", "base_name"])
    again = rank != F.col("_first")
    count = F.col("stop_count").cast("string")
    return joined.withColumns({
        "type_name": F.when(again, F.concat("base_name", F.lit(" ("), count, F.lit("停)"))).otherwise(F.col("base_name")),
        "type_name_r": F.coalesce(F.when(again, F.concat("base_name_r", F.lit(" ("), count, F.lit(" stops)")))
                                  .otherwise(F.col("base_name_r")), F.lit(""))}).drop("_first")


def service_patterns(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Named patterns of all routes; their order is (route_id, stop_count desc, shape_id)."""
    patterns = C.materialize(collapse_variations(trip_variations(stop_times, trips, stops, routes)), "patterns")
    via = via_stops(patterns, stop_times, stops)
    named = patterns.join(via, ["route_id", "shape_id"], "left").withColumns(
        {"base_name": type_name(), "base_name_r": type_name_roman()})
    out = disambiguate(named).withColumn("neg_count", -F.col("stop_count"))
    color = F.when(F.col("route_color").startswith("#"), F.col("route_color")).otherwise(
        F.concat(F.lit("#"), F.col("route_color")))
    return out.withColumn("color", F.coalesce(color, F.lit(DEFAULT_TYPE_COLOR)))


def pattern_stop_rows(patterns: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Each pattern's physical stops once, at their first sequence."""
    rows = (patterns.select("route_id", "shape_id", "neg_count", "trip_id").join(stop_times, "trip_id")
            .join(stops.select("stop_id", F.coalesce("parent_station", "stop_id").alias("parent")), "stop_id"))
    return rows.groupBy("route_id", "shape_id", "neg_count", "parent").agg(F.min("stop_sequence").alias("seq"))
