"""Grouping of same-named stops that lie close together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import codes, geo
from netloom.operators import common as C

GROUP_RADIUS_M = 250.0


def _pairs_within(spots: DataFrame, radius: float) -> DataFrame:
    """Ordered pairs of same-named spots within ``radius``: ``later`` and ``earlier`` ids."""
    around = spots.select("name", F.col("stop_id").alias("later"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
                          F.explode(geo.ball_cells(F.col("lat"), F.col("lon"), radius, around=True)).alias("_cell"))
    here = spots.select("name", F.col("stop_id").alias("earlier"), "lat", "lon", geo.ball_cells(F.col("lat"), F.col("lon"), radius).alias("_cell"))
    return (around.join(here, ["name", "_cell"]).where("earlier < later")
            .withColumn("metres", geo.haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
            .where(F.col("metres") <= radius).select("later", "earlier", "metres"))


def stop_groups(stops: DataFrame) -> DataFrame:
    """(stop_id, station_g_cd) for physical stops: in stop order, a stop joins the oldest
    cluster all of whose members are within 250 m, else it starts one.  Stops other stops
    name as parent stay alone.

    A stop's choice depends only on earlier same-named stops within twice the radius, so in
    every round all stops whose such predecessors are settled are decided together.  Stops
    at one place always share a cluster and are handled as one spot.
    """
    parents = stops.where("parent_station is not null").select(F.col("parent_station").alias("stop_id")).distinct()
    physical = stops.where("parent_station is null")
    alone = physical.join(parents, "stop_id", "left_semi").select("stop_id", F.col("stop_id").alias("root"))
    rest = (physical.join(parents, "stop_id", "left_anti")
            .select("stop_id", F.trim("stop_name").alias("name"), F.col("stop_lat").alias("lat"),
                    F.col("stop_lon").alias("lon")))
    spots = C.materialize(rest.groupBy("name", "lat", "lon").agg(F.min("stop_id").alias("stop_id")), "spots")
    pairs = C.materialize(_pairs_within(spots, 2.0 * GROUP_RADIUS_M), "stop-pairs")
    close = pairs.where(F.col("metres") <= GROUP_RADIUS_M).select("later", "earlier")
    decided = C.materialize(spots.join(pairs.select(F.col("later").alias("stop_id")).distinct(), "stop_id", "left_anti")
                            .select("stop_id", F.col("stop_id").alias("root")), "clusters")
    waiting = C.materialize(spots.join(decided, "stop_id", "left_anti").select("stop_id"), "waiting")
    while not waiting.isEmpty():
        blocked = (pairs.join(waiting.withColumnRenamed("stop_id", "earlier"), "earlier", "left_semi")
                   .select(F.col("later").alias("stop_id")).distinct())
        ready = waiting.join(blocked, "stop_id", "left_anti")
        sizes = decided.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
        near = (ready.join(close.withColumnRenamed("later", "stop_id"), "stop_id")
                .join(decided.withColumnRenamed("stop_id", "earlier"), "earlier")
                .groupBy("stop_id", "root").agg(F.count(F.lit(1)).alias("near")))
        joined = (near.join(sizes, "root").where("near = members")
                  .groupBy("stop_id").agg(F.min("root").alias("root")))
        new = C.materialize(ready.join(joined, "stop_id", "left").select(
            "stop_id", F.coalesce("root", "stop_id").alias("root")), "clusters")
        decided = decided.unionByName(new)
        waiting = C.materialize(waiting.join(new, "stop_id", "left_anti"), "waiting")
    placed = (rest.join(spots.withColumnRenamed("stop_id", "spot"), ["name", "lat", "lon"])
              .join(decided.withColumnRenamed("stop_id", "spot"), "spot").select("stop_id", "root"))
    return placed.unionByName(alone).select(
        "stop_id", codes.fnv_code(F.col("root"), codes.STATION_GROUP_CODES).alias("station_g_cd"))
