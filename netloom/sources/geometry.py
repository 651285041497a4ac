"""Track geometry landed as JSON: relations with their ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("elements array<struct<type: string, id: bigint, tags: map<string,string>, members: array<struct<"
          "type: string, ref: bigint, role: string, geometry: array<struct<lat: double, lon: double>>>>>>")


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """One row per vertex: (relation_id, name, way_ord, vertex_ord, lat, lon)."""
    elements = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    return explode_ways(elements.where("e.type = 'relation'").select(
        F.col("e.id").alias("relation_id"), F.coalesce(F.col("e.tags")["name"], F.lit("")).alias("name"),
        F.col("e.members").alias("members")))


def explode_ways(relations: DataFrame) -> DataFrame:
    ways = relations.select("relation_id", "name", F.posexplode("members").alias("way_ord", "m")).where(
        "m.type = 'way' and m.geometry is not null")
    return ways.select("relation_id", "name", "way_ord", F.posexplode("m.geometry").alias("vertex_ord", "v")).select(
        "relation_id", "name", "way_ord", "vertex_ord", "v.lat", "v.lon")
