"""Bus timetables published as JSON arrays, turned into feed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import kana, text
from netloom.operators import common as C
from netloom.plans.build import Feed
from netloom.sources.master import SOURCE_ORDER, with_source_order

# Fixed values of the timetable source.
OPERATOR = "odpt.Operator:TokyuBus"
PREFIX = "tokyu_json"
ROUTE_COLOR = "DD1133"
ROUTE_TYPE = 3
COMMUNITY_ROUTES = ["TokyuBus.Tamachan", "TokyuBus.Shinabasu", "TokyuBus.Sanma"]

_COMMON = "`owl:sameAs` string, `dc:title` string, `odpt:operator` string"
PATTERN = _COMMON + ", `odpt:busroute` string, `odpt:direction` string"
POLE = _COMMON + ", `odpt:kana` string, `geo:lat` double, `geo:long` double"
TIMETABLE = (_COMMON + ", `odpt:busroutePattern` string, `odpt:busTimetableObject` array<struct<"
             "`odpt:index`: int, `odpt:busstopPole`: string, `odpt:arrivalTime`: string,"
             "`odpt:departureTime`: string, `odpt:destinationSign`: string>>")


def read_odpt(spark: SparkSession, path: str, schema: str, operator: str = OPERATOR,
              lines: bool = False) -> DataFrame:
    """Records of one operator.  The operator field is text or an array; read as text, an
    array keeps its JSON form.  A large file is best landed as JSON lines, which split."""
    raw = with_source_order(spark.read.schema(schema).option("multiLine", not lines).json(path))
    return raw.where(has_operator(F.col("odpt:operator"), operator))


def has_operator(field: Column, operator: str) -> Column:
    many = F.from_json(field, "array<string>")
    return F.when(field.startswith("["), F.array_contains(many, operator)).otherwise(field == operator)


def strip_prefix(c: Column) -> Column:
    """The part after the first colon."""
    return F.when(c.contains(":"), F.regexp_replace(c, "^[^:]*:", "")).otherwise(c)


def scoped(c: Column) -> Column:
    return F.concat(F.lit(f"{PREFIX}:"), strip_prefix(c))


def direction_id(c: Column) -> Column:
    return F.when(c == "1", 0).when(c == "2", 1)


def route_name(title: Column) -> Column:
    """First word of the title."""
    word = F.regexp_extract(title, r"^\s*(\S+)", 1)
    return F.when(word == "", title).otherwise(word)


def is_community_route(route: Column) -> Column:
    return strip_prefix(route).isin(COMMUNITY_ROUTES)


def _numbered(df: DataFrame) -> DataFrame:
    return C.assign_serial(df, SOURCE_ORDER, "ord").drop(*SOURCE_ORDER)


def odpt_to_gtfs(patterns: DataFrame, poles: DataFrame, timetables: DataFrame) -> Feed:
    """Feed tables from patterns, poles and timetables (rows of one operator, with source
    order): a timetable is a trip of its pattern's route, its objects are the stop times."""
    p = (_numbered(patterns).where(~is_community_route(F.col("odpt:busroute")))
         .select(scoped(F.col("owl:sameAs")).alias("pattern_id"), scoped(F.col("odpt:busroute")).alias("route_id"),
                 direction_id(F.col("odpt:direction")).alias("direction_id"),
                 route_name(F.coalesce("dc:title", F.lit(""))).alias("name"), "ord"))
    routes = p.select("route_id", F.col("name").alias("route_short_name"), F.col("name").alias("route_long_name"),
                      F.lit(None).cast("string").alias("route_long_name_r"), F.lit(ROUTE_TYPE).alias("route_type"),
                      F.lit(ROUTE_COLOR).alias("route_color"), "ord")
    reading = text.hiragana_to_katakana(F.coalesce("odpt:kana", F.lit("")))
    stops = _numbered(poles).select(
        scoped(F.col("owl:sameAs")).alias("stop_id"), F.coalesce("dc:title", F.lit("")).alias("stop_name"),
        reading.alias("stop_name_k"), kana.romaji_display_name(reading).alias("stop_name_r"),
        F.lit(None).cast("string").alias("stop_name_zh"), F.lit(None).cast("string").alias("stop_name_ko"),
        F.coalesce("geo:lat", F.lit(0.0)).alias("stop_lat"), F.coalesce("geo:long", F.lit(0.0)).alias("stop_lon"),
        F.lit(None).cast("string").alias("parent_station"), "ord")
    # A pattern listed twice counts as its last entry.
    by_pattern = p.groupBy("pattern_id").agg(F.max_by(F.struct("route_id", "direction_id"), F.col("ord")).alias("r"))
    t = C.materialize(_numbered(timetables).select(
        scoped(F.col("owl:sameAs")).alias("trip_id"), scoped(F.col("odpt:busroutePattern")).alias("pattern_id"),
        F.col("odpt:busTimetableObject").alias("objects"), "ord").join(by_pattern, "pattern_id"), "timetables")
    signs = F.filter(F.transform("objects", lambda o: o["odpt:destinationSign"]), lambda s: s.isNotNull())
    trips = t.select("trip_id", "r.route_id", F.get(signs, F.lit(0)).alias("trip_headsign"), "r.direction_id",
                     F.col("pattern_id").alias("shape_id"), "ord")
    o = t.select("trip_id", F.col("ord").alias("_trip"), F.posexplode("objects").alias("_i", "o"))
    arrival, departure = F.col("o.`odpt:arrivalTime`"), F.col("o.`odpt:departureTime`")
    readable = (text.clock_time(F.coalesce(arrival, departure)).isNotNull()
                | text.clock_time(F.coalesce(departure, arrival)).isNotNull())
    times = o.where(readable).select(
        "trip_id", scoped(F.col("o.`odpt:busstopPole`")).alias("stop_id"), F.col("o.`odpt:index`").alias("stop_sequence"),
        F.lit(None).cast("double").alias("shape_dist_traveled"), "_trip", "_i")
    times = C.assign_serial(times, ["_trip", "_i"], "ord").drop("_trip", "_i")
    return Feed(routes, stops, trips, times)
