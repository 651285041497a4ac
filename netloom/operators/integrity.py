"""Constraints and quality checks on network and feed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import common as C
from netloom.schema import COLUMNS, Network


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: the first row per key in source order stays."""
    return C.first_by(df, keys, [F.col(c) for c in order])


def fk_semi(df: DataFrame, ref: DataFrame, key: str, ref_key: str | None = None) -> DataFrame:
    """Rows whose foreign key exists."""
    keys = ref.select(F.col(ref_key or key).alias(key)).distinct()
    return df.join(keys, key, "left_semi")


def drop_dangling_parents(stops: DataFrame) -> DataFrame:
    """Parents that are not stops themselves become NULL."""
    known = stops.select(F.col("stop_id").alias("_parent")).distinct()
    return (stops.join(known, F.col("parent_station") == F.col("_parent"), "left")
            .withColumn("parent_station", F.when(F.col("_parent").isNotNull(), F.col("parent_station")))
            .drop("_parent"))


def serial_gaps(df: DataFrame, column: str = "id") -> DataFrame:
    """One row describing a serial column; ``gap_free`` tells whether it is exactly 1..n."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.min(column), F.lit(1)).alias("lowest"),
                  F.coalesce(F.max(column), F.lit(0)).alias("highest"),
                  F.countDistinct(column).alias("distinct_ids")).withColumn(
        "gap_free", (F.col("lowest") == 1) & (F.col("highest") == F.col("rows"))
        & (F.col("distinct_ids") == F.col("rows")))


# Columns a snapshot cannot do without. (fixed values)
REQUIRED = {
    "companies": ["company_cd", "company_name", "company_name_k"],
    "lines": ["line_cd", "line_name", "line_name_k", "line_name_h"],
    "stations": ["station_cd", "station_g_cd", "lat", "lon", "station_name", "station_name_k"],
    "aliases": ["id"], "line_aliases": ["station_cd", "alias_cd"],
}


def snapshot_problems(tables: dict[str, DataFrame], feed_routes: DataFrame | None = None) -> list[str]:
    """What makes a snapshot unusable: tables missing while others exist, missing required
    columns, or a feed build without a single route."""
    problems = []
    missing = [t for t in COLUMNS if t not in tables]
    if tables and missing:
        problems.append(f"missing tables: {', '.join(missing)}")
    for table, columns in REQUIRED.items():
        if table in tables:
            problems += [f"{table} lacks {c}" for c in columns if c not in tables[table].columns]
    if feed_routes is not None and feed_routes.isEmpty():
        problems.append("no feed route was read")
    return problems


def snapshot_counts(net: Network) -> DataFrame:
    """Rows per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
             for name, df in net.tables().items()]
    return reduce(DataFrame.unionByName, parts)


def validate_fk(net: Network, raw_sst: DataFrame | None = None) -> DataFrame:
    """Violations of the stop-pattern table: codes that do not parse, unknown stations and
    unknown types.  ``raw_sst`` holds the codes as text; by default the typed table is used."""
    sst = net.sst if raw_sst is None else raw_sst
    parsed = sst.select("id", F.expr("try_cast(station_cd AS bigint)").alias("station_cd"),
                        F.expr("try_cast(type_cd AS bigint)").alias("type_cd"))

    def found(rows: DataFrame, problem: str, code: Column) -> DataFrame:
        return rows.select("id", F.lit(problem).alias("problem"), code.alias("code"))

    no_station = parsed.where("station_cd is null")
    no_type = parsed.where("station_cd is not null and type_cd is null")
    good = parsed.where("station_cd is not null and type_cd is not null")
    return (found(no_station, "unparsable station_cd", F.lit(None).cast("bigint"))
            .unionByName(found(no_type, "unparsable type_cd", F.lit(None).cast("bigint")))
            .unionByName(found(good.join(net.stations, "station_cd", "left_anti"),
                               "unknown station_cd", F.col("station_cd")))
            .unionByName(found(good.join(net.types, "type_cd", "left_anti"),
                               "unknown type_cd", F.col("type_cd"))))


# Runs of stations that must be neighbours on their line. (fixed values)
EXPECTED_RUNS = [(99301, [9930100, 9930102]), (99301, [9930128, 9930101, 9930129])]


def validate_order(stations: DataFrame, expected: DataFrame, bound: int | None = None,
                   chunk: int = C.CHUNK) -> DataFrame:
    """Expected runs that are not adjacent among a line's active stations, in the order
    (e_sort, station_cd).  ``expected(run_id, line_cd, station_cds)``.

    Adjacency needs no numbering of whole lines: each expected station is followed to its
    successor, which is found for the run's lines only.
    """
    members = expected.select("run_id", "line_cd", F.posexplode("station_cds").alias("i", "station_cd"))
    lines = expected.select("line_cd").distinct()
    rows = stations.where("e_status = 0").join(lines, "line_cd", "left_semi").select(
        "line_cd", "station_cd", "e_sort")
    ordered = C.assign_serial(rows, ["line_cd", "e_sort", "station_cd"], "at").select(
        "line_cd", "station_cd", "at")
    placed = members.join(ordered, ["line_cd", "station_cd"], "left")
    start = F.max(F.when(F.col("i") == 0, F.col("at")))
    report = placed.groupBy("run_id", "line_cd").agg(
        start.alias("start"), F.min(F.col("at") - F.col("i")).alias("lo"),
        F.max(F.col("at") - F.col("i")).alias("hi"), F.count("at").alias("found"),
        F.count(F.lit(1)).alias("length"))
    return report.where("start is null or found < length or lo <> start or hi <> start").select(
        "run_id", "line_cd", F.when(F.col("start").isNull(), "first station missing")
        .otherwise("stations are not consecutive").alias("problem"))


def group_collisions(sst: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated pattern codes that already exist."""
    return generated.select("line_group_cd").distinct().join(
        sst.select("line_group_cd").distinct(), "line_group_cd", "left_semi")
