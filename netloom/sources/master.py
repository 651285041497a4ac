"""Master CSVs as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import common as C
from netloom.operators import integrity as I
from netloom.schema import COLUMNS, KEYS, Network

# File of each table. (fixed values)
FILES = {
    "companies": "1!companies.csv", "lines": "2!lines.csv", "stations": "3!stations.csv",
    "types": "4!types.csv", "station_station_types": "5!station_station_types.csv",
    "aliases": "6!aliases.csv", "line_aliases": "7!line_aliases.csv",
}
# Source position of a row: splits of a file in order, rows of a split as read.
SOURCE_ORDER = ["_file", "_block", "_row"]


def with_source_order(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_row"))


def drop_comment_columns(df: DataFrame) -> DataFrame:
    """Columns whose header starts with `#` are notes."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("#")])


def try_cast(c: Column, dtype: str) -> Column:
    """Lenient cast: trimmed, unparsable text is NULL."""
    return c if dtype == "string" else F.trim(c).try_cast(dtype)


def typed(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Declared columns in declared types; blank text and absent columns are NULL."""
    extra = [c for c in df.columns if c.startswith("_")]

    def one(name: str, dtype: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(dtype).alias(name)
        return try_cast(F.nullif(F.col(name), F.lit("")), dtype).alias(name)

    return df.select(*[one(n, t) for n, t in columns], *extra)


def fill_default(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def normalize_real(df: DataFrame, column: str) -> DataFrame:
    """Round to single precision."""
    return df.withColumn(column, F.col(column).cast("float").cast("double"))


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return typed(with_source_order(drop_comment_columns(raw)), COLUMNS[table])


def valid_stations(df: DataFrame) -> DataFrame:
    """Stations need readable codes and coordinates."""
    return df.where("station_cd is not null and station_g_cd is not null and lat is not null and lon is not null")


# Text columns that read as blank, not NULL, when empty. (fixed values)
BLANK_TEXT = {
    "companies": ["company_name", "company_name_k", "company_name_h", "company_name_r",
                  "company_name_en", "company_name_full_en"],
    "lines": ["line_name", "line_name_k", "line_name_h", "line_name_r", "line_name_zh", "line_name_ko"],
    "stations": ["station_name", "station_name_k", "post", "address", "open_ymd", "close_ymd"],
    "types": ["type_name", "type_name_k", "color"],
}
# Integer columns that default to zero. (fixed values)
ZERO = {
    "companies": ["rr_cd", "company_type", "e_status", "e_sort"],
    "lines": ["company_cd", "e_status", "e_sort", "transport_type"],
    "stations": ["line_cd", "pref_cd", "e_status", "e_sort", "transport_type"],
    "types": ["priority"],
}


def served(table: str, df: DataFrame) -> DataFrame:
    """A snapshot table as queries see it: defaults applied, keyless rows dropped."""
    for c in BLANK_TEXT.get(table, []):
        df = fill_default(df, c, "")
    for c in ZERO.get(table, []):
        df = fill_default(df, c, 0)
    return valid_stations(df) if table == "stations" else df.where(F.col(KEYS[table]).isNotNull())


def load_master(spark: SparkSession, folder: str) -> Network:
    """The seven master files as a network: first row per key, serial ids in file order."""
    frames = {}
    for table, file in FILES.items():
        df = read_csv(spark, f"{folder}/{file}", table)
        key = {"types": "type_cd"}.get(table, KEYS[table])
        if table == "station_station_types":
            df = C.assign_serial(df.drop("id"), SOURCE_ORDER, "id")
        else:
            df = I.dedup_first(df, [key], SOURCE_ORDER)
            if table == "types":
                df = C.assign_serial(df.drop("id"), SOURCE_ORDER, "id")
        if table in ("lines", "stations"):
            df = fill_default(df, "transport_type", 0)
        if table == "lines":
            df = normalize_real(df, "average_distance")
        frames[table] = df.select(*[c for c, _ in COLUMNS[table]])
    return Network(**frames)


def read_snapshot(spark: SparkSession, folder: str, fmt: str = "parquet") -> Network:
    """A written snapshot, ready for queries."""
    frames = {}
    for table, cols in COLUMNS.items():
        path = f"{folder}/{table}"
        raw = (spark.read.parquet(path) if fmt == "parquet"
               else spark.read.option("header", True).option("escape", '"').csv(path))
        frames[table] = served(table, typed(raw.select(*[F.col(c).cast("string") for c in raw.columns]), cols)
                               if fmt == "csv" else raw)
    return Network(**frames)


def line_name_rn(net: Network) -> DataFrame:
    """Search form of line names."""
    return net.lines.where("line_name_rn is not null").select("line_cd", "line_name_rn")
