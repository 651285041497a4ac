"""Writers: dataset snapshot, calibration tables, column updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.schema import COLUMNS, KEYS, Network


def write_snapshot(net: Network, folder: str, fmt: str = "parquet") -> None:
    """All tables in declared column order, sorted by their integer key.  The sort is a
    range partitioning, so files come out ordered without gathering a table in one task."""
    for table, cols in COLUMNS.items():
        df = getattr(net, table).select(*[c for c, _ in cols])
        ordered = df.orderBy(F.col(KEYS[table]).asc_nulls_first())
        if fmt == "csv":
            ordered.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, _ in cols]) \
                .write.option("header", True).option("emptyValue", "").option("escape", '"') \
                .csv(f"{folder}/{table}")
        else:
            ordered.write.parquet(f"{folder}/{table}")


def merge_calibration(old: DataFrame, new: DataFrame, recalculated: DataFrame, manual: DataFrame,
                      keys: list[str], scope: str = "line_cd") -> DataFrame:
    """Calibration table after a run: entries of recalculated ``scope`` values are replaced
    by the new ones, others stay, and keys present in the manual table are left out."""
    kept = old.join(recalculated.select(scope).distinct(), scope, "left_anti")
    merged = kept.unionByName(new.select(*old.columns))
    return merged.join(manual.select(*keys).distinct(), keys, "left_anti")


def update_column(table: DataFrame, changes: DataFrame, key: str, column: str,
                  differs: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``table`` with ``column`` taken from ``changes`` where present and different, and a
    one-row count of the changed rows."""
    joined = table.join(changes.select(key, F.col(column).alias("_new")), key, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column))
    if differs is not None:
        changed = changed & differs
    out = joined.withColumn(column, F.when(changed, F.col("_new")).otherwise(F.col(column))).select(*table.columns)
    return out, joined.agg(F.count(F.when(changed, 1)).alias("changed"))
