"""Shared building blocks: ranked picks, skew-safe sequences, serial ids, durable cuts.

A window over one group is sorted inside one task.  Groups here (a stop pattern, a
line, a request) can in principle hold a large share of all rows, so the sequence
helpers work on chunks whenever the longest group is unknown or exceeds ``CHUNK``.  Chunks are ranges of
rows in (group, position) order, cut by rank, so sparse positions make no small ones; chunk summaries carry the state
across chunk borders, and only groups that cross a border have any.  That path reads its input twice, so it
writes the input first: chained steps then stay linear in cost.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20


# ---------------------------------------------------------------- session and durability

def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on (all are runtime SQL settings)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Sizes of compressed files stand for their rows in memory: by file size alone, a few columns of a large table count as small
    # and go whole through the driver. Joins planned as shuffled still become broadcasts where the measured rows are few.
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "16")
    # Lets `row_number() <= k` prune to k rows per key before the shuffle, up to the
    # largest per-request limit in the library.
    spark.conf.set("spark.sql.window.group.limit.threshold", "10000")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def durable_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: the session's spark.checkpoint.dir, else the context's checkpoint folder.

    A session on one machine that names neither gets a local folder; on a cluster that would give every executor a
    folder of its own, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-netloom-")
    return _LOCAL_DIRS[app]


def materialize(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost
    executors, and gives later stages real sizes and column pruning."""
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Tables between steps are written once and read a few times, so they take little room rather than little time.
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------------ ranked picks

def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key.  The ``= 1`` filter becomes a group limit, so each map task
    sends at most one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_by(df: DataFrame, keys: list[str], order: list, limit: Column, cap: int,
           rank: str = "rank") -> DataFrame:
    """At most ``limit`` rows per key, ``cap`` being the literal upper bound of ``limit``
    that prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked.where((F.col(rank) <= F.lit(cap)) & (F.col(rank) <= limit))


def not_passing(pass_col: str | Column = "pass") -> Column:
    """NULL counts as stopping."""
    c = F.col(pass_col) if isinstance(pass_col, str) else pass_col
    return ~c.eqNullSafe(F.lit(1))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --------------------------------------------------------------------- skew-safe sequences

def _fits(bound: int | None, chunk: int) -> bool:
    return bound is not None and bound <= chunk


def rank_chunks(df: DataFrame, keys: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` written once with ``__c``, the number of its chunk: rows in the order of (keys, order) are cut into ranges of about
    as many rows as a shuffle partition takes, or ``chunk`` where that is less than the default.

    Within a group a later chunk holds later rows; a large group spans several chunks and small ones share one.
    """
    by = [F.col(c).asc() for c in (*keys, order)]
    if chunk >= CHUNK:
        dealt = df.repartitionByRange(*by)
    else:
        dealt = df.repartitionByRange(max(1, -(-df.count() // chunk)), *by)
    return materialize(dealt.withColumn("__c", F.spark_partition_id()), "chunks")


def number_in_group(df: DataFrame, keys: list[str], order: str, out: str,
                    bound: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Dense 1..n per group by a unique integer ``order`` column."""
    if _fits(bound, chunk):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    cut = rank_chunks(df, keys, order, chunk)
    counts = cut.groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.sum("__n").over(before)).where("__off > 0").drop("__n")
    numbered = cut.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*keys, "__c").orderBy(order)))
    return (_left_null_safe(numbered, offsets, [*keys, "__c"])
            .withColumn(out, F.col("__r") + F.coalesce("__off", F.lit(0)))
            .drop("__c", "__r", "__off"))


def lag_in_group(df: DataFrame, keys: list[str], pos: str, cols: dict[str, str],
                 bound: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Adds ``out: column of the previous row`` per group ordered by unique ``pos``."""
    if _fits(bound, chunk):
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns({o: F.lag(c).over(w) for o, c in cols.items()})
    cut = rank_chunks(df, keys, pos, chunk)
    last = cut.groupBy(*keys, "__c").agg(
        F.max_by(F.struct(*[F.col(c).alias(o) for o, c in cols.items()]), F.col(pos)).alias("__last"))
    carry = (last.withColumn("__prev", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__c")))
             .where("__prev is not null").drop("__last"))
    w = Window.partitionBy(*keys, "__c").orderBy(pos)
    marked = cut.withColumns({"__first": F.row_number().over(w) == 1,
                              **{f"__l_{o}": F.lag(c).over(w) for o, c in cols.items()}})
    joined = _left_null_safe(marked, carry, [*keys, "__c"])
    return joined.withColumns({
        o: F.when(F.col("__first"), F.col(f"__prev.{o}")).otherwise(F.col(f"__l_{o}")) for o in cols
    }).drop("__c", "__first", "__prev", *[f"__l_{o}" for o in cols])


def running_sum(df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column],
                bound: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Inclusive running totals per group ordered by unique ``pos``."""
    if _fits(bound, chunk):
        w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: F.sum(c).over(w) for o, c in sums.items()})
    cut = rank_chunks(df.withColumns({f"__v_{o}": c for o, c in sums.items()}), keys, pos, chunk)
    totals = cut.groupBy(*keys, "__c").agg(*[F.sum(f"__v_{o}").alias(f"__t_{o}") for o in sums])
    before = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__c"))
    carry = (totals.withColumns({"__k": first, **{f"__b_{o}": F.sum(f"__t_{o}").over(before) for o in sums}})
             .where("__k > 1").drop("__k", *[f"__t_{o}" for o in sums]))
    w = Window.partitionBy(*keys, "__c").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    part = cut.withColumns({f"__s_{o}": F.sum(f"__v_{o}").over(w) for o in sums})
    joined = _left_null_safe(part, carry, [*keys, "__c"])
    return joined.withColumns({
        o: F.col(f"__s_{o}") + F.coalesce(F.col(f"__b_{o}"), F.lit(0)) for o in sums
    }).drop("__c", *[f"{p}{o}" for o in sums for p in ("__v_", "__s_", "__b_")])


def clipped_sum(df: DataFrame, keys: list[str], pos: str, step: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``out``, the state after each row of x' = min(0, x + step), from 0, and ``{out}_before``, the state before it, per group
    ordered by unique ``pos``.

    A segment's effect on the state is x -> min(c, x + s); two such compose to min(min(c2, c1 + s2), x + s1 + s2), so a chunk is
    summed up in two numbers whatever its length.  With P the sums of steps inside a segment, c is s - max P and the state after a
    row is P - max(-x, max P so far).  There is one path: chunks by rank, a prefix over their summaries, then the rows.
    """
    cut = rank_chunks(df.withColumn("__s", step), keys, pos, chunk)
    rows = Window.partitionBy(*keys, "__c").orderBy(pos)
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumn("__p", F.sum("__s").over(upto))
    parts = inner.groupBy(*keys, "__c").agg(F.sum("__s").alias("__t"), F.max("__p").alias("__m"))
    # At most one row per chunk that the group crosses.
    over = Window.partitionBy(*keys).orderBy("__c")
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("__sum", F.sum("__t").over(so_far))
    after = F.col("__sum") + F.least(F.lit(0.0), F.min(F.col("__t") - F.col("__m") - F.col("__sum")).over(so_far))
    parts = parts.withColumn("__x", after).withColumn("__in", F.lag("__x").over(over)).where("__in IS NOT NULL")
    joined = _left_null_safe(inner, parts.select(*keys, "__c", "__in"), [*keys, "__c"]).withColumn("__in", F.coalesce("__in", F.lit(0.0)))
    state = F.col("__p") - F.greatest(-F.col("__in"), F.max("__p").over(upto))
    done = joined.withColumn(out, state)
    return done.withColumn(f"{out}_before", F.coalesce(F.lag(out).over(rows), F.col("__in"))).drop("__s", "__p", "__in", "__c")


def _left_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__key_{k}")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, "left").drop(*[f"__key_{k}" for k in keys])


def attach_group_totals(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Group aggregates joined back to every row: partial aggregation first, so a hot
    group is never gathered in one task as an unordered window would do."""
    return _left_null_safe(df, df.groupBy(*keys).agg(*aggs), keys)


# ---------------------------------------------------------------------------- serial ids

def assign_serial(df: DataFrame, order: list[str], out: str = "id", keep: list[str] | None = None) -> DataFrame:
    """Gap-free 1..n in ``order`` (which must identify a row) without a one-task sort; ``keep`` names the columns that stay (all).

    Rows are range-partitioned and sorted once; each row's partition and place in it are stored with it (the cut makes
    them stable under retries), and the rows of the partitions before are added on reading, without a second shuffle.
    """
    by = [F.col(c).asc() for c in order]
    kept = df.columns if keep is None else keep
    # Partition number in the upper 31 bits, place in the partition in the lower 33.
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).select(*kept, F.monotonically_increasing_id().alias("_m"))
    parted = materialize(dealt, "serial")
    part = F.shiftright("_m", 33)
    # One row per partition: bounded by the partition count, not by the data.
    counts = {r["_p"]: r["_n"] for r in parted.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    offsets = [0]
    for p in range(max(counts, default=0)):
        offsets.append(offsets[-1] + counts.get(p, 0))
    before = F.get(F.array(*[F.lit(n).cast("bigint") for n in offsets]), part.cast("int"))
    return parted.withColumn(out, F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + before + 1).drop("_m")


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group: one aggregate, one number back to the driver."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return int(row[0] or 0)


def group_totals(df: DataFrame, keys: list[str], aggs: dict[str, Column],
                 bound: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Aggregates of a group on each of its rows.  Short groups reuse the partitioning the
    neighbouring windows already need; unbounded ones aggregate first and join back."""
    if _fits(bound, chunk):
        w = Window.partitionBy(*keys)
        return df.withColumns({o: a.over(w) for o, a in aggs.items()})
    return attach_group_totals(materialize(df, "totals"), keys, [a.alias(o) for o, a in aggs.items()])


def set_digest(member: Column) -> list[Column]:
    """Aggregates identifying a set of distinct members: its size and two independently
    seeded 64-bit XORs.  They combine partially, so no set is gathered in memory."""
    present = member.isNotNull()
    return [F.count(member).alias("set_size"),
            F.coalesce(F.bit_xor(F.when(present, F.xxhash64(member))), F.lit(0)).alias("set_h1"),
            F.coalesce(F.bit_xor(F.when(present, F.xxhash64(F.lit("second"), member))), F.lit(0)).alias("set_h2")]


SET_DIGEST = ["set_size", "set_h1", "set_h2"]
