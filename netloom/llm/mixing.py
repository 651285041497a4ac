"""Mixing sources to target weights by hash thresholds, built-in functions only.

Every document has a hash in [0, 2^60).  A budget of words in a source becomes a threshold: documents whose hash lies below
it are taken.  A histogram of words by source and leading hash bits finds the bucket in which the running sum crosses the
budget; only the documents of that bucket are counted again by their next bits, until it holds a single hash.  Nothing is
sorted by hash, and the documents of a hot source are summed in 1,024 partial sums a task.

Repeats are nested budgets: the k-th pass over a source has what the target leaves after k - 1 whole passes, so its
threshold is never above that of the pass before, and a document is taken once for every threshold above its hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.shared import WHITE, cut, without
from netloom.operators.common import assign_serial

HASH_BITS, STEP = 60, 10
#: Rows of the source table that are sent to every task; above that the join is a shuffle on salted sources.
SMALL_SOURCES, SALTS = 100_000, 64
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(whole == "", 0).otherwise(F.size(F.split(whole, WHITE))).cast("long")


def place(key: Column, text: Column, seed: int) -> Column:
    """The hash of a document in [0, 2^60): of its id, or of its text where it has none."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def water_level(sources: DataFrame, repeats: int) -> float:
    """The words a weight of one gets when all sources' words are shared by weight and no source gets more than
    ``repeats`` times its own; one row a round comes to the driver.  ``sources``: weight, source_size."""
    full = F.col("source_size") * repeats
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, held = (total / weights if weights else 0.0), 0
    while True:
        over = F.col("weight") * F.lit(level) > full
        n, words, weight = sources.where(over).agg(F.count("*"), F.sum(full), F.sum("weight")).first()
        # Sources that are above stay above while the level rises, so their number settles.
        if n == held or weight == weights:
            return level
        held, level = n, (total - words) / (weights - weight)


def _same(a: Column, b: Column, *more: Column) -> Column:
    out = a.eqNullSafe(b)
    for m in more:
        out = out & m
    return out


def nested_thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, level, threshold: for every budget the hash below which a source's documents are taken.

    ``docs``: source, hash, size.  ``budgets``: source, level, budget, source_size; any number of levels a source.  A budget of
    the source's size or more takes all (2^60), one of zero or less nothing (0).  Otherwise the sum of sizes below the
    threshold differs from the budget by at most half the size at the boundary hash; a tie leaves the boundary out.  Documents of
    one hash go together.
    """
    trivial = budgets.select("source", "level", F.when(F.col("budget") <= 0, 0).when(F.col("budget") >= F.col("source_size"), 1 << HASH_BITS)
                             .cast("long").alias("threshold"))
    found = trivial.where("threshold IS NOT NULL")
    # One row per open budget: the bucket that holds its boundary, and the words before it.
    open_ = (budgets.where("budget > 0 AND budget < source_size")
             .select("source", "level", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix")))
    rows = docs.select("source", "hash", "size")
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        b = open_.select(F.col("source").alias("__s"), "level", "budget", "before", "prefix")
        wide = shift + STEP
        if wide == HASH_BITS:
            sums = rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
                F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
            held = sums.join(b, _same(sums["source"], F.col("__s")))
        else:
            met = rows.join(b, _same(rows["source"], F.col("__s"), F.shiftright("hash", wide) == F.col("prefix")))
            held = met.groupBy("source", "level", "budget", "before", F.shiftright("hash", shift).alias("bucket")).agg(
                F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # At most 1,024 buckets a budget.
        w = Window.partitionBy("source", "level").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        run = held.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(w), F.lit(0)))
        edge = cut(run.where("words > 0 AND before < budget AND before + words >= budget")
                   .select("source", "level", "budget", "before", "bucket", "words", "low", "high"), "boundary")
        over = F.col("before") + F.col("words") - F.col("budget")
        taken = F.when(over < F.col("budget") - F.col("before"), F.col("high") + 1).otherwise(F.col("low"))
        found = found.unionByName(edge.where("low = high").select("source", "level", taken.alias("threshold")))
        left = edge.where("low < high")
        if left.isEmpty():
            break
        open_ = left.select("source", "level", "budget", "before", F.col("bucket").alias("prefix"))
        if wide == HASH_BITS:
            # Later rounds read the boundary buckets only.
            near = open_.select(F.col("source").alias("__s"), "prefix").distinct()
            rows = cut(rows.join(near, _same(rows["source"], F.col("__s"), F.shiftright("hash", shift) == F.col("prefix")), "left_semi"), "boundary-rows")
    return found


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), repeats: int = 3, seed: int = 42, key: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` without its text plus size (words), source_size, target (of the source, double) and taken (words the mix takes).

    Sources in the order of their code points, null last, weigh ``weights``, repeating.  They share the words of all documents by
    weight; none gets more than ``repeats`` times its own words, the excess is shared by the others.  A document is taken
    0 to ``repeats`` times; the words taken from a source differ from its target by at most half its boundary document.

    The result follows from ids and texts alone, so reruns agree.  Null texts have size 0 and are taken with 0 words; rows that repeat
    an id in a source are taken together; rows without an id are told apart by their texts.  Without documents, or without a
    word, targets are 0.  Columns that carry an added name are replaced.
    """
    rest = without(docs.withColumns({"__text": F.col(f"`{text}`"), "__key": F.col(f"`{key}`"), "__source": F.col(f"`{source}`")}), [text, *ADDED])
    narrow = cut(rest.withColumns({"size": word_count(F.col("__text")), "__hash": place(F.col("__key"), F.col("__text"), seed)}).drop("__text", "__key"), "sizes")
    rows = narrow.select(F.col("__source").alias("source"), F.col("__hash").alias("hash"), "size")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranked = assign_serial(sums, ["last", "source"], "rank").drop("last")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")
    weighed = cut(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)), "sources")
    level = water_level(weighed, repeats)
    goals = weighed.select("source", "source_size", F.least((F.col("source_size") * repeats).cast("double"), F.col("weight") * F.lit(level)).alias("target"))
    passes = goals.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("level"))
    budgets = passes.select("source", "level", "source_size", (F.col("target") - (F.col("level") - 1) * F.col("source_size")).alias("budget"))
    bounds = nested_thresholds(rows, budgets).groupBy("source").agg(F.collect_list("threshold").alias("bounds"))  # `repeats` a source
    plan = goals.join(bounds.withColumnRenamed("source", "__b"), _same(F.col("source"), F.col("__b")), "left")
    plan = cut(plan.select(F.col("source").alias("__name"), "source_size", "target", "bounds"), "mix")
    if plan.count() <= SMALL_SOURCES:
        joined = narrow.join(F.broadcast(plan), _same(F.col("__source"), F.col("__name")), "left")
    else:
        salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = narrow.withColumn("__turn", F.pmod("__hash", F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, _same(F.col("__source"), F.col("__name"), F.col("__turn") == F.col("__salt")), "left")
    times = F.size(F.filter("bounds", lambda t: F.col("__hash") < t))
    kept = [c for c in narrow.columns if not c.startswith("__") and c != "size"]
    return joined.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(docs.select("doc_id", "source", "text")).drop("source")
