"""Quality rules with host verdicts, built-in functions only.

Every document is measured in one pass: the words of its whole text stay one array, and repeats are found by sorting
the hashes of its three-word windows inside the row, so words are never shuffled.  Failures are then counted by
host.  A host's rate is shrunk towards all hosts by a beta prior fitted to the hosts (method of moments), so a host
with few documents is not condemned by one of them, and the verdict joins back to the host's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import WHITE, WORD, cut, without

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of the whole text.

    Null and empty texts and texts of white space only have 0 of each (symbols count anywhere).  Columns that carry
    these names are replaced.
    """
    rest = without(df, MEASURES)
    whole = F.coalesce(F.col("__whole"), F.lit(""))
    held = (rest.withColumn("__whole", df[text])
            .withColumn("__words", F.filter(F.split(whole, WHITE), lambda w: w != ""))
            .withColumn("__lines", F.when(F.contains(whole, F.lit("\n")), F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)))))
    places = F.when(F.size("__words") > 3, F.sequence(F.lit(0), F.size("__words") - 3))
    word = lambda i: F.get(F.col("__words"), i)
    held = (held.withColumn("__hashes", F.transform(places, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
            .withColumn("__again", F.coalesce(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.lit(False)))
            # Only texts with a repeat need places; they are sorted with their hashes.
            .withColumn("__sorted", F.when(F.col("__again"), F.array_sort(
                F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
            .withColumn("__places", F.array_sort(F.transform(
                F.filter(F.transform("__sorted", lambda x, k: F.struct(
                    x["i"].alias("i"),
                    (F.coalesce(F.get(F.col("__sorted"), k - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(F.col("__sorted"), k + 1)["h"] == x["h"], F.lit(False))).alias("again"))),
                    lambda x: x["again"]), lambda x: x["i"]))))
    covered = F.aggregate("__places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, i: F.struct(
        (i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n")), lambda s: s["n"])
    return held.select(
        *[F.col(f"`{c}`") for c in rest.columns],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("__lines") - F.size(F.array_distinct("__lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failed() -> Column:
    """Whether a measured document breaks a rule: under 50 words, or more than half of them repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str = "source", bad: str = "base_failed", worst: float = 0.5) -> DataFrame:
    """host, n, k (failed), rate (shrunk) and verdict (false: the host is not worth keeping), one row per host.

    The prior Beta(a, b) has the mean of all documents and the hosts' spread beyond chance; with no such spread every
    host gets the common mean.  A host falls if its shrunk rate exceeds ``worst``.  A null host is a host of its own.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(bad).cast("long")).alias("k"))
    t = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                  F.sum(F.col("k") / F.col("n") * F.col("k")).alias("kk")).first()  # five numbers
    mean = t.k / t.n if t.n else 0.0
    size = _prior_size(t.hosts, t.n or 0, mean, t.nn or 0, t.kk or 0.0)
    rate = (F.col("k") + F.lit(mean * size)) / (F.col("n") + F.lit(size)) if size is not None else F.lit(mean)
    return hosts.withColumn("rate", rate.cast("double")).withColumn("verdict", F.col("rate") <= worst)


def _prior_size(hosts: int, n: int, mean: float, nn: int, kk: float) -> float | None:
    """a + b of the beta prior from the weighted spread of host rates; None if the hosts do not differ beyond chance.

    With r_i = k_i / n_i, S = sum n_i (r_i - mean)^2 has expectation v (hosts - 1) (1 - rho) + v rho (n - nn / n), where
    v = mean (1 - mean) and rho = 1 / (a + b + 1).
    """
    v = mean * (1 - mean)
    if hosts < 2 or v <= 0:
        return None
    spread = kk - n * mean * mean
    room = n - nn / n - (hosts - 1)
    rho = (spread / v - (hosts - 1)) / room if room > 0 else 0.0
    if rho <= 0:
        return None
    return max(1 / min(rho, 0.999) - 1, 1e-3)


def judge(df: DataFrame, host: str = "source", text: str = "text", worst: float = 0.5) -> DataFrame:
    """``df`` without its text plus the measures, base_failed and kept (false if a rule or the host's verdict says so).

    Measured rows are written once and read by the count and the join.  The host table is one row per host; Spark sends
    it to all tasks only if its size, known after the count, allows, and splits a hot host otherwise.
    """
    narrow = cut(measure(without(df, ["base_failed", "kept"]), text).drop(text).withColumn("base_failed", failed()), "quality")
    verdicts = host_verdicts(narrow, host, "base_failed", worst).select(F.col("host").alias("__host"), "verdict")
    joined = narrow.join(verdicts, narrow[host].eqNullSafe(F.col("__host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("verdict")).drop("__host", "verdict")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    return judge(docs.select("doc_id", "source", "text")).select("doc_id", *MEASURES, "base_failed", "kept")
