"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters; word edges are blanks) in order.  A document's
own profile is compared with each language's: an n-gram's penalty is how far it is out of place, or the most
possible if the language lacks it.  The nearest language wins, ties by name.

N-grams are numbers of 3 x 21 bits, so a whole text is counted by one sort of an array.  Profiles are learned from a
bounded, hash-chosen sample of labelled texts for each language; prediction reads nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.llm.shared import arrow_map, map_rows

#: N-grams of a profile.
PROFILE = 400
#: Labelled texts a language is learned from, at most.
SAMPLE = 2_000
_MASK = np.uint64(0x1FFFFF)


def _table() -> np.ndarray:
    """For each code point the letter it counts as (lower case where that is one character), 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: np.ndarray | None = None


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a whole text and their counts; both empty if it has no letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _table()
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    codes = _LETTERS[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    c = np.concatenate(([0], codes, [0])).astype(np.uint64)
    blank = c == 0
    c = c[~(blank & np.concatenate(([False], blank[:-1])))]  # one blank between words
    if not c.any():
        return none
    one = c[c > 0]
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    # Leading 1: tells a bigram that starts with a blank from a letter, a trigram from a bigram.
    two |= np.uint64(1) << np.uint64(42)
    three = three[(c[1:-1] > 0)] | (np.uint64(1) << np.uint64(63))
    keys = np.sort(np.concatenate((one, two, three)))
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    at = np.nonzero(first)[0]
    return keys[at], np.diff(np.append(at, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams, most frequent first, ties by number."""
    if len(keys) > most:  # all that can be among them, ties at the last place too
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        few = counts >= least
        keys, counts = keys[few], counts[few]
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """Language profiles as one table: n-gram numbers in order, and each language's place of each (or the penalty)."""

    def __init__(self, ranks: dict[str, list[int]], most: int):
        self.names = sorted(ranks)
        self.most = most
        self.keys = np.unique(np.array([k for r in ranks.values() for k in r], np.uint64))
        self.places = np.full((len(self.names), len(self.keys) + 1), -1, np.int32)
        for i, name in enumerate(self.names):
            r = np.array(ranks[name], np.uint64)
            self.places[i, np.searchsorted(self.keys, r)] = np.arange(len(r))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score: 1 for the same profile, 0 for nothing in common."""
        keys, counts = grams(text)
        if not len(keys) or not self.names:
            return "und", 0.0
        own = ranked(keys, counts, self.most)
        at = np.searchsorted(self.keys, own)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == own[hit]
        at[~hit] = len(self.keys)
        place = self.places[:, at]
        away = np.where(place < 0, self.most, np.abs(place - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.most * len(own)))


def learn(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE,
          most: int = PROFILE) -> Profiles:
    """Profiles of the values of ``lang`` from at most ``sample`` texts of each, chosen by a hash of ``key``.

    Rows with a null language or text are left out.  N-grams are counted per task and summed by Spark; a language's
    profile is a limited window, so ``most`` rows of each come to the driver.
    """
    sizes = {r["l"]: r["n"] for r in df.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("l"))
             .agg(F.count("*").alias("n")).collect()}  # one number a language, as are the profiles
    # First by a share of the hashes, which needs no order and leaves about half more than is wanted; then exactly.
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * sample / n)))]), F.col("lang")) \
        if sizes else F.lit(0.0)
    named = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("h"), F.col(text).alias("text"))
    few = named.where(F.col("h") / F.lit(2.0 ** 64) + 0.5 < share)
    order = Window.partitionBy("lang").orderBy("h", "text")
    some = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(name, []).append(grams(t))
            for name, found in by.items():
                keys = np.concatenate([k for k, _ in found])
                uniq, where = np.unique(keys, return_inverse=True)
                n = np.bincount(where, weights=np.concatenate([c for _, c in found]), minlength=len(uniq)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(uniq)), pa.array(uniq.view(np.int64)), pa.array(n)],
                                                 names=["lang", "gram", "n"])

    total = arrow_map(some, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Order by the unsigned number: flipping the sign bit makes signed order the same.
    top = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram").bitwiseXOR(F.lit(-(1 << 63))))
    rows = total.withColumn("r", F.row_number().over(top)).where(F.col("r") <= most).orderBy("lang", "r").collect()
    ranks: dict[str, list[int]] = {}
    for r in rows:
        ranks.setdefault(r.lang, []).append(r.gram & 0xFFFFFFFFFFFFFFFF)
    return Profiles(ranks, most)


def identify(df: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` plus the language of the whole text and its score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as is all if no language was learned.  Columns
    that carry these names are replaced.  A map: no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def make():
        return shared.value.predict

    return map_rows(df, {"t": text}, f"`{lang}` string, `{score}` double", make)
