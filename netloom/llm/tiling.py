"""Benchmark decontamination by greedy string tiling.

A benchmark item counts as leaked into a document if tiles - common token runs that overlap neither in the
document nor in the item - cover a given share of the item's tokens.  Tiles may come in any order, so a passage
whose sentences were moved about is still found.

1. Seeds: runs of ``least`` tokens.  A document's seeds are looked up in the items' seed table (a hash join in the
   task that reads the document).  Only item tokens under a shared seed can be tiled, so pairs whose seeds cover too
   little are dropped without loss.
2. Tiles: the longest common run of tokens not yet marked is found by running Karp-Rabin hashes over the seeded
   stretches, checked token by token and marked, until no run of ``least`` tokens is left.

The items are a stated query set.  They are read in blocks of bounded size, and each block is broadcast and held
against all documents in one pass; there is no shuffle and no limit on a document's or an item's matches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import map_rows

#: Item tokens of one broadcast block, at most (a longer single item makes a block of its own).
BLOCK = 1 << 20
_TOKEN = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1
LEAK = "struct<item_id:bigint,covered:int,n_tokens:int,n_tiles:int,longest:int>"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with a key and tokens, in lists of at most ``BLOCK`` tokens.  Equal rows count once."""
    block, size = [], 0
    for r in items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL").distinct().orderBy("k", "t").toLocalIterator():
        t = tokens(r.t)
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r.k, t))
        size += len(t)
    if block:
        yield block


def _runs(free: list[bool], stretches) -> Iterator[tuple[int, int]]:
    """Unmarked runs inside the stretches."""
    for lo, hi in stretches:
        at = lo
        while at < hi:
            if not free[at]:
                at += 1
                continue
            end = at
            while end < hi and free[end]:
                end += 1
            yield at, end
            at = end


def _hashes(seq: list[int], lo: int, hi: int, n: int) -> Iterator[tuple[int, int]]:
    """(position, Karp-Rabin hash) of every window of n tokens in seq[lo:hi]."""
    if hi - lo < n:
        return
    lead, h = pow(_BASE, n - 1, _MOD), 0
    for x in seq[lo:lo + n]:
        h = (h * _BASE + x) % _MOD
    yield lo, h
    for i in range(lo + n, hi):
        h = ((h - seq[i - n] * lead) * _BASE + seq[i]) % _MOD
        yield i - n + 1, h


def tile(doc: list[str], item: list[str], starts: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (document position, item position, length), longest first; ties by document, then item position.

    ``starts``: document positions of the seeds shared with the item.
    """
    stretches: list[list[int]] = []
    for s in starts:
        if stretches and s <= stretches[-1][1]:
            stretches[-1][1] = s + least
        else:
            stretches.append([s, s + least])
    ids: dict[str, int] = {}
    b = [ids.setdefault(x, len(ids) + 1) for x in item]
    a = {i: ids.get(doc[i], 0) for lo, hi in stretches for i in range(lo, hi)}
    row = [a.get(i, 0) for i in range(stretches[-1][1])] if stretches else []
    free_a, free_b = [True] * len(row), [True] * len(b)
    found = []

    def matches(n: int) -> Iterator[tuple[int, int]]:
        """Equal windows of n unmarked tokens; marks made meanwhile are heeded."""
        at = defaultdict(list)
        for lo, hi in _runs(free_b, [(0, len(b))]):
            for i, h in _hashes(b, lo, hi, n):
                at[h].append(i)
        for lo, hi in list(_runs(free_a, stretches)):
            for i, h in _hashes(row, lo, hi, n):
                for j in at.get(h, ()):
                    if all(free_a[i:i + n]) and all(free_b[j:j + n]) and row[i:i + n] == b[j:j + n]:
                        yield i, j
                        break

    most = min(len(b), max((hi - lo for lo, hi in stretches), default=0))
    while most >= least:
        lo, n = least - 1, most  # the longest n that still has a match: any match holds shorter ones
        while lo < n:
            mid = (lo + n + 1) // 2
            lo, n = (mid, n) if next(matches(mid), None) else (lo, mid - 1)
        if n < least:
            break
        for i, j in matches(n):
            free_a[i:i + n] = free_b[j:j + n] = [False] * n
            found.append((i, j, n))
        most = n - 1
    return found


def with_leaks(docs: DataFrame, items: DataFrame, least: int = 3, share: float = 0.6, item_key: str = "item_id",
               item_text: str = "text", text: str = "text", out: str = "leaks") -> DataFrame:
    """``docs`` plus ``out``: the items leaked into the whole text, ordered by item, empty where clean.

    An entry has item_id, covered and n_tokens (tiled and all tokens of the item), n_tiles and longest (tokens).
    Null and empty texts are clean.  Items of fewer than ``least`` tokens never match; items without a key are
    left out; repeated documents are judged each.  A column called ``out`` is replaced.
    """
    spark = docs.sparkSession
    found = docs.withColumn(out, F.array().cast(f"array<{LEAK}>"))
    for block in blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared):
            held = shared.value
            seeds = defaultdict(list)
            for n, (_, t) in enumerate(held):
                for i in range(len(t) - least + 1):
                    seeds[tuple(t[i:i + least])].append((n, i))

            def one(text, leaks):
                t = tokens(text)
                hits = [(i, g) for i, g in enumerate(zip(*(t[k:] for k in range(least)))) if g in seeds]
                if not hits:
                    return (leaks,)
                starts, under = defaultdict(list), defaultdict(set)
                for i, g in hits:
                    for n, j in seeds[g]:
                        if not starts[n] or starts[n][-1] != i:
                            starts[n].append(i)
                        under[n].update(range(j, j + least))
                more = []
                for n, seen in under.items():
                    item, words = held[n]
                    if len(seen) >= share * len(words):
                        tiles = tile(t, words, starts[n], least)
                        covered = sum(x[2] for x in tiles)
                        if covered >= share * len(words):
                            more.append({"item_id": item, "covered": covered, "n_tokens": len(words),
                                         "n_tiles": len(tiles), "longest": max(x[2] for x in tiles)})
                return (sorted([*leaks, *more], key=lambda x: x["item_id"]),)

            return one

        found = map_rows(found, {"text": text, "leaks": out}, f"`{out}` array<{LEAK}>", make)
    return found


def leaked_pairs(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, covered, n_tokens, n_tiles, longest, coverage of every leaked pair."""
    found = with_leaks(docs.select("doc_id", "text"), items, **how)
    return (found.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("x"))
            .select("doc_id", "x.*").withColumn("coverage", F.col("covered") / F.col("n_tokens")))


def keep_clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` less the documents into which an item leaked."""
    return with_leaks(docs, items, out="__leaks", **how).where(F.size("__leaks") == 0).drop("__leaks")
