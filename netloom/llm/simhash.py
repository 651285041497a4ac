"""SimHash near-duplicates by the generalised pigeonhole principle.

1. ``fingerprints``: one 64-bit SimHash of a text's word shingles, a map over Arrow batches.
2. ``layout``: bits that agree most often are grouped into m partitions, and every partition gets its own
   threshold.  If two fingerprints differ in at most k bits and the thresholds t_i (each -1 or more) sum to
   k - m + 1, some partition differs in at most t_i bits.  A dynamic programme picks the thresholds, and the
   number of partitions, with the least estimated rows and candidates.  The estimate comes from bit counts
   over all fingerprints; any layout gives the same links.
3. ``links``: each fingerprint goes to the bucket of its own value in a partition and to those within t_i
   bits (probes); home rows meet all rows of a bucket and are verified on all 64 bits.  Buckets above
   ``CHUNK`` rows are split into chunks, and every pair of chunks is a group of its own, so no task holds a
   whole bucket.  A group gives only the links that join its members (a spanning forest), never all pairs.
4. ``components``: the links' connected components.

Texts that share much common matter can come within k bits by chance if k is large.  ``near_duplicates`` may therefore
take further 64-bit SimHashes of the same shingles under other hashes, which a link must pass as well.

Equal fingerprints collapse before the search, so a group of exact copies costs one row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import star_roots
from netloom.llm.shared import arrow_map, cut, map_rows

BITS = 64
#: Rows of one bucket chunk.
CHUNK = 2048
#: Cost of checking a candidate (some 1.5 ns in arrays) against that of dealing out a row (some 1.5 us).
CHECK_COST = 0.001
#: Odd factors of the check fingerprints' hashes.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


# ------------------------------------------------------------------------- fingerprints

def _majority(h: np.ndarray) -> int:
    """Unsigned number of the bits set in over half of ``h``."""
    n, b = len(h), np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    if n < 256:
        ones = np.unpackbits(b, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(b[:, i], minlength=256) @ _BYTE for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's shingles of ``words`` words (fewer words: the whole sequence; none: no hash)."""
    import xxhash

    w = text.encode().lower().split() if text else []  # bytes: only A-Z change and only ASCII white space splits
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42)), np.uint64, max(1, len(w) - words + 1))


def fingerprint(text: str | None, words: int, checks: int = 0, repeats: bool = True) -> list[int]:
    """Unsigned SimHashes of a text: its fingerprint and ``checks`` more under other hashes; all 0 without a word.

    With ``repeats`` a shingle counts each time it stands in the text, else once.
    """
    h = _hashes(text, words)
    if not repeats:
        h = np.unique(h)
    if not len(h):
        return [0] * (1 + checks)
    out = [_majority(h)]
    for factor in _FACTORS[:checks]:
        x = h * factor
        out.append(_majority((x ^ (x >> np.uint64(32))) * factor))
    return out


def fingerprints(df: DataFrame, words: int = 5, text: str = "text", out: str = "fingerprint", checks: int = 0,
                 repeats: bool = True) -> DataFrame:
    """``df`` plus ``out`` long: the 64 bits of the text's SimHash, read as a signed number; and, if asked for, that many
    check fingerprints in columns ``out``_1, ...

    Null and empty texts and texts without a word get 0.  Columns with these names are replaced.
    """

    def make():
        return lambda t: tuple(f - (1 << 64) if f >> 63 else f for f in fingerprint(t, words, checks, repeats))

    return map_rows(df, {"t": text}, ", ".join(f"`{n}` bigint" for n in [out, *check_names(out, checks)]), make)


def check_names(fp: str, checks: int) -> list[str]:
    return [f"{fp}_{i + 1}" for i in range(checks)]


# ------------------------------------------------------------------------------- layout

@dataclass(frozen=True)
class Layout:
    """Bits of every partition and its threshold (-1: the partition is not probed)."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    def masks(self) -> list[tuple[int, int, list[int]]]:
        """(partition, mask, differences to probe) with 64-bit signed numbers."""
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        out = []
        for i, (bits, t) in enumerate(zip(self.groups, self.thresholds)):
            if t >= 0:
                probes = [signed(sum(1 << b for b in c)) for e in range(1, t + 1) for c in itertools.combinations(bits, e)]
                out.append((i, signed(sum(1 << b for b in bits)), probes))
        return out


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and, for every pair of bits, the rows that have both: 64 x 64 numbers from all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(v), 1 << 14):
                part = np.ascontiguousarray(v[at:at + (1 << 14)])
                x = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
                seen += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)),
                                          pa.array(np.append(total.ravel(), seen).astype(np.int64))], names=["i", "j", "n"])

    rows = arrow_map(fps, run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:  # 64 * 64 + 1 rows at any size
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = r.n
    return n, both


def _grouped(corr: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of bits of nearly equal size; each grows by the bit most correlated with it."""
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        rest = sorted(left)
        own = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            b = max(sorted(left), key=lambda x: (corr[x, own].sum(), -x))
            own.append(b)
            left.discard(b)
        groups.append(tuple(sorted(own)))
    return groups


def _near(agree: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, ... bits of a group, from each bit's own chance."""
    p = np.ones(1)
    for b in bits:
        p = np.convolve(p, [agree[b], 1 - agree[b]])
    return p


def layout(n: int, both: np.ndarray, most: int) -> Layout:
    """The cheapest partitions and thresholds for finding all pairs within ``most`` differing bits."""
    n = max(n, 2)
    ones = both.diagonal() / n
    agree = ones ** 2 + (1 - ones) ** 2
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    corr = np.abs(both / n - np.outer(ones, ones)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    best = None
    for m in range(2, most + 2):
        groups = _grouped(corr, m)
        need = most - m + 1
        # plan[s]: least cost of the groups so far whose thresholds sum to s
        plan = {0: (0.0, ())}
        for bits in groups:
            near, grown = np.cumsum(_near(agree, bits)), {}
            for s, (cost, chosen) in plan.items():
                for t in range(-1, min(most, len(bits)) + 1):
                    rows = sum(math.comb(len(bits), e) for e in range(t + 1))
                    if rows > 1 << 16:
                        break
                    c = cost + n * rows + CHECK_COST * n * n * (near[t] if t >= 0 else 0.0)
                    if s + t not in grown or c < grown[s + t][0]:
                        grown[s + t] = (c, (*chosen, t))
            plan = grown
        if need in plan and (best is None or plan[need][0] < best[0]):
            best = (plan[need][0], Layout(tuple(groups), plan[need][1]))
    return best[1]


# -------------------------------------------------------------------------------- links

def _forest(v: np.ndarray, fp: np.ndarray, checks: list[np.ndarray], home: np.ndarray, side: np.ndarray, most: int, most_checks: int):
    """Links that join what a group's links join.  ``side`` 0: home rows that ask, 1: rows that answer."""
    asks, answers = np.unique(v[(side == 0) & home]), np.unique(v[side == 1])
    if not len(asks) or not len(answers):
        return
    every, first = np.unique(v, return_index=True)
    where_a, where_b = np.searchsorted(every, asks), np.searchsorted(every, answers)
    bits, more = fp[first].view(np.uint64), [c[first].view(np.uint64) for c in checks]
    other, others = bits[where_b], [m[where_b] for m in more]
    root = np.arange(len(every))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for ia in where_a:
        close = np.nonzero(np.bitwise_count(other ^ bits[ia]) <= most)[0]
        if more and len(close) > 1:
            away = sum(np.bitwise_count(o[close] ^ m[ia]).astype(np.int64) for o, m in zip(others, more))
            close = close[away <= most_checks]
        mine = find(ia)
        for ib in where_b[close]:
            theirs = find(ib)
            if theirs != mine:
                lo, hi = min(mine, theirs), max(mine, theirs)
                root[hi] = lo
                mine = lo
                yield int(every[ia]), int(every[ib])


def links(fps: DataFrame, plan: Layout, most: int, checks: tuple[str, ...] = (), most_checks: int = 0) -> DataFrame:
    """(u, v): links within ``most`` bits that join the same vertices as all such links do.

    ``fps``: one row per vertex, columns ``v`` (its number) and ``fp`` long.  With ``checks``, columns of check
    fingerprints, a link must also differ in ``most_checks`` of their bits at most, together.
    """
    own = ["v", "fp", *checks]
    sides = [F.struct(F.lit(i).alias("part"), F.lit(m).alias("mask"),
                      F.array(F.lit(0), *map(F.lit, probes)).cast("array<bigint>").alias("flips"))
             for i, m, probes in plan.masks()]
    rows = (fps.select(*own, F.explode(F.array(*sides)).alias("s"))
            .select(*own, "s.part", F.col("fp").bitwiseAND(F.col("s.mask")).alias("value"), F.explode("s.flips").alias("flip"))
            .select(*own, "part", F.col("value").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("home")))
    full = (rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("home").alias("asked"))
            .where("n > 1 AND asked").select("part", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("k")))
    met = rows.join(full, ["part", "key"]).withColumn("c", F.pmod(F.xxhash64("v"), "k").cast("int"))
    others = F.sequence(F.lit(0), F.col("k") - 1)
    ask = F.transform(others, lambda j: F.struct(F.col("c").alias("a"), j.alias("b"), F.lit(0).alias("side")))
    answer = F.transform(others, lambda j: F.struct(j.alias("a"), F.col("c").alias("b"), F.lit(1).alias("side")))
    dealt = (met.select("part", "key", *own, "home", F.explode(F.when(F.col("home"), F.concat(ask, answer)).otherwise(answer)).alias("g"))
             .select("part", "key", "g.a", "g.b", "g.side", "home", *own))
    keys = ["part", "key", "a", "b"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive in order; one that goes on in the next batch waits for it."""
        held: list[np.ndarray] = []

        def done(cols: list[np.ndarray], edges: np.ndarray):
            out = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > 1:
                    side, home, v, fp, *more = (c[lo:hi] for c in cols[4:])
                    out += _forest(v, fp, more, home, side, most, most_checks)
            if out:
                u, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                    for c in (*keys, "side", "home", *own)]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            edges = np.nonzero(new)[0]
            yield from done(cols, edges)
            held = [c[edges[-1]:] for c in cols]
        if held:
            yield from done(held, np.array([0, len(held[0])]))

    return arrow_map(dealt, run, "u long, v long")


def components(fp_rows: DataFrame, most: int, key: str = "doc_id", fp: str = "fingerprint", out: str = "component_id",
               checks: int = 0, most_checks: int = 0) -> DataFrame:
    """``fp_rows`` plus ``out``: the smallest ``key`` reachable over fingerprints that differ in ``most`` bits or fewer
    (and in ``most_checks`` bits of their ``checks`` check fingerprints).

    Every row gets a component; equal fingerprints always share one; null keys count only if a component
    has no other.  ``fp_rows`` should be a stored table, as it is read several times.
    """
    more = check_names(fp, checks)
    vertex = F.xxhash64(fp, *more) if checks else F.col(fp)
    named = fp_rows.drop(out).withColumn("_v", vertex)
    fps = cut(named.groupBy(F.col("_v").alias("v")).agg(F.min(fp).alias("fp"), *[F.min(c).alias(c) for c in more], F.min(key).alias("low")),
              "fingerprints")
    n, both = bit_counts(fps.select("fp"))
    roots = star_roots(links(fps.drop("low"), layout(n, both, most), most, tuple(more), most_checks))
    rooted = (fps.join(roots.select(F.col("u").alias("v"), "root"), "v", "left")
              .select("v", "low", F.coalesce("root", "v").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias(out))
    # The table of fingerprints is narrow; a fingerprint shared by many rows is left to skew splitting.
    wide = rooted.join(lowest, "root").select(F.col("v").alias("_v"), out)
    return named.join(wide, "_v").drop("_v", *more)


#: Check fingerprints, and the bits of them a link may differ in: texts with four fifths of their shingles in common
#: differ in 19 of 128 bits on average, unrelated ones in over 50.
CHECKS, MOST_CHECKS = 2, 28


def near_duplicates(docs: DataFrame, words: int = 5, most: int = 8, key: str = "doc_id", text: str = "text",
                    checks: int = CHECKS, most_checks: int = MOST_CHECKS, repeats: bool = False) -> DataFrame:
    """key, fingerprint, component_id of every row.  Defaults: five-word shingles, each counted once, and a similarity of
    56/64 of the bits, of which two check fingerprints must not fall short far.  (Were repeats counted, a line repeated
    often would make all texts that have it alike.)

    Null and empty texts share fingerprint 0 and so one component.  Repeated rows keep their number.
    """
    rows = cut(fingerprints(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")), words, "__text", checks=checks, repeats=repeats)
               .drop("__text"), "docs")
    return components(rows, most, key, checks=checks, most_checks=most_checks)


def keep_first(docs: DataFrame, words: int = 5, most: int = 8) -> DataFrame:
    """``docs`` less all but one document of each group of near-duplicates: the one with the smallest doc_id.

    doc_id names a document: of rows that repeat one, a single row stays.  Rows without doc_id cannot be
    named and all stay.  Null and empty texts are copies of each other.
    """
    known = docs.where("doc_id IS NOT NULL")
    found = near_duplicates(known, words, most)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    # The semi-join leaves each task's rows together and in order by doc_id, which the last step reuses.
    some = known.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return some.unionByName(docs.where("doc_id IS NULL"))
