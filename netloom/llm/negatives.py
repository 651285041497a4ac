"""Hard negatives by threshold joins on an inverted index with norm bounds.

Vectors become whole numbers, so scores (inner products) are exact.  Anchors meet all rows in blocks; for one pair of blocks and a
threshold per anchor:

* **Index.**  The leading dimensions of a row whose prefix norm times the anchors' largest prefix norm stays under the lowest
  threshold are left out of the index: they cannot make a score alone.  Rows are sorted by the number of dimensions left out, so
  the posting list of a dimension is a leading range of rows.
* **Accumulate and prune.**  Posting lists are read from the last dimensions to the first.  A pair goes when its partial
  score plus the product of the two norms over what is left is under the anchor's threshold.
* **Verify.**  Pairs that remain get the dimensions the index left out.

``search`` starts at high thresholds and lowers them for the windows that are not full, until they are or the lowest threshold
is reached.  A window is an anchor's best rows, or its best rows at or below a score.  A task keeps the best rows of every window
over all the blocks it meets, raises the window's threshold to them as it goes, and passes on at most a window's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.shared import arrow_map, cut

#: Rows of a block and of an anchor block, and dimensions read at a step.
ROWS, ANCHORS, STEP = 4096, 512, 8
#: Bytes of anchors that are sent to every task, and of a group of anchor blocks otherwise; copies of a group, each of which meets
#: a share of the rows in a task of its own.
SMALL, GROUP, REPLICAS = 16 << 20, 128 << 20, 256
#: Shares of the bound ||x|| max||y|| at which positives are searched, highest first; then without a threshold.
POSITIVE_LEVELS = (0.5, 0.35, 0.25, 0.15)
#: Shares of the positive's score down to which negatives are searched before the window's own floor.
NEGATIVE_LEVELS = (0.98, 0.93)
#: Above this product of norms doubles are not exact and Python's whole numbers are used.
EXACT = float(1 << 52)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, v array<double> of the rows that take part: known id and label, and a vector of finite components.

    Labels of ids divisible by 7 are shifted, as the query of this operator wants it; components become floor(256 x).
    """
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(finite)
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return kept.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), v.alias("v"))


def _stack(vectors: list, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _longs(values) -> bytes:
    return np.array(values, np.int64).tobytes()


def blocks(rows: DataFrame, dims: int, size: int, name: str) -> DataFrame:
    """One row per block of up to ``size`` rows of a task: ids, labels and vectors as bytes, and the windows, if any, as
    their number per row and three numbers each."""
    windows = "windows" in rows.columns

    def packed(part: list[dict]) -> pa.RecordBatch:
        cols = {"ids": _longs([r["vec_id"] for r in part]), "labels": _longs([r["label"] for r in part]),
                "vectors": _stack([r["v"] for r in part], dims).tobytes()}
        if windows:
            cols["counts"] = _longs([len(r["windows"]) for r in part])
            cols["windows"] = _longs([[w["item"], w["low"], w["high"]] for r in part for w in r["windows"]])
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols.values()], names=list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            held += b.to_pylist()
            while len(held) >= size:
                yield packed(held[:size])
                held = held[size:]
        if held:
            yield packed(held)

    schema = "ids binary, labels binary, vectors binary" + (", counts binary, windows binary" if windows else "")
    return cut(arrow_map(rows, run, schema), name)


def _survivors(x: np.ndarray, y: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row, score) of two blocks whose score reaches the anchor's floor."""
    m, dims = x.shape
    edges = [*range(0, dims, STEP), dims]
    steps = len(edges) - 1
    # Norms of the leading dimensions up to every edge, a little above the truth.
    px = np.sqrt(np.stack([(x[:, :e] ** 2).sum(axis=1) for e in edges], axis=1)) * (1 + 1e-12)
    py = np.sqrt(np.stack([(y[:, :e] ** 2).sum(axis=1) for e in edges], axis=1)) * (1 + 1e-12)
    # Steps of dimensions the index leaves out, row by row.
    skip = np.maximum((py * px.max(axis=0) < floor.min()).sum(axis=1) - 1, 0)
    order = np.argsort(skip, kind="stable")
    y, py, skip = y[order], py[order], skip[order]
    score = np.zeros((m, len(y)))
    alive = np.ones((m, len(y)), bool)
    if steps:
        alive[:, skip == steps] = False
    done = 0
    for s in range(steps - 1, -1, -1):
        n = int(np.searchsorted(skip, s, side="right"))  # the postings of these dimensions: the first n rows
        if not n:
            continue
        score[:, :n] += x[:, edges[s]:edges[s + 1]] @ y[:n, edges[s]:edges[s + 1]].T
        alive[:, :n] &= score[:, :n] + np.outer(px[:, s], py[:n, s]) >= floor[:, None]
        if alive.sum() * 16 < alive.size:
            done = s
            break
    a, r = np.nonzero(alive)
    got = score[a, r]

    def add(on, s):
        got[on] += np.einsum("ij,ij->i", x[a[on], edges[s]:edges[s + 1]], y[r[on], edges[s]:edges[s + 1]])

    # The few pairs left: the postings not read yet, then what the index left out.
    for s in range(done - 1, -1, -1):
        on = skip[r] <= s
        add(on, s)
        keep = ~on | (got + px[a, s] * py[r, s] >= floor[a])
        a, r, got = a[keep], r[keep], got[keep]
    for s in range(steps):
        add(skip[r] > s, s)
    keep = got >= floor[a]
    return a[keep], order[r[keep]], got[keep]


def pairs_above(x: np.ndarray, y: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, k, score) with x_i . y_k >= floor_i, exact for whole numbers.

    Where scores may exceed 2^52, Python's whole numbers are used, and what does not fit a long is clipped to it.
    """
    if np.linalg.norm(x, axis=1).max(initial=0) * np.linalg.norm(y, axis=1).max(initial=0) < EXACT:
        i, k, s = _survivors(x, y, floor.astype(float))
        return i, k, s.astype(np.int64)

    def whole(z):
        out = np.empty(z.shape, dtype=object)
        out[:] = [[int(c) for c in row] for row in z]
        return out

    exact = np.clip(whole(x) @ whole(y).T, LOW, HIGH).astype(np.int64)
    i, k = np.nonzero(exact >= floor[:, None])
    return i, k, exact[i, k]


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first ``k`` rows of every window by score (higher first), then id; an id counts once."""
    keys = ["anchor", "item"]
    frame = frame.sort_values([*keys, "score", "vec_id"], ascending=[True, True, False, True], kind="stable").drop_duplicates([*keys, "vec_id"])
    return frame[frame.groupby(keys).cumcount() < k]


class _Asks:
    """An anchor block with its windows, the best rows found for them so far and the thresholds these allow."""

    def __init__(self, block: dict, dims: int, k: int, same: bool):
        self.k, self.same = k, same
        self.ids, self.labels, counts = (np.frombuffer(block[c], np.int64) for c in ("ids", "labels", "counts"))
        self.x = np.frombuffer(block["vectors"]).reshape(len(self.ids), dims)
        w = np.frombuffer(block["windows"], np.int64).reshape(-1, 3)
        self.item, self.low, self.high = w[:, 0], w[:, 1].copy(), w[:, 2]
        self.owner = np.repeat(np.arange(len(self.ids)), counts)
        self.first, self.counts = np.cumsum(counts) - counts, counts
        self.place = pd.Series(np.arange(len(w)), index=pd.MultiIndex.from_arrays([self.ids[self.owner], self.item]))
        self.best: pd.DataFrame | None = None

    def meet(self, ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> None:
        floor = np.full(len(self.ids), HIGH)
        np.minimum.at(floor, self.owner, self.low)
        i, k, s = pairs_above(self.x, y, floor)
        on = (self.ids[i] != ids[k]) & ((self.labels[i] == labels[k]) == self.same)
        i, k, s = i[on], k[on], s[on]
        new = []
        for j in range(int(self.counts.max(initial=0))):
            has = self.counts[i] > j
            w = self.first[i[has]] + j
            fits = (s[has] >= self.low[w]) & (s[has] <= self.high[w])
            w = w[fits]
            new.append(pd.DataFrame({"anchor": self.ids[self.owner[w]], "item": self.item[w], "vec_id": ids[k[has][fits]], "score": s[has][fits]}))
        if not sum(map(len, new)):
            return
        self.best = _best(pd.concat([*new, self.best] if self.best is not None else new), self.k)
        last = self.best.groupby(["anchor", "item"])["score"].agg(["size", "min"])
        full = last[last["size"] == self.k]["min"]
        at = self.place.loc[full.index].to_numpy()
        self.low[at] = np.maximum(self.low[at], full.to_numpy())


def search(asks: DataFrame, row_blocks: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """anchor, item, vec_id, score, rank: the first ``k`` rows of every window of ``asks`` (vec_id, label, v, windows
    array<struct<item, low, high>>) with the anchor's label (``same``) or another one.

    Anchor blocks form groups; each row block meets every group.  Anchors of a small total size (counted) are sent to all tasks;
    otherwise a group is copied, and a copy meets its share of the row blocks in a task of its own.
    """
    packed = blocks(asks, dims, ANCHORS, "anchors")
    total = packed.agg(F.sum(F.length("vectors") + F.length("windows"))).first()[0] or 0
    groups, copies = (1, 1) if total <= SMALL else (-(-total // GROUP), REPLICAS)
    a = packed.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("r"),
                      *[F.col(c).alias(f"a_{c}") for c in packed.columns])
    b = row_blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"),
                          F.pmod(F.xxhash64("ids"), F.lit(copies)).cast("int").alias("r"), *row_blocks.columns)
    met = b.join(F.broadcast(a) if total <= SMALL else a, ["g", "r"]).drop("g", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[bytes, _Asks] = {}
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                block = {c[2:]: v for c, v in row.items() if c.startswith("a_")}
                key = block["ids"] + block["windows"]
                if key not in state:
                    state[key] = _Asks(block, dims, k, same)
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                state[key].meet(ids, labels, np.frombuffer(row["vectors"]).reshape(len(ids), dims))
        for s in state.values():
            if s.best is not None and len(s.best):
                yield pa.RecordBatch.from_pandas(s.best, preserve_index=False)

    found = arrow_map(met, run, "anchor long, item long, vec_id long, score long")
    once = found.groupBy("anchor", "item", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("anchor", "item").orderBy(F.desc("score"), "vec_id")
    return cut(once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "window")


def _fill(windows: DataFrame, anchors: DataFrame, row_blocks: DataFrame, dims: int, k: int, same: bool, floors: list[Column]) -> DataFrame:
    """anchor, item, vec_id, score, rank of all windows (anchor, item, high, limit): thresholds fall from floor to floor for
    those with fewer than ``k`` rows, the last of ``floors`` being the lowest."""
    left, parts = windows, []
    for i, low in enumerate(floors):
        asked = left.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list(F.struct("item", low.alias("low"), "high")).alias("windows"))
        found = search(anchors.join(asked, "vec_id"), row_blocks, dims, k, same)
        if i == len(floors) - 1:
            parts.append(found)
            break
        full = found.where(F.col("rank") == k).select("anchor", "item")
        parts.append(found.join(full, ["anchor", "item"], "left_semi"))
        left = cut(left.join(full, ["anchor", "item"], "left_anti"), "windows")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def hard_negatives(rows: DataFrame, asks: Column, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``rows`` (vec_id, label, v) where ``asks`` holds.

    An anchor's positives are its first ``positives`` other rows of its label by score (higher first, then smaller id); a positive's
    negatives the first ``negatives`` rows of other labels with share * positive <= 100 * negative <= 100 * positive, so a
    positive of negative score has none.  Shorter vectors count as ending in zeros.  Rows that repeat an id count once, by
    their best score; of those that repeat an anchor's id one asks, the first by label and vector.  An empty table gives no row.
    """
    made = cut(rows, "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dims, longest = made.agg(F.max(F.size("v")), F.max(norm)).first()
    dims, longest = dims or 0, longest or 0.0
    row_blocks = blocks(made, dims, ROWS, "row-blocks")
    one = made.where(asks).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    anchors = cut(one.select("vec_id", "x.label", "x.v"), "anchor-rows")
    bound = norm * F.lit(longest)
    asked = anchors.select(F.col("vec_id").alias("anchor"), F.lit(0).cast("long").alias("item"), F.lit(HIGH).alias("high"), F.least(bound, F.lit(9e18)).alias("limit"))
    floors = [F.floor(F.col("limit") * level).cast("long") for level in POSITIVE_LEVELS] + [F.lit(LOW)]
    best = cut(_fill(asked, anchors, row_blocks, dims, positives, True, floors), "positives")
    windows = best.where("score >= 0").select("anchor", F.col("vec_id").alias("item"), F.col("score").alias("high"), F.col("score").alias("limit"))
    # ceil(share * p / 100) in whole numbers.
    lowest = (F.col("limit").cast("decimal(38,0)") * share + 99) / 100
    floors = [F.ceil(F.col("limit") * level).cast("long") for level in NEGATIVE_LEVELS if 100 * level > share] + [F.floor(lowest).cast("long")]
    found = _fill(windows, anchors, row_blocks, dims, negatives, False, floors)
    scores = best.select("anchor", F.col("vec_id").alias("item"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor", "item"]).select(
        F.col("anchor").alias("anchor_id"), F.col("item").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100."""
    return hard_negatives(usable(embeddings), F.col("vec_id") % 100 == 0)
