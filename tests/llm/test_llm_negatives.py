import random

import numpy as np
import pytest

from netloom.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def plain(rows, step=100):
    """All scores of every anchor; an id counts once, by its best score."""
    kept = []
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, tuple(int(np.floor(256.0 * float(np.float32(x)))) for x in v), (lab + 1) % 10 if i % 7 == 0 else lab))
    out = []
    for a in sorted({i for i, _, _ in kept if i % step == 0}):
        lab, vec = min((x, v) for i, v, x in kept if i == a)
        score = {}
        for i, v, x in kept:
            if i != a:
                s = sum(p * q for p, q in zip(vec, v))
                k = (i, x == lab)
                score[k] = max(s, score.get(k, s))
        order = sorted(score.items(), key=lambda e: (-e[1], e[0][0]))
        for (p, _), ps in [e for e in order if e[0][1]][:5]:
            fit = [(i, s) for (i, same), s in order if not same and 80 * ps <= 100 * s <= 100 * ps][:5]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, lab, "clash") for i, v, lab in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in N.mined(df).collect())


def vectors(rng, n, dims=24, copies=0.3):
    base = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(n)]
    for i in range(n):
        if rng.random() < copies:
            base[i] = [x + rng.gauss(0, 0.01) for x in base[rng.randrange(n)]]
    return base


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(N, "ROWS", 64)
    monkeypatch.setattr(N, "ANCHORS", 3)
    vs = vectors(rng, 700)
    rows = [(i, v, rng.choice([0, 1, 1, 1, 2, 9]) if i % 97 else 55) for i, v in enumerate(vs)]
    rows += [(None, vs[0], 1), (701, None, 1), (702, vs[1], None), (703, [0.1, None], 1), (704, [float("nan")] * 24, 1), (705, [float("inf")] * 24, 2)]
    rows += [(800, vs[3][:10], 1), (801, vs[3] + [0.5], 1), (802, [], 1), (100, vs[100], rows[100][2]), (5, vs[5], rows[5][2]), (-100, vs[7], 1)]
    assert run(spark, rows) == plain(rows)


def test_groups_of_anchor_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, v, rng.randrange(3)) for i, v in enumerate(vectors(rng, 600))]
    for name, value in (("SMALL", 0), ("GROUP", 2000), ("REPLICAS", 3), ("ROWS", 50), ("ANCHORS", 2)):
        monkeypatch.setattr(N, name, value)
    assert run(spark, rows) == plain(rows)


def test_ties_equal_vectors_and_a_common_vector(spark):
    same = [0.25] * 8
    rows = [(i, same if i % 3 else [0.2] * 8, i % 2) for i in range(400)]
    assert run(spark, rows) == plain(rows)


def test_empty_few_and_large_values(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1)]) == []
    few = [(100, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, [-0.8, 0.0], 1)]
    assert run(spark, few) == plain(few)
    big = [(100, [3e6, 1.0], 1), (1, [2e6, 5.0], 1), (2, [1.9e6, 7.0], 2), (3, [1.7e6, 2.0], 3)]
    assert run(spark, big) == plain(big) != []


def test_index_and_pruning_lose_no_pair():
    rng = np.random.default_rng(1)
    for dims in (0, 1, 7, 8, 30, 64):
        x = np.floor(rng.normal(0, 40, (20, dims)) * np.linspace(0.2, 2, dims))
        y = np.floor(rng.normal(0, 40, (500, dims)) * np.linspace(0.2, 2, dims))
        truth = x @ y.T
        for q in (0.0, 0.5, 0.9, 0.999):
            floor = np.quantile(truth, q, axis=1).astype(np.int64) if dims else np.zeros(20, np.int64)
            i, k, s = N.pairs_above(x, y, floor)
            want = {(a, b): truth[a, b] for a, b in zip(*np.nonzero(truth >= floor[:, None]))}
            assert {(a, b): c for a, b, c in zip(i, k, s)} == want


def test_index_leaves_dimensions_out(monkeypatch):
    """A high threshold omits leading dimensions, and few pairs reach verification."""
    rng = np.random.default_rng(2)
    x, y = np.floor(rng.normal(0, 32, (16, 64))), np.floor(rng.normal(0, 32, (2000, 64)))
    read = []
    real = np.outer
    monkeypatch.setattr(np, "outer", lambda a, b: read.append(len(b)) or real(a, b))
    floor = np.full(16, int(0.6 * np.linalg.norm(x, axis=1).min() * np.linalg.norm(y, axis=1).max()))
    N.pairs_above(x, y, floor)
    assert read and min(read) < 2000 or len(read) < 8


def test_usable_rows_and_labels(spark):
    df = spark.createDataFrame([(7, [0.5, -0.001], 9, ""), (8, [0.5], 9, ""), (9, [], 1, "")], SCHEMA)
    got = {r.vec_id: (r.label, r.v) for r in N.usable(df).collect()}
    assert got == {7: (0, [128.0, -1.0]), 8: (9, [128.0]), 9: (1, [])}
