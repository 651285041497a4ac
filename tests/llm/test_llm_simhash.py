import random

import numpy as np
import pytest
import xxhash

from netloom.llm import simhash
from netloom.llm.components import star_roots

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, most):
    """key -> smallest key reachable; fps: list of (key, unsigned fingerprint)."""
    near = {k: [j for j, g in fps if bin(f ^ g).count("1") <= most] for k, f in fps}
    out = {}
    for k in sorted(near):
        if k in out:
            continue
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = k
                todo += near[x]
    return out


def test_fingerprints(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abCÉ'ß") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \t\n", "one", "Two words", "a b c", " x y z w"] + [" ".join(word() for _ in range(n)) for n in (3, 4, 50, 255, 256, 257, 300, 2000)]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    for words in (3, 5):
        for r in simhash.fingerprints(df, words).collect():
            assert r.fingerprint % (1 << 64) == slow_fingerprint(texts[r.doc_id], words), (r.doc_id, words)


@pytest.mark.parametrize("most", [1, 3, 6, 8])
def test_some_partition_is_within_its_threshold(most):
    rng = np.random.default_rng(most)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    x[:, 1] = x[:, 0]  # two bits that always agree
    plan = simhash.layout(10 ** 6, x.T @ x, most)
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    assert sum(plan.thresholds) == most - len(plan.groups) + 1
    assert any({0, 1} <= set(g) for g in plan.groups)
    for _ in range(2000):
        flips = set(rng.choice(64, most, replace=False).tolist())
        assert any(len(flips & set(g)) <= t for g, t in zip(plan.groups, plan.thresholds))


def clusters(rng, n_groups, most_size):
    fps = []
    for _ in range(n_groups):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, most_size)):
            fps.append(f)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
    rng.shuffle(fps)
    return list(enumerate(fps, 100))


@pytest.mark.parametrize("chunk,most", [(2048, 3), (7, 3), (2048, 6)])
def test_components_match_all_pairs(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    fps = clusters(random.Random(chunk + most), 60, 12)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(k, signed(f), "x") for k, f in fps], "doc_id long, fingerprint long, component_id string")
    got = {r.doc_id: r.component_id for r in simhash.components(df, most).collect()}
    assert got == slow_components(fps, most)


def test_one_dense_bucket_gives_few_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(5)
    base = rng.getrandbits(62)
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)})
    df = spark.createDataFrame([(f, f) for f in fps], "v long, fp long")
    n, both = simhash.bit_counts(df.select("fp"))
    assert n == len(fps) and both[0, 0] == sum(f & 1 for f in fps)
    found = simhash.links(df, simhash.layout(n, both, 3), 3).count()
    assert found < len(fps) * 60  # all pairs would be 95,000
    assert len({r.root for r in star_roots(simhash.links(df, simhash.layout(n, both, 3), 3)).collect()}) == 1


def test_star_roots(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 8), (202, 200), (200, 201)]
    got = {r.u: r.root for r in star_roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 201: 200, 202: 200}
    assert star_roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_first(spark):
    rng = random.Random(3)
    body = [" ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(400)) for _ in range(6)]
    near = body[0].split()
    near[17] = "other"
    rows = [(5, body[0]), (2, " ".join(near)), (9, body[0]), (9, body[0]), (3, body[1]), (4, None), (1, ""), (8, " \n"), (None, body[1]),
            (None, None), (6, body[2] * 60)]
    docs = spark.createDataFrame([(k, t, None, "src", 1) for k, t in rows], DOC)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 6]
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_repeated_and_null_keys_keep_their_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", "z"), (1, "a b c d", "z"), (None, "a b c d", "z"), (7, None, "z")],
                                 "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs, 3, 3, checks=0, repeats=True).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (7, 7)]


def test_check_fingerprints_part_texts_that_agree_by_chance(spark):
    a, b, c = 0b1111, 0b1110, 0b1100
    rows = [(1, a, 0, 0), (2, b, 2 ** 40 - 1, 0), (3, c, 0, 1), (4, a, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long, fingerprint_1 long, fingerprint_2 long")
    got = {r.doc_id: r.component_id for r in simhash.components(df, 3, checks=2, most_checks=32).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1}
    assert {r.component_id for r in simhash.components(df, 3).collect()} == {1}


def test_a_repeated_line_does_not_make_texts_alike(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(200)) + " the same line once again\n" * 200) for i in range(4)]
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in rows], DOC)
    assert simhash.keep_first(docs).count() == 4
    assert len({r.component_id for r in simhash.near_duplicates(docs, repeats=True, checks=0).collect()}) < 4
