import random

import pytest

from netloom.llm import tiling


def slow_tiles(a, b, least):
    """Greedy string tiling by comparing all positions; lengths of tiles, longest first."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(fa[i:i + best]) and all(fb[j:j + best]):
                fa[i:i + best] = fb[j:j + best] = [False] * best
                out.append(best)


def seeds(a, b, least):
    grams = {tuple(b[j:j + least]) for j in range(len(b) - least + 1)}
    return [i for i in range(len(a) - least + 1) if tuple(a[i:i + least]) in grams]


@pytest.mark.parametrize("least", [2, 3, 5])
def test_tiles_match_the_plain_version(least):
    rng = random.Random(least)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        got = tiling.tile(a, b, seeds(a, b, least), least)
        assert [n for *_, n in got] == slow_tiles(a, b, least), (a, b)
        assert all(a[i:i + n] == b[j:j + n] for i, j, n in got)
        assert sum(n for *_, n in got) == len({x for i, _, n in got for x in range(i, i + n)}) == len({x for _, j, n in got for x in range(j, j + n)})


ITEM = "Alpha beta gamma delta, epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi. Rho sigma tau upsilon phi chi psi omega!"
ITEMS = [(1, ITEM), (1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, "Uno dos tres cuatro cinco seis siete ocho nueve diez once doce")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in ITEMS], "item_id long, text string, leaks string")


def filler(n, seed=0):
    rng = random.Random(seed)
    return " ".join(f"f{rng.randint(0, 10 ** 9)}" for _ in range(n))


def test_leaks(spark, items):
    one, two, three = ITEM.split(". ")
    rows = [(1, filler(50) + " " + ITEM + " " + filler(30)),  # whole
            (2, f"{three} {filler(9)} {one.upper()} {filler(5)} {two}"),  # reordered, other case
            (3, filler(40) + " " + one),  # a third only
            (4, None), (5, ""), (6, filler(20_000, 7)), (7, filler(20_000, 8) + ITEM + filler(20_000, 9)),
            (8, "too short"), (9, ITEMS[5][1] + " " + ITEM), (9, ITEMS[5][1] + " " + ITEM)]
    docs = spark.createDataFrame([(k, t, "old") for k, t in rows], "doc_id long, text string, leaks string")
    got = sorted((r.doc_id, r.item_id) for r in tiling.leaked_pairs(docs, items).collect())
    assert got == [(1, 1), (2, 1), (7, 1), (9, 1), (9, 1), (9, 4), (9, 4)]
    tiles = {r.doc_id: r for r in tiling.leaked_pairs(docs, items).where("item_id = 1").collect()}
    assert tiles[1].n_tiles == 1 and tiles[1].coverage == 1.0 and tiles[2].n_tiles == 3 and tiles[2].coverage == 1.0
    kept = tiling.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]


def test_blocks_do_not_change_the_result(spark, items, monkeypatch):
    docs = spark.createDataFrame([(1, ITEM), (2, ITEMS[5][1] + ITEM)], "doc_id long, text string")
    want = sorted(map(tuple, tiling.leaked_pairs(docs, items).collect()))
    monkeypatch.setattr(tiling, "BLOCK", 1)
    assert len(list(tiling.blocks(items, "item_id", "text"))) == 4
    assert sorted(map(tuple, tiling.leaked_pairs(docs, items).collect())) == want and len(want) == 3


def test_empty_tables(spark, items):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert tiling.leaked_pairs(docs.limit(0), items).count() == 0
    assert tiling.leaked_pairs(docs, items.limit(0)).count() == 0
    assert tiling.keep_clean(docs, items.limit(0)).count() == 1
