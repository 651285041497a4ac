import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import common as C


@pytest.fixture(scope="module")
def seq(spark):
    rng = random.Random(3)
    data = []
    for g, n in [("a", 23), ("b", 1), ("c", 9), (None, 7)]:
        for p in rng.sample(range(1, 60), n):
            data.append((g, p, rng.randint(0, 9)))
    return data, spark.createDataFrame(data, "g string, p int, v int").repartition(5)


def by_group(data):
    groups = {}
    for g, p, v in data:
        groups.setdefault(g, []).append((p, v))
    return {g: sorted(r) for g, r in groups.items()}


@pytest.mark.parametrize("bound,chunk", [(100, 1000), (None, 4), (23, 4)])
def test_sequences(seq, bound, chunk):
    data, df = seq
    out = C.number_in_group(df, ["g"], "p", "n", bound, chunk)
    out = C.lag_in_group(out, ["g"], "p", {"prev": "v"}, bound, chunk)
    out = C.running_sum(out, ["g"], "p", {"total": F.col("v")}, bound, chunk)
    out = C.group_totals(out, ["g"], {"top": F.max("v")}, bound, chunk)
    got = {(r.g, r.p): (r.n, r.prev, r.total, r.top) for r in out.collect()}
    want = {}
    for g, items in by_group(data).items():
        total, prev = 0, None
        for i, (p, v) in enumerate(items):
            total += v
            want[(g, p)] = (i + 1, prev, total, max(x for _, x in items))
            prev = v
    assert got == want


def test_serial_is_gap_free_and_ordered(spark):
    values = [(i % 7, i) for i in range(500)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame(values, "a int, b int").repartition(9)
    got = [(r.a, r.b) for r in C.assign_serial(df, ["a", "b"], "id").orderBy("id").collect()]
    assert got == sorted(values)
    ids = [r.id for r in C.assign_serial(df, ["a", "b"], "id").collect()]
    assert sorted(ids) == list(range(1, 501))


def test_first_by_prunes_before_the_shuffle(seq):
    _, df = seq
    plan = C.first_by(df, ["g"], ["p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_set_digest_ignores_order_and_tells_sets_apart(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (2, 7), (2, 5), (3, 5), (4, None)], "k int, m int")
    got = {r.k: (r.set_size, r.set_h1, r.set_h2) for r in df.groupBy("k").agg(*C.set_digest(F.col("m"))).collect()}
    assert got[1] == got[2] != got[3] and got[4][0] == 0


@pytest.mark.parametrize("chunk", [1, 2, 7, C.CHUNK])
def test_clipped_sum_matches_the_loop(spark, chunk):
    rng = random.Random(chunk)
    rows = [(g, p * 10 ** 6, round(rng.uniform(-2, 2), 3)) for g, n in ((1, 40), (2, 1), (None, 7), (3, 15)) for p in rng.sample(range(10 ** 6), n)]
    df = spark.createDataFrame(rows, "g int, p long, s double").repartition(3)
    got = {(r.g, r.p): (r.x, r.x_before) for r in C.clipped_sum(df, ["g"], "p", F.col("s"), "x", chunk).collect()}
    assert len(got) == len(rows)
    for g in (1, 2, 3, None):
        x = 0.0
        for _, p, s in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            before, x = x, min(0.0, x + s)
            assert got[g, p] == pytest.approx((x, before), abs=1e-9)


def test_chunks_are_cut_by_rank(spark):
    """Sparse positions do not make one chunk a row."""
    df = spark.range(1000).selectExpr("0 AS g", "id * 1000000007 AS p")
    sizes = [r["count"] for r in C.rank_chunks(df, ["g"], "p", 100).groupBy("__c").count().collect()]
    assert len(sizes) <= 12 and max(sizes) <= 400


def test_serial_ids_take_one_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 7 AS a", "id AS b", "id + 1 AS c")
    out = C.assign_serial(df, ["a", "b"], "n", keep=["c"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["c", "n"] and "Window" not in plan and "Exchange" not in plan
    want = [c for _, _, c in sorted((i % 7, i, i + 1) for i in range(1000))]
    assert [r.c for r in out.orderBy("n").collect()] == want and {r.n for r in out.collect()} == set(range(1, 1001))


def test_a_column_of_a_written_table_counts_by_its_rows_not_by_its_file(spark):
    df = spark.range(100_000).selectExpr("xxhash64(id) AS id", *[f"'constant' AS s{i}" for i in range(10)])
    size = C.materialize(df, "wide").select("id")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) >= 100_000 * 8
