import math
import random

import pytest

from netloom.operators import celltree
from netloom.operators import spatial as S


def km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.fixture(scope="module")
def world():
    rng = random.Random(5)
    points = [(i, 0, 35 + rng.random() * 0.3, 139 + rng.random() * 0.3) for i in range(300)]
    points += [(1000 + i, 0, 35.1, 139.1) for i in range(120)]  # one crowded spot
    points += [(2000 + i, 1, rng.uniform(-80, 80), rng.choice([-179.99, 179.98, 0.0]) + rng.random() * 0.01) for i in range(60)]
    places = [(35.1, 139.1), (35.2, 139.4), (-33.0, -70.0), (10.0, 179.995), (10.0, -179.999), (89.0, 20.0), (36.9, 141.0)]
    asks = [(n, kind, lat, lon, k) for n, (lat, lon, kind, k) in enumerate(
        (lat, lon, kind, k) for lat, lon in places for kind in (0, 1) for k in (1, 7, 50, 500))]
    return points, asks


def test_k_nearest(spark, world):
    points, asks = world
    got = {}
    out = S.k_nearest(spark.createDataFrame(points, "point_id int, kind int, lat double, lon double"),
                      spark.createDataFrame(asks, "ask_id int, kind int, qlat double, qlon double, k int"), 1000)
    for r in out.collect():
        got.setdefault(r.ask_id, []).append((r.rank, r.point_id, r.distance_km))
    for ask, kind, lat, lon, k in asks:
        want = sorted((km((lat, lon), (p[2], p[3])), p[0]) for p in points if p[1] == kind)[:k]
        mine = sorted(got[ask])
        assert [x[0] for x in mine] == list(range(1, len(want) + 1))
        assert [x[2] for x in mine] == pytest.approx([w[0] for w in want], rel=1e-9, abs=1e-9)
        if k < 100 and kind == 0 and lat > 30:
            assert [x[1] for x in mine] == [w[1] for w in want]


def test_a_crowded_area_is_refined(spark):
    """32,000 coordinates within one old finest cell (600 m): few of them meet an ask."""
    rng = random.Random(9)
    points = [(i, 0, 35.0 + rng.random() * 0.004, 139.0 + rng.random() * 0.004) for i in range(32_000)]
    points += [(50_000 + i, 0, 35.0, 139.0 + i * 1e-9) for i in range(200)]  # closer than the finest cell is wide
    asks = [(n, 0, 35.0 + 0.004 * rng.random(), 139.0 + 0.004 * rng.random(), k) for n, k in enumerate([1, 5, 50, 50, 400])]
    asks += [(10, 0, 34.9, 139.0, 3), (11, 0, -35.0, -41.0, 2), (12, 0, 35.0, 139.0, 250)]
    p = spark.createDataFrame(points, "point_id int, kind int, lat double, lon double")
    a = spark.createDataFrame(asks, "ask_id int, kind int, qlat double, qlon double, k int")
    tree = celltree.build(p)
    assert tree.spots.groupBy("level", "cx", "cy").count().where(f"count > {celltree.FULL} AND level < {celltree.FINEST}").count() == 0
    met = {r.ask_id: r["count"] for r in celltree.leaves_in_reach(tree, a).join(tree.spots, ["kind", "level", "cx", "cy"]).groupBy("ask_id").count().collect()}
    for ask in asks:
        assert met[ask[0]] <= 8 * ask[4] + 20 * celltree.FULL, ask
    got = {}
    for r in S.k_nearest(p, a, 1000, tree).collect():
        got.setdefault(r.ask_id, []).append((r.rank, r.distance_km))
    for n, _, lat, lon, k in asks:
        want = sorted(km((lat, lon), x[2:]) for x in points)[:k]
        assert [d for _, d in sorted(got[n])] == pytest.approx(want, rel=1e-9, abs=1e-7)


def test_trees_of_nothing_and_of_missing_coordinates(spark):
    schema = "point_id int, kind int, lat double, lon double"
    ask = spark.createDataFrame([(1, 0, 1.0, 1.0, 2)], "ask_id int, kind int, qlat double, qlon double, k int")
    assert S.k_nearest(spark.createDataFrame([], schema), ask, 5).count() == 0
    rows = S.k_nearest(spark.createDataFrame([(1, 0, None, 2.0), (2, 0, 90.0, 180.0), (3, 1, 1.0, 1.0)], schema), ask, 5).collect()
    assert [r.point_id for r in rows] == [2]


def test_within_radius(spark, world):
    points, _ = world
    rng = random.Random(8)
    left = [(i, 35 + rng.random() * 0.3, 139 + rng.random() * 0.3) for i in range(60)] + [(90, 10.0, 179.999), (91, 10.0, -179.999)]
    extra = [(9000, 1, 10.0, -179.9995), (9001, 1, 10.001, 179.9995)]
    out = S.within_radius(spark.createDataFrame(left, "i int, qlat double, qlon double"),
                          spark.createDataFrame(points + extra, "point_id int, kind int, lat double, lon double"), 900.0)
    got = {(r.i, r.point_id) for r in out.collect()}
    want = {(i, p[0]) for i, a, b in left for p in points + extra if km((a, b), (p[2], p[3])) * 1000 <= 900}
    assert got == want and (90, 9000) in got


def test_crowded_spot_is_cut_before_the_join(spark, world):
    """Copies at one coordinate are ranked before any pair is formed."""
    points, asks = world
    plan = S.k_nearest(spark.createDataFrame(points, "point_id int, kind int, lat double, lon double"),
                       spark.createDataFrame(asks, "ask_id int, kind int, qlat double, qlon double, k int"), 50) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def test_crowded_spots_meet_an_ask_with_no_more_points_than_it_lacks(spark, monkeypatch):
    """Forty stops at each of fifty places: an ask for fifty is joined with some fifty, not with forty copies of fifty places."""
    points = spark.createDataFrame([(100 * s + c, 0, 35.0 + s * 0.001, 139.0) for s in range(50) for c in range(40)],
                                   "point_id int, kind int, lat double, lon double")
    asks = spark.createDataFrame([(n, 0, 35.0 + n * 0.001, 139.0, 50) for n in range(20)], "ask_id int, kind int, qlat double, qlon double, k int")
    ranked, real = [], S.C.top_by
    monkeypatch.setattr(S.C, "top_by", lambda df, *rest: ranked.append(df) or real(df, *rest))
    found = S.k_nearest(points, asks, 50)
    assert max(r["count"] for r in ranked[-1].groupBy("ask_id").count().collect()) <= 70
    got = {}
    for r in found.collect():
        got.setdefault(r.ask_id, []).append((r.rank, r.point_id))
    for n in range(20):
        want = sorted((km((35.0 + n * 0.001, 139.0), (35.0 + s * 0.001, 139.0)), 100 * s + c) for s in range(50) for c in range(40))[:50]
        assert [p for _, p in sorted(got[n])][:40] == [p for _, p in want][:40] and len(got[n]) == 50


def test_groups_at_one_coordinate_share_a_search(spark, make_network, monkeypatch):
    net = make_network(lines=[dict(line_cd=1, e_status=0), dict(line_cd=2, e_status=2)],
                       stations=[dict(station_cd=i, station_g_cd=i, line_cd=1 + (i == 2), lat=35.0 + i * 0.01, lon=139.0, e_status=0, transport_type=1)
                                 for i in range(1, 5)])
    coords = spark.createDataFrame([(7, 35.0, 139.0), (8, 35.0, 139.0), (9, 36.0, 139.0)], "source_g_cd bigint, lat double, lon double")
    asked, real = [], S.k_nearest
    monkeypatch.setattr(S, "k_nearest", lambda points, asks, *rest: asked.append(asks.count()) or real(points, asks, *rest))
    got = sorted((r.source_g_cd, r["rank"], r.stop_cd) for r in S.bus_stops_near(net, coords, 3).collect())
    assert got == [(7, 1, 1), (7, 3, 3), (8, 1, 1), (8, 3, 3), (9, 1, 4), (9, 2, 3)]
    assert asked == [2]
