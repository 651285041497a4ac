import math
import random

import pytest
from pyspark.sql import functions as F

from netloom.functions import codes
from netloom.plans import build as B
from netloom.plans import patterns as P
from netloom.plans import stop_groups as G
from netloom.plans import stop_order as O


def fnv64(s):
    h = 0xcbf29ce484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001b3 % 2 ** 64
    return h


def test_hash_values(spark):
    df = spark.createDataFrame([("",), ("a",), ("東京駅",), ("toei:1001",)], "s string")
    got = {r.s: (r.h.hi << 32) + r.h.lo for r in df.select("s", codes.fnv1a64(F.col("s")).alias("h")).collect()}
    assert got[""] == 0xcbf29ce484222325 and got["a"] == 0xaf63dc4c8601ec8c
    assert all(v == fnv64(k) for k, v in got.items())
    mods = {r.s: r.m for r in df.select("s", codes.hash_mod(F.col("s"), 100_000_000).alias("m")).collect()}
    assert mods == {k: fnv64(k) % 100_000_000 for k in got}


@pytest.mark.parametrize("n,span", [(40, 47), (30, 30), (25, 400)])
def test_allocation_equals_probing_one_by_one(spark, n, span):
    rng = random.Random(n)
    names = [f"x{rng.randint(0, 60)}" for _ in range(n * 2)]
    names = names[:1] + [x for i, x in enumerate(names[1:], 1)]
    kept = list(dict.fromkeys(names))[:n]
    names = [x for x in names if x in kept]
    used, want = set(), {}
    for x in names:
        if x not in want:
            code = next(1000 + (fnv64(x) + k) % span for k in range(span) if 1000 + (fnv64(x) + k) % span not in used)
            used.add(code)
            want[x] = code
    df = spark.createDataFrame(list(enumerate(names)), "ord int, name string").repartition(5)
    got = {r.name: r.code for r in codes.allocate(df, "name", ["ord"], (1000, span)).collect()}
    assert got == want


def test_allocation_fails_when_full(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "ord int, name string")
    with pytest.raises(ValueError):
        codes.allocate(df, "name", ["ord"], (0, 4))


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def test_stop_groups_equal_greedy_clustering(spark):
    rng = random.Random(2)
    stops = [(f"s{i:03d}", rng.choice(["A", " A ", "B", "C"]), 35 + rng.randint(0, 14) * 0.0009,
              139 + rng.randint(0, 5) * 0.0011, None) for i in range(150)]
    stops += [("child", "A", 35.0, 139.0, "s005"), ("child2", "B", 35.0, 139.0, "s007")]
    df = spark.createDataFrame(stops, "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string")
    got = {r.stop_id: r.station_g_cd for r in G.stop_groups(df.repartition(4)).collect()}
    want, names = {}, {}
    for s in stops:
        if s[4] is None:
            if s[0] in ("s005", "s007"):
                want[s[0]] = s[0]
            else:
                names.setdefault(s[1].strip(), []).append(s)
    for members in names.values():
        clusters = []
        for s in sorted(members):
            home = next((c for c in clusters if all(metres(s[2:4], o[2:4]) <= 250 for o in c)), None)
            if home is None:
                clusters.append([s])
            else:
                home.append(s)
        for c in clusters:
            want.update({s[0]: min(x[0] for x in c) for s in c})
    assert got == {k: 200_000_000 + fnv64(v) % 100_000_000 for k, v in want.items()}


def test_stop_groups_at_and_beyond_the_pole_equal_all_pairs(spark):
    rng = random.Random(5)
    stops = [(f"p{i:02d}", "P", 89.994 + rng.randint(0, 12) * 0.001, rng.choice([-180.0, -90.0, 0.0, 45.0, 179.9, 540.0]), None) for i in range(40)]
    # The same place, written as one does and as the generated feeds have it.
    stops += [("q1", "Q", 85.0, -180.0, None), ("q2", "Q", 95.0, 0.0, None), ("q3", "Q", 125.0, 10.0, None), ("q4", "Q", 125.001, 10.0, None)]
    df = spark.createDataFrame(stops, "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string")
    assert df.select(F.max(F.size(G.geo.ball_cells(F.col("stop_lat"), F.col("stop_lon"), 500.0, around=True)))).first()[0] <= 8
    def place(s):
        la, lo = math.radians(s[2]), math.radians(s[3])
        return math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)

    def apart(s, o):
        return 2 * 6371000.0 * math.asin(min(1.0, math.dist(place(s), place(o)) / 2))

    clusters = {"P": [], "Q": []}
    for s in sorted(stops):
        home = next((c for c in clusters[s[1]] if all(apart(s, o) <= 250 for o in c)), None)
        home.append(s) if home else clusters[s[1]].append([s])
    want = {s[0]: 200_000_000 + fnv64(c[0][0]) % 100_000_000 for name in clusters for c in clusters[name] for s in c}
    assert len(clusters["Q"]) == 2
    assert {r.stop_id: r.station_g_cd for r in G.stop_groups(df).collect()} == want


def feed_frames(spark, trips, parents=None):
    """trips: (trip, route, direction, shape, [(seq, stop, dist)])."""
    parents = parents or {}
    ids = sorted({s for t in trips for _, s, _ in t[4]} | set(parents.values()))
    stops = spark.createDataFrame([(s, f"N{s}", None if s == "s1" else f"R{s}", parents.get(s), i) for i, s in enumerate(ids)],
                                  "stop_id string, stop_name string, stop_name_r string, parent_station string, ord bigint")
    t = spark.createDataFrame([(a, b, c, d, i) for i, (a, b, c, d, _) in enumerate(trips)],
                              "trip_id string, route_id string, direction_id int, shape_id string, ord bigint")
    times = spark.createDataFrame([(t[0], s, q, x) for t in trips for q, s, x in t[4]],
                                  "trip_id string, stop_id string, stop_sequence int, shape_dist_traveled double")
    return times, t, stops


def order_one_route(trips, parents):
    par = lambda s: parents.get(s, s)
    stops_of = lambda t: len({s for _, s, _ in t[4]})
    top = lambda t: max((x for _, _, x in t[4] if x is not None), default=None)
    far = lambda d: (0, -d) if d is not None else (1, 0)
    shapes = {}
    for t in trips:
        if t[3] is not None:
            g = shapes.setdefault((t[3], t[2]), [set(), None])
            g[0] |= {s for _, s, _ in t[4]}
            if top(t) is not None:
                g[1] = top(t) if g[1] is None else max(g[1], top(t))
    best = min(shapes, key=lambda k: (-len(shapes[k][0]), far(shapes[k][1]), {0: 0, None: 1}.get(k[1], 2), k[0]), default=(None, None))[0]
    main = min(trips, key=lambda t: (0 if t[3] is not None and t[3] == best else 1, 0 if t[2] == 0 else 1, -stops_of(t), far(top(t)), -len(t[4]), t[0]))
    seq = {}
    for q, s, _ in main[4]:
        seq[par(s)] = min(q, seq.get(par(s), q))
    ctx = {}
    for t in trips:
        if t is main:
            continue
        line = [par(s) for _, s, _ in sorted(t[4])]
        for i, p in enumerate(line):
            if p in seq:
                continue
            prev, nxt = line[i - 1] if i else None, line[i + 1] if i + 1 < len(line) else None
            rank = ((prev not in seq) + (nxt not in seq), sorted(t[4])[i][0], t[0])
            if p not in ctx or rank < ctx[p][0]:
                ctx[p] = (rank, t[2], prev, nxt)

    def chain(p, side):
        depth, cur, seen = 1, ctx[p][side], {p}
        while cur is not None:
            if cur in seq:
                return seq[cur], depth
            if cur in seen or cur not in ctx:
                return None
            seen.add(cur)
            cur, depth = ctx[cur][side], depth + 1
        return None

    pos = {p: float(q) for p, q in seq.items()}
    last = max(seq.values())
    for p, (_, d, prev, nxt) in ctx.items():
        sg = 1 if d is None or (main[2] is not None and d == main[2]) else -1
        a, b = seq.get(prev), seq.get(nxt)
        if a is not None and b is not None:
            v = (a + b) / 2
        elif a is not None:
            v = a + sg * 0.5
        elif b is not None:
            v = b - sg * 0.5
        else:
            ca, cb = chain(p, 2), chain(p, 3)
            if ca and cb:
                v = (ca[0] + cb[0]) / 2 + (ca[1] - cb[1]) * 0.01
            elif ca:
                v = ca[0] + sg * 0.1 * ca[1]
            elif cb:
                v = cb[0] - sg * 0.1 * cb[1]
            elif nxt is None:
                v = last + 0.5 if sg == 1 else 0.5
            elif prev is None:
                v = 0.5 if sg == 1 else last + 0.5
            else:
                v = last + 9999.0
        pos[p] = v
    ordered = sorted(pos, key=lambda p: (round(pos[p], 9), p))
    return {p: i + 1 for i, p in enumerate(ordered)}


@pytest.mark.parametrize("seed", [1, 2])
def test_stop_order_equals_route_by_route(spark, seed):
    rng = random.Random(seed)
    trips, parents = [], {"s3": "s2", "s9": "s8"}
    for r in range(12):
        for t in range(rng.randint(1, 5)):
            stops = [f"s{rng.randint(1, 22)}" for _ in range(rng.randint(2, 9))]
            seqs = sorted(rng.sample(range(1, 40), len(stops)))
            trips.append((f"t{r}-{t}", f"r{r}", rng.choice([0, 1, None]), rng.choice([None, f"h{r}a", f"h{r}b"]),
                          [(q, s, rng.choice([None, float(q)])) for q, s in zip(seqs, stops)]))
    times, t, stops = feed_frames(spark, trips, parents)
    positions = O.stop_route_positions(times, t, stops, chunk=5).withColumn("position", F.round("position", 9))
    got = {}
    for r in O.renumber(positions).collect():
        got.setdefault(r.route_id, {})[r.parent] = r.stop_order
    for r in range(12):
        mine = [x for x in trips if x[1] == f"r{r}"]
        assert got[f"r{r}"] == order_one_route(mine, parents), f"r{r}"


def test_patterns_fold_both_ways_and_name_loops(spark):
    trips = [("t1", "r", 0, "a", [(1, "s1", None), (2, "s2", None), (3, "s3", None)]),
             ("t2", "r", 1, "b", [(1, "s3", None), (2, "s2", None), (3, "s1", None)]),
             ("t3", "r", 0, "loop1", [(1, "s2", None), (2, "s4", None), (3, "s5", None), (4, "s6", None), (5, "s2", None)]),
             ("t4", "r", 0, "loop2", [(1, "s2", None), (2, "s4", None), (3, "s7", None), (4, "s6", None), (5, "s2", None)]),
             ("t5", "r", 1, "c", [(1, "s3", None), (2, "s2", None)]), ("t6", "r", 1, "d", [(1, "s2", None), (2, "s3", None), (4, "s8", None)])]
    times, t, stops = feed_frames(spark, trips)
    t = t.withColumn("trip_headsign", F.when(F.col("shape_id").startswith("loop"), "Park").otherwise("Ns3"))
    routes = spark.createDataFrame([("r", "R1", None, None, "00FF00", 1)], "route_id string, route_short_name string, route_long_name string,"
                                   "route_long_name_r string, route_color string, ord bigint")
    got = {r.shape_id: r for r in P.service_patterns(times, t, stops, routes).collect()}
    assert set(got) == {"a", "loop1", "loop2", "c", "d"}
    assert got["a"].direction == 0 and got["a"].both_ways and got["a"].type_name == "Ns1 ⇔ Ns3" and got["a"].type_name_r == "Rs3"
    assert got["loop1"].type_name == "Park（Ns5経由・循環）" and got["loop1"].type_name_r == "Rs2 via Rs5 (Loop)"
    assert got["loop2"].type_name == "Park（Ns7経由・循環）"
    assert got["c"].type_name == "Ns3" and got["d"].type_name == "Ns2 → Ns3" and got["c"].color == "#00FF00"
    rows = {(r.shape_id, r.parent): r.seq for r in P.pattern_stop_rows(P.service_patterns(times, t, stops, routes), times, stops).collect()}
    assert rows[("loop1", "s2")] == 1


def test_repeated_names_get_their_stop_count(spark):
    trips = [("t1", "r", 0, "a", [(1, "s1", None), (2, "s2", None), (3, "s9", None)]), ("t2", "r", 0, "b", [(1, "s1", None), (2, "s9", None)])]
    times, t, stops = feed_frames(spark, trips)
    t = t.withColumn("trip_headsign", F.lit("Ns9"))
    routes = spark.createDataFrame([("r", "R1", None, None, None, 1)], "route_id string, route_short_name string, route_long_name string,"
                                   "route_long_name_r string, route_color string, ord bigint")
    got = {r.shape_id: (r.type_name, r.type_name_r, r.color) for r in P.service_patterns(times, t, stops, routes).collect()}
    assert got["a"][0] == "Ns1 → Ns9" and got["b"][0] == "Ns1 → Ns9 (2停)" and got["b"][1] == "Rs9 (2 stops)" and got["b"][2] == "#000000"


def test_virtual_services_need_both_local_types(make_network):
    net = make_network(types=[dict(id=1, type_cd=100)])
    with pytest.raises(ValueError):
        B.virtual_local_services(net)


def test_virtual_services(make_network):
    net = make_network(
        types=[dict(id=1, type_cd=100), dict(id=2, type_cd=101)],
        lines=[dict(line_cd=1, e_status=0, transport_type=0), dict(line_cd=99301, e_status=0, transport_type=0), dict(line_cd=3, e_status=2, transport_type=0)],
        stations=[dict(station_cd=12, line_cd=1, e_status=0, e_sort=2, transport_type=0), dict(station_cd=11, line_cd=1, e_status=0, e_sort=1, transport_type=0),
                  dict(station_cd=13, line_cd=1, e_status=2, e_sort=3, transport_type=0), dict(station_cd=21, line_cd=99301, e_status=0, e_sort=1, transport_type=0),
                  dict(station_cd=31, line_cd=3, e_status=0, e_sort=1, transport_type=0)],
        station_station_types=[dict(id=1, station_cd=11, type_cd=101, line_group_cd=5, **{"pass": 0}), dict(id=2, station_cd=11, type_cd=100, line_group_cd=6, **{"pass": 0})])
    out = [tuple(r) for r in B.virtual_local_services(net).sst.orderBy("id").collect()]
    assert out[2:] == [(3, 11, 100, 1000000001, 0), (4, 12, 100, 1000000001, 0), (5, 21, 101, 1000099301, 0)]


def test_an_integrated_feed_makes_only_what_is_read(spark, make_network):
    trips = [("toei:t1", "toei:1", 0, "sh1", [(1, "s1", 0.0), (2, "s2", 1.0), (3, "s3", 2.0)]),
             ("toei:t2", "toei:1", 1, "sh2", [(1, "s3", 0.0), (2, "s4", 1.0)]), ("x:t3", "x:9", 0, "sh3", [(1, "s2", 0.0), (2, "s5", 1.0)])]
    times, trip_table, stops = feed_frames(spark, trips, {"s5": "s4"})
    stops = stops.withColumns({"stop_lat": F.lit(35.0) + F.col("ord"), "stop_lon": F.lit(139.0), **{
        c: F.lit(None).cast("string") for c in ("stop_name_k", "stop_name_zh", "stop_name_ko")}})
    routes = spark.createDataFrame([("toei:1", "R1", None, None, 3, None, 1), ("x:9", "R9", None, None, 3, None, 2)],
                                   "route_id string, route_short_name string, route_long_name string, route_long_name_r string, route_type int, route_color string, ord bigint")
    trip_table = trip_table.withColumn("trip_headsign", F.lit(None).cast("string"))
    net = make_network(lines=[{"line_cd": 7, "line_name": "old"}], types=[{"id": 1, "type_cd": 100}],
                       station_station_types=[{"id": 1, "station_cd": 5, "type_cd": 100, "line_group_cd": 3, "pass": 1}])
    unread = times.withColumn("stop_sequence", F.raise_error(F.lit("read")).cast("int"))
    lines = B.integrate_feed(net, B.Feed(routes, stops, trip_table, unread)).lines
    code = 100_000_000 + fnv64("toei:1") % 10_000_000
    assert sorted((r.line_cd, r.line_name) for r in lines.collect()) == [(7, "old"), (code, "R1")]
    whole = B.integrate_feed(net, B.Feed(routes, stops, trip_table, times))
    pairs = [("s1", "toei:1"), ("s2", "toei:1"), ("s3", "toei:1"), ("s4", "toei:1"), ("s2", "x:9"), ("s4", "x:9")]
    stations = {200_000_000 + fnv64(f"{s}-{r}") % 100_000_000: r for s, r in pairs}
    assert {r.station_cd for r in whole.stations.collect()} == set(stations)
    got = whole.sst.orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, len(got) + 1)) and got[0].station_cd == 5
    assert {r.station_cd for r in got[1:]} <= set(stations)
    assert {r.type_cd for r in got} == {r.type_cd for r in whole.types.collect()}
