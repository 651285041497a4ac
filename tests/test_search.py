import pytest
from pyspark.sql import functions as F

from netloom.operators import lookup as L


def test_substrings_match_exactly(spark):
    values = [("f", v) for v in ["東京", "京都", "東京駅前", "aab", "abab", "ab%c_", "x"]]
    needles = [("f", n) for n in ["東京", "京", "ab", "aba", "%", "_", "zz", "東京駅前"]] + [("g", "x")]
    index = L.name_index(spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate([*values, ("f", ""), ("f", None)])], "key int, field string, value string"))
    got = {(r.value, r.needle) for r in L.substring_matches(index, spark.createDataFrame(needles, "field string, needle string")).collect()}
    assert got == {(v, n) for f, v in values for g, n in needles if f == g and n in v}


def test_line_search_limits_and_blank_query(spark, make_network):
    names = {1: "Loop", 2: "Loop East", 3: "Main", 4: "Closed Loop"}
    net = make_network(lines=[dict(line_cd=k, line_name=v, e_status=2 if k == 4 else 0) for k, v in names.items()])
    req = spark.createDataFrame([(1, "Loop", 5), (2, "Loop", None), (3, "", 2), (4, "Ｍain", 1), (5, "loop", 9)], "req_id int, name string, limit int")
    got = sorted((r.req_id, r["rank"], r.line_cd) for r in L.search_lines(net, req).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (3, 1, 1), (3, 2, 2), (4, 1, 3)]


def test_a_kept_index_is_all_a_search_reads(spark, make_network, monkeypatch):
    net = make_network(lines=[dict(line_cd=k, line_name=v, e_status=0) for k, v in {1: "Loop", 2: "Loop East", 3: "Main"}.items()],
                       stations=[dict(station_cd=10 + k, station_g_cd=k, line_cd=k, station_name=f"Stop {k}", e_status=0) for k in (1, 2, 3)])
    kept = L.with_names(net)
    req = spark.createDataFrame([(1, "Stop"), (2, "2"), (3, "none")], "req_id int, name string")
    want = sorted((r.req_id, r.station_cd) for r in L.search_stations(net, req).collect())
    monkeypatch.setattr(L, "name_index", lambda keys: pytest.fail("built again"))
    assert sorted((r.req_id, r.station_cd) for r in L.search_stations(kept, req).collect()) == want == [(1, 11), (1, 12), (1, 13), (2, 12)]
    assert [r.line_cd for r in L.search_lines(kept, spark.createDataFrame([(1, "East", 1)], "req_id int, name string, limit int")).collect()] == [2]


def test_unanswerable_requests_are_split_off(spark):
    req = spark.createDataFrame([(1, 5, 3), (2, -1, 3), (3, 2, None), (4, 1, -9)], "req_id int, id int, limit int")
    ok, bad = L.validate_requests(req, ["id", "limit"])
    assert sorted(r.req_id for r in ok.collect()) == [1, 3]
    assert {r.req_id: r.rejected_argument for r in bad.collect()} == {2: "id", 4: "limit"}


def test_line_hits_beyond_every_limit_are_pruned_before_the_shuffle(spark, make_network):
    net = make_network(lines=[dict(line_cd=k, line_name=f"Loop {k}", e_status=0) for k in range(9, 0, -1)])
    out = L.search_lines(net, spark.createDataFrame([(1, "loop", 3), (2, "Loop", None), (3, "LOOP", 0), (4, "Loop", 20)], "req_id int, name string, limit int"))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.req_id, r.rank, r.line_cd) for r in out.collect())
    assert got == [(2, 1, 1), *((4, k, k) for k in range(1, 10))]


def test_stations_are_ranked_by_name_or_met_from_the_origin(spark, make_network):
    """Requests of one name share a ranking; requests with an origin are not joined with all hits of their name."""
    import itertools
    net = make_network(
        lines=[dict(line_cd=k, line_name=f"L{k}", e_status=0) for k in (1, 2, 3)], types=[dict(id=1, type_cd=1, kind=0, priority=0)],
        stations=[dict(station_cd=c, station_g_cd=c // 2, line_cd=1 + c % 3, station_name=f"Stop {c}", station_name_rn=f"Stop {c}", e_status=0,
                       transport_type=c % 2) for c in range(12)],
        station_station_types=[dict(id=10 + n, station_cd=c, type_cd=1, line_group_cd=g, **{"pass": p})
                               for n, (c, g, p) in enumerate([(0, 5, 1), (3, 5, 0), (4, 5, 1), (6, 5, 0), (7, 6, 0), (3, 6, 0), (9, None, 0)])])
    texts, froms, limits, kinds = ["stop", "Stop 1", "9", "none"], [None, 0, 1, 4], [None, 2], ["RailAndBus", "Rail", None]
    asked = list(enumerate(itertools.product(texts, froms, limits, kinds)))
    req = spark.createDataFrame([(i, *x) for i, x in asked], "req_id int, name string, from_group bigint, limit int, transport string")
    got = {}
    for r in L.search_stations(net, req).collect():
        got.setdefault(r.req_id, []).append((r["rank"], r.station_cd, r.line_group_cd))
    rows = [r.asDict() for r in sorted(net.sst.collect(), key=lambda r: r.id)]
    typed = {r["station_cd"] for r in rows}
    for i, (name, start, limit, kind) in asked:
        want = []
        for c in range(12):
            if name.lower() not in f"stop {c}" or kind == "Rail" and c % 2:
                continue
            group = None
            if start is not None:
                mine = [s for s in range(12) if s // 2 == start]
                known = {r["line_group_cd"] for r in rows if r["station_cd"] in mine} - {None}
                group = next((r["line_group_cd"] for r in rows if r["station_cd"] == c and r["pass"] != 1 and r["line_group_cd"] in known), None)
                same = [s for s in mine if s % 3 == c % 3]
                if group is None and not (same and (c not in typed or any(s not in typed for s in same))):
                    continue
            want.append((c, group))
        assert sorted(got.get(i, [])) == [(n + 1, *w) for n, w in enumerate(want[:limit])], asked[i]
    plan = L.search_stations(net, req)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(name#" in plan
