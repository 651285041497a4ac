"""Requests meet narrow pattern rows before wide columns are joined."""

import pytest

from netloom.operators import eta, routes
from netloom.operators import lookup as L


@pytest.fixture(scope="module")
def net(make_network):
    """Five patterns of four stops each, every one on a line of its own."""
    stations = [dict(station_cd=100 * g + i, station_g_cd=100 * g + i, line_cd=g, e_status=0, e_sort=i, lat=35 + i / 100, lon=139 + g / 100,
                     transport_type=0, station_name=f"s{g}{i}") for g in range(1, 6) for i in range(4)]
    return make_network(
        companies=[dict(company_cd=1, e_status=0)],
        lines=[dict(line_cd=g, company_cd=1, line_type=2, line_name=f"l{g}", e_status=0) for g in range(1, 6)],
        stations=stations, types=[dict(id=1, type_cd=7, type_name="local", kind=0, priority=1)],
        station_station_types=[dict(id=100 * g + i, station_cd=100 * g + i, type_cd=7, line_group_cd=g, **{"pass": 0}) for g in range(1, 6) for i in range(4)])


@pytest.fixture
def met(monkeypatch):
    """Pattern rows that reach the joins with types and stations, call by call."""
    seen = []
    for name in ("typed_patterns", "pattern_line_stops"):
        plain = getattr(L, name)

        def watched(n, plain=plain):
            seen.append(sorted({r.line_group_cd for r in n.sst.select("line_group_cd").collect()}))
            return plain(n)

        monkeypatch.setattr(L, name, watched)
    return seen


def cases(spark):
    one = lambda *row, cols: spark.createDataFrame([row], cols)
    lists = one(1, [2, 2], cols="req_id int, line_group_cds array<bigint>")
    at = one(1, [201, 202], cols="req_id int, station_cds array<bigint>")
    ends = one(1, 200, 202, cols="req_id int, from_group bigint, to_group bigint")
    ride = one(1, 200, 203, 0, cols="req_id int, from_station bigint, to_station bigint, direction int")
    none = spark.createDataFrame([], "line_cd bigint, kind int, kmh double")
    return {
        "stations_by_line_group": (lambda n: [L.stations_by_line_group(n, lists)], [8]),
        "stations_by_line_groups": (lambda n: [L.stations_by_line_groups(n, lists)], [8]),
        "stations_by_group": (lambda n: [L.stations_by_group(n, one(1, 201, cols="req_id int, station_g_cd bigint"))], [1]),
        "line_stations": (lambda n: [L.line_stations(n, one(1, 2, None, 1, cols="req_id int, line_cd bigint, station_cd bigint, direction int"))], [4]),
        "lines_by_line_group": (lambda n: [L.lines_by_line_group(n, lists)], [8]),
        "lines_by_line_group_routes": (lambda n: [L.lines_by_line_group_routes(n, lists)], [4]),
        "train_types_by_station": (lambda n: [L.train_types_by_station(n, at)], [2]),
        "train_types_by_line_group": (lambda n: [L.train_types_by_line_group(n, lists)], [4]),
        "route_stops_by_station": (lambda n: [L.route_stops_by_station(n, ride)], [4]),
        "routes": (lambda n: routes.routes(n, ends), [4, 1]),
        "route_types": (lambda n: routes.route_types(n, ends), [1, 1]),
        "arrival_times": (lambda n: [eta.arrival_times(n, ride, none)], [4]),
        "train_route": (lambda n: eta.train_route(n, one(1, 2, 200, 203, cols="req_id int, line_group_cd bigint, from_station bigint, to_station bigint"), none), [4, 0]),
    }


@pytest.mark.parametrize("name", ["stations_by_line_group", "stations_by_line_groups", "stations_by_group", "line_stations", "lines_by_line_group",
                                  "lines_by_line_group_routes", "train_types_by_station", "train_types_by_line_group",
                                  "route_stops_by_station", "routes", "route_types", "arrival_times", "train_route"])
def test_only_asked_patterns_are_joined(spark, net, met, name):
    run, sizes = cases(spark)[name]
    assert [df.count() for df in run(net)] == sizes
    assert met and all(m == [2] for m in met)


def test_null_and_unknown_keys(spark, net):
    req = spark.createDataFrame([(1, None), (2, 99), (3, 2)], "req_id int, line_group_cd bigint")
    assert {r.req_id for r in L.stations_by_line_group(net, req).collect()} == {3}
    assert L.asked_rows(net, req.limit(0)).sst.count() == 0


def test_a_patterns_rows_are_complete_before_they_are_repeated(spark, make_network):
    from netloom.operators import enrich as N
    net = make_network(stations=[dict(station_cd=c, station_g_cd=c, line_cd=1, e_status=0) for c in (1, 2)],
                       lines=[dict(line_cd=1, company_cd=3, line_name="a", e_status=0)], companies=[dict(company_cd=3, company_name="c")],
                       types=[dict(id=1, type_cd=1, kind=0, priority=0)],
                       station_station_types=[dict(id=i, station_cd=i, type_cd=1, line_group_cd=5) for i in (1, 2)])
    _, lines = N.station_train_types(net, spark.createDataFrame([(7, 1), (8, 2), (9, 1)], "req_id bigint, station_cd bigint"))
    got = sorted((r.req_id, r.tt_id, r.sst_id, r.company_name, r.line_type_sst) for r in lines.collect())
    assert got == [(q, t, s, "c", 1) for q, t in ((7, 1), (8, 2), (9, 1)) for s in (1, 2)]
    joins = [x for x in lines._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in x]
    assert "Join Inner" in joins[0]  # the last join is the one with the requests' train types


def test_shown_types_join_a_patterns_rows_before_rides_repeat_them(spark, net):
    req = spark.createDataFrame([(1, 2, 200, 203)], "req_id int, line_group_cd bigint, from_station bigint, to_station bigint")
    none = spark.createDataFrame([], "line_cd bigint, kind int, kmh double")
    bounded = net.with_tables(bounds={"pattern": 10})  # no step is written, so the plan is whole
    plan = eta.train_route(bounded, req, none)[0]._jdf.queryExecution().analyzed().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    joins = []
    for i, line in enumerate(plan):
        if "Join LeftOuter" in line:
            end = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))
            joins.append("\n".join(plan[i:end]))
    shown = [j for j in joins if "max_by(kind" in j]
    assert shown and any("Generate explode(sequence" not in j for j in shown)
