import json

import pytest
from pyspark.sql import functions as F

from netloom.operators import integrity as I
from netloom.sources import geometry, gtfs, master, odpt, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


@pytest.fixture()
def folder(tmp_path):
    write(tmp_path / "1!companies.csv", "company_cd,company_name,#note,unknown\n1,A,x,y\n1,B,x,y\nbad,C,x,y\n")
    write(tmp_path / "2!lines.csv", "line_cd,company_cd,line_name,line_name_k,line_name_h,average_distance,e_status\n7,1,L,LK,LH,1066.84,0\n8,1,M,MK,,,x\n")
    write(tmp_path / "3!stations.csv", 'station_cd,station_g_cd,station_name,station_name_k,line_cd,lon,lat,e_status,e_sort\n'
          '71,1,"S, one",SK,7, 139.5 ,35.1,0,1\n72,2,T,TK,7,,35.2,0,2\n')
    write(tmp_path / "4!types.csv", "id,type_cd,type_name,type_name_k,color,kind\n9,300,Local,L,#1,0\n8,200,Rapid,R,#2,2\n")
    write(tmp_path / "5!station_station_types.csv", "id,station_cd,type_cd,line_group_cd,pass\n,71,300,5,0\n,72,999,5,\n,abc,300,,1\n")
    write(tmp_path / "6!aliases.csv", "id,line_name\n1,AL\n")
    write(tmp_path / "7!line_aliases.csv", "id,station_cd,alias_cd\n1,71,1\n")
    return str(tmp_path)


def test_master_files(spark, folder):
    net = master.load_master(spark, folder)
    assert [(r.company_cd, r.company_name) for r in net.companies.where("company_cd is not null").collect()] == [(1, "A")]
    lines = {r.line_cd: r for r in net.lines.collect()}
    assert lines[7].average_distance == pytest.approx(1066.84, abs=1e-4) and lines[7].average_distance != 1066.84
    assert lines[8].line_name_h is None and lines[8].transport_type == 0 and lines[8].e_status is None
    assert [(r.id, r.type_cd) for r in net.types.orderBy("id").collect()] == [(1, 300), (2, 200)]
    assert [(r.id, r.station_cd, r.line_group_cd, r["pass"]) for r in net.sst.orderBy("id").collect()] == [
        (1, 71, 5, 0), (2, 72, 5, None), (3, None, None, 1)]
    assert I.serial_gaps(net.sst).first().gap_free
    problems = {(r.id, r.problem) for r in I.validate_fk(net).collect()}
    assert problems == {(2, "unknown type_cd"), (3, "unparsable station_cd")}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_snapshot_round_trip(spark, folder, tmp_path, fmt):
    net = master.load_master(spark, folder)
    sinks.write_snapshot(net, str(tmp_path / "out"), fmt)
    back = master.read_snapshot(spark, str(tmp_path / "out"), fmt)
    stations = back.stations.collect()
    assert [(s.station_cd, s.station_name, s.lon, s.post) for s in stations] == [(71, "S, one", 139.5, "")]  # no coordinate, no station
    assert {r.line_cd: (r.line_name_h, r.e_status) for r in back.lines.collect()} == {7: ("LH", 0), 8: ("", 0)}
    assert I.snapshot_problems(back.tables()) == []
    assert I.snapshot_problems({"lines": back.lines.drop("line_name")}) != []


def test_order_check(spark, make_network):
    net = make_network(stations=[dict(station_cd=c, line_cd=99301, e_sort=s, e_status=0) for c, s in
                                 [(9930100, 1), (9930102, 2), (9930128, 3), (9930101, 4), (9930129, 5), (9930103, 6)]])
    expected = lambda runs: spark.createDataFrame([(i, line, cds) for i, (line, cds) in enumerate(runs)], "run_id int, line_cd bigint, station_cds array<bigint>")
    assert I.validate_order(net.stations, expected(I.EXPECTED_RUNS)).collect() == []
    bad = I.validate_order(net.stations, expected([(99301, [9930102, 9930101]), (99301, [1, 2]), (99301, [9930129, 9930101])])).collect()
    assert {(r.run_id, r.problem) for r in bad} == {(0, "stations are not consecutive"), (1, "first station missing"), (2, "stations are not consecutive")}


def test_feeds(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d, n in ((a, "1"), (b, "2")):
        write(d / "routes.txt", f"route_id,agency_id,route_short_name,route_long_name,route_desc,route_type,url,color\n{n},x,S{n},,d,x,u,00FF00\n{n},x,DUP,,d,3,u,\n")
        write(d / "stops.txt", "stop_id,code,stop_name,desc,lat,lon,zone,url,type,parent_station\n"
              "10-01,c,西八王子駅南口,d,35.5,bad,z,u,0,10\n10,c,西八王子,d,35.5,139.1,z,u,1,\n11,c,無名,d,35,139,z,u,0,77\n")
        write(d / "trips.txt", f"route_id,service_id,trip_id,headsign,short,direction_id,block,shape_id\n{n},s,t1,H,,1,,sh\nnone,s,t2,,,,,\n")
        write(d / "stop_times.txt", "trip_id,arr,dep,stop_id,seq,head,p,d,dist\nt1,8:00,8:00,10-01,1,,,,\nt1,8:01,8:01,11,2,,,,1.5\nt1,8:01,8:01,10,2,,,,9\nt9,8:01,8:01,11,1,,,,\n")
    write(a / "translations.txt", "table_name,field_name,language,translation,record_id,record_sub_id,field_value\n"
          "stops,stop_name,ja-Hrkt,ﾆｼﾊﾁｵｳｼﾞ,10-02,,\nstops,stop_name,en,First,10-01,,\nstops,stop_name,en,Second,10-03,,\n"
          "stops,stop_name,en,South,10-01,,\nstops,stop_name,ko,니시,,,無名\ntrips,x,en,no,10,,\n")
    write(b / "translations.txt", "table_name,field_name,language,translation\nstops,stop_name,en,ignored\n")
    feed = gtfs.read_feeds(spark, {"toei": str(a), "keio": str(b)}).cleaned()
    routes = {r.route_id: r for r in feed.routes.collect()}
    assert set(routes) == {"toei:1", "keio:2"} and routes["toei:1"].route_short_name == "S1" and routes["toei:1"].route_type == 3
    stops = {r.stop_id: r for r in feed.stops.collect()}
    parent = stops["toei:10"]
    assert parent.stop_name_r == "First" and parent.stop_name_k == "ニシハチオウジ"  # shortened keys: the first child wins
    child = stops["toei:10-01"]
    assert child.stop_name_r == "South" and child.stop_lon == 0.0 and child.parent_station == "toei:10"
    assert stops["toei:11"].stop_name_ko == "니시" and stops["toei:11"].parent_station is None
    assert stops["keio:10"].stop_name_r is None
    assert {r.trip_id for r in feed.trips.collect()} == {"toei:t1", "keio:t1"}
    times = {(r.trip_id, r.stop_sequence): r.stop_id for r in feed.stop_times.collect()}
    assert times[("toei:t1", 2)] == "toei:11" and len(times) == 4


def test_timetable_json(spark, tmp_path):
    op = odpt.OPERATOR
    pat = [{"owl:sameAs": "odpt.BusroutePattern:TokyuBus.A.1", "dc:title": "渋41 大井町", "odpt:operator": op, "odpt:busroute": "odpt.Busroute:TokyuBus.A", "odpt:direction": "1"},
           {"owl:sameAs": "odpt.BusroutePattern:TokyuBus.C.1", "dc:title": "x", "odpt:operator": op, "odpt:busroute": "odpt.Busroute:TokyuBus.Sanma"},
           {"owl:sameAs": "odpt.BusroutePattern:Other.1", "dc:title": "x", "odpt:operator": "odpt.Operator:Other", "odpt:busroute": "o:z"}]
    poles = [{"owl:sameAs": "odpt.BusstopPole:P1", "dc:title": "渋谷", "odpt:kana": "しぶや", "odpt:operator": [op, "x"], "geo:lat": 35.0, "geo:long": 139.0},
             {"owl:sameAs": "odpt.BusstopPole:P2", "dc:title": "目黒", "odpt:operator": op}, {"owl:sameAs": "odpt.BusstopPole:P3", "dc:title": "他", "odpt:operator": ["x"]}]
    obj = lambda i, p, a=None, d=None, s=None: {"odpt:index": i, "odpt:busstopPole": f"odpt.BusstopPole:{p}", "odpt:arrivalTime": a, "odpt:departureTime": d, "odpt:destinationSign": s}
    tts = [{"owl:sameAs": "odpt.BusTimetable:T1", "odpt:operator": op, "odpt:busroutePattern": "odpt.BusroutePattern:TokyuBus.A.1",
            "odpt:busTimetableObject": [obj(1, "P1", d="08:30"), obj(2, "P2", a="8:35", s="大井町駅"), obj(3, "P1", a="bad"), obj(4, "P9", a="9:00"), obj(5, "P1")]},
           {"owl:sameAs": "odpt.BusTimetable:T2", "odpt:operator": op, "odpt:busroutePattern": "odpt.BusroutePattern:TokyuBus.C.1", "odpt:busTimetableObject": []}]
    frames = []
    for name, data, schema in [("p", pat, odpt.PATTERN), ("s", poles, odpt.POLE), ("t", tts, odpt.TIMETABLE)]:
        write(tmp_path / f"{name}.json", json.dumps(data, ensure_ascii=False))
        frames.append(odpt.read_odpt(spark, str(tmp_path / f"{name}.json"), schema))
    feed = odpt.odpt_to_gtfs(*frames).cleaned()
    assert [(r.route_id, r.route_short_name, r.route_color) for r in feed.routes.collect()] == [("tokyu_json:TokyuBus.A", "渋41", "DD1133")]
    assert {r.stop_id: (r.stop_name_k, r.stop_name_r, r.stop_lat) for r in feed.stops.collect()} == {
        "tokyu_json:P1": ("シブヤ", "Shibuya", 35.0), "tokyu_json:P2": ("", None, 0.0)}
    assert [(r.trip_id, r.trip_headsign, r.direction_id, r.shape_id) for r in feed.trips.collect()] == [
        ("tokyu_json:T1", "大井町駅", 0, "tokyu_json:TokyuBus.A.1")]
    assert [(r.stop_sequence, r.stop_id) for r in feed.stop_times.orderBy("stop_sequence").collect()] == [(1, "tokyu_json:P1"), (2, "tokyu_json:P2")]


def test_weekday_services(spark):
    trips = spark.createDataFrame([("a",), ("b",)], "service_id string")
    cal = spark.createDataFrame([("a", "1", "1", "1", "1", "1"), ("b", "1", "0", "1", "1", "1")], "service_id string, " + ", ".join(f"{d} string" for d in gtfs.WEEKDAYS))
    names = lambda df: sorted(r.service_id for r in df.collect())
    assert names(gtfs.weekday_services(cal, trips)) == ["a"]
    assert names(gtfs.weekday_services(None, trips)) == ["a", "b"]


def test_header_read_and_geometry(spark, tmp_path):
    write(tmp_path / "stops.txt", "﻿stop_id,stop_name\n1,A\n")
    assert gtfs.read_full(spark, str(tmp_path), "stops.txt").select("stop_id").first()[0] == "1"
    write(tmp_path / "g.json", json.dumps({"elements": [{"type": "relation", "id": 5, "tags": {"name": "L"}, "members": [
        {"type": "way", "ref": 1, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]}, {"type": "node", "ref": 2}]}, {"type": "node", "id": 6}]}))
    got = [tuple(r) for r in geometry.read_ways(spark, str(tmp_path / "g.json")).orderBy("vertex_ord").collect()]
    assert got == [(5, "L", 0, 0, 1.0, 2.0), (5, "L", 0, 1, 1.5, 2.5)]


def test_update_and_merge(spark):
    t = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, None)], "k int, v double")
    out, changed = sinks.update_column(t, spark.createDataFrame([(1, 5.0), (3, 7.0), (9, 1.0)], "k int, v double"), "k", "v")
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, 5.0), (2, 6.0), (3, 7.0)] and changed.first()[0] == 1


def test_feeds_are_told_apart_and_files_are_optional(spark, tmp_path):
    header = "route_id,agency_id,route_short_name,route_long_name,route_desc,route_type,route_url,route_color\n"
    for folder, route in (("a/bus", "1"), ("bus", "2"), ("with space", "3")):
        path = tmp_path / folder
        path.mkdir(parents=True)
        (path / "routes.txt").write_text(header + f"{route},,S{route},,,3,,\n")
    feeds = {"x": str(tmp_path / "bus"), "y": str(tmp_path / "a/bus"), "z": str(tmp_path / "with space"), "gone": str(tmp_path / "none")}
    got = gtfs.read_routes(spark, feeds).orderBy("ord").collect()
    assert [(r.route_id, r.route_short_name) for r in got] == [("x:2", "S2"), ("y:1", "S1"), ("z:3", "S3")]
    assert gtfs.read_translations(spark, feeds).count() == 0
    assert gtfs.read_stops(spark, {"gone": feeds["gone"]}, None).count() == 0
