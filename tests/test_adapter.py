from demo import adapter
from demo.lookups import decode_enums
from netloom.operators import common as C
from netloom.operators import lookup as L

SF = "/root/testdata/sf0.001"


def test_a_query_writes_only_the_tables_it_reads(spark, monkeypatch):
    written, write = [], C.materialize
    monkeypatch.setattr(adapter, "_NETWORKS", {})
    monkeypatch.setattr(C, "materialize", lambda df, name="cut", *a: written.append(name) or write(df, name, *a))
    assert decode_enums(spark, SF).count() == 200 and decode_enums(spark, SF).count() == 200
    assert sorted(written) == ["companies", "lines"]


def test_replaced_tables_do_not_reach_the_shared_network(spark):
    net = adapter.build_network(spark, SF)
    fewer = net.with_tables(station_station_types=net.sst.where("id <= 10"))
    assert fewer.sst.count() == 10 < net.sst.count()
    assert fewer.stations is net.stations and fewer.bound("line") == net.bound("line") == C.largest_group(net.stations, ["line_cd"])
    assert net.with_tables(bounds=None).bound("line") is None and net.with_tables(bounds={"line": 3}).bound("line") == 3
    assert set(L.measure_bounds(net)) == {"pattern", "line", "group"}
