"""A cross-section of the demo queries against their SQL oracles on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from demo.adapter import TABLES
from demo.check import compare

SF = "/root/testdata/sf0.001"
NAMES = ["stations_nearby", "search_stations", "line_stations", "stations_by_line_groups", "routes", "route_types",
         "arrival_times", "train_route", "enrich_group_stations", "stop_route_order", "service_patterns",
         "virtual_local_services", "usable_trips"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    result, _, _ = compare(spark, con, SF, name)
    assert result.startswith("ok"), result


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"req_id", "station_cd", "rank", "distance"} <= set(df.columns) and df.count() > 0
