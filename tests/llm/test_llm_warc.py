import gzip
import hashlib
import json
import zlib
from pathlib import Path

import duckdb
import pytest

from netloom.llm import warc
from netloom.llm.sql import WARC

BIG = "<p>" + "é" * 600 + "</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2 x\r\nWARC-Type: evil", BIG), (7, None, BIG), (7, None, BIG), (3, "u", "small"), (4, "u", "small"),
         (5, "u", None), (6, "u", ""), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 90),
         (None, "u", BIG), (None, "u", "n" * 2000), (13, "u", "long " * 400_000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "old") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)


def expected():
    best = {}
    for k, _, h in PAGES:
        p = (h or "").encode()
        if len(p) >= 1000 and k is not None:
            best[p] = max(k, best.get(p, k))
    for k, _, h in PAGES:
        p = (h or "").encode()
        to = best.get(p)
        to = None if to == k else to
        yield k, len(p), hashlib.sha1(p).hexdigest(), "revisit" if to is not None else "response", to


def key(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


def test_round_trip(spark, pages, tmp_path):
    got = warc.round_trip(pages, str(tmp_path))
    assert key(tuple(r) for r in got.collect()) == key(expected())
    raw = [f.read_bytes() for f in Path(tmp_path, "raw").glob("*.warc.gz")]
    done = list(Path(tmp_path, "records").glob("*.warc.gz"))
    assert 0 < len(raw) == len(done)
    for data in raw:  # one member
        z = zlib.decompressobj(31)
        z.decompress(data)
        assert z.eof and not z.unused_data
    assert sorted(map(gzip.decompress, raw)) == sorted(gzip.decompress(f.read_bytes()) for f in done)
    entries = [json.loads(x) for f in Path(tmp_path, "records").glob("*.index.json") for x in f.read_text().splitlines()]
    assert len(entries) == len(PAGES)
    for e in entries:  # each member stands alone
        member = Path(e["path"]).read_bytes()[e["offset"]:e["offset"] + e["length"]]
        assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: " + e["type"].encode())


def test_payloads_and_heads(spark, pages, tmp_path):
    raw = warc.cut(warc.write_monolithic(warc.with_revisits(pages), f"{tmp_path}/raw"), "t")
    done = warc.cut(warc.normalise(raw, f"{tmp_path}/records"), "t")
    (tmp_path / "records" / "left.index.json").write_text('{"path": "gone", "offset": 0, "length": 9, "id": "<x>", "type": "response"}')
    index = warc.read_index(done, str(tmp_path))
    got = {r.id: r for r in warc.read_records(index, str(tmp_path)).collect()}
    assert bytes(got["<urn:x-page:7>"].payload) == BIG.encode() and got["<urn:x-page:1>"].payload is None
    assert got["<urn:x-page:2>"].url == "http://a/2%20x%0D%0AWARC-Type:%20evil" and got["<urn:x-page:2>"].type == "revisit"
    assert got["<urn:x-page:13>"].payload_bytes == 2_000_000


def test_normalising_accepts_members(spark, tmp_path):
    recs = [warc.record(i, "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None) for i in range(50)]
    (tmp_path / "in.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    done = warc.normalise(spark.createDataFrame([(str(tmp_path / "in.warc.gz"),)], "path string"), str(tmp_path / "out")).collect()
    assert done[0].n_records == 50 and gzip.decompress(Path(done[0].path).read_bytes()) == b"".join(recs)


def test_a_cut_archive_is_an_error():
    rec = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert list(warc.split_records(iter([rec[:10], rec[10:] + rec[:30], rec[30:]]))) == [rec, rec]
    with pytest.raises(ValueError):
        list(warc.split_records(iter([rec, rec[:-20]])))


def test_empty_table(spark, pages, tmp_path):
    assert warc.round_trip(pages.limit(0), str(tmp_path)).count() == 0


def test_oracle_on_the_fixture(pages):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [p for p in PAGES if p[0] is not None])
    assert key(con.execute(WARC).fetchall()) == key(r for r in expected() if r[0] is not None)
