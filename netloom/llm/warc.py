"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

A monolithic archive is one gzip stream over all records, so no record can be read without all before it.
``normalise`` inflates such a file once, as a stream, writes every record as a gzip member of its own and a sidecar
index of offsets; ``read_records`` then fetches records by index entry, in ranges.

Archives are files in a folder that all executors share, reached through the file system its URI names.  A task
writes files of its own, with a name no other attempt has; only those of successful attempts get into the table of
archives, which is written before it is read, so a repeated task leaves an orphan file at worst.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import arrow_map, cut
from netloom.operators.common import durable_dir

#: Payloads from this size are stored once; others equal to them revisit the stored record.
REVISIT = 1000
#: Bytes a task holds of a stream or of neighbouring records, beside one record.
CHUNK = 1 << 22
#: Inflated bytes of one archive, about; a task goes on to another file beyond.
ARCHIVE = 1 << 28
#: Bytes of an archive whose records one task reads, about.
STRETCH = 1 << 23
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


# ------------------------------------------------------------------------------ records

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record.  A revisit keeps the HTTP head, whose Content-Length is the payload's, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
             "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < "!" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of a record's head, names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; holds one record and one chunk."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            stop = end + 8 + int(parse_head(bytes(held[at:end]))["content-length"])
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(stream) -> Iterator[bytes]:
    """Inflated chunks of a gzip file of one member or many."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK // 4):
        while data:
            yield z.decompress(data, CHUNK)
            data = z.unconsumed_tail or z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


# ------------------------------------------------------------------------------- writing

def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), digest and refers_to: for payloads of ``REVISIT`` bytes and more, the largest
    page_id that has an equal payload, null for that page itself, for smaller payloads and where no equal payload has a
    page_id.

    Digests are grouped and joined without the pages; these are shuffled once, by page_id and digest.
    """
    whole = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    named = whole.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = named.where(F.octet_length("html") >= REVISIT).select("page_id", "digest")
    keepers = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    again = (large.join(keepers, "digest").where("NOT page_id <=> refers_to")
             .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct())
    return (named.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d"))


def _open(folder: str):
    files, path = fs.FileSystem.from_uri(folder)
    return files, path.rstrip("/")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html, digest, refers_to): path, n_records.  Every archive is one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        path = out = z = None
        n = size = 0
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(b.num_rows):
                page_id, url, page, digest, refers_to = (c[i].as_py() for c in cols)
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, z, n, size = files.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                rec = record(page_id, url, page.encode(), digest, refers_to)
                out.write(z.compress(rec))
                n, size = n + 1, size + len(rec)
                if size > ARCHIVE:
                    out.write(z.flush())
                    out.close()
                    yield _row(path=path, n_records=n)
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            yield _row(path=path, n_records=n)

    return arrow_map(pages, run, "path string, n_records long")


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values.values()], names=list(values))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive of ``archives`` (path): path of the new archive, index (its sidecar), n_records.

    The input is inflated once.  A record becomes one gzip member; the sidecar has a JSON line for each record: path,
    offset and length of the member, and the record's id and type.  An input of many members is accepted as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            for old in b.column(0).to_pylist():
                path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                index = path.removesuffix(".warc.gz") + ".index.json"
                n = at = 0
                with (files.open_input_stream(old, compression=None) as stream, files.open_output_stream(path, compression=None) as out,
                      files.open_output_stream(index, compression=None) as side):
                    for rec in split_records(inflate(stream)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        out.write(member)
                        head = parse_head(rec[:rec.index(b"\r\n\r\n")])
                        side.write(json.dumps({"path": path, "offset": at, "length": len(member), "id": head["warc-record-id"],
                                               "type": head["warc-type"]}).encode() + b"\n")
                        n, at = n + 1, at + len(member)
                yield _row(path=path, index=index, n_records=n)

    return arrow_map(archives.select("path"), run, "path string, index string, n_records long")


# ------------------------------------------------------------------------------- reading

INDEX = "path string, offset long, length long, id string, type string"
RECORD = ("id string, type string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary")


def _parse(rec: bytes) -> tuple:
    end = rec.index(b"\r\n\r\n")
    head = parse_head(rec[:end])
    body = rec[end + 4:end + 4 + int(head["content-length"])]
    http_end = body.index(b"\r\n\r\n")
    http = parse_head(body[:http_end])
    payload = body[http_end + 4:]
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return (head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), head.get("warc-target-uri"), digest,
            int(http["content-length"]), payload if head["warc-type"] == "response" else None)


def read_index(done: DataFrame, folder: str) -> DataFrame:
    """Entries of the sidecars that ``done`` (index) names, in columns ``INDEX``.  Tasks open them, so neither their paths
    nor their lines pass through the driver, and sidecars that a lost attempt left in the folder are not read."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as side:
                    lines = io.BufferedReader(side)
                    while rows := [json.loads(x) for x in itertools.islice(lines, 10_000)]:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)

    return arrow_map(done.select("index"), run, INDEX)


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of index entries (path, offset, length) in columns ``RECORD``.  Neighbouring entries are fetched as one
    range; each member is inflated by itself and its payload held against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def ranges(b):
            path = lo = hi = None
            for p, o, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if p == path and o == hi and hi - lo < CHUNK:
                    hi += n
                    sizes.append(n)
                    continue
                if path is not None:
                    yield path, lo, sizes
                path, lo, hi, sizes = p, o, o + n, [n]
            if path is not None:
                yield path, lo, sizes

        for b in batches:
            for path, lo, sizes in ranges(b):
                with files.open_input_file(path) as f:
                    data = f.read_at(sum(sizes), lo)
                at, rows = 0, []
                for n in sizes:
                    row = _parse(zlib.decompress(data[at:at + n], 31))
                    rows.append(row if payloads else (*row[:-1], None))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return arrow_map(index.select("path", "offset", "length"), run, RECORD)


def page_number(record_id):
    """The page_id in a record id, null if it has none."""
    digits = F.regexp_extract(record_id, _ID + r"(-?\d+)>", 1)
    return F.when(digits != "", digits.cast("long"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to monolithic archives, normalises these and reads all records back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null html is an empty payload.  Rows that repeat a page_id and payload are records each.  Other columns are left out.
    ``folder``: where archives go; by default a new one in the session's shared folder.
    """
    spark = pages.sparkSession
    folder = folder or f"{durable_dir(spark)}/warc-{uuid.uuid4().hex}"
    raw = cut(write_monolithic(with_revisits(pages), f"{folder}/raw"), "archives")
    n = max(1, raw.count())
    done = cut(normalise(raw.repartition(n), f"{folder}/records"), "archives")
    # Stretches of archives are dealt by hash: ranges would send a sample of all entries to the driver first.
    stretch = F.floor(F.col("offset") / STRETCH)
    index = read_index(done, folder).repartition(2 * n, "path", stretch).sortWithinPartitions("path", "offset")
    found = read_records(index, folder, payloads=False)
    return found.select(page_number(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
                        page_number(F.col("refers_to")).alias("refers_to"))
