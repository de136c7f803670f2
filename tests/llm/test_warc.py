import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from vettable.llm import warc as W
from vettable.llm.common import shared_path
from . import helpers as H

NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
LONG = "<p>" + "same body " * 20


def brute(pages):
    """Digest rows of (page_id, url, html) straight from the table."""
    first = {}
    for i, (p, _, html) in enumerate(pages):
        body = (html or "").encode()
        key = (p is None, p or 0, i)
        if len(body) >= 100:
            first[body] = min(first.get(body, key), key)
    out = []
    for i, (p, _, html) in enumerate(pages):
        body = (html or "").encode()
        again = body in first and first[body][2] != i
        ref = pages[first[body][2]][0] if again else None
        out.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", ref))
    return sorted(out, key=repr)


def pages_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows],
                                 "page_id long, url string, html string, record_type string, payload string, row int")


AWKWARD = [
    (5, "http://a.example/x?y=1#z", LONG), (3, "http://a.example", LONG), (3, "http://a.example", LONG),
    (9, None, None), (None, "http://b.example/", LONG), (None, None, "short"), (10, "no scheme", "short"),
    (11, "http://c.example/a b\r\nX-Evil: 1", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    (12, "http://d.example/", ""), (-4, "http://d.example/", "é漢\U0001f600\r\n\r\n" * 30), (13, "http://e/", "x" * 3_000_000),
    (14, "http://f/", "s" * 99), (15, "http://f/", "s" * 99), (16, "http://f/", "s" * 100), (17, "http://f/", "s" * 100),
]


def test_round_trip_of_awkward_pages(spark):
    got = sorted(H.rows(W.round_trip(pages_table(spark, AWKWARD)), *NAMES), key=repr)
    assert got == brute(AWKWARD)


def test_driver_pages(spark):
    pages = spark.read.parquet(f"{H.SF}/pages.parquet")
    rows = H.rows(pages, "page_id", "url", "html")
    twice = pages.union(pages.withColumn("page_id", F.col("page_id") + 100_000))
    again = rows + [(p + 100_000, u, h) for p, u, h in rows]
    assert sorted(H.rows(W.round_trip(twice), *NAMES), key=repr) == brute(again)
    assert W.round_trip(pages.limit(0)).collect() == []


def test_files_conform_and_captures_nest(spark):
    path = shared_path(spark, "test-warc")
    W.write_archives(pages_table(spark, AWKWARD), path)
    records = W.read_records(spark, path).collect()
    assert len(records) == 3 * len(AWKWARD) and not any(r.error for r in records)
    assert len({r.record_id for r in records}) == len(records)
    for r in records:
        assert r.record_id.startswith("<urn:uuid:") and len(r.record_id) == 47 and r.date == W.NO_DATE
        assert r.headers["content-length"].isdigit() and r.target_uri and "\n" not in r.target_uri
        assert r.payload_digest == hashlib.sha256(r.payload).hexdigest() and r.payload_bytes == len(r.payload)
        if r.record_type == "response":
            assert r.headers["warc-payload-digest"] == f"sha256:{r.payload_digest}"
        if r.record_type == "revisit":
            assert r.headers["warc-profile"] == W.SAME_PAYLOAD and r.payload == b""
    caps = W.captures(W.read_records(spark, path)).collect()
    assert len(caps) == len(AWKWARD)
    for c in caps:
        assert c.response.record_id == c.capture_id and len(c.requests) == len(c.metadata) == 1
        assert c.requests[0].target_uri == c.response.target_uri
        assert c.requests[0].http_header.startswith("GET /") and "Host: " in c.requests[0].http_header


def record(kind, rid, block=b"", **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, **{k.replace("_", "-"): v for k, v in fields.items()}}
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items())
    return b"WARC/1.0\r\n" + lines + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nWARC/1.0\r\n"
    a = record("warcinfo", "<w>", b"software: x\r\n") + record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r>",
                                                              Content_Type="application/http; msgtype=request")
    b = record("response", "<r>", http, Content_Type="application/http; msgtype=response")
    c = record("metadata", "<m2>", b"k: 2", WARC_Concurrent_To="<r>") + record("metadata", "<m1>", b"k: 1", WARC_Concurrent_To="<r>")
    lost = record("request", "<q9>", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<gone>")
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (a, c)))  # the parts of a capture in two files
    (tmp_path / "two.warc").write_bytes(b + lost)
    (tmp_path / "three.warc").write_bytes(record("resource", "<s>", b"abc") + b[:-40])
    (tmp_path / "four.warc").write_bytes(b"not an archive")
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = W.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.record_id or "", r.error) for r in rows if r.error) == [("", "cut short"), ("", "no record header")]
    found = {r.capture_id: r for r in W.captures(W.read_records(spark, str(tmp_path))).collect()}
    assert set(found) == {"<r>", "<gone>"}
    whole = found["<r>"]
    assert whole.response.payload == b"body\r\n\r\nWARC/1.0\r\n" and whole.response.http_header == "HTTP/1.1 200 OK\r\nX: y"
    assert [m.record_id for m in whole.metadata] == ["<m1>", "<m2>"] and [q.record_id for q in whole.requests] == ["<q>"]
    assert found["<gone>"].response is None and len(found["<gone>"].requests) == 1


@pytest.mark.parametrize("data, error", [
    (b"WARC/1.1\r\nWARC-Type: x\r\n\r\nabc", "no content length"), (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", "cut short"),
    (b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc", "no record end"), (b"\r\n\r\n", "no record header")])
def test_errors_end_a_file(data, error):
    *_, (_, _, last) = W.parse_records(data)
    assert last == error
    assert list(W.parse_records(b"")) == []
    (_, fields, block), = W.parse_records(b"WARC/1.1\r\nA: 1\r\n two\r\nContent-Length: 2\r\n\r\nhi")
    assert fields[0] == ("a", "1 two") and block == b"hi"


def test_compressed_archives(spark):
    path = shared_path(spark, "test-warc-gz")
    W.write_archives(pages_table(spark, AWKWARD), path, compression="gzip")
    assert W.read_records(spark, path, payload=False).filter("record_type = 'request'").count() == len(AWKWARD)
