"""Operator 13: WARC archives - records written, read back and assembled to captures.

Writing. Each page becomes a capture of three records: the response (or revisit), its
request, and metadata that holds the page's id; the last two name the first by
``WARC-Concurrent-To``. Records are text rows of Spark's text writer whose line separator
is the ``CRLF CRLF`` that ends every record, so any file system that Spark writes will do.
Of equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page id is
stored; the others are revisits that name its record (``WARC-Refers-To``). Equal payloads
meet by SHA-256: the digest is combined map-side, only repeated ones are joined back, and
that table is written first, so Spark can split the join at a digest that very many pages
share. Files are rolled at about ``FILE_BYTES``.

Reading. Files come through ``binaryFile`` (plain or gzip, one or many members), one file a
row, so a file must stay under Spark's 2 GB a value; a record is found by its header's
``Content-Length``, never by searching for a marker, so payloads may hold anything. A file
that ends inside a record, or has something else where a record should start, gives one
row with ``error`` and no more records.

Assembly. Requests and metadata are grouped by the record that they name and joined to the
responses and revisits: one nested row per capture, whatever files the records stand in.
A request or metadata record whose response is absent gives a capture without response.
A revisit takes payload size and digest from the response that it refers to.

Defined results: null html is empty, a null url is ``urn:page:<id>``; line ends and blanks in
urls are percent-escaped; repeated rows are captures of their own (the first stored, the
others revisits); null page ids are kept and are never the smallest beside others; an empty
table gives no captures; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_path, written

REVISIT_BYTES = 100
FILE_BYTES = 16 << 20
#: WARC-Date of records; pages bear no time of their own.
NO_DATE = "1970-01-01T00:00:00Z"
#: The profile of the standard for payloads that a digest found equal (fixed value).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")


# ------------------------------------------------------------------ writing

def _record_id(kind: str, page_id: Column, row: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), row.cast("string"))
                   .cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to the end of its block; fields of null value are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                    F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
                   date: str = NO_DATE, compression: str = "none") -> None:
    """Write the records of ``pages`` as WARC files under ``path``."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page"),
                        F.col(url).cast("string").alias("url"), body.alias("body"))
    sized = rows.select("row", "page", F.octet_length("body").cast("long").alias("size"),
                        F.sha2(F.col("body").cast("binary"), 256).alias("digest"))
    # The smallest id, known ones first; the row number makes it one row.
    first = F.min(F.struct(F.col("page").isNull().alias("unknown"), "page", "row")).alias("first")
    firsts = written(sized.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(first, F.count("*").alias("copies"))
                     .filter("copies > 1").select("digest", "first.page", "first.row"), "warc-firsts")
    mean = (rows.agg(F.avg(F.octet_length("body"))).first()[0] or 0) + 1_000

    w = (rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
         .join(firsts.select("digest", F.col("page").alias("first_page"), F.col("row").alias("first_row")), "digest", "left"))
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    own, page = _record_id("response", F.col("page"), F.col("row")), F.coalesce(F.col("page").cast("string"), F.lit(""))
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), page)),
                                                                "\r", "%0D"), "\n", "%0A"), " ", "%20")
    host = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    place = F.regexp_replace(target, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))

    def head(kind: Column | str, record_id: Column) -> list[tuple[str, Column]]:
        return [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", record_id),
                ("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    response = _record(
        head(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), own)
        + [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
           ("WARC-Profile", F.when(again, F.lit(SAME_PAYLOAD))),
           ("WARC-Refers-To", F.when(again, _record_id("response", F.col("first_page"), F.col("first_row")))),
           ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(again, http).otherwise(F.concat(http, F.col("body"))))
    request = _record(
        head("request", _record_id("request", F.col("page"), F.col("row")))
        + [("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(place.startswith("/"), place).otherwise(F.concat(F.lit("/"), place)),
                 F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    metadata = _record(
        head("metadata", _record_id("metadata", F.col("page"), F.col("row")))
        + [("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), page, F.lit("\r\n")))
    (w.select(F.explode(F.array(response, request, metadata)).alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", compression)
     .option("maxRecordsPerFile", max(3, int(3 * FILE_BYTES / mean))).text(path))


# ------------------------------------------------------------------ reading

def inflated(content: bytes) -> bytes:
    """The content of a plain file, or of all members of a gzip file (also one cut short)."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(rest))
        rest = member.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[int, list[tuple[str, str]], bytes | str]]:
    """(offset, header fields, block) of each record; a str in the block's place is an error, the last item."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n") if end >= 0 else []
        if not lines or lines[0].strip() not in VERSIONS:
            yield at, [], "no record header"
            return
        fields: list[tuple[str, str]] = []
        for line in lines[1:]:
            if line[:1] in (b" ", b"\t") and fields:  # a folded line belongs to the field before it
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip().decode('utf-8', 'replace')}")
            else:
                name, _, value = line.partition(b":")
                fields.append((name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")))
        length = dict(fields).get("content-length", "")
        if not length.isascii() or not length.isdigit():
            yield at, fields, "no content length"
            return
        start, stop = end + 4, end + 4 + int(length)
        if stop > len(data):
            yield at, fields, "cut short"
            return
        yield at, fields, data[start:stop]
        if data[stop:stop + 4] != b"\r\n\r\n":
            if data[stop:]:
                yield stop, [], "no record end"
            return
        at = stop + 4


RECORD = ("path string, offset long, record_id string, record_type string, target_uri string, date string, "
          "concurrent_to array<string>, refers_to string, content_type string, headers map<string,string>, "
          "http_header string, payload_bytes long, payload_digest string, payload binary, error string")
_ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
    ("target_uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
    ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_header", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def record_row(path: str, offset: int, fields: list[tuple[str, str]], block: bytes | str, payload: bool) -> tuple:
    by_name = dict(reversed(fields))  # of repeated fields the first counts
    kind, media = by_name.get("warc-type"), by_name.get("content-type")
    if isinstance(block, str):
        return (path, offset, None, None, None, None, None, None, None, list(by_name.items()), None, None, None, None, block)
    http, body = "", block
    if (media or "").lower().startswith("application/http"):
        raw, _, body = block.partition(b"\r\n\r\n")
        http = raw.decode("utf-8", "replace")
    return (path, offset, by_name.get("warc-record-id"), kind, by_name.get("warc-target-uri"), by_name.get("warc-date"),
            [v for n, v in fields if n == "warc-concurrent-to"], by_name.get("warc-refers-to"), media,
            list(by_name.items()), http, len(body), hashlib.sha256(body).hexdigest(),
            body if payload or kind == "metadata" else None, None)


def read_records(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``.

    ``payload=False`` leaves payloads out (metadata keep theirs); sizes and digests are of the whole payload.
    """
    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, size = [], 0
                for offset, fields, block in parse_records(inflated(content.as_py())):
                    rows.append(record_row(name, offset, fields, block, payload))
                    size += len(block) if payload else 500
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    bound_batches(spark)
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)],
                                      schema=_ARROW)


# ------------------------------------------------------------------ assembly

def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, requests, metadata``.

    ``response`` is a struct of the response or revisit record; the others are arrays in order of their record ids.
    """
    whole = F.struct("record_id", "record_type", "target_uri", "date", "refers_to", "content_type", "http_header",
                     "payload_bytes", "payload_digest", "payload", "path", "offset")
    answered = F.col("record_type").isin("response", "revisit")
    main = records.filter(answered).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    names = F.when(F.size("concurrent_to") > 0, F.col("concurrent_to")).otherwise(F.array("record_id"))
    beside = (records.filter(F.col("record_type").isin("request", "metadata"))
              .select(F.explode(names).alias("capture_id"), "record_type", whole.alias("r")))
    grouped = beside.groupBy("capture_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, F.col("r"))),
                     lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1)
                     .otherwise(0)).alias(out)
        for kind, out in (("request", "requests"), ("metadata", "metadata"))])
    return main.join(grouped, "capture_id", "full_outer")


def page_captures(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the captures that have a response.

    The page's id is the ``pageId`` field of the capture's metadata.
    """
    fields = F.get("metadata", 0)["payload"].cast("string")
    rows = written(found.filter("response is not null").select(
        "capture_id",
        F.nullif(F.regexp_extract(fields, r"(?m)^pageId: *(-?\d*)\r?$", 1), F.lit("")).cast("long").alias("page_id"),
        "response.record_type", F.col("response.refers_to").alias("to"), "response.payload_bytes",
        "response.payload_digest"), "warc-captures")
    stored = rows.filter("record_type = 'response'").select(
        F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_digest").alias("full_digest"))
    again = rows.filter("record_type = 'revisit'").join(stored, "to", "left").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type",
        "refers_to")
    return rows.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(again)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and assemble the captures."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return page_captures(captures(read_records(pages.sparkSession, path, payload=False)))
