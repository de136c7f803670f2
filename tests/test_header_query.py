"""The rows-only ``header_findings`` query against a brute-force replay in plain
Python (reference-style byte checks, ``csv`` first record, A1-A3/A6) over the
driver's smallest documents table."""
import csv
import io
import os
import re

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from vettable.functions import constants as K
from vettable.functions.text import normalize_name

SF = "/root/testdata/sf0.001"


def _steady(lines, d):
    counts = [ln.count(d) for ln in lines]
    return bool(lines) and min(counts) > 0 and min(counts) == max(counts)


def _header(text: str):
    """The header the gate would read, or None when the file is blocked first."""
    raw = text.encode("utf-8")
    if not raw:
        return None
    sample = raw[:K.SNIFF_BYTES]
    if any(sample.startswith(sig) for sig in K.BINARY_SIGNATURES) or b"\x00" in sample:
        return None
    try:
        sample_text = sample.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None
    if not sample_text.strip(K.STRIP_CHARS):
        return None
    lines = [ln for ln in re.split(r"\r?\n", sample_text) if ln.strip(" ") != ""][:5]
    if not _steady(lines, ",") and any(_steady(lines, d) for d in (";", "\t", "|")):
        return None
    body = raw.decode("utf-8-sig")
    try:
        header = next(csv.reader(io.StringIO(body, newline=""), strict=True))
    except (StopIteration, csv.Error):
        return None
    return header


def _findings(doc_id, header):
    norm = [normalize_name(h) for h in header]
    out = []
    susp = sum(1 for n in norm if not n or n.startswith("unnamed"))
    if susp:
        out.append((doc_id, "SUSPICIOUS_COLUMN_NAME", "WARNING", None, susp))
    seen = {}
    for n in norm:
        if n:
            seen[n] = seen.get(n, 0) + 1
    amb = sum(1 for c in seen.values() if c > 1)
    if amb:
        out.append((doc_id, "AMBIGUOUS_COLUMN_NAMES", "CRITICAL", None, amb))
    for name, n in zip(header, norm):
        if n in K.PII_COLUMN_NAMES:
            out.append((doc_id, "PII_COLUMN_NAME", "CRITICAL", name, 1))
    return out


@pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="driver data absent")
def test_header_findings_match_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = []
    for d in docs:
        h = _header(d["text"])
        if h is not None:
            expected += _findings(str(d["doc_id"]), h)
    got = [tuple(r) for r in E.queries()["header_findings"](spark, SF)
           .select("dataset_id", "code", "severity", "column", "count").collect()]
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert expected  # the fixture exercises at least one finding


def _preflight(text: str):
    """(status, risk_flag, encoding, delimiter, column_count, data_row_count) by the gate's rules."""
    raw = text.encode("utf-8")

    def blocked(flag, enc=None, delim=None, ncol=None, rows=None):
        return ("BLOCKED", flag, enc, delim, ncol, rows)
    if not raw:
        return blocked("EMPTY_FILE")
    if len(raw) > K.MAX_FILE_SIZE_BYTES:
        return blocked("FILE_TOO_LARGE")
    sample = raw[:K.SNIFF_BYTES]
    if any(sample.startswith(sig) for sig in K.BINARY_SIGNATURES) or b"\x00" in sample:
        return blocked("BINARY_OR_ENCRYPTED_CONTENT")
    try:
        sample_text = sample.decode("utf-8-sig")
    except UnicodeDecodeError:
        return blocked("UNSUPPORTED_ENCODING")
    lines = [ln for ln in re.split(r"\r?\n", sample_text) if ln.strip(" ") != ""][:5]
    guess = next((d for d in (",", ";", "\t", "|") if _steady(lines, d)),
                 "," if "," in sample_text else None)
    if not sample_text.strip(K.STRIP_CHARS):
        return blocked("EMPTY_FILE", "utf-8")
    if (guess or ",") != ",":
        return blocked("NON_COMMA_DELIMITER", "utf-8", guess)
    body = raw.decode("utf-8-sig")
    reader = csv.reader(io.StringIO(body, newline=""), strict=True)
    try:
        try:
            header = next(reader)
        except StopIteration:
            return blocked("EMPTY_FILE", "utf-8", ",")
        if not header or all(not c.strip() for c in header):
            return blocked("MISSING_HEADER", "utf-8", ",")
        ncol = len(header)
        if ncol > K.MAX_COLUMNS:
            return blocked("TOO_MANY_COLUMNS", "utf-8", ",", ncol)
        if any(len(c) > K.MAX_CELL_LENGTH for c in header):
            return blocked("CELL_TOO_LARGE", "utf-8", ",", ncol)
        rows = 0
        for row in reader:
            if not row or all(not c.strip() for c in row):
                continue
            rows += 1
            if rows > K.MAX_ROWS:
                return blocked("TOO_MANY_ROWS", "utf-8", ",", ncol, rows)
            if len(row) != ncol:
                return blocked("MALFORMED_CSV", "utf-8", ",", ncol, rows)
            if any(len(c) > K.MAX_CELL_LENGTH for c in row):
                return blocked("CELL_TOO_LARGE", "utf-8", ",", ncol, rows)
    except csv.Error:
        return blocked("MALFORMED_CSV", "utf-8", ",")
    if rows == 0:
        return blocked("HEADER_ONLY_FILE", "utf-8", ",", ncol, 0)
    return ("ACCEPTED", None, "utf-8", ",", ncol, rows)


@pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="driver data absent")
def test_preflight_documents_match_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = {str(d["doc_id"]): _preflight(d["text"]) + (len(d["text"].encode("utf-8")),)
                for d in docs}
    got = {r["dataset_id"]: (r["status"], r["risk_flag"], r["encoding"], r["delimiter"],
                             r["column_count"], r["data_row_count"], r["file_size_bytes"])
           for r in E.queries()["preflight_documents"](spark, SF).collect()}
    assert got == expected
