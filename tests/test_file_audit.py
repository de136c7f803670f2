"""Audits of files with headers of their own: record facts and rows against Python's ``csv``, blocked audits."""
import csv
import io
import random

from pyspark.sql import functions as F

from vettable.functions import constants as K
from vettable.operators.audit import audit
from vettable.operators.file_audit import audit_files, audit_rows, file_rows, frame_names
from vettable.operators.preflight import record_facts
from vettable.plans import derived as D
from vettable.sources.csv import frame_names as python_names
from vettable.sources.files import texts_as_files

SF = "/root/testdata/sf0.001"


def texts_of(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "dataset_id string, text string")


def random_texts(n):
    rnd = random.Random(1)
    parts = ["a", "b", "é", ",", ",", ",", '"', '"', '""', "\n", "\r\n", "\r", " ", "xyzw"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def python_facts(text, limit):
    out = {"header": None, "records": 0, "uneven": None, "long_cell": None, "broken": False, "overlong": False}
    try:
        for record in csv.reader(io.StringIO(text, newline=""), strict=True):
            if out["header"] is None:
                out["header"] = record
            elif "".join(record).strip():
                out["records"] += 1
                if len(record) != len(out["header"]):
                    out["uneven"] = out["uneven"] or out["records"]
                if max(map(len, record)) > limit:
                    out["long_cell"] = out["long_cell"] or out["records"]
            elif len(record) > len(out["header"]):
                out["overlong"] = True
    except csv.Error:
        out["broken"] = True
    return out


def test_record_facts_match_the_csv_module(spark):
    texts = random_texts(3000)
    texts += ["a,b\n" + "x" * (K.READER_FIELD_LIMIT + k) + ",1\n1,2" for k in (0, 1)]  # a reader's longest field, and one more
    texts.append('"' + '""' * 50_000 + '",b\n1,2')  # many doubled quotes: no recursion
    got = {r.dataset_id: r.asDict() for r in record_facts(texts_of(spark, texts), 3).collect()}
    compared = 0
    for i, text in enumerate(texts):
        want = python_facts(text, 3)
        if want["header"] or want["broken"] and want["header"] is None:  # an empty first line is no header for either
            compared += 1
            assert {k: got[str(i)][k] for k in want} == want, text[:200]
    assert compared > 2000


def test_rows_match_the_csv_module(spark):
    texts = [t for t in random_texts(600) if not python_facts(t, 99)["broken"]]
    got = {}
    for r in file_rows(texts_of(spark, texts)).collect():
        got.setdefault(r.dataset_id, []).append((r._row, r["values"]))
    for i, text in enumerate(texts):
        records = list(csv.reader(io.StringIO(text, newline=""), strict=True))[1:]
        lines = [v for _, v in sorted(got.get(str(i), []))]
        kept = [r for r in records if len(r) > 1 or r and r[0].strip(" \t")]
        assert [v for v in lines if v != [""]] == kept, text  # [""]: a quoted empty line is a row, for a reader too


def files_of(spark, files):
    df = spark.createDataFrame([(n, t) for n, t in files.items()], "id string, text string")
    return texts_as_files(df, "id", "text", "id")


FILES = {
    "good.csv": "k,v\n1,x\n2,y\n", "dups.csv": "a,a,,Unnamed: 2\n1,1,1,1\n1,1,1,1\n", "blank.csv": " \n ", "head.csv": "a,b\n",
    "semi.csv": "a;b\n1;2\n", "ragged.csv": "a,b\n1\n", "reader.csv": "a,b\n1,2\n,,\n", "short.csv": "a,b\n1,2\n,\n\n  \n",
    "mail.csv": 'email,note\n"x@example.com","line\nbreak, ""quoted"""\n', "quote.csv": 'a,b\n"x"y,1\n',
    "place.csv": "lat,lon\n91,10\nnope,20\n", "empty.csv": "",
}


def test_every_file_has_one_audit(spark):
    r = audit_files(files_of(spark, FILES), max_rows=10)
    audits = {a.dataset_id: a for a in r.audits.collect()}
    assert set(audits) == set(FILES)
    found = {}
    for f in r.findings.orderBy("dataset_id", "ord").collect():
        found.setdefault(f.dataset_id, []).append((f.ord, f.code, f.severity, f.column, f["count"]))
    blocked = {"blank.csv": "EMPTY_FILE", "head.csv": "HEADER_ONLY_FILE", "semi.csv": "NON_COMMA_DELIMITER",
               "ragged.csv": "MALFORMED_CSV", "reader.csv": "CSV_READ_FAILURE", "quote.csv": "MALFORMED_CSV", "empty.csv": "EMPTY_FILE"}
    for name, code in blocked.items():
        a = audits[name]
        assert (a.status, a.row_count, a.column_count, a.quality_score, a.finding_count) == ("BLOCKED", 0, 0, 0, 1)
        assert len(a.fingerprint) == 64 and found[name] == [(0, code, "CRITICAL", None, 1)]
    assert audits["good.csv"].status == "READY" and audits["good.csv"].quality_score == 100 and "good.csv" not in found
    assert [x[1:] for x in found["dups.csv"]] == [
        ("SUSPICIOUS_COLUMN_NAME", "WARNING", None, 2), ("AMBIGUOUS_COLUMN_NAMES", "CRITICAL", None, 1),
        ("DUPLICATE_ROWS", "WARNING", None, 1)]
    assert [x[1:] for x in found["short.csv"]] == [("MISSING_VALUES", "WARNING", "a", 1), ("MISSING_VALUES", "WARNING", "b", 1)]
    assert [x[1:] for x in found["mail.csv"]] == [("PII_COLUMN_NAME", "CRITICAL", "email", 1), ("PII_VALUE_PATTERN", "CRITICAL", "email", 1)]
    assert [x[1:] for x in found["place.csv"]] == [("INVALID_COORDINATE", "WARNING", "lat", 2), ("MIXED_NUMERIC_TEXT", "WARNING", "lat", 2)]


def test_missing_paths_are_blocked_audits(spark):
    paths = spark.createDataFrame([("gone.csv", False, False), ("folder", True, False), ("good.csv", True, True)],
                                  "path string, exists boolean, is_file boolean")
    r = audit_files(files_of(spark, {"good.csv": FILES["good.csv"]}), paths=paths)
    assert {(a.dataset_id, a.status, a.fingerprint is None) for a in r.audits.collect()} == {
        ("good.csv", "READY", False), ("gone.csv", "BLOCKED", True), ("folder", "BLOCKED", True)}
    assert {f.code for f in r.findings.collect()} == {"FILE_NOT_FOUND", "NOT_A_FILE"}


def test_frame_names(spark):
    headers = [["a", "a", "a.1", "", "Unnamed: 3", "a"], ["x"], ["a", "b"], ["", ""]]
    df = spark.createDataFrame([(h,) for h in headers], "names array<string>")
    assert [r[0] for r in df.select(frame_names(F.col("names"))).collect()] == [python_names(h) for h in headers]


def test_array_rows_give_the_audit_of_columns(spark):
    """The same table as columns and as arrays: equal findings, scores and fingerprints (with a late type sample)."""
    wide = D.dirty_orders(spark, SF)
    one = audit(wide, order_col="_row_id", columns=D.ORDERS_COLUMNS, type_sample_limit=50)
    rows = wide.select("dataset_id", F.col("_row_id").alias("_row"), F.array(*D.ORDERS_COLUMNS).alias("values"))
    heads = wide.select("dataset_id").distinct().withColumn("names", F.array(*[F.lit(c) for c in D.ORDERS_COLUMNS]))
    two = audit_rows(rows, heads, type_sample_limit=50)
    assert [tuple(r) for r in one.audits.collect()] == [tuple(r) for r in two.audits.collect()]
    assert sorted(map(tuple, one.findings.collect())) == sorted(map(tuple, two.findings.collect()))
