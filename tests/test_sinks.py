"""CSV sink bytes and report completeness."""
import glob
import hashlib

from pyspark.sql import functions as F

from vettable.operators.repairs import apply_plan
from vettable.sources.sinks import report_json
from vettable.sources.sinks import write_csv as sink_csv

from .helpers import load


def _bytes(path):
    parts = sorted(glob.glob(path + "/part-*"))
    return b"".join(open(p, "rb").read() for p in parts)


def test_repaired_bytes_match_published_sample(spark, write_csv, tmp_path):
    # 4 rows, one duplicate; markers on category then dedupe -> 3 rows
    src = write_csv("item,category\nA,tools\nA,tools\nB,\nC,parts\n", "sample.csv")
    df, cols, _ = load(spark, src)
    out = apply_plan(df, [("STANDARDIZE_MISSING_MARKERS", ["category"]),
                          ("REMOVE_EXACT_DUPLICATES", [])], keys=["dataset_id"], data_columns=cols)
    dest = str(tmp_path / "out")
    sink_csv(out, dest, cols, source_path=src, single_file=True)
    data = _bytes(dest)
    assert data == b"item,category\nA,tools\nB,\nC,parts\n"
    assert hashlib.sha256(data).hexdigest() == \
        "1ae42f08eeac9adb8ef3d3bf0fa64857eb8be4bf39c11016b544c6f5e772d2cc"


def test_single_column_empty_row_kept(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b")], "_row_id long, v string")
    dest = str(tmp_path / "one")
    sink_csv(df, dest, ["v"], single_file=True)
    assert _bytes(dest) == b'v\na\n""\nb\n'


def test_quoting_minimal(spark, tmp_path):
    df = spark.createDataFrame([(0, 'x,y', 'say "hi"', " pad ")], "_row_id long, a string, b string, c string")
    dest = str(tmp_path / "q")
    sink_csv(df, dest, ["a", "b", "c"], single_file=True)
    assert _bytes(dest) == b'a,b,c\n"x,y","say ""hi""", pad \n'


def test_report_completeness(spark):
    run = spark.createDataFrame([("d1", "REPAIRED", None, None, None), ("d2", "READY", None, None, None)],
                                "dataset_id string, outcome string, audit_after string, comparison string, lineage string")
    rows = {r["dataset_id"]: r["complete"] for r in report_json(run).collect()}
    assert rows == {"d1": False, "d2": True}


def test_write_report_refuses_incomplete_and_writes_json(spark, tmp_path):
    import pytest

    from vettable.sources.sinks import SinkError, parse_report, write_report
    run = spark.createDataFrame(
        [("d1", "REPAIRED", "a", "c", "l"), ("d2", "READY", None, None, None)],
        "dataset_id string, outcome string, audit_after string, comparison string, lineage string")
    dest = str(tmp_path / "reports.json")
    write_report(report_json(run), dest)
    lines = [ln for p in (tmp_path / "reports.json").glob("part-*")
             for ln in p.read_text().splitlines() if ln.strip()]
    docs = {d["outcome"]: d for d in map(parse_report, lines)}
    assert set(docs) == {"REPAIRED", "READY"} and docs["REPAIRED"]["schema_version"] == "1.0"
    incomplete = run.withColumn("lineage", F.lit(None).cast("string"))
    with pytest.raises(SinkError):
        write_report(report_json(incomplete), str(tmp_path / "bad.json"))


def test_a_missing_column_is_missing_evidence(spark):
    run = spark.createDataFrame([("d1", "REPAIRED", "c"), ("d2", "DENIED", None)], "dataset_id string, outcome string, comparison string")
    got = {r.dataset_id: (r.complete, r.missing, r.report) for r in report_json(run).collect()}
    assert got["d1"][:2] == (False, ["audit_after", "lineage"]) and got["d2"][:2] == (True, [])
    assert list(__import__("json").loads(got["d2"][2])) == ["schema_version", "dataset_id", "outcome", "reason", "audit_before", "plan",
                                                            "decision", "audit_after", "comparison", "lineage"]


def test_parts_in_name_order_keep_the_rows(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as _row_id", "cast(1000 - id as string) as v").repartition(7)
    dest = str(tmp_path / "many")
    sink_csv(df, dest, ["v"])
    lines = [x for x in _bytes(dest).decode().split("\n") if x and x != "v"]
    assert lines == [str(1000 - i) for i in range(1000)]
