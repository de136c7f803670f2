"""S3: JSON records - rejects, first-seen key union and text values."""
from pyspark.sql import functions as F

from vettable.operators.file_audit import audit_rows
from vettable.sources.json_records import json_cells, json_rows, json_table, key_union, refusals

TEXTS = [
    '{"a": 1, "b": "x"}',
    '{"b": "y", "c": true}',
    '{"a": null}',
    'not json',
    '{"a": 1, "a": 2}',
    '[1, 2]',
    '{}',
    '{"a": {"z": 1}}',
    '{"c": false, "d": 2.5}',
]


def _frame(spark):
    return spark.createDataFrame([("ds", i, t) for i, t in enumerate(TEXTS)],
                                 "dataset_id string, _row_id bigint, props string")


def test_rejects_one_row_per_record(spark):
    _, rejects = json_cells(_frame(spark), "props")
    got = {r["_row_id"]: r["reason"] for r in rejects.collect()}
    assert got == {3: "INVALID_JSON_OR_DUPLICATE_KEY", 4: "INVALID_JSON_OR_DUPLICATE_KEY",
                   5: "NOT_AN_OBJECT", 6: "EMPTY_OBJECT", 7: "NESTED_VALUE"}


def test_key_union_first_seen_order(spark):
    cells, _ = json_cells(_frame(spark), "props")
    order = [r["column"] for r in key_union(cells).orderBy("position").collect()]
    assert order == ["a", "b", "c", "d"]


def test_table_values(spark):
    t = json_table(_frame(spark), "props", ["a", "b", "c", "d"])
    rows = {r["_row_id"]: (r["a"], r["b"], r["c"], r["d"]) for r in t.collect()}
    assert rows == {0: ("1", "x", "", ""), 1: ("", "y", "true", ""), 2: ("", "", "", ""),
                    8: ("", "", "false", "2.5")}


def test_records_of_documents_are_ordered_beyond_a_million_places(spark):
    rows = [("d", 0, "[" + ",".join(['{"a": 1}'] * 3) + "]"), ("d", 1, '{"records": [{"b": 2}, [], {"a": 3}]}')]
    cells, rejects = json_cells(spark.createDataFrame(rows, "dataset_id string, _row_id bigint, t string"), "t",
                                documents=True)
    got = sorted((tuple(r["_row_id"]), r["column"], r["value"]) for r in cells.collect())
    assert got == [((0, 0), "a", "1"), ((0, 1), "a", "1"), ((0, 2), "a", "1"), ((1, 0), "b", "2"), ((1, 2), "a", "3")]
    assert [(tuple(r["_row_id"]), r["reason"]) for r in rejects.collect()] == [((1, 1), "NOT_AN_OBJECT")]
    assert [r["column"] for r in key_union(cells).orderBy("position").collect()] == ["a", "b"]


def test_scalars_stay_as_written_and_keys_in_order(spark):
    df = spark.createDataFrame([("d", 0, '{"z": 1.0, "a": 12345678901234567890, "t": true, "n": null, "s": "x\\u00e9"}')],
                               "dataset_id string, _row_id bigint, t string")
    cells, _ = json_cells(df, "t")
    assert [(r["column"], r["value"]) for r in cells.orderBy("_pos").collect()] == [
        ("z", "1.0"), ("a", "12345678901234567890"), ("t", "true"), ("n", ""), ("s", "xé")]
    doc = df.withColumn("t", F.lit('{"records": [{"b": 1.50, "a": 2}, {"c": false}]}'))
    cells, _ = json_cells(doc, "t", documents=True)
    assert [(r["column"], r["value"]) for r in cells.orderBy("_row_id", "_pos").collect()] == [("b", "1.5"), ("a", "2"), ("c", "false")]


def test_empty_keys_and_limits_refuse(spark):
    rows = [("ok", 0, '{"a": 1}'), ("key", 0, '{"": 1}'), ("key", 1, '{"a": 1}'), ("long", 0, '{"a": "123456"}'), ("many", 0, '{"a": 1}'),
            ("many", 1, '{"a": 1}'), ("many", 2, '{"a": 1}'), ("wide", 0, '{"a": 1, "b": 2, "c": 3}')]
    df = spark.createDataFrame(rows, "dataset_id string, _row_id bigint, t string")
    got = {(r.dataset_id, r.reason, r.records) for r in refusals(df, "t", max_rows=2, max_columns=2, max_cell_length=5).collect()}
    assert got == {("key", "EMPTY_KEY", 1), ("long", "CELL_TOO_LARGE", 1), ("many", "TOO_MANY_ROWS", 3), ("wide", "TOO_MANY_COLUMNS", 1)}


def test_every_dataset_has_the_union_of_its_own_keys(spark):
    rows = [("x", 0, '{"a": "1"}'), ("x", 1, '{"b": "2", "a": ""}'), ("y", 0, '{"email": "a@b.cd"}'), ("y", 1, "broken")]
    found = audit_rows(*json_rows(spark.createDataFrame(rows, "dataset_id string, _row_id bigint, t string"), "t"))
    assert {(a.dataset_id, a.row_count, a.column_count) for a in found.audits.collect()} == {("x", 2, 2), ("y", 1, 1)}
    assert {(f.dataset_id, f.code, f.column, f["count"]) for f in found.findings.collect()} == {
        ("x", "MISSING_VALUES", "a", 1), ("x", "MISSING_VALUES", "b", 1), ("y", "PII_COLUMN_NAME", "email", 1),
        ("y", "PII_VALUE_PATTERN", "email", 1)}
