"""R4-R7 (split, offer, digest, validity), E4/E5 (alias restore, public projection)
and F5 (single-action guard) on small fixtures."""
import json

import pytest
from pyspark.sql import functions as F

from vettable.operators import evidence as EV
from vettable.operators import review as RV
from vettable.operators.audit import audit
from vettable.operators.repairs import RepairError, only_action

from .helpers import load

CSV = ("business_email,notes,city\n"
       "sales@example.com,,Oslo\n"
       "info@example.com,ok,\n"
       "team@example.com,,Rome\n")
REVIEW_SCHEMA = ("dataset_id string, kind string, column string, reviewer_reference string, "
                 "reason string, reviewed_at bigint")


def _audit(spark, write_csv):
    df, cols, hdr = load(spark, write_csv(CSV))
    return audit(df, columns=cols, order_col="_row_id", raw_header=hdr, materialize=True)


def _reviews(spark, rows):
    return spark.createDataFrame(rows, REVIEW_SCHEMA)


def test_offer_split_digest_validity(spark, write_csv):
    r = _audit(spark, write_csv)
    offer = RV.offerable_choices(r.findings).collect()[0]
    assert offer["public_contact"] == ["business_email"]
    assert offer["optional"] == ["city", "notes"]

    good = [("ds", "public_contact", "business_email", "analyst-1", "Shared team mailbox.", 1),
            ("ds", "optional", "notes", "analyst-1", "Shared team mailbox.", 1)]
    split = {(x["code"], x["column"]): x["accepted"] for x in RV.split_findings(
        r.findings, _reviews(spark, good)).collect()}
    assert split[("PII_VALUE_PATTERN", "business_email")] is True
    assert split[("MISSING_VALUES", "notes")] is True
    assert split[("MISSING_VALUES", "city")] is False

    d1 = RV.review_digest(_reviews(spark, good)).collect()[0]["review_digest"]
    d2 = RV.review_digest(_reviews(spark, good[::-1])).collect()[0]["review_digest"]
    changed = [good[0], ("ds", "optional", "notes", "analyst-1", "Another stated reason.", 1)]
    d3 = RV.review_digest(_reviews(spark, changed)).collect()[0]["review_digest"]
    assert d1 == d2 and d1 != d3 and len(d1) == 64

    fresh = r.audits.select("dataset_id", "fingerprint")
    ok = RV.review_validity(_reviews(spark, good), r.findings, r.audits, fresh).collect()[0]
    assert ok["valid"] and ok["checks"] == []
    bad = [("ds", "public_contact", "city", " ", "short", 1)]
    stale = fresh.select("dataset_id", F.lit("0" * 64).alias("fingerprint"))
    v = RV.review_validity(_reviews(spark, bad), r.findings, r.audits, stale).collect()[0]
    assert not v["valid"]
    assert v["checks"] == ["REVIEWER_REFERENCE", "REASON_LENGTH", "PUBLIC_CHOICE_NOT_OFFERED",
                           "STALE_FINGERPRINT"]


def test_alias_restore_and_public_projection(spark, write_csv):
    r = _audit(spark, write_csv)
    aliases = EV.column_aliases(r.findings)
    amap = {x["column"]: x["alias"] for x in aliases.collect()}
    assert amap == {"business_email": "column_001", "city": "column_002", "notes": "column_003"}
    acts = spark.createDataFrame(
        [("ds", "c1", 0, "TRIM_OUTER_WHITESPACE", ["column_003", "column_001"]),
         ("ds", "c1", 1, "REMOVE_EXACT_DUPLICATES", []),
         ("ds", "c2", 0, "TRIM_OUTER_WHITESPACE", ["column_009"])],
        "dataset_id string, candidate_id string, action_idx int, action string, columns array<string>")
    restored, unknown = EV.restore_columns(acts, aliases)
    got = {(x["candidate_id"], x["action_idx"]): x["columns"] for x in restored.collect()}
    assert got[("c1", 0)] == ["notes", "business_email"]
    assert got[("c1", 1)] == []
    assert [(x["candidate_id"], x["alias"]) for x in unknown.collect()] == [("c2", "column_009")]
    told = EV.public_audit(r.audits, r.findings).collect()[0]
    issues = json.loads(told["issues"])
    assert [(i["code"], i["column"], i["count"]) for i in issues] == [
        ("MISSING_VALUES", "notes", 2), ("MISSING_VALUES", "city", 1), ("PII_VALUE_PATTERN", "business_email", 3)]
    assert json.loads(told["accepted_issues"]) == [] and "example.com" not in str(told)


def test_reviewers_and_choices_count(spark, write_csv):
    r = _audit(spark, write_csv)
    one = [("ds", "optional", "notes", "analyst-1", "Notes may be blank.", 1), ("ds", "optional", "city", "analyst-1", "Notes may be blank.", 1)]
    two = [one[0], one[1][:3] + ("analyst-2",) + one[1][4:]]
    digests = {RV.review_digest(_reviews(spark, x)).collect()[0]["review_digest"] for x in (one, two, two[::-1])}
    assert len(digests) == 2
    empty = [("ds", "optional", None, "analyst-1", "Nothing is declared here.", 1)]
    fresh = r.audits.select("dataset_id", "fingerprint")
    v = RV.review_validity(_reviews(spark, empty), r.findings, r.audits, fresh).collect()[0]
    assert not v["valid"] and v["checks"] == ["NOTHING_DECLARED"]
    heads = spark.createDataFrame([("ds", 0, "notes")], "dataset_id string, position int, name string")
    assert [x["violation"] for x in RV.review_violations(_reviews(spark, empty), heads, r.findings).collect()] == ["NOTHING_DECLARED"]


def test_too_many_issues_are_refused_whole(spark):
    audits = spark.createDataFrame([(d, "QUARANTINED", "a" * 64, 1, 1, 0, 0) for d in ("few", "many")],
                                   "dataset_id string, status string, fingerprint string, row_count long, column_count int, "
                                   "duplicate_row_count long, quality_score int")
    found = spark.createDataFrame([(d, i, "MISSING_VALUES", "WARNING", f"c{i}", 1, False) for d, n in (("few", 500), ("many", 501))
                                   for i in range(n)], "dataset_id string, ord int, code string, severity string, column string, "
                                                       "count long, accepted boolean")
    assert [x["dataset_id"] for x in EV.minimized_evidence(found, audits).collect()] == ["few"]
    assert [(x["dataset_id"], x["issues"]) for x in EV.oversized_evidence(found).collect()] == [("many", 501)]


def test_single_action_guard():
    only_action([("REMOVE_EXACT_DUPLICATES", [])], "REMOVE_EXACT_DUPLICATES")
    with pytest.raises(RepairError):
        only_action([("REMOVE_EXACT_DUPLICATES", []), ("TRIM_OUTER_WHITESPACE", ["a"])],
                    "REMOVE_EXACT_DUPLICATES")
