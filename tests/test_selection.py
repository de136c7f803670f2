"""Candidate trials, regressions and recommendation on small CSV fixtures."""
from pyspark.sql import functions as F

from vettable.operators.audit import audit
from vettable.plans.governed import candidate_batch, evaluate_candidates, safe_policy

from .helpers import load


def analyze(spark, path, candidates):
    df, cols, hdr = load(spark, path)
    before = audit(df, columns=cols, order_col="_row_id", raw_header=hdr, materialize=True)
    plans, acts = candidate_batch(spark, before.audits, candidates, ["ds"])
    pol = safe_policy(before.audits)
    return evaluate_candidates(df, cols, plans, acts, pol, before=before)


def by_id(df, key="candidate_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_dedupe_recommended_trim_regresses(spark, write_csv):
    p = write_csv("item,category\n A ,tools\n A ,tools\nA,tools\nB,parts\n")
    a = analyze(spark, p, {"dedupe": [("REMOVE_EXACT_DUPLICATES", [])],
                           "trim": [("TRIM_OUTER_WHITESPACE", ["item"])]})
    ev = by_id(a.evaluations)
    assert ev["trim"]["status"] == "REGRESSION_DETECTED"
    assert ev["dedupe"]["status"] == "NO_AUDIT_REGRESSION"
    rec = a.recommendations.collect()[0]
    assert rec["status"] == "RECOMMENDED" and rec["recommended_candidate_id"] == "dedupe"


def test_trim_only_no_improvement(spark, write_csv):
    p = write_csv("item,category\n A ,tools\nB,parts\n")
    a = analyze(spark, p, {"trim": [("TRIM_OUTER_WHITESPACE", ["item"])]})
    rows = by_id(a.candidates)
    assert rows["trim"]["disposition"] == "NO_MEASURED_IMPROVEMENT"
    assert a.recommendations.collect()[0]["status"] == "NO_IMPROVING_CANDIDATE"


def test_equal_audits_different_content_tie(spark, write_csv):
    p = write_csv("item,category\n A ,tools\n A ,tools\nB,parts\n")
    a = analyze(spark, p, {"dedupe": [("REMOVE_EXACT_DUPLICATES", [])],
                           "trimdedupe": [("TRIM_OUTER_WHITESPACE", ["item"]),
                                          ("REMOVE_EXACT_DUPLICATES", [])]})
    rec = a.recommendations.collect()[0]
    assert rec["status"] == "HUMAN_CHOICE_REQUIRED"
    assert rec["shortlisted_candidate_ids"] == "dedupe,trimdedupe"


def test_equal_content_shorter_plan_wins(spark, write_csv):
    p = write_csv("item,category\nA,tools\nA,tools\nB,\nC,parts\n")
    a = analyze(spark, p, {"markers_dedupe": [("STANDARDIZE_MISSING_MARKERS", ["category"]),
                                              ("REMOVE_EXACT_DUPLICATES", [])],
                           "dedupe": [("REMOVE_EXACT_DUPLICATES", [])]})
    rec = a.recommendations.collect()[0]
    assert rec["status"] == "RECOMMENDED" and rec["recommended_candidate_id"] == "dedupe"
    after = by_id(a.trial.after.audits)
    assert after["dedupe"]["quality_score"] == 90 and after["dedupe"]["row_count"] == 3


def test_still_dirty_recommended_but_quarantined(spark, write_csv):
    p = write_csv("item,category\nA,\nA,\nB,tools\n")
    a = analyze(spark, p, {"dedupe": [("REMOVE_EXACT_DUPLICATES", [])]})
    rec = a.recommendations.collect()[0]
    assert rec["status"] == "RECOMMENDED"
    assert by_id(a.trial.after.audits)["dedupe"]["status"] == "QUARANTINED"


def test_unsupported_and_review_required(spark, write_csv):
    p = write_csv("item,category\nA,tools\nA,tools\n")
    a = analyze(spark, p, {"redact": [("REDACT_PII", ["item"])],
                           "dedupe": [("REMOVE_EXACT_DUPLICATES", [])]})
    tr = by_id(a.trial.trials)
    # REDACT_PII is not allowed by the safe policy -> review, never executed
    assert tr["redact"]["status"] == "REQUIRES_REVIEW"
    assert tr["dedupe"]["status"] == "REAUDITED"
