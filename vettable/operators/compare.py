"""T-2 to T-6: before/after comparison, regression rules, evidence checks, matching of trials and plans.

``before`` audits are keyed by ``dataset_id``; ``after`` audits and findings
by ``(dataset_id, candidate_id)``. Everything is a join on those keys (the
finding-level rules join on ``(code, column)`` with a null-safe column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .audit import AuditResult
from .policy import PLAN_KEYS, authorize, plan_hashes

HEX64 = "^[0-9a-f]{64}$"


def _codes(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.filter(~F.col("accepted")).groupBy(*keys).agg(
        F.collect_set("code").alias("codes"), F.count("*").alias("n_issues"))


def comparison(before_audits: DataFrame, before_findings: DataFrame, after_audits: DataFrame,
               after_findings: DataFrame) -> DataFrame:
    """T-2: deltas and resolved / remaining / new codes (sorted, joined as text)."""
    empty = F.array().cast("array<string>")
    b = (before_audits.join(_codes(before_findings, ["dataset_id"]), on="dataset_id", how="left")
         .select("dataset_id", F.col("status").alias("before_status"),
                 F.col("quality_score").alias("before_quality_score"),
                 F.col("row_count").alias("before_row_count"),
                 F.col("duplicate_row_count").alias("before_duplicate_row_count"),
                 F.coalesce("codes", empty).alias("bc"),
                 F.coalesce("n_issues", F.lit(0)).alias("before_issue_count")))
    a = (after_audits.join(_codes(after_findings, PLAN_KEYS), on=PLAN_KEYS, how="left")
         .select(*PLAN_KEYS, F.col("status").alias("after_status"),
                 F.col("quality_score").alias("after_quality_score"),
                 F.col("row_count").alias("after_row_count"),
                 F.col("duplicate_row_count").alias("after_duplicate_row_count"),
                 F.coalesce("codes", empty).alias("ac"),
                 F.coalesce("n_issues", F.lit(0)).alias("after_issue_count")))
    j = a.join(b, on="dataset_id", how="inner")
    return j.select(
        *PLAN_KEYS, "before_status", "after_status", "before_quality_score", "after_quality_score",
        (F.col("after_quality_score") - F.col("before_quality_score")).cast("int")
        .alias("quality_score_delta"),
        F.col("before_issue_count").cast("int").alias("before_issue_count"),
        F.col("after_issue_count").cast("int").alias("after_issue_count"),
        (F.col("after_issue_count") - F.col("before_issue_count")).cast("int").alias("issue_count_delta"),
        "before_row_count", "after_row_count",
        (F.col("after_row_count") - F.col("before_row_count")).alias("row_count_delta"),
        "before_duplicate_row_count", "after_duplicate_row_count",
        F.greatest(F.lit(0), F.col("before_duplicate_row_count") - F.col("after_duplicate_row_count"))
        .alias("duplicate_rows_removed"),
        F.array_join(F.array_sort(F.array_except("bc", "ac")), ",").alias("resolved_issue_codes"),
        F.array_join(F.array_sort(F.array_intersect("bc", "ac")), ",").alias("remaining_issue_codes"),
        F.array_join(F.array_sort(F.array_except("ac", "bc")), ",").alias("new_issue_codes"))


def finding_profile(findings: DataFrame, keys: list[str]) -> DataFrame:
    """T-3: per (code, column): highest severity rank and total count."""
    return findings.filter(~F.col("accepted")).groupBy(*keys, "code", "column").agg(
        F.max(T.severity_rank(F.col("severity"))).alias("sev"),
        F.sum("count").alias("cnt"))


def regressions(before_audits: DataFrame, before_findings: DataFrame, after_audits: DataFrame,
                after_findings: DataFrame, plan_actions: DataFrame, trials: DataFrame) -> DataFrame:
    """T-4: one row per regression rule that fires for a completed trial.

    Columns: dataset_id, candidate_id, rule, code, column. A blocked output
    yields ``OUTPUT_BLOCKED`` alone.
    """
    done = trials.filter(F.col("status").isin("REAUDITED", "OUTPUT_BLOCKED")).select(*PLAN_KEYS)
    dedupe = plan_actions.groupBy(*PLAN_KEYS).agg(
        F.bool_or(F.col("action") == "REMOVE_EXACT_DUPLICATES").alias("has_dedupe"))
    b = before_audits.select("dataset_id", F.col("status").alias("bs"),
                             F.col("quality_score").alias("bq"), F.col("row_count").alias("br"),
                             F.col("column_count").alias("bcc"),
                             F.col("duplicate_row_count").alias("bd"))
    a = after_audits.select(*PLAN_KEYS, F.col("status").alias("as_"),
                            F.col("quality_score").alias("aq"), F.col("row_count").alias("ar"),
                            F.col("column_count").alias("acc"),
                            F.col("duplicate_row_count").alias("ad"))
    j = (done.join(a, on=PLAN_KEYS, how="inner").join(b, on="dataset_id", how="inner")
         .join(dedupe, on=PLAN_KEYS, how="left"))
    removed = F.col("br") - F.col("ar")
    blocked = F.col("as_") == "BLOCKED"
    rules = F.array_compact(F.array(
        F.when(blocked, F.lit("OUTPUT_BLOCKED")),
        F.when(~blocked & (F.col("bs") == "READY") & (F.col("as_") != "READY"),
               F.lit("READINESS_REGRESSION")),
        F.when(~blocked & (F.col("aq") < F.col("bq")), F.lit("QUALITY_SCORE_DECREASED")),
        F.when(~blocked & (F.col("acc") != F.col("bcc")), F.lit("COLUMN_COUNT_CHANGED")),
        F.when(~blocked & (F.col("ar") > F.col("br")), F.lit("ROWS_ADDED")),
        F.when(~blocked & (removed > 0) & ~F.coalesce("has_dedupe", F.lit(False)),
               F.lit("UNEXPECTED_ROW_REMOVAL"))
        .when(~blocked & (removed > F.col("bd")), F.lit("EXCESS_ROW_REMOVAL")),
        F.when(~blocked & (F.col("ad") > F.col("bd")), F.lit("DUPLICATES_INCREASED"))))
    scalar = j.select(*PLAN_KEYS, F.explode(rules).alias("rule"),
                      F.lit(None).cast("string").alias("code"),
                      F.lit(None).cast("string").alias("column"))
    bp = finding_profile(before_findings, ["dataset_id"]).select(
        "dataset_id", "code", F.col("column").alias("bcol"), F.col("sev").alias("bsev"),
        F.col("cnt").alias("bcnt"))
    ap = finding_profile(after_findings, PLAN_KEYS)
    ok = j.filter(~blocked).select(*PLAN_KEYS)
    fj = (ap.join(ok, on=PLAN_KEYS, how="left_semi")
          .join(bp, (ap["dataset_id"] == bp["dataset_id"]) & (ap["code"] == bp["code"])
                & ap["column"].eqNullSafe(bp["bcol"]), how="left")
          .select(ap["dataset_id"], ap["candidate_id"], ap["code"], ap["column"], "sev", "cnt",
                  "bsev", "bcnt"))
    frules = F.array_compact(F.array(
        F.when(F.col("bsev").isNull(), F.lit("NEW_FINDING")),
        F.when(F.col("bsev").isNotNull() & (F.col("sev") > F.col("bsev")), F.lit("SEVERITY_INCREASED")),
        F.when(F.col("bsev").isNotNull() & (F.col("cnt") > F.col("bcnt")),
               F.lit("FINDING_COUNT_INCREASED"))))
    per_finding = fj.select(*PLAN_KEYS, F.explode(frules).alias("rule"), "code", "column")
    return scalar.unionByName(per_finding)


def _scored(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A13/A14 worked out again from the findings that were not accepted."""
    left = findings.filter(~F.col("accepted"))
    return left.groupBy(*keys).agg(F.sum(T.penalty(F.col("severity"))).alias("lost"), F.count("*").alias("open"))


def _audit_differs(keys: list[str], audits: DataFrame, findings: DataFrame, name: str) -> DataFrame:
    """``keys, name``: the recorded status, score or number of findings is not what the findings give."""
    j = audits.join(_scored(findings, keys), keys, "left")
    lost, number = F.coalesce("lost", F.lit(0)), F.coalesce("open", F.lit(0))
    blocked = F.col("status") == "BLOCKED"
    score = F.when(blocked, 0).otherwise(F.greatest(F.lit(0), F.lit(100) - lost))
    status = F.when(blocked, "BLOCKED").when(number == 0, "READY").otherwise("QUARANTINED")
    differs = ~F.col("quality_score").eqNullSafe(score) | ~F.col("status").eqNullSafe(status) | (F.col("finding_count") != number)
    return j.select(*keys, differs.alias(name))


def evidence_checks(trials: DataFrame, plan_decisions: DataFrame, before: AuditResult, after: AuditResult, plans: DataFrame,
                    plan_actions: DataFrame, policies: DataFrame, comparisons: DataFrame,
                    reproduced: DataFrame | None = None) -> DataFrame:
    """T-5: ``PLAN_KEYS, checks``: for every completed trial the names of the checks its evidence fails.

    Nothing recorded is taken on trust: decisions are authorized again, comparisons
    and scores worked out again from the audits, hashes compared along plan, audit,
    trial and, with ``reproduced(PLAN_KEYS, fingerprint)``, with the output computed again.
    """
    expected, _ = authorize(before.audits, before.findings, plans, plan_actions, policies)
    fields = ("status", "can_execute", "policy_id", "source_fingerprint", "reasons")
    j = (trials.filter("status = 'REAUDITED'").select(*PLAN_KEYS, "output_fingerprint")
         .join(plans.select(*PLAN_KEYS, "source_fingerprint"), PLAN_KEYS, "left")
         .join(expected.select(*PLAN_KEYS, F.struct(*fields).alias("expected")), PLAN_KEYS, "left")
         .join(plan_decisions.select(*PLAN_KEYS, F.struct(*fields).alias("decision")), PLAN_KEYS, "left"))
    told = comparisons.columns[2:]
    again = comparison(before.audits, before.findings, after.audits, after.findings)
    j = (j.join(comparisons.select(*PLAN_KEYS, F.struct(*told).alias("told")), PLAN_KEYS, "left")
         .join(again.select(*PLAN_KEYS, F.struct(*told).alias("again")), PLAN_KEYS, "left"))
    b = before.audits.select("dataset_id", F.col("status").alias("bs"), F.col("fingerprint").alias("bfp"),
                             F.col("row_count").alias("br"), F.col("duplicate_row_count").alias("bd"))
    a = after.audits.select(*PLAN_KEYS, F.col("fingerprint").alias("afp"), F.col("row_count").alias("ar"),
                            F.col("duplicate_row_count").alias("ad"))
    j = (j.join(b, "dataset_id", "left").join(a, PLAN_KEYS, "left")
         .join(_audit_differs(["dataset_id"], before.audits, before.findings, "before_differs"), "dataset_id", "left")
         .join(_audit_differs(PLAN_KEYS, after.audits, after.findings, "after_differs"), PLAN_KEYS, "left"))
    other = F.lit(False)
    if reproduced is not None:
        j = j.join(reproduced.select(*PLAN_KEYS, F.col("fingerprint").alias("now")), PLAN_KEYS, "left")
        other = ~F.col("now").eqNullSafe(F.col("output_fingerprint"))

    def bad_hash(c: str) -> Column:
        return ~F.coalesce(F.col(c).rlike(HEX64), F.lit(False))
    checks = F.array_compact(F.array(*[F.when(F.coalesce(fails, F.lit(True)), F.lit(name)) for name, fails in (
        ("NOT_APPROVED", ~((F.col("decision.status") == "APPROVED") & F.col("decision.can_execute"))),
        ("DECISION_DIFFERS", ~F.col("decision").eqNullSafe(F.col("expected"))),
        ("SOURCE_BLOCKED", F.col("bs") == "BLOCKED"),
        ("BAD_SOURCE_HASH", bad_hash("bfp")),
        ("PLAN_NOT_BOUND", ~F.col("source_fingerprint").eqNullSafe(F.col("bfp"))),
        ("BAD_OUTPUT_HASH", bad_hash("output_fingerprint")),
        ("OUTPUT_HASH_DIFFERS", ~F.col("afp").eqNullSafe(F.col("output_fingerprint"))),
        ("OUTPUT_NOT_REPRODUCED", other),
        ("COMPARISON_DIFFERS", F.col("told").isNull() | ~F.col("told").eqNullSafe(F.col("again"))),
        ("BEFORE_AUDIT_DIFFERS", F.col("before_differs")), ("AFTER_AUDIT_DIFFERS", F.col("after_differs")),
        ("MORE_DUPLICATES_THAN_ROWS", (F.col("bd") > F.col("br")) | (F.col("ad") > F.col("ar"))))]))
    return j.select(*PLAN_KEYS, checks.alias("checks"))


def evaluate(trials: DataFrame, plans: DataFrame, plan_actions: DataFrame, checks: DataFrame,
             regression_rows: DataFrame) -> DataFrame:
    """T-5/T-6: ``PLAN_KEYS, trial_status, status, checks`` of every requested plan and every trial.

    Requests and trials must match both ways: a plan without a trial is
    TRIAL_MISSING, a trial without a plan PLAN_MISSING, a trial of a plan that says
    something else PLAN_DIFFERS. Trials that were not completed keep their status;
    completed ones are EVIDENCE_INVALID when a check of :func:`evidence_checks`
    fails, else REGRESSION_DETECTED or NO_AUDIT_REGRESSION.
    """
    n_reg = regression_rows.groupBy(*PLAN_KEYS).agg(F.count("*").alias("n_reg"))
    asked = plan_hashes(plans, plan_actions).select(*PLAN_KEYS, F.col("plan_hash").alias("asked"))
    ran = trials.select(*PLAN_KEYS, F.col("status").alias("trial_status"), "plan_hash", F.lit(True).alias("ran"))
    j = (asked.join(ran, PLAN_KEYS, "full_outer").join(checks, PLAN_KEYS, "left").join(n_reg, PLAN_KEYS, "left"))
    status = (F.when(F.col("ran").isNull(), "TRIAL_MISSING").when(F.col("asked").isNull(), "PLAN_MISSING")
              .when(~F.col("plan_hash").eqNullSafe(F.col("asked")), "PLAN_DIFFERS")
              .when(F.col("trial_status") != "REAUDITED", F.col("trial_status"))
              .when(F.coalesce(F.size("checks") != 0, F.lit(True)), "EVIDENCE_INVALID")
              .when(F.coalesce("n_reg", F.lit(0)) > 0, "REGRESSION_DETECTED").otherwise("NO_AUDIT_REGRESSION"))
    return j.select(*PLAN_KEYS, "trial_status", status.alias("status"), "checks")
