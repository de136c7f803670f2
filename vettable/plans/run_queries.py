"""Registered queries over governed runs: routes to every terminal state, trial outcomes, tampered evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.audit import AuditResult, audit
from ..operators.compare import comparison, evaluate, evidence_checks
from ..operators.policy import PLAN_KEYS
from ..operators.trials import output_fingerprints, run_trials
from ..session import cut
from . import catalog as C
from . import derived as D
from . import governed as G
from . import oracle as O

register = C.register

# One plan per dataset of the fleet: what a planner proposed.
_TIDY = [("STANDARDIZE_MISSING_MARKERS", ["priority"]), ("REMOVE_EXACT_DUPLICATES", [])]
FLEET_PLANS = {
    "clean": _TIDY, "marked": _TIDY, "contacts": _TIDY, "blank": _TIDY, "stale": _TIDY,
    "emptied": [("STANDARDIZE_MISSING_MARKERS", D.FLEET_COLUMNS)],
    "unsupported": [("FILL_MISSING_VALUES", ["priority"])],
    "misnamed": [("TRIM_OUTER_WHITESPACE", ["priorty"])],
}
_OTHER_SOURCE = "0" * 64


def _fleet_batch(spark, audits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plans, bound to the audited sources but for one that was made for an older source."""
    parts = [G.candidate_batch(spark, audits, {"plan": steps}, [name]) for name, steps in FLEET_PLANS.items()]
    plans, acts = parts[0]
    for p, a in parts[1:]:
        plans, acts = plans.unionByName(p), acts.unionByName(a)
    return plans.withColumn("source_fingerprint", F.when(F.col("dataset_id") == "stale", _OTHER_SOURCE)
                            .otherwise(F.col("source_fingerprint"))), acts


def _fleet_policy(audits: DataFrame) -> DataFrame:
    """Safe repairs everywhere; one dataset's policy also allows an action that is never executed."""
    p = G.safe_policy(audits)
    return p.withColumn("allowed_actions", F.when(F.col("dataset_id") == "unsupported", F.concat(
        "allowed_actions", F.array(F.lit("FILL_MISSING_VALUES")))).otherwise(F.col("allowed_actions")))


def _fleet_after_sql() -> str:
    """Outputs of the plans that run, as one source with the dataset as key."""
    runs = [n for n in FLEET_PLANS if n in ("marked", "emptied")]
    return " UNION ALL ".join(
        f"SELECT dataset_id, _row_id, {', '.join(D.FLEET_COLUMNS)} FROM ({O.apply_sql(part, D.FLEET_COLUMNS, FLEET_PLANS[n])}) r{i}"
        for i, n in enumerate(runs) for part in [f"SELECT * FROM ({D.FLEET_ORDERS_SQL}) f{i} WHERE dataset_id = '{n}'"])


_CRIT = ", ".join(O.q(c) for c in K.CRITICAL_REVIEW_CODES)
_FLEET_CTES = f"""
b AS (SELECT * FROM ({O.audit_sql(D.FLEET_ORDERS_SQL, D.FLEET_COLUMNS, output="audits")}) x1),
bf AS (SELECT dataset_id, bool_or(severity = 'CRITICAL' OR code IN ({_CRIT})) AS critical
       FROM ({O.audit_sql(D.FLEET_ORDERS_SQL, D.FLEET_COLUMNS)}) x2 GROUP BY dataset_id),
a AS (SELECT * FROM ({O.audit_sql(_fleet_after_sql(), D.FLEET_COLUMNS, output="audits")}) x3),
afp AS (SELECT dataset_id, fingerprint FROM ({O.fingerprint_sql(_fleet_after_sql(), D.FLEET_COLUMNS)}) x4),
bfp AS (SELECT dataset_id, fingerprint FROM ({O.fingerprint_sql(D.FLEET_ORDERS_SQL, D.FLEET_COLUMNS)}) x5),
pl AS (SELECT * FROM (VALUES {", ".join(
    f"({O.q(n)}, {str(all(x in K.EXECUTABLE_ACTIONS for x, _ in s)).lower()}, {str(n != 'stale').lower()}, "
    f"{str(all(set(c) <= set(D.FLEET_COLUMNS) for _, c in s)).lower()})" for n, s in FLEET_PLANS.items())})
       AS t(dataset_id, executable, bound, named)),
t AS (SELECT b.dataset_id, b.status AS audit_status, b.quality_score AS score_before, pl.dataset_id IS NOT NULL AS planned,
        CASE WHEN b.status = 'BLOCKED' OR NOT pl.bound THEN 'DENIED' WHEN coalesce(bf.critical, false) THEN 'REQUIRES_REVIEW'
             WHEN NOT pl.executable THEN 'UNSUPPORTED' WHEN NOT pl.named THEN 'TRIAL_FAILED'
             WHEN a.status = 'BLOCKED' THEN 'OUTPUT_BLOCKED' ELSE 'REAUDITED' END AS trial_status,
        a.status AS status_after, a.quality_score AS score_after, a.row_count AS rows_after, b.row_count AS rows_before,
        afp.fingerprint AS output_fingerprint, bfp.fingerprint AS source_fingerprint
      FROM b LEFT JOIN bf ON bf.dataset_id = b.dataset_id LEFT JOIN pl ON pl.dataset_id = b.dataset_id
      LEFT JOIN a ON a.dataset_id = b.dataset_id LEFT JOIN afp ON afp.dataset_id = b.dataset_id
      LEFT JOIN bfp ON bfp.dataset_id = b.dataset_id)"""
_GOVERNED_SQL = f"""
WITH {_FLEET_CTES},
o AS (SELECT *, CASE WHEN audit_status <> 'QUARANTINED' THEN audit_status WHEN NOT planned THEN 'NO_PLAN'
                     WHEN trial_status IN ('DENIED', 'REQUIRES_REVIEW') THEN trial_status
                     WHEN trial_status = 'REAUDITED' THEN 'REPAIRED' ELSE 'EXECUTION_FAILED' END AS outcome FROM t)
SELECT dataset_id, outcome, audit_status, score_before,
  CASE WHEN outcome = 'EXECUTION_FAILED' THEN CASE WHEN dataset_id = 'misnamed' THEN 'UNKNOWN_COLUMN' ELSE trial_status END END AS reason,
  CASE WHEN outcome = 'REPAIRED' THEN score_after END AS score_after,
  CASE WHEN outcome = 'REPAIRED' THEN CAST(rows_after - rows_before AS BIGINT) END AS row_count_delta,
  CASE WHEN outcome = 'REPAIRED' THEN output_fingerprint END AS output_fingerprint,
  CASE WHEN outcome = 'REPAIRED' THEN source_fingerprint IS NOT NULL END AS source_preserved
FROM o
"""


@register("governed_run", _GOVERNED_SQL)
def governed_run(spark, sf_dir):
    """L3: a fleet of datasets, each to its terminal state (every state occurs)."""
    src = D.fleet_orders(spark, sf_dir)
    audits = audit(src, order_col="_row_id", columns=D.FLEET_COLUMNS, materialize=True).audits
    plans, acts = _fleet_batch(spark, audits)
    g = G.govern(src, D.FLEET_COLUMNS, plans, acts, _fleet_policy(audits))
    return g.select("dataset_id", "outcome", "audit_status", "score_before", "reason",
                    F.col("audit_after.quality_score").alias("score_after"), F.col("comparison.row_count_delta").alias("row_count_delta"),
                    F.col("lineage.output_fingerprint_sha256").alias("output_fingerprint"),
                    F.col("lineage.source_preserved").alias("source_preserved"))


@register("trial_outcomes", f"""
WITH {_FLEET_CTES}
SELECT dataset_id, trial_status AS status, CASE WHEN trial_status = 'TRIAL_FAILED' THEN 'UNKNOWN_COLUMN' END AS error,
  CASE WHEN trial_status IN ('REAUDITED', 'OUTPUT_BLOCKED') THEN output_fingerprint END AS output_fingerprint
FROM t WHERE planned AND dataset_id <> 'clean'
""")
def trial_outcomes(spark, sf_dir):
    """T-1, F6: plans of every fate side by side (a failing candidate has an error and stops no other)."""
    src = D.fleet_orders(spark, sf_dir).filter("dataset_id <> 'clean'")
    before = audit(src, order_col="_row_id", columns=D.FLEET_COLUMNS, materialize=True)
    plans, acts = _fleet_batch(spark, before.audits)
    t = run_trials(src, D.FLEET_COLUMNS, before, plans, acts, _fleet_policy(before.audits))
    return t.trials.select("dataset_id", "status", "error", "output_fingerprint")


@register("changed_source_trials", f"""
SELECT 'orders' AS dataset_id, candidate_id, 'SOURCE_CHANGED' AS status, CAST(NULL AS VARCHAR) AS output_fingerprint
FROM (SELECT DISTINCT candidate_id FROM {C._actions_values(C.ORDERS_CANDIDATES)}) t
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))
""")
def changed_source_trials(spark, sf_dir):
    """T-1/F4 integrity: the source gained one row after its audit, so no trial of it counts."""
    src = D.dirty_orders(spark, sf_dir)
    before = audit(src, order_col="_row_id", columns=D.ORDERS_COLUMNS, materialize=True)
    plans, acts = G.candidate_batch(spark, before.audits, C.ORDERS_CANDIDATES, ["orders"])
    first = src.agg(F.min_by(F.struct(*[c for c in src.columns]), "_row_id").alias("r")).select("r.*")
    now = src.unionByName(first.withColumn("_row_id", -F.col("_row_id") - 1))
    t = run_trials(now, D.ORDERS_COLUMNS, before, plans, acts, G.safe_policy(before.audits))
    return t.trials.select(*PLAN_KEYS, "status", "output_fingerprint")


# What is changed in the evidence of a completed trial, and the checks that must notice.
TAMPERED = {
    "untouched": [], "decision": ["NOT_APPROVED", "DECISION_DIFFERS"], "policy": ["DECISION_DIFFERS"],
    "other_plan_source": ["DECISION_DIFFERS", "PLAN_NOT_BOUND"], "output_hash": ["OUTPUT_HASH_DIFFERS", "OUTPUT_NOT_REPRODUCED"],
    "both_hashes": ["OUTPUT_NOT_REPRODUCED"], "no_hash": ["BAD_OUTPUT_HASH", "OUTPUT_HASH_DIFFERS", "OUTPUT_NOT_REPRODUCED"],
    "comparison": ["COMPARISON_DIFFERS"], "no_comparison": ["COMPARISON_DIFFERS"],
    "score": ["COMPARISON_DIFFERS", "AFTER_AUDIT_DIFFERS"], "duplicates": ["COMPARISON_DIFFERS", "MORE_DUPLICATES_THAN_ROWS"],
}
_STEPS = {"kept": C.MARKERS_PLAN}


def _per_kind(df: DataFrame) -> DataFrame:
    """The evidence of the one candidate, once per kind of change (as a candidate of that name)."""
    kinds = F.explode(F.array(*[F.lit(k) for k in TAMPERED])).alias("kind")
    return df.select(kinds, *df.columns).withColumn("candidate_id", F.col("kind")).drop("kind")


@register("tampered_evidence", f"""
WITH r AS (SELECT count(*) AS n FROM ({C._REGRESSION_SQL}) x WHERE candidate_id = 'c_markers')
SELECT 'orders' AS dataset_id, v.candidate_id,
  CASE WHEN v.checks <> '' THEN 'EVIDENCE_INVALID' WHEN r.n > 0 THEN 'REGRESSION_DETECTED' ELSE 'NO_AUDIT_REGRESSION' END AS status,
  v.checks FROM (VALUES {", ".join(f"({O.q(k)}, {O.q(','.join(c))})" for k, c in TAMPERED.items())}) AS v(candidate_id, checks)
JOIN r ON true
""")
def tampered_evidence(spark, sf_dir):
    """T-5: every kind of tampering with a trial's evidence is found by working it out again."""
    from ..operators.compare import regressions
    src = D.dirty_orders(spark, sf_dir)
    before = audit(src, order_col="_row_id", columns=D.ORDERS_COLUMNS, materialize=True)
    plans, acts = G.candidate_batch(spark, before.audits, _STEPS, ["orders"])
    policy = G.safe_policy(before.audits)
    t = run_trials(src, D.ORDERS_COLUMNS, before, plans, acts, policy)
    again = output_fingerprints(src, plans.select(*PLAN_KEYS), acts, D.ORDERS_COLUMNS)
    kind, wrong = F.col("candidate_id"), F.lit("f" * 64)

    def change(df: DataFrame, column: str, **by_kind) -> DataFrame:
        out = F.col(column)
        for k, value in by_kind.items():
            out = F.when(kind == k, value).otherwise(out)
        return df.withColumn(column, out)
    audits, found = _per_kind(t.after.audits), _per_kind(t.after.findings)
    audits = change(audits, "quality_score", score=F.col("quality_score") + 1)
    audits = change(audits, "duplicate_row_count", duplicates=F.col("row_count") + 1)
    audits = change(audits, "fingerprint", both_hashes=wrong)
    after = AuditResult(findings=cut(found), audits=cut(audits))
    told = comparison(before.audits, before.findings, t.after.audits, t.after.findings)
    comp = change(_per_kind(told), "after_quality_score", comparison=F.col("after_quality_score") + 1).filter(kind != "no_comparison")
    decided = change(_per_kind(t.plan_decisions), "status", decision=F.lit("REQUIRES_REVIEW"))
    decided = change(decided, "policy_id", policy=F.lit("another policy"))
    trials = change(_per_kind(t.trials), "output_fingerprint", output_hash=wrong, both_hashes=wrong, no_hash=F.lit("none"))
    asked = change(_per_kind(plans), "source_fingerprint", other_plan_source=wrong)
    steps = _per_kind(acts)
    trials = trials.drop("plan_hash").join(G.plan_hashes(asked, steps), PLAN_KEYS)
    checks = evidence_checks(trials, decided, before, after, asked, steps, policy, comp, _per_kind(again))
    regs = _per_kind(regressions(before.audits, before.findings, t.after.audits, t.after.findings, acts, t.trials))
    return evaluate(trials, asked, steps, cut(checks), regs).select(
        *PLAN_KEYS, "status", F.array_join("checks", ",").alias("checks"))


@register("matched_batch", f"""
WITH ev AS (SELECT * FROM ({C._EVALUATIONS_SQL}) x)
SELECT dataset_id, CASE WHEN candidate_id = 'c_trim' THEN 'c_trim' ELSE candidate_id END AS candidate_id,
  CASE WHEN candidate_id = 'c_trim' THEN 'TRIAL_MISSING' WHEN candidate_id = 'c_dedupe' THEN 'PLAN_DIFFERS'
       ELSE evaluation_status END AS status FROM ev
UNION ALL SELECT DISTINCT dataset_id, 'c_unasked', 'PLAN_MISSING' FROM ev
""")
def matched_batch(spark, sf_dir):
    """T-6: a plan whose trial is lost, a trial nobody asked for, and a trial of a plan that was edited since."""
    src = D.dirty_orders(spark, sf_dir)
    before = audit(src, order_col="_row_id", columns=D.ORDERS_COLUMNS, materialize=True)
    plans, acts = G.candidate_batch(spark, before.audits, C.ORDERS_CANDIDATES, ["orders"])
    a = G.evaluate_candidates(src, D.ORDERS_COLUMNS, plans, acts, G.safe_policy(before.audits), before=before)
    trials = a.trial.trials.filter("candidate_id <> 'c_trim'")
    trials = trials.unionByName(trials.filter("candidate_id = 'c_markers'").withColumn("candidate_id", F.lit("c_unasked")))
    edited = plans.withColumn("summary", F.when(F.col("candidate_id") == "c_dedupe", "edited").otherwise(F.col("summary")))
    checks = evidence_checks(trials, a.trial.plan_decisions, before, a.trial.after, plans, acts, G.safe_policy(before.audits),
                             a.comparisons)
    return evaluate(trials, edited, acts, cut(checks), a.regressions).select(*PLAN_KEYS, "status")
