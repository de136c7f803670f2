"""Governed pipelines over evidence tables.

* :func:`candidate_batch` turns candidate plans (an input, e.g. proposals
  received from a planner) into ``plans`` / ``plan_actions`` bound to the
  audited source fingerprint.
* :func:`evaluate_candidates` is the candidate analysis (L4/L5): audit,
  authorize, trial, compare, check regressions, evaluate, recommend.
* :func:`govern` is the governed run (L3) for one plan per dataset: each
  dataset ends in a terminal state carried as a column, no driver loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import constants as K
from ..operators.audit import AuditResult, audit
from ..operators.compare import comparison, evaluate, evidence_checks, regressions
from ..operators.lineage import lineage
from ..operators.policy import PLAN_KEYS, plan_hashes  # noqa: F401
from ..operators.select import recommend
from ..operators.trials import TrialResult, run_trials, source_fingerprints
from ..session import cut

PLAN_ACTION_SCHEMA = Ty.StructType([
    Ty.StructField("dataset_id", Ty.StringType()),
    Ty.StructField("candidate_id", Ty.StringType()),
    Ty.StructField("summary", Ty.StringType()),
    Ty.StructField("action_idx", Ty.IntegerType()),
    Ty.StructField("action", Ty.StringType()),
    Ty.StructField("columns", Ty.ArrayType(Ty.StringType())),
    Ty.StructField("justification", Ty.StringType()),
])


def safe_policy(datasets: DataFrame, policy_id: str = "safe-repairs",
                allow_safe_repairs: bool = True) -> DataFrame:
    """The policy allowing the three executable actions (or none)."""
    allowed = list(K.EXECUTABLE_ACTIONS) if allow_safe_repairs else []
    return datasets.select("dataset_id").distinct().select(
        "dataset_id", F.lit(policy_id if allow_safe_repairs else "conservative-default")
        .alias("policy_id"),
        F.array(*[F.lit(a) for a in allowed]).cast("array<string>").alias("allowed_actions"))


def candidate_batch(spark: SparkSession, audits: DataFrame,
                    candidates: dict[str, list[tuple[str, list[str]]]],
                    dataset_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Plans for every audited dataset (or the named ones), bound to its fingerprint.

    ``candidates``: candidate_id -> ordered (action, columns) list; an empty
    list is a plan with no action. The batch is one literal array exploded on
    each audit row, so the plans are derived from the audits table itself -
    no dataset list passes through the driver and no join is needed.
    """
    entries = []
    for cid, actions in candidates.items():
        if not actions:
            entries.append((cid, -1, None, [], None))
        for i, (action, cols) in enumerate(actions):
            entries.append((cid, i, action, list(cols), f"step {i} of {cid}"))
    batch = F.array(*[F.struct(
        F.lit(cid).alias("candidate_id"), F.lit(f"plan {cid}").alias("summary"),
        F.lit(i).cast("int").alias("action_idx"), F.lit(a).cast("string").alias("action"),
        F.array(*[F.lit(c) for c in cols]).cast("array<string>").alias("columns"),
        F.lit(j).cast("string").alias("justification")) for cid, i, a, cols, j in entries])
    target = audits if dataset_ids is None else audits.filter(F.col("dataset_id").isin(*dataset_ids))
    bound = target.select("dataset_id", F.col("fingerprint").alias("source_fingerprint"),
                          F.explode(batch).alias("p")).select("dataset_id", "source_fingerprint", "p.*")
    plans = bound.select(*PLAN_KEYS, "source_fingerprint", "summary").distinct()
    plan_actions = bound.filter(F.col("action_idx") >= 0).select(
        *PLAN_KEYS, "action_idx", "action", "columns", "justification")
    return plans, plan_actions


@dataclass
class CandidateAnalysis:
    before: AuditResult
    trial: TrialResult
    comparisons: DataFrame
    regressions: DataFrame
    evaluations: DataFrame
    candidates: DataFrame
    recommendations: DataFrame


def evaluate_candidates(source: DataFrame, columns: list[str], plans: DataFrame,
                        plan_actions: DataFrame, policies: DataFrame,
                        before: AuditResult | None = None,
                        reviews: DataFrame | None = None) -> CandidateAnalysis:
    """L4/L5 for every dataset of ``source`` (verbatim cells + ``_row_id``)."""
    if before is None:
        before = audit(source, columns=columns, order_col="_row_id", reviews=reviews,
                       materialize=True)
    trial = run_trials(source, columns, before, plans, plan_actions, policies, reviews=reviews)
    comp = comparison(before.audits, before.findings, trial.after.audits, trial.after.findings)
    regs = regressions(before.audits, before.findings, trial.after.audits, trial.after.findings,
                       plan_actions, trial.trials)
    regs, comp = cut(regs), cut(comp)
    checks = evidence_checks(trial.trials, trial.plan_decisions, before, trial.after, plans, plan_actions, policies, comp)
    evals = cut(evaluate(trial.trials, plans, plan_actions, checks, regs))
    cands, recs = recommend(evals, before.audits, before.findings, trial.after.audits,
                            trial.after.findings, trial.trials, plan_actions)
    return CandidateAnalysis(before, trial, comp, regs, evals, cands, recs)


def govern(source: DataFrame, columns: list[str], plans: DataFrame, plan_actions: DataFrame,
           policies: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """L3: one plan per dataset; every dataset ends in one row with its terminal state and evidence.

    The route is worked out before anything runs: BLOCKED and READY datasets end
    after the audit (their plans are neither authorized nor run); a QUARANTINED one
    ends NO_PLAN or PLAN_NOT_UNIQUE without exactly one plan, DENIED or
    REQUIRES_REVIEW after authorization. Only datasets with an approved plan are read
    again. Those end REPAIRED with comparison and lineage, or EXECUTION_FAILED with
    the reason.
    """
    before = audit(source, columns=columns, order_col="_row_id", reviews=reviews, materialize=True)
    asked = plans.groupBy("dataset_id").agg(F.count("*").alias("n_plans"), F.min("candidate_id").alias("candidate_id"))
    route = cut(before.audits.join(asked, "dataset_id", "left").select(
        "dataset_id", "candidate_id", F.col("status").alias("audit_status"), F.col("quality_score").alias("score_before"),
        F.when(F.col("status") != "QUARANTINED", F.col("status")).when(F.col("n_plans").isNull(), "NO_PLAN")
        .when(F.col("n_plans") > 1, "PLAN_NOT_UNIQUE").alias("ends")))
    active = route.filter("ends is null").select("dataset_id")
    plans, plan_actions = (cut(x.join(active, "dataset_id", "left_semi")) for x in (plans, plan_actions))
    trial = run_trials(source, columns, before, plans, plan_actions, policies, reviews=reviews)
    comp = comparison(before.audits, before.findings, trial.after.audits, trial.after.findings)
    told = [c for c in comp.columns if c not in PLAN_KEYS]
    now = source_fingerprints(source.join(active, "dataset_id", "left_semi"), columns)
    proven, _ = lineage(now, trial.trials.select(*PLAN_KEYS, F.col("output_fingerprint").alias("fingerprint")), before.audits,
                        trial.after.audits, plans, trial.plan_decisions, trial.action_decisions)
    proof = [c for c in proven.columns if c not in PLAN_KEYS]
    after = trial.after.audits
    j = (route.join(trial.plan_decisions.select(*PLAN_KEYS, F.col("status").alias("decision"), "reasons"), PLAN_KEYS, "left")
         .join(trial.trials.select(*PLAN_KEYS, F.col("status").alias("trial_status"), "error"), PLAN_KEYS, "left")
         .join(after.select(*PLAN_KEYS, F.struct(*[c for c in after.columns if c not in PLAN_KEYS]).alias("audit_after")),
               PLAN_KEYS, "left")
         .join(comp.select(*PLAN_KEYS, F.struct(*told).alias("comparison")), PLAN_KEYS, "left")
         .join(proven.select(*PLAN_KEYS, F.struct(*proof).alias("lineage")), PLAN_KEYS, "left"))
    repaired = F.coalesce((F.col("trial_status") == "REAUDITED") & F.col("lineage").isNotNull(), F.lit(False))
    held = F.col("trial_status").isin("DENIED", "REQUIRES_REVIEW")
    outcome = (F.when(F.col("ends").isNotNull(), F.col("ends")).when(held, F.col("trial_status"))
               .when(repaired, "REPAIRED").otherwise("EXECUTION_FAILED"))
    reason = F.when(F.col("ends").isNull() & ~held & ~repaired, F.coalesce("error", "trial_status"))
    ran = F.col("ends").isNull() & ~held
    return j.select("dataset_id", "candidate_id", outcome.alias("outcome"), "audit_status", "score_before", "decision", "reasons",
                    reason.alias("reason"), *[F.when(ran & repaired, F.col(c)).alias(c)
                                              for c in ("audit_after", "comparison", "lineage")])
