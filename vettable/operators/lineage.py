"""L1/L2: lineage evidence and export verification as fingerprint equi-joins.

Every fingerprint is recomputed from data (never taken from a model or the
plan), then checked against the evidence rows. A failed check is a row in
``failures``; a lineage row is produced only when every check passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import PLAN_KEYS
from .trials import output_fingerprints, source_fingerprints


def lineage(current_source: DataFrame, current_output: DataFrame, before_audits: DataFrame,
            after_audits: DataFrame, plans: DataFrame, plan_decisions: DataFrame,
            plan_actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L1. ``current_source(dataset_id, fingerprint)``,
    ``current_output(dataset_id, candidate_id, fingerprint)``: fingerprints now.

    Returns ``(lineage, failures)``.
    """
    acts = plan_actions.groupBy(*PLAN_KEYS).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("action_idx", "action"))),
                                 lambda x: x["action"]), ",").alias("executed_actions"))
    j = (plans.select(*PLAN_KEYS, F.col("source_fingerprint").alias("plan_fp"))
         .join(plan_decisions.select(*PLAN_KEYS, F.col("source_fingerprint").alias("decision_fp"),
                                     "policy_id"), on=PLAN_KEYS, how="inner")
         .join(current_source.select("dataset_id", F.col("fingerprint").alias("src_fp")),
               on="dataset_id", how="left")
         .join(current_output.select(*PLAN_KEYS, F.col("fingerprint").alias("out_fp")),
               on=PLAN_KEYS, how="left")
         .join(before_audits.select("dataset_id", F.col("fingerprint").alias("before_fp"),
                                    F.col("status").alias("source_audit_status")),
               on="dataset_id", how="left")
         .join(after_audits.select(*PLAN_KEYS, F.col("fingerprint").alias("after_fp"),
                                   F.col("status").alias("output_audit_status")),
               on=PLAN_KEYS, how="inner")
         .join(acts, on=PLAN_KEYS, how="left"))
    checks = F.array_compact(F.array(
        F.when(F.col("src_fp").isNull(), F.lit("SOURCE_MISSING")),
        F.when(F.col("out_fp").isNull(), F.lit("OUTPUT_MISSING")),
        F.when(~F.col("before_fp").eqNullSafe(F.col("src_fp")), F.lit("SOURCE_AUDIT_MISMATCH")),
        F.when(~F.col("plan_fp").eqNullSafe(F.col("src_fp")), F.lit("PLAN_NOT_BOUND")),
        F.when(~F.col("decision_fp").eqNullSafe(F.col("src_fp")), F.lit("DECISION_NOT_BOUND")),
        F.when(~F.col("after_fp").eqNullSafe(F.col("out_fp")), F.lit("OUTPUT_AUDIT_MISMATCH"))))
    j = j.withColumn("_checks", checks)
    failures = j.filter(F.size("_checks") > 0).select(
        *PLAN_KEYS, F.explode("_checks").alias("failure"))
    ok = j.filter(F.size("_checks") == 0).select(
        *PLAN_KEYS, F.col("src_fp").alias("source_fingerprint_sha256"),
        F.col("out_fp").alias("output_fingerprint_sha256"), "source_audit_status",
        "output_audit_status", "policy_id", F.coalesce("executed_actions", F.lit(""))
        .alias("executed_actions"), F.col("src_fp").eqNullSafe(F.col("before_fp")).alias("source_preserved"))
    return ok, failures


def export_check(source: DataFrame, columns: list[str], chosen: DataFrame, plan_actions: DataFrame,
                 trials: DataFrame, source_fingerprint: DataFrame) -> DataFrame:
    """L2: re-run each chosen candidate from the source; its output must reproduce
    the trial fingerprint and the source must be unchanged.

    ``chosen(dataset_id, candidate_id)``; ``source_fingerprint(dataset_id,
    fingerprint)`` is the fingerprint the trial ran on.
    """
    now = output_fingerprints(source, chosen, plan_actions, columns).withColumnRenamed("fingerprint", "fp")
    src_now = source_fingerprints(source, columns).withColumnRenamed("fingerprint", "src_now")
    j = (chosen.select(*PLAN_KEYS).join(now, on=PLAN_KEYS, how="left")
         .join(trials.select(*PLAN_KEYS, "output_fingerprint"), on=PLAN_KEYS, how="left")
         .join(src_now, on="dataset_id", how="left")
         .join(source_fingerprint.select("dataset_id", F.col("fingerprint").alias("src_then")),
               on="dataset_id", how="left"))
    return j.select(*PLAN_KEYS, F.col("fp").alias("output_fingerprint_sha256"),
                    F.col("fp").eqNullSafe(F.col("output_fingerprint")).alias("output_reproduced"),
                    F.col("src_now").eqNullSafe(F.col("src_then")).alias("source_unchanged"),
                    (F.col("fp").eqNullSafe(F.col("output_fingerprint"))
                     & F.col("src_now").eqNullSafe(F.col("src_then"))).alias("export_allowed"))
