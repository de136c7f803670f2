"""What audit evidence may leave the trust boundary.

Only codes, severities, counts and column *aliases* leave; real column names
stay in a local alias table. All steps are relational: a filter, a
``dense_rank`` per dataset, joins back on the alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ISSUES = 500


def eligible_audits(audits: DataFrame) -> DataFrame:
    """BLOCKED or un-fingerprinted audits never leave."""
    return audits.filter((F.col("status") != "BLOCKED") & F.col("fingerprint").isNotNull()
                         & F.col("fingerprint").rlike("^[0-9a-f]{64}$"))


def column_aliases(findings: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Sorted distinct finding columns per dataset -> ``column_001``, ``column_002`` ..."""
    keys = list(keys)
    cols = findings.filter(F.col("column").isNotNull() & ~F.col("accepted")) \
        .select(*keys, "column").distinct()
    w = Window.partitionBy(*keys).orderBy("column")
    return cols.select(*keys, "column",
                       F.format_string("column_%03d", F.dense_rank().over(w)).alias("alias"))


def minimized_issues(findings: DataFrame, audits: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """E3 (issue rows): code, severity, alias, count - no names, values or messages."""
    keys = list(keys)
    rem = findings.filter(~F.col("accepted"))
    aliases = column_aliases(findings, keys)
    ok = eligible_audits(audits).select(*keys)
    return (rem.join(ok, on=keys, how="left_semi")
           .join(aliases, on=keys + ["column"], how="left")
           .select(*keys, "ord", "code", "severity", F.col("alias").alias("column_ref"), "count"))


def oversized_evidence(findings: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Datasets whose issue list is too long to be accepted: refused whole, never cut."""
    keys = list(keys)
    return (findings.filter(~F.col("accepted")).groupBy(*keys).agg(F.count("*").alias("issues"))
            .filter(F.col("issues") > MAX_ISSUES))


def minimized_evidence(findings: DataFrame, audits: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """E3 (record): one JSON document per dataset, sorted keys, issues in order.

    A dataset with more than ``MAX_ISSUES`` issues is refused whole (:func:`oversized_evidence` names it).
    """
    keys = list(keys)
    refused = oversized_evidence(findings, keys)
    audits = audits.join(refused.select(*keys), keys, "left_anti")
    issues = minimized_issues(findings, audits, keys)
    per = issues.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "ord", "code", "column_ref", "count", "severity"))).alias("issues"))
    rec = eligible_audits(audits).join(per, on=keys, how="left")
    issue_arr = F.transform(F.coalesce(F.col("issues"), F.array()), lambda x: F.struct(
        x["code"].alias("code"), x["column_ref"].alias("column_ref"), x["count"].alias("count"),
        x["severity"].alias("severity")))
    doc = F.struct(
        F.col("column_count").alias("column_count"),
        F.col("duplicate_row_count").alias("duplicate_row_count"),
        issue_arr.alias("issues"),
        F.col("quality_score").alias("quality_score"),
        F.col("row_count").alias("row_count"),
        F.col("fingerprint").alias("source_fingerprint_sha256"),
        F.col("status").alias("status"))
    return rec.select(*keys, F.to_json(doc).alias("evidence_json"))


def restore_columns(plan_actions: DataFrame, aliases: DataFrame, keys=("dataset_id",)) -> tuple[
        DataFrame, DataFrame]:
    """Map returned aliases back to real columns, keeping their order.

    Returns ``(restored plan_actions, unknown aliases)``; a plan with an
    unknown alias must be rejected.
    """
    keys = list(keys)
    exploded = plan_actions.select(*keys, "candidate_id", "action_idx",
                                   F.posexplode_outer("columns").alias("pos", "alias"))
    joined = exploded.join(aliases.select(*keys, "alias", "column"), on=keys + ["alias"], how="left")
    unknown = joined.filter(F.col("alias").isNotNull() & F.col("column").isNull()) \
        .select(*keys, "candidate_id", "action_idx", "alias")
    back = joined.groupBy(*keys, "candidate_id", "action_idx").agg(
        F.sort_array(F.collect_list(F.when(F.col("alias").isNotNull(),
                                           F.struct("pos", "column")))).alias("_c"))
    restored = plan_actions.drop("columns").join(back, on=keys + ["candidate_id", "action_idx"],
                                                 how="left") \
        .withColumn("columns", F.transform(F.coalesce(F.col("_c"), F.array()),
                                           lambda x: x["column"])).drop("_c")
    return restored, unknown


def public_audit(audits: DataFrame, findings: DataFrame) -> DataFrame:
    """E5: audits for readers outside: counts, score and status, issues by code and column, no messages or values."""
    issue = F.struct("ord", "code", "severity", "column", "count", "accepted")
    per = findings.groupBy("dataset_id").agg(F.sort_array(F.collect_list(issue)).alias("issues"))

    def told(accepted: Column) -> Column:
        kept = F.filter(F.coalesce("issues", F.array().cast(per.schema["issues"].dataType)), lambda x: x["accepted"] == accepted)
        return F.to_json(F.transform(kept, lambda x: F.struct(x["code"].alias("code"), x["severity"].alias("severity"),
                                                              x["column"].alias("column"), x["count"].alias("count"))))
    return audits.join(per, "dataset_id", "left").select(
        "dataset_id", "status", "fingerprint", "row_count", "column_count", "duplicate_row_count", "quality_score",
        told(F.lit(False)).alias("issues"), told(F.lit(True)).alias("accepted_issues"))
