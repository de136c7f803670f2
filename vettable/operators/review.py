"""Reviewer declarations (public contact / optional columns).

Declarations are a table ``reviews(dataset_id, kind, column, reviewer_reference,
reason, reviewed_at)`` with ``kind`` in {public_contact, optional}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

PII_CODES = ("PII_COLUMN_NAME", "PII_VALUE_PATTERN")


def public_contact_kind(column) -> F.Column:
    """Phone / email / null for a column name (as a column expression)."""
    m = F.create_map(*[x for k, v in K.PUBLIC_CONTACT_COLUMNS.items() for x in (F.lit(k), F.lit(v))])
    return m[T.normalize_name_col(column)]


def review_sets(reviews: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Declarations folded to one row per dataset (input of the audit's R4 split)."""
    keys = list(keys)
    return reviews.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "public_contact", F.col("column"))))
        .alias("public_columns"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "optional", F.col("column"))))
        .alias("optional_columns"))


def review_violations(reviews: DataFrame, headers: DataFrame, findings: DataFrame,
                      conflicts: DataFrame | None = None, keys=("dataset_id",)) -> DataFrame:
    """Every reason a declaration cannot be applied, one row each.

    ``headers(keys..., position, name)`` lists the dataset's columns,
    ``conflicts(keys..., column, conflicts)`` comes from
    :func:`vettable.operators.audit.contact_conflicts`.
    """
    keys = list(keys)
    dup = (reviews.groupBy(*keys, "kind", "column").count().filter("count > 1")
           .select(*keys, "column", F.lit("DUPLICATE_DECLARATION").alias("violation")))
    unknown = (reviews.join(headers.select(*keys, F.col("name").alias("column")),
                            on=keys + ["column"], how="left_anti")
               .select(*keys, "column", F.lit("UNKNOWN_COLUMN").alias("violation")))
    ambiguous = (reviews.select(*keys).distinct()
                 .join(findings.filter(F.col("code") == "AMBIGUOUS_COLUMN_NAMES").select(*keys),
                       on=keys, how="left_semi")
                 .select(*keys, F.lit(None).cast("string").alias("column"),
                         F.lit("AMBIGUOUS_HEADERS").alias("violation")))
    not_contact = (reviews.filter((F.col("kind") == "public_contact")
                                  & public_contact_kind(F.col("column")).isNull())
                   .select(*keys, "column", F.lit("NOT_A_PUBLIC_CONTACT_COLUMN").alias("violation")))
    bad_kind = (reviews.filter(~F.col("kind").isin("public_contact", "optional"))
                .select(*keys, "column", F.lit("UNKNOWN_KIND").alias("violation")))
    nothing = (reviews.groupBy(*keys).agg(F.count("column").alias("n")).filter("n = 0")
               .select(*keys, F.lit(None).cast("string").alias("column"), F.lit("NOTHING_DECLARED").alias("violation")))
    out = dup.unionByName(unknown.filter(F.col("column").isNotNull())).unionByName(ambiguous).unionByName(
        not_contact.filter(F.col("column").isNotNull())).unionByName(bad_kind).unionByName(nothing)
    if conflicts is not None:
        inc = (reviews.filter(F.col("kind") == "public_contact")
               .join(conflicts.filter(F.col("conflicts") > 0), on=keys + ["column"], how="inner")
               .select(*keys, "column", F.lit("INCOMPATIBLE_CONTACT_VALUES").alias("violation")))
        out = out.unionByName(inc)
    return out


def split_findings(findings: DataFrame, reviews: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """R4 on an existing findings table: set ``accepted`` from declarations."""
    keys = list(keys)
    decl = reviews.select(*keys, "kind", "column").distinct()
    j = findings.drop("accepted").join(decl, on=keys + ["column"], how="left")
    cov = (((F.col("kind") == "public_contact") & F.col("code").isin(*PII_CODES))
           | ((F.col("kind") == "optional") & (F.col("code") == "MISSING_VALUES")))
    return j.groupBy(*[c for c in findings.columns if c != "accepted"]).agg(
        F.coalesce(F.bool_or(cov), F.lit(False)).alias("accepted"))


def offerable_choices(findings: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Columns a reviewer may declare: public-contact PII columns; missing-value columns."""
    keys = list(keys)
    pub = (findings.filter(F.col("code").isin(*PII_CODES) & F.col("column").isNotNull()
                           & public_contact_kind(F.col("column")).isNotNull())
           .groupBy(*keys).agg(F.array_sort(F.collect_set("column")).alias("public_contact")))
    opt = (findings.filter((F.col("code") == "MISSING_VALUES") & F.col("column").isNotNull())
           .groupBy(*keys).agg(F.array_sort(F.collect_set("column")).alias("optional")))
    return pub.join(opt, on=keys, how="full_outer")


def review_digest(reviews: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """SHA-256 of the canonical declarations per dataset.

    Every declaration with its reviewer, reason and time is in the document, in a
    fixed order, so two reviewers give another digest than one.
    """
    keys = list(keys)
    entry = F.struct("column", "kind", "reason", "reviewed_at", "reviewer_reference")
    docs = reviews.groupBy(*keys).agg(F.sort_array(F.collect_set(entry)).alias("declarations"))
    return docs.select(*keys, F.sha2(F.to_json(F.struct("declarations"), {"ignoreNullFields": "false"}), 256)
                       .alias("review_digest"))


def review_validity(reviews: DataFrame, findings: DataFrame, audits: DataFrame,
                    claimed: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Reviewer 1-100 chars, reason 10-500, choices offered, fingerprint fresh.

    A review that declares no column is not valid. ``claimed(keys..., fingerprint)`` is
    the fingerprint the review was made on.
    Output: one row per dataset with ``valid`` and the failed ``checks``.
    """
    keys = list(keys)
    offered = offerable_choices(findings, keys)
    sets = review_sets(reviews, keys)
    meta = reviews.groupBy(*keys).agg(
        F.min(F.length(T.strip(F.col("reviewer_reference")))).alias("rl_min"),
        F.max(F.length(T.strip(F.col("reviewer_reference")))).alias("rl_max"),
        F.min(F.length(T.strip(F.col("reason")))).alias("rs_min"),
        F.max(F.length(T.strip(F.col("reason")))).alias("rs_max"))
    j = (sets.join(meta, on=keys).join(offered, on=keys, how="left")
         .join(audits.select(*keys, F.col("fingerprint").alias("_fresh")), on=keys, how="left")
         .join(claimed.select(*keys, F.col("fingerprint").alias("_claimed")), on=keys, how="left"))
    empty = F.array().cast("array<string>")
    checks = F.array_compact(F.array(
        F.when(F.size("public_columns") + F.size("optional_columns") == 0, F.lit("NOTHING_DECLARED")),
        F.when((F.col("rl_min") < 1) | (F.col("rl_max") > 100), F.lit("REVIEWER_REFERENCE")),
        F.when((F.col("rs_min") < 10) | (F.col("rs_max") > 500), F.lit("REASON_LENGTH")),
        F.when(F.size(F.array_except(F.col("public_columns"),
                                     F.coalesce(F.col("public_contact"), empty))) > 0,
               F.lit("PUBLIC_CHOICE_NOT_OFFERED")),
        F.when(F.size(F.array_except(F.col("optional_columns"),
                                     F.coalesce(F.col("optional"), empty))) > 0,
               F.lit("OPTIONAL_CHOICE_NOT_OFFERED")),
        F.when(~F.col("_fresh").eqNullSafe(F.col("_claimed")), F.lit("STALE_FINGERPRINT"))))
    return j.select(*keys, (F.size(checks) == 0).alias("valid"), checks.alias("checks"))
