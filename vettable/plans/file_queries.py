"""Registered queries over files: every document as the bytes of one CSV file (gate, audits, findings, evidence)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import evidence as EV
from ..operators.audit import header_findings
from ..operators.file_audit import audit_files
from ..operators.policy import authorize
from ..operators.preflight import preflight
from ..sources.files import texts_as_files
from ..sources.tables import read_table
from . import file_oracle as FO
from . import governed as G
from .catalog import register

LIMITS = {"max_file_size_bytes": K.MAX_FILE_SIZE_BYTES, "max_rows": K.MAX_ROWS, "max_columns": K.MAX_COLUMNS,
          "max_cell_length": K.MAX_CELL_LENGTH}
_SQL_LIMITS = {"max_bytes": K.MAX_FILE_SIZE_BYTES, "max_rows": K.MAX_ROWS, "max_columns": K.MAX_COLUMNS,
               "max_cell": K.MAX_CELL_LENGTH}
DOCS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS dataset_id, text FROM documents"


def document_files(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("name"))
    return texts_as_files(d, "doc_id", "text", "name")


@register("preflight_documents", FO.preflight_sql(DOCS_SQL, **_SQL_LIMITS))
def preflight_documents(spark, sf_dir):
    """P3-P15 over every document treated as the bytes of one CSV file."""
    return preflight(document_files(spark, sf_dir), **LIMITS).select(
        "dataset_id", "status", "risk_flag", "encoding", "delimiter", "column_count", "data_row_count", "file_size_bytes")


@register("header_findings", FO.header_findings_sql(DOCS_SQL))
def header_findings_query(spark, sf_dir):
    """A1-A3, A6 over the header (first CSV record) of every document-file."""
    headers = preflight(document_files(spark, sf_dir)).filter(F.col("header").isNotNull()).select(
        "dataset_id", F.posexplode("header").alias("position", "name"))
    return header_findings(headers, ["dataset_id"])


_REQUESTED_SQL = f"""
WITH {FO.gate_ctes(DOCS_SQL, **_SQL_LIMITS)}
SELECT dataset_id, status, risk_flag FROM gate
UNION ALL SELECT 'lost_' || doc_id || '.csv', 'BLOCKED', 'FILE_NOT_FOUND' FROM documents WHERE lang = 'de'
UNION ALL SELECT 'dir_' || doc_id || '.csv', 'BLOCKED', 'NOT_A_FILE' FROM documents WHERE lang = 'es'
"""


@register("requested_files", _REQUESTED_SQL)
def requested_files(spark, sf_dir):
    """P1/P2 with the gate: requested paths of which some don't exist and some are folders."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    lost, folder = F.col("lang").eqNullSafe("de"), F.col("lang").eqNullSafe("es")
    paths = d.select(F.concat(F.when(lost, "lost_").when(folder, "dir_").otherwise("doc_"), "id", F.lit(".csv")).alias("path"),
                     (~lost).alias("exists"), (~lost & ~folder).alias("is_file"))
    return preflight(document_files(spark, sf_dir), paths=paths, **LIMITS).select("dataset_id", "status", "risk_flag")


@register("blocked_audits", FO.file_audit_sql(DOCS_SQL, **_SQL_LIMITS))
def blocked_audits(spark, sf_dir):
    """A12 with A1-A14: one audit per document-file; blocked ones have score 0 and one CRITICAL finding."""
    return audit_files(document_files(spark, sf_dir), **LIMITS).audits


@register("file_findings", FO.file_audit_sql(DOCS_SQL, "findings", **_SQL_LIMITS))
def file_findings(spark, sf_dir):
    """A1-A12 findings of every document-file, each with a header of its own."""
    return audit_files(document_files(spark, sf_dir), **LIMITS).findings.drop("accepted")


_PROPOSAL = {"c_trim": [("REMOVE_EXACT_DUPLICATES", [])], "c_none": []}
_BLOCKED_POLICY_SQL = f"""
WITH a AS ({FO.file_audit_sql(DOCS_SQL, **_SQL_LIMITS)}),
f AS ({FO.file_audit_sql(DOCS_SQL, "findings", **_SQL_LIMITS)}),
crit AS (SELECT dataset_id, bool_or(severity = 'CRITICAL' OR code IN ({", ".join("'" + c + "'" for c in K.CRITICAL_REVIEW_CODES)})) AS critical
         FROM f GROUP BY dataset_id)
SELECT a.dataset_id, v.candidate_id, CASE WHEN a.status = 'BLOCKED' THEN 'DENIED' WHEN coalesce(crit.critical, false) THEN 'REQUIRES_REVIEW'
         WHEN v.n = 0 AND a.status <> 'READY' THEN 'REQUIRES_REVIEW' ELSE 'APPROVED' END AS status,
       a.status <> 'BLOCKED' AS leaves
FROM a JOIN (VALUES ('c_trim', 1), ('c_none', 0)) AS v(candidate_id, n) ON true LEFT JOIN crit ON crit.dataset_id = a.dataset_id
"""


@register("blocked_decisions", _BLOCKED_POLICY_SQL)
def blocked_decisions(spark, sf_dir):
    """V4 rule 2 and E1 over files: plans for blocked files are denied, and their evidence never leaves."""
    r = audit_files(document_files(spark, sf_dir), **LIMITS)
    plans, acts = G.candidate_batch(spark, r.audits, _PROPOSAL)
    decided, _ = authorize(r.audits, r.findings, plans, acts, G.safe_policy(r.audits))
    leaves = EV.eligible_audits(r.audits).select("dataset_id", F.lit(True).alias("leaves"))
    return decided.join(leaves, "dataset_id", "left").select(
        "dataset_id", "candidate_id", "status", F.coalesce("leaves", F.lit(False)).alias("leaves"))
