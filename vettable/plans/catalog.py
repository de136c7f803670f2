"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver tables (or views Spark derives from all of their
rows). ``ORACLE`` holds the matching DuckDB SQL where the semantics are
expressible in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import audit
from ..sources.tables import read_table
from . import derived as D
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def _orders_audit(spark, sf_dir):
    return audit(D.dirty_orders(spark, sf_dir), order_col="_row_id", columns=D.ORDERS_COLUMNS)


AUDIT_COLS = ["dataset_id", "status", "row_count", "column_count", "duplicate_row_count",
              "quality_score", "finding_count"]


@register("audit_findings", O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS))
def audit_findings(spark, sf_dir):
    """A1-A14 findings of the dirty orders dataset, in emission order."""
    return _orders_audit(spark, sf_dir).findings


@register("audit_score", O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, output="audits"))
def audit_score(spark, sf_dir):
    """A13/A14 audit record: status, counts, quality score."""
    return _orders_audit(spark, sf_dir).audits.select(*AUDIT_COLS)


_MISSING_SQL = O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, codes=("MISSING_VALUES",))
_DUP_SQL = O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, codes=("DUPLICATE_ROWS",))
_MIXED_SQL = O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, codes=("MIXED_NUMERIC_TEXT",))


def _only(findings: DataFrame, code: str) -> DataFrame:
    return findings.filter(F.col("code") == code)


@register("missing_values", _MISSING_SQL)
def missing_values(spark, sf_dir):
    """A4: missing or blank cells per column."""
    return _only(_orders_audit(spark, sf_dir).findings, "MISSING_VALUES")


@register("duplicate_rows", _DUP_SQL)
def duplicate_rows(spark, sf_dir):
    """A5: extra copies of exact duplicate rows (NA-folded view)."""
    return _only(_orders_audit(spark, sf_dir).findings, "DUPLICATE_ROWS")


@register("mixed_numeric_text", _MIXED_SQL)
def mixed_numeric_text(spark, sf_dir):
    """A10: numbers and text among the first 2,000 non-empty values of a column."""
    return _only(_orders_audit(spark, sf_dir).findings, "MIXED_NUMERIC_TEXT")


@register("pii_documents", O.audit_sql(
    "SELECT lang AS dataset_id, doc_id AS _row_id, text FROM documents", ["text"]))
def pii_documents(spark, sf_dir):
    """A7 (with A4/A5/A9/A10) over every document text, one dataset per language."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("_row_id"), "text")
    return audit(d, order_col="_row_id", columns=["text"]).findings


@register("unicode_documents", O.audit_sql(
    "SELECT lang AS dataset_id, doc_id AS _row_id, translate(text, ' 0123', chr(160) || '\uff10\uff11\uff12\uff13') AS text "
    "FROM documents", ["text"]))
def unicode_documents(spark, sf_dir):
    """A7/A9 over every document text with no-break spaces for blanks and full-width digits for 0 to 3."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("_row_id"),
        F.translate("text", " 0123", "\u00a0\uff10\uff11\uff12\uff13").alias("text"))
    return audit(d, order_col="_row_id", columns=["text"]).findings


@register("pii_pages", O.audit_sql(
    "SELECT 'pages' AS dataset_id, page_id AS _row_id, url, html FROM pages", ["url", "html"]))
def pii_pages(spark, sf_dir):
    """A7 over raw web pages (url and html columns)."""
    p = read_table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("dataset_id"), F.col("page_id").alias("_row_id"), "url", "html")
    return audit(p, order_col="_row_id", columns=["url", "html"]).findings


@register("prompt_injection", O.audit_sql(D.DOCUMENTS_WITH_PHRASES_SQL, ["text"],
                                          codes=("PROMPT_INJECTION_PATTERN",)))
def prompt_injection(spark, sf_dir):
    """Instruction-manipulation text, per language."""
    return _only(audit(D.documents_with_phrases(spark, sf_dir), order_col="_row_id",
                       columns=["text"]).findings, "PROMPT_INJECTION_PATTERN")


@register("conversation_audit", O.audit_sql(
    "SELECT role AS dataset_id, {'c': conv_id, 't': turn} AS _row_id, text FROM conversations", ["text"]))
def conversation_audit(spark, sf_dir):
    """Full audit of conversation turns, one dataset per role.

    Row order (for the A10 type sample) is conversation, then turn.
    """
    c = read_table(spark, sf_dir, "conversations").select(
        F.col("role").alias("dataset_id"), F.struct("conv_id", "turn").alias("_row_id"),
        "text")
    return audit(c, order_col="_row_id", columns=["text"]).findings


@register("invalid_coordinate", O.audit_sql(D.COORDINATES_SQL, ["Latitude", "lon"]))
def invalid_coordinate(spark, sf_dir):
    """Coordinate columns; in-range decimals are exempt from A7."""
    return audit(D.coordinates(spark, sf_dir), order_col="_row_id",
                 columns=["Latitude", "lon"]).findings


@register("fleet_audit", O.audit_sql(D.EVENTS_FLEET_SQL, ["user_id", "props"], output="audits"))
def fleet_audit(spark, sf_dir):
    """A13/A14 for a fleet: one audit record per event type, one scan for all."""
    return audit(D.events_fleet(spark, sf_dir), order_col="_row_id",
                 columns=["user_id", "props"]).audits.select(*AUDIT_COLS)


# ---------------------------------------------------------------- repairs
from ..operators.repairs import apply_plan  # noqa: E402

PADDED_COLUMNS = ["status", "cust"]
TRIM_PLAN = [("TRIM_OUTER_WHITESPACE", ["status", "cust"])]
DEDUPE_PLAN = [("REMOVE_EXACT_DUPLICATES", [])]
MARKERS_PLAN = [("STANDARDIZE_MISSING_MARKERS", ["priority"])]
CHAIN_PLAN = [("TRIM_OUTER_WHITESPACE", ["priority"]), ("STANDARDIZE_MISSING_MARKERS", ["priority"]),
              ("REMOVE_EXACT_DUPLICATES", [])]


def _repaired(df: DataFrame, columns: list[str], plan) -> DataFrame:
    out = apply_plan(df, plan, keys=["dataset_id"], data_columns=columns)
    return out.select("dataset_id", "_row_id", *columns)


@register("repair_trim", O.apply_sql(D.PADDED_ORDERS_SQL, PADDED_COLUMNS, TRIM_PLAN))
def repair_trim(spark, sf_dir):
    """outer whitespace removed from the named columns."""
    return _repaired(D.padded_orders(spark, sf_dir), PADDED_COLUMNS, TRIM_PLAN)


@register("repair_dedupe", O.apply_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, DEDUPE_PLAN))
def repair_dedupe(spark, sf_dir):
    """exact duplicate rows removed, first copy (lowest row id) kept."""
    return _repaired(D.dirty_orders(spark, sf_dir), D.ORDERS_COLUMNS, DEDUPE_PLAN)


@register("repair_markers", O.apply_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, MARKERS_PLAN))
def repair_markers(spark, sf_dir):
    """textual missing markers in the named column become null."""
    return _repaired(D.dirty_orders(spark, sf_dir), D.ORDERS_COLUMNS, MARKERS_PLAN)


@register("repair_chain", O.apply_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, CHAIN_PLAN))
def repair_chain(spark, sf_dir):
    """trim, then markers, then de-duplication, in plan order."""
    return _repaired(D.dirty_orders(spark, sf_dir), D.ORDERS_COLUMNS, CHAIN_PLAN)


# ---------------------------------------------------------------- fingerprints
from ..operators.audit import identity_stats  # noqa: E402

DOC_FP_COLUMNS = ["text", "source"]


@register("table_fingerprint", O.fingerprint_sql(
    "SELECT lang AS dataset_id, text, source FROM documents", DOC_FP_COLUMNS))
def table_fingerprint(spark, sf_dir):
    """Order-independent multiset fingerprint of each language's documents."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset_id"), "text", "source")
    return identity_stats(d, ["dataset_id"], DOC_FP_COLUMNS).select(
        "dataset_id", "row_count", "fingerprint")


@register("document_sha256", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS length FROM documents")
def document_sha256(spark, sf_dir):
    """S8 on content: SHA-256 and byte length of every document's UTF-8 bytes."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    b = F.encode("text", "UTF-8")
    return d.select("doc_id", F.sha2(b, 256).alias("sha256"), F.octet_length(b).cast("bigint")
                    .alias("length"))


# ---------------------------------------------------------------- trials (T-1)
from ..plans import governed as G  # noqa: E402

ORDERS_CANDIDATES = {
    "c_dedupe": DEDUPE_PLAN,
    "c_markers": MARKERS_PLAN,
    "c_markers_dedupe": MARKERS_PLAN + DEDUPE_PLAN,
    "c_trim": [("TRIM_OUTER_WHITESPACE", ["priority"])],
    "c_redact": [("REDACT_PII", ["cust"])],
}


def _orders_trial(spark, sf_dir):
    """Source audit and trial only: what the trial-level queries need (L4 up to T-1)."""
    from ..operators.trials import run_trials
    src = D.dirty_orders(spark, sf_dir)
    before = audit(src, order_col="_row_id", columns=D.ORDERS_COLUMNS, materialize=True)
    plans, acts = G.candidate_batch(spark, before.audits, ORDERS_CANDIDATES, ["orders"])
    trial = run_trials(src, D.ORDERS_COLUMNS, before, plans, acts, G.safe_policy(before.audits))
    return before, trial, acts


def _orders_analysis(spark, sf_dir):
    src = D.dirty_orders(spark, sf_dir)
    before = audit(src, order_col="_row_id", columns=D.ORDERS_COLUMNS, materialize=True)
    plans, acts = G.candidate_batch(spark, before.audits, ORDERS_CANDIDATES, ["orders"])
    pol = G.safe_policy(before.audits)
    return G.evaluate_candidates(src, D.ORDERS_COLUMNS, plans, acts, pol, before=before)


def _trial_outputs_sql() -> str:
    parts = []
    for cid, plan in ORDERS_CANDIDATES.items():
        if cid == "c_redact":
            continue
        body = O.apply_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, plan)
        parts.append(f"SELECT '{cid}' AS dataset_id, _row_id, "
                     + ", ".join(O.ident(c) for c in D.ORDERS_COLUMNS) + f" FROM ({body}) z")
    return " UNION ALL ".join(parts)


_TRIAL_AUDIT_SQL = ("SELECT 'orders' AS dataset_id, dataset_id AS candidate_id, status, row_count, "
                    "column_count, duplicate_row_count, quality_score, finding_count FROM ("
                    + O.audit_sql(_trial_outputs_sql(), D.ORDERS_COLUMNS, output="audits") + ") t")


@register("trial_audits", _TRIAL_AUDIT_SQL)
def trial_audits(spark, sf_dir):
    """T-1: every permitted candidate executed and re-audited in one job."""
    _, trial, _ = _orders_trial(spark, sf_dir)
    return trial.after.audits.select("dataset_id", "candidate_id", *AUDIT_COLS[1:])


# ---------------------------------------------------------------- authorization (V4/V5)
from ..functions import constants as K  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..operators.policy import authorize  # noqa: E402

DOC_SOURCE_SQL = "SELECT lang AS dataset_id, doc_id AS _row_id, text FROM documents"


def _two_fleets(spark, sf_dir):
    """Evidence of two sources with different schemas, unioned as evidence tables."""
    o = audit(D.dirty_orders(spark, sf_dir), order_col="_row_id", columns=D.ORDERS_COLUMNS,
              materialize=True)
    d = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("_row_id"), "text")
    dr = audit(d, order_col="_row_id", columns=["text"], materialize=True)
    return o.audits.unionByName(dr.audits), o.findings.unionByName(dr.findings)


def _decisions(spark, sf_dir):
    audits, findings = _two_fleets(spark, sf_dir)
    plans, acts = G.candidate_batch(spark, audits, ORDERS_CANDIDATES)
    pol = G.safe_policy(audits)
    return authorize(audits, findings, plans, acts, pol)


def _candidate_values() -> str:
    rows = []
    for cid, plan in ORDERS_CANDIDATES.items():
        allowed = all(a in K.EXECUTABLE_ACTIONS for a, _ in plan)
        rows.append(f"('{cid}', {len(plan)}, {str(allowed).lower()})")
    return "(VALUES " + ", ".join(rows) + ") AS cand(candidate_id, n_actions, all_allowed)"


_CRIT = ", ".join(O.q(c) for c in K.CRITICAL_REVIEW_CODES)


def _policy_sql(sources: list[tuple[str, list[str]]]) -> str:
    """V4 in SQL for every candidate of every dataset of the given sources."""
    fs = " UNION ALL ".join(f"SELECT * FROM ({O.audit_sql(s, c)}) x{i}" for i, (s, c) in enumerate(sources))
    aus = " UNION ALL ".join(f"SELECT dataset_id, status FROM ({O.audit_sql(s, c, output='audits')}) y{i}"
                             for i, (s, c) in enumerate(sources))
    return f"""
WITH f AS ({fs}),
a AS ({aus}),
crit AS (SELECT dataset_id, string_agg(DISTINCT code, ', ' ORDER BY code) AS codes FROM f
         WHERE NOT accepted AND (severity = 'CRITICAL' OR code IN ({_CRIT})) GROUP BY dataset_id)
SELECT a.dataset_id, cand.candidate_id,
  CASE WHEN crit.codes IS NOT NULL THEN 'REQUIRES_REVIEW'
       WHEN cand.n_actions = 0 AND a.status = 'READY' THEN 'APPROVED'
       WHEN cand.n_actions = 0 THEN 'REQUIRES_REVIEW'
       WHEN NOT cand.all_allowed THEN 'REQUIRES_REVIEW' ELSE 'APPROVED' END AS status,
  CASE WHEN crit.codes IS NOT NULL THEN 'CRITICAL_FINDINGS: ' || crit.codes
       WHEN NOT cand.all_allowed THEN 'NOT_ALLOWED: an action is outside the policy'
       ELSE 'ALL_ALLOWED: the policy lists every action' END AS reason
FROM a JOIN {_candidate_values()} ON true
LEFT JOIN crit ON crit.dataset_id = a.dataset_id
"""


_POLICY_SQL = _policy_sql([(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS), (DOC_SOURCE_SQL, ["text"])])


@register("policy_decisions", _POLICY_SQL)
def policy_decisions(spark, sf_dir):
    """V4/V5: each candidate of each dataset decided against its audit and policy."""
    pd_, _ = _decisions(spark, sf_dir)
    return pd_.select("dataset_id", "candidate_id", "status", F.col("reasons")[0].alias("reason"))


_ACTION_SQL = f"""
WITH pd AS ({_POLICY_SQL}),
acts AS (SELECT * FROM (VALUES {", ".join(
    f"('{cid}', {i}, '{a}')" for cid, plan in ORDERS_CANDIDATES.items() for i, (a, _) in enumerate(plan))})
    AS t(candidate_id, action_idx, action))
SELECT pd.dataset_id, acts.candidate_id, CAST(acts.action_idx AS INTEGER) AS action_idx, acts.action,
  CASE WHEN pd.reason LIKE 'CRITICAL%' THEN 'REQUIRES_REVIEW'
       WHEN acts.action IN ({", ".join(O.q(a) for a in K.EXECUTABLE_ACTIONS)}) THEN 'APPROVED'
       ELSE 'REQUIRES_REVIEW' END AS decision
FROM pd JOIN acts ON acts.candidate_id = pd.candidate_id
"""


@register("action_decisions", _ACTION_SQL)
def action_decisions(spark, sf_dir):
    """V4 per action: approved, held for review, or denied with the plan."""
    _, ad = _decisions(spark, sf_dir)
    return ad.select("dataset_id", "candidate_id", "action_idx", "action", "decision")


# ---------------------------------------------------------------- comparison, regressions, selection
_BEFORE_F = O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)
_BEFORE_A = O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, output="audits")
_AFTER_F = O.audit_sql(_trial_outputs_sql(), D.ORDERS_COLUMNS)
_AFTER_A = O.audit_sql(_trial_outputs_sql(), D.ORDERS_COLUMNS, output="audits")

_COMPARISON_SQL = f"""
WITH b AS (SELECT * FROM ({_BEFORE_A}) x), a AS (SELECT * FROM ({_AFTER_A}) y),
bf AS (SELECT dataset_id, list_distinct(list(code)) AS codes FROM ({_BEFORE_F}) z GROUP BY dataset_id),
af AS (SELECT dataset_id, list_distinct(list(code)) AS codes FROM ({_AFTER_F}) w GROUP BY dataset_id)
SELECT b.dataset_id, a.dataset_id AS candidate_id, b.status AS before_status, a.status AS after_status,
  b.quality_score AS before_quality_score, a.quality_score AS after_quality_score,
  CAST(a.quality_score - b.quality_score AS INTEGER) AS quality_score_delta,
  b.finding_count AS before_issue_count, a.finding_count AS after_issue_count,
  CAST(a.finding_count - b.finding_count AS INTEGER) AS issue_count_delta,
  b.row_count AS before_row_count, a.row_count AS after_row_count,
  CAST(a.row_count - b.row_count AS BIGINT) AS row_count_delta,
  b.duplicate_row_count AS before_duplicate_row_count, a.duplicate_row_count AS after_duplicate_row_count,
  CAST(greatest(0, b.duplicate_row_count - a.duplicate_row_count) AS BIGINT) AS duplicate_rows_removed,
  array_to_string(list_sort(list_filter(coalesce(bf.codes, []), lambda x: NOT list_contains(coalesce(af.codes, []), x))), ',') AS resolved_issue_codes,
  array_to_string(list_sort(list_filter(coalesce(bf.codes, []), lambda x: list_contains(coalesce(af.codes, []), x))), ',') AS remaining_issue_codes,
  array_to_string(list_sort(list_filter(coalesce(af.codes, []), lambda x: NOT list_contains(coalesce(bf.codes, []), x))), ',') AS new_issue_codes
FROM b JOIN a ON true LEFT JOIN bf ON bf.dataset_id = b.dataset_id LEFT JOIN af ON af.dataset_id = a.dataset_id
"""


@register("comparison", _COMPARISON_SQL)
def comparison_query(spark, sf_dir):
    """T-2: before/after deltas and code sets for every executed candidate."""
    from ..operators.compare import comparison
    before, trial, _ = _orders_trial(spark, sf_dir)
    return comparison(before.audits, before.findings, trial.after.audits, trial.after.findings)


_SEV = "CASE severity WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'CRITICAL' THEN 3 ELSE 0 END"
_REGRESSION_SQL = f"""
WITH b AS (SELECT * FROM ({_BEFORE_A}) x), a AS (SELECT * FROM ({_AFTER_A}) y),
bp AS (SELECT code, "column", max({_SEV}) AS sev, sum("count") AS cnt FROM ({_BEFORE_F}) z GROUP BY code, "column"),
ap AS (SELECT dataset_id, code, "column", max({_SEV}) AS sev, sum("count") AS cnt FROM ({_AFTER_F}) w
       GROUP BY dataset_id, code, "column"),
dd AS (SELECT * FROM (VALUES {", ".join(f"('{cid}', {str(any(x == 'REMOVE_EXACT_DUPLICATES' for x, _ in plan)).lower()})" for cid, plan in ORDERS_CANDIDATES.items())}) AS t(candidate_id, has_dedupe)),
scalar AS (
  SELECT a.dataset_id AS candidate_id, 'READINESS_REGRESSION' AS rule FROM a JOIN b ON true WHERE b.status = 'READY' AND a.status <> 'READY'
  UNION ALL SELECT a.dataset_id, 'QUALITY_SCORE_DECREASED' FROM a JOIN b ON true WHERE a.quality_score < b.quality_score
  UNION ALL SELECT a.dataset_id, 'COLUMN_COUNT_CHANGED' FROM a JOIN b ON true WHERE a.column_count <> b.column_count
  UNION ALL SELECT a.dataset_id, 'ROWS_ADDED' FROM a JOIN b ON true WHERE a.row_count > b.row_count
  UNION ALL SELECT a.dataset_id, CASE WHEN NOT dd.has_dedupe THEN 'UNEXPECTED_ROW_REMOVAL' ELSE 'EXCESS_ROW_REMOVAL' END
     FROM a JOIN b ON true JOIN dd ON dd.candidate_id = a.dataset_id
     WHERE (b.row_count - a.row_count > 0 AND NOT dd.has_dedupe) OR (dd.has_dedupe AND b.row_count - a.row_count > b.duplicate_row_count)
  UNION ALL SELECT a.dataset_id, 'DUPLICATES_INCREASED' FROM a JOIN b ON true WHERE a.duplicate_row_count > b.duplicate_row_count),
per AS (
  SELECT ap.dataset_id AS candidate_id, 'NEW_FINDING' AS rule, ap.code, ap."column" FROM ap
    LEFT JOIN bp ON bp.code = ap.code AND bp."column" IS NOT DISTINCT FROM ap."column" WHERE bp.code IS NULL
  UNION ALL SELECT ap.dataset_id, 'SEVERITY_INCREASED', ap.code, ap."column" FROM ap
    JOIN bp ON bp.code = ap.code AND bp."column" IS NOT DISTINCT FROM ap."column" WHERE ap.sev > bp.sev
  UNION ALL SELECT ap.dataset_id, 'FINDING_COUNT_INCREASED', ap.code, ap."column" FROM ap
    JOIN bp ON bp.code = ap.code AND bp."column" IS NOT DISTINCT FROM ap."column" WHERE ap.cnt > bp.cnt)
SELECT 'orders' AS dataset_id, candidate_id, rule, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS "column" FROM scalar
UNION ALL SELECT 'orders', candidate_id, rule, code, "column" FROM per
"""


@register("regressions", _REGRESSION_SQL)
def regressions_query(spark, sf_dir):
    """T-4: regression rules fired by each executed candidate."""
    from ..operators.compare import regressions
    before, trial, acts = _orders_trial(spark, sf_dir)
    return regressions(before.audits, before.findings, trial.after.audits, trial.after.findings,
                       acts, trial.trials)


def _actions_values(candidates) -> str:
    rows = []
    for cid, plan in candidates.items():
        for i, (a, cols) in enumerate(plan):
            lst = "[" + ", ".join(O.q(c) for c in cols) + "]" if cols else "CAST([] AS VARCHAR[])"
            rows.append(f"({O.q(cid)}, {i}, {O.q(a)}, {lst})")
    return "(VALUES " + ", ".join(rows) + ") AS t(candidate_id, action_idx, action, cols)"


_EXE = ", ".join(O.q(a) for a in K.EXECUTABLE_ACTIONS)
_KNOWN = "[" + ", ".join(O.q(c) for c in D.ORDERS_COLUMNS) + "]"
_TRIAL_FP_SQL = O.fingerprint_sql(_trial_outputs_sql(), D.ORDERS_COLUMNS)

# T-1 status, T-5/T-6 evaluation, C1 improvement and C3 disposition restated in
# SQL over the before/after audits of the dirty orders and the fixed batch.
_EVAL_CTES = f"""
pd AS (SELECT candidate_id, status FROM ({_policy_sql([(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)])}) z),
acts AS (SELECT * FROM {_actions_values(ORDERS_CANDIDATES)}),
st AS (SELECT candidate_id, bool_and(action IN ({_EXE})) AS exe,
         bool_or((action = 'REMOVE_EXACT_DUPLICATES' AND len(cols) > 0)
              OR (action = 'STANDARDIZE_MISSING_MARKERS' AND len(cols) = 0)
              OR (action IN ('TRIM_OUTER_WHITESPACE', 'STANDARDIZE_MISSING_MARKERS')
                  AND NOT list_has_all({_KNOWN}, cols))) AS fails
       FROM acts GROUP BY candidate_id),
trial AS (SELECT pd.candidate_id,
    CASE WHEN pd.status <> 'APPROVED' THEN CASE WHEN pd.status = 'DENIED' THEN 'DENIED' ELSE 'REQUIRES_REVIEW' END
         WHEN NOT coalesce(st.exe, true) THEN 'UNSUPPORTED'
         WHEN coalesce(st.fails, false) THEN 'TRIAL_FAILED'
         ELSE 'REAUDITED' END AS trial_status
  FROM pd LEFT JOIN st ON st.candidate_id = pd.candidate_id),
b AS (SELECT * FROM ({_BEFORE_A}) x1),
a AS (SELECT * FROM ({_AFTER_A}) x2),
reg AS (SELECT candidate_id, count(*) AS n FROM ({_REGRESSION_SQL}) x3 GROUP BY candidate_id),
ev AS (SELECT trial.candidate_id,
    CASE WHEN trial.trial_status <> 'REAUDITED' THEN trial.trial_status
         WHEN a.dataset_id IS NULL OR b.duplicate_row_count > b.row_count
              OR a.duplicate_row_count > a.row_count THEN 'EVIDENCE_INVALID'
         WHEN coalesce(reg.n, 0) > 0 THEN 'REGRESSION_DETECTED'
         ELSE 'NO_AUDIT_REGRESSION' END AS status
  FROM trial JOIN b ON true LEFT JOIN a ON a.dataset_id = trial.candidate_id
  LEFT JOIN reg ON reg.candidate_id = trial.candidate_id),
prof AS (
  SELECT '@source' AS cid, code, "column", max({_SEV}) AS sev, sum("count") AS cnt
    FROM ({_BEFORE_F}) x4 WHERE NOT accepted GROUP BY code, "column"
  UNION ALL SELECT dataset_id, code, "column", max({_SEV}), sum("count")
    FROM ({_AFTER_F}) x5 WHERE NOT accepted GROUP BY dataset_id, code, "column"
  UNION ALL SELECT '@source', '@duplicates', NULL, duplicate_row_count, 0 FROM b
  UNION ALL SELECT dataset_id, '@duplicates', NULL, duplicate_row_count, 0 FROM a),
passing AS (SELECT candidate_id FROM ev WHERE status = 'NO_AUDIT_REGRESSION'),
pairs AS (SELECT candidate_id AS x, '@source' AS y FROM passing
          UNION ALL SELECT p.candidate_id, q.candidate_id FROM passing p JOIN passing q
                    ON p.candidate_id <> q.candidate_id),
pk AS (SELECT DISTINCT pairs.x, pairs.y, prof.code, prof."column" FROM pairs
       JOIN prof ON prof.cid = pairs.x OR prof.cid = pairs.y),
cmp AS (SELECT pk.x, pk.y, coalesce(px.sev, 0) AS sx, coalesce(px.cnt, 0) AS cx,
               coalesce(py.sev, 0) AS sy, coalesce(py.cnt, 0) AS cy
        FROM pk LEFT JOIN prof px ON px.cid = pk.x AND px.code = pk.code AND px."column" IS NOT DISTINCT FROM pk."column"
                LEFT JOIN prof py ON py.cid = pk.y AND py.code = pk.code AND py."column" IS NOT DISTINCT FROM pk."column"),
imp AS (SELECT x, y, bool_and(sx <= sy AND cx <= cy) AND bool_or(sx < sy OR cx < cy) AS improves
        FROM cmp GROUP BY x, y),
rows AS (SELECT ev.candidate_id, ev.status AS evaluation_status,
    CASE WHEN ev.status <> 'NO_AUDIT_REGRESSION' THEN 'EXCLUDED'
         WHEN coalesce(imp.improves, false) THEN 'IMPROVING' ELSE 'NO_MEASURED_IMPROVEMENT' END AS disposition
  FROM ev LEFT JOIN imp ON imp.x = ev.candidate_id AND imp.y = '@source')
"""

_EVALUATIONS_SQL = f"""
WITH {_EVAL_CTES}
SELECT 'orders' AS dataset_id, candidate_id, evaluation_status, disposition FROM rows
"""

# C2 dominance, C4 skyline, C5 identical-output collapse and C6 outcome.
_RECOMMENDATION_SQL = f"""
WITH {_EVAL_CTES},
impr AS (SELECT candidate_id FROM rows WHERE disposition = 'IMPROVING'),
dom AS (SELECT DISTINCT imp.y AS candidate_id FROM imp
        JOIN impr ix ON ix.candidate_id = imp.x JOIN impr iy ON iy.candidate_id = imp.y
        JOIN a ax ON ax.dataset_id = imp.x JOIN a ay ON ay.dataset_id = imp.y
        WHERE imp.improves AND ax.quality_score >= ay.quality_score
          AND NOT (ay.status = 'READY' AND ax.status <> 'READY')),
short AS (SELECT candidate_id FROM impr WHERE candidate_id NOT IN (SELECT candidate_id FROM dom)),
fp AS (SELECT dataset_id AS candidate_id, fingerprint FROM ({_TRIAL_FP_SQL}) x6),
pstr AS (SELECT cid, string_agg(code || '|' || coalesce("column", '~') || '|' || sev || '|' || cnt, ';'
                                ORDER BY code, "column", sev, cnt) AS profile FROM prof GROUP BY cid),
nact AS (SELECT candidate_id, count(*) AS n_actions FROM acts GROUP BY candidate_id),
fin AS (SELECT short.candidate_id, coalesce(nact.n_actions, 0) AS n_actions,
               concat_ws('#', fp.fingerprint, a.status, a.quality_score, a.row_count, a.column_count,
                         a.duplicate_row_count, pstr.profile) AS ident
        FROM short JOIN a ON a.dataset_id = short.candidate_id
        LEFT JOIN fp ON fp.candidate_id = short.candidate_id
        LEFT JOIN pstr ON pstr.cid = short.candidate_id
        LEFT JOIN nact ON nact.candidate_id = short.candidate_id),
agg AS (SELECT count(*) AS n, count(DISTINCT ident) AS nid, min(n_actions) AS mn,
               count(*) FILTER (WHERE n_actions = (SELECT min(n_actions) FROM fin)) AS nmin FROM fin),
final AS (SELECT fin.candidate_id FROM fin, agg
          WHERE NOT (agg.n > 1 AND agg.nid = 1 AND agg.nmin = 1) OR fin.n_actions = agg.mn)
SELECT 'orders' AS dataset_id,
  CASE WHEN count(*) = 1 THEN 'RECOMMENDED' WHEN count(*) > 1 THEN 'HUMAN_CHOICE_REQUIRED'
       ELSE 'NO_IMPROVING_CANDIDATE' END AS status,
  CASE WHEN count(*) = 1 THEN min(candidate_id) END AS recommended_candidate_id,
  coalesce(string_agg(candidate_id, ',' ORDER BY candidate_id), '') AS shortlisted_candidate_ids
FROM final
"""


@register("candidate_evaluations", _EVALUATIONS_SQL)
def candidate_evaluations(spark, sf_dir):
    """T-5/T-6 + C3: evaluation status and disposition of every candidate."""
    a = _orders_analysis(spark, sf_dir)
    return a.candidates


@register("recommendation", _RECOMMENDATION_SQL)
def recommendation(spark, sf_dir):
    """Skyline of improving candidates, tie collapse, outcome."""
    return _orders_analysis(spark, sf_dir).recommendations


# ---------------------------------------------------------------- JSON records (S3)
from ..operators.file_audit import audit_rows  # noqa: E402
from ..sources.json_records import json_cells, json_rows  # noqa: E402


@register("json_props_audit", O.audit_sql(
    "SELECT event_type AS dataset_id, event_id AS _row_id, coalesce(props->>'k', '') AS k FROM events",
    ["k"]))
def json_props_audit(spark, sf_dir):
    """S3 + audit: each event's JSON props as a record; one table per event type, each with its own key union."""
    e = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset_id"), F.col("event_id").alias("_row_id"), "props")
    rows, headers = json_rows(e, "props")
    return audit_rows(rows, headers).findings


@register("json_rejects", "SELECT event_type AS dataset_id, CAST(count(*) FILTER (WHERE NOT json_valid(props) "
          "OR json_type(props) <> 'OBJECT') AS BIGINT) AS rejected, CAST(count(*) AS BIGINT) AS records "
          "FROM events GROUP BY event_type")
def json_rejects(spark, sf_dir):
    """S3 rejection counts per event type (invalid, non-object, nested, duplicate keys)."""
    e = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset_id"), F.col("event_id").alias("_row_id"), "props")
    _, rejects = json_cells(e, "props")
    per = rejects.groupBy("dataset_id").agg(F.count("*").alias("rejected"))  # one row per record
    tot = e.groupBy("dataset_id").agg(F.count("*").alias("records"))
    return tot.join(per, on="dataset_id", how="left").select(
        "dataset_id", F.coalesce("rejected", F.lit(0)).cast("bigint").alias("rejected"),
        F.col("records").cast("bigint").alias("records"))


# ---------------------------------------------------------------- preview
from ..sources.preview import preview  # noqa: E402

_SENS_RE2 = ("(?i)(?:\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b)"
             "|(?:(?:^|[^0-9])(?:\\+?1[.\\s-]?)?\\(?\\d{3}\\)?[.\\s-]?\\d{3}[.\\s-]?\\d{4}(?:[^0-9]|$))")
_S = O.strip_sql("x")
_PREVIEW_SQL = f"""
WITH f AS (SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id LIMIT {K.PREVIEW_ROWS}),
p AS (SELECT doc_id, list_filter([CAST(doc_id AS VARCHAR), text, lang, source],
                                 lambda x: x IS NOT NULL AND {_S} <> '') AS present FROM f)
SELECT doc_id AS row_key, CAST(len(present) AS INTEGER) AS populated_cells,
  array_to_string(list_transform(present[1:{K.PREVIEW_VALUES_PER_ROW}], lambda x:
    CASE WHEN regexp_matches({_S}, {O.q(_SENS_RE2)}) THEN '[sensitive value]'
         WHEN length({_S}) > {K.PREVIEW_MAX_CHARS} THEN substr({_S}, 1, {K.PREVIEW_KEEP_CHARS}) || '...'
         ELSE {_S} END), ' | ') AS preview
FROM p WHERE len(present) > 0
"""


@register("redacted_preview", _PREVIEW_SQL)
def redacted_preview(spark, sf_dir):
    """First 25 documents, redacted and shortened cell previews (top-k is the feature)."""
    d = read_table(spark, sf_dir, "documents")
    return preview(d, ["doc_id", "text", "lang", "source"], "doc_id")


# ---------------------------------------------------------------- evidence
from ..operators import evidence as EV  # noqa: E402

_ALIAS_SQL = f"""
WITH f AS (SELECT * FROM ({O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)}) x
           UNION ALL SELECT * FROM ({O.audit_sql(DOC_SOURCE_SQL, ["text"])}) y),
al AS (SELECT dataset_id, "column",
              printf('column_%03d', dense_rank() OVER (PARTITION BY dataset_id ORDER BY "column")) AS alias
       FROM (SELECT DISTINCT dataset_id, "column" FROM f WHERE "column" IS NOT NULL AND NOT accepted) z)
SELECT f.dataset_id, f.ord, f.code, f.severity, al.alias AS column_ref, f."count"
FROM f LEFT JOIN al ON al.dataset_id = f.dataset_id AND al."column" = f."column"
WHERE NOT f.accepted
"""


@register("aliased_evidence", _ALIAS_SQL)
def aliased_evidence(spark, sf_dir):
    """Findings leave only with column aliases, codes and counts."""
    audits, findings = _two_fleets(spark, sf_dir)
    return EV.minimized_issues(findings, audits)


_ISSUE_JSON = ("CASE WHEN column_ref IS NULL THEN json_object('code', code, 'count', \"count\", 'severity', severity) "
               "ELSE json_object('code', code, 'column_ref', column_ref, 'count', \"count\", 'severity', severity) END")
_EVIDENCE_SQL = f"""
WITH iss AS ({_ALIAS_SQL}),
a AS (SELECT * FROM ({O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, output="audits")}) x1
      UNION ALL SELECT * FROM ({O.audit_sql(DOC_SOURCE_SQL, ["text"], output="audits")}) x2),
fp AS (SELECT dataset_id, fingerprint FROM ({O.fingerprint_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)}) x3
       UNION ALL SELECT dataset_id, fingerprint FROM ({O.fingerprint_sql(DOC_SOURCE_SQL, ["text"])}) x4),
arr AS (SELECT dataset_id, '[' || string_agg(({_ISSUE_JSON})::VARCHAR, ',' ORDER BY ord) || ']' AS issues
        FROM iss GROUP BY dataset_id)
SELECT a.dataset_id, json_object('column_count', a.column_count, 'duplicate_row_count', a.duplicate_row_count,
  'issues', json(coalesce(arr.issues, '[]')), 'quality_score', a.quality_score, 'row_count', a.row_count,
  'source_fingerprint_sha256', fp.fingerprint, 'status', a.status)::VARCHAR AS evidence_json
FROM a JOIN fp ON fp.dataset_id = a.dataset_id LEFT JOIN arr ON arr.dataset_id = a.dataset_id
WHERE a.status <> 'BLOCKED' AND regexp_full_match(fp.fingerprint, '[0-9a-f]{{64}}')
"""


@register("evidence_documents", _EVIDENCE_SQL)
def evidence_documents(spark, sf_dir):
    """E3 record: one sorted-key JSON evidence document per dataset."""
    audits, findings = _two_fleets(spark, sf_dir)
    return EV.minimized_evidence(findings, audits)


# ---------------------------------------------------------------- reviews
from ..operators import review as RV  # noqa: E402
from ..operators.audit import contact_conflicts  # noqa: E402

_REVIEW_ROWS = [("orders", "optional", "priority", "analyst-7", "Priority may be blank for bulk orders.", 1767225600)]


def _reviews(spark, rows=_REVIEW_ROWS):
    return spark.createDataFrame(rows, "dataset_id string, kind string, column string, "
                                       "reviewer_reference string, reason string, reviewed_at bigint")


_REVIEWED_F = O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS,
                          accepted="(\"column\" = 'priority' AND code = 'MISSING_VALUES')")
_REVIEWED_A = O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS, output="audits",
                          accepted="(\"column\" = 'priority' AND code = 'MISSING_VALUES')")


@register("review_split", _REVIEWED_F)
def review_split(spark, sf_dir):
    """A declared optional column's missing values are accepted, not penalized."""
    sets = RV.review_sets(_reviews(spark))
    return audit(D.dirty_orders(spark, sf_dir), order_col="_row_id", columns=D.ORDERS_COLUMNS,
                 reviews=sets).findings


@register("review_score", _REVIEWED_A)
def review_score(spark, sf_dir):
    """R4 + A13: the audit record re-scored after the reviewer's declarations."""
    sets = RV.review_sets(_reviews(spark))
    return audit(D.dirty_orders(spark, sf_dir), order_col="_row_id", columns=D.ORDERS_COLUMNS,
                 reviews=sets).audits.select(*AUDIT_COLS)


_CONTACT_SQL = f"""
SELECT lang AS dataset_id, 'business_email' AS "column",
  CAST(count(*) FILTER (WHERE {O.strip_sql('text')} <> '' AND (
        regexp_matches({O.strip_sql('text')}, {O.q(O.SSN_RE2)})
     OR (regexp_matches({O.strip_sql('text')}, {O.q(O.PII_RE2)})
         AND NOT regexp_full_match({O.strip_sql('text')}, {O.q('(?i)' + K.EMAIL_VALUE)})))) AS BIGINT) AS conflicts
FROM documents GROUP BY lang
"""


@register("review_conflicts", _CONTACT_SQL)
def review_conflicts(spark, sf_dir):
    """Document texts declared as a business email column hold other sensitive text."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("text").alias("business_email"))
    return contact_conflicts(d, columns=["business_email"])


_DECLARED = [("public_contact", "business_email"), ("public_contact", "source"),
             ("optional", "missing_col")]
_NORM_SQL = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_')"
_REVIEW_VIOLATIONS_SQL = f"""
WITH langs AS (SELECT DISTINCT lang AS dataset_id FROM documents),
rv AS (SELECT langs.dataset_id, v.kind, v."column" FROM langs JOIN (VALUES {", ".join(
    f"({O.q(k)}, {O.q(c)})" for k, c in _DECLARED)}) AS v(kind, "column") ON true),
hd AS (SELECT langs.dataset_id, h.name FROM langs JOIN (VALUES ('business_email'), ('source')) AS h(name) ON true),
cf AS ({_CONTACT_SQL})
SELECT dataset_id, "column", 'DUPLICATE_DECLARATION' AS violation FROM rv
  GROUP BY dataset_id, kind, "column" HAVING count(*) > 1
UNION ALL SELECT rv.dataset_id, rv."column", 'UNKNOWN_COLUMN' FROM rv
  WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.dataset_id = rv.dataset_id AND hd.name = rv."column")
UNION ALL SELECT DISTINCT dataset_id, CAST(NULL AS VARCHAR), 'AMBIGUOUS_HEADERS' FROM (
  SELECT dataset_id FROM hd WHERE {_NORM_SQL.format('name')} <> ''
  GROUP BY dataset_id, {_NORM_SQL.format('name')} HAVING count(*) > 1) z
UNION ALL SELECT dataset_id, "column", 'NOT_A_PUBLIC_CONTACT_COLUMN' FROM rv
  WHERE kind = 'public_contact' AND {_NORM_SQL.format('"column"')} NOT IN ({", ".join(O.q(c) for c in K.PUBLIC_CONTACT_COLUMNS)})
UNION ALL SELECT dataset_id, "column", 'UNKNOWN_KIND' FROM rv WHERE kind NOT IN ('public_contact', 'optional')
UNION ALL SELECT rv.dataset_id, rv."column", 'INCOMPATIBLE_CONTACT_VALUES' FROM rv
  JOIN cf ON cf.dataset_id = rv.dataset_id AND cf."column" = rv."column"
  WHERE rv.kind = 'public_contact' AND cf.conflicts > 0
"""


@register("review_violations", _REVIEW_VIOLATIONS_SQL)
def review_violations(spark, sf_dir):
    """Declarations that cannot be applied (unknown column, not a contact column,
    incompatible values)."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("_row_id"),
        F.col("text").alias("business_email"), "source")
    r = audit(d, order_col="_row_id", columns=["business_email", "source"], materialize=True)
    # Declarations and headers per audited dataset, derived from the audits
    # table (a literal array exploded per row; nothing goes through the driver).
    decl = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column")) for k, c in _DECLARED])
    reviews = r.audits.select("dataset_id", F.explode(decl).alias("d")).select(
        "dataset_id", "d.kind", "d.column", F.lit("rev").alias("reviewer_reference"),
        F.lit("Declared by the data owner").alias("reason"),
        F.lit(0).cast("bigint").alias("reviewed_at"))
    headers = r.audits.select("dataset_id", F.posexplode(
        F.array(F.lit("business_email"), F.lit("source"))).alias("position", "name"))
    conflicts = contact_conflicts(d, columns=["business_email", "source"])
    return RV.review_violations(reviews, headers, r.findings, conflicts)


# ---------------------------------------------------------------- human review, gate, batch rules
from ..operators import policy as PO  # noqa: E402
from ..operators.trials import source_fingerprints  # noqa: E402


_APPROVALS = [("c_dedupe", "reviewer-1", "Duplicates verified by hand.", [0]),
              ("c_markers_dedupe", "reviewer-1", "Only the dedupe step is accepted.", [1]),
              ("c_trim", " ", "No reviewer given.", [0])]
_HUMAN_SQL = f"""
WITH pd AS ({_policy_sql([(DOC_SOURCE_SQL, ["text"])])}),
acts AS (SELECT * FROM {_actions_values(ORDERS_CANDIDATES)}),
ad AS (SELECT pd.dataset_id, acts.candidate_id, acts.action_idx,
         CASE WHEN pd.reason LIKE 'CRITICAL%' THEN 'REQUIRES_REVIEW'
              WHEN acts.action IN ({_EXE}) THEN 'APPROVED' ELSE 'REQUIRES_REVIEW' END AS decision
       FROM pd JOIN acts ON acts.candidate_id = pd.candidate_id),
ap AS (SELECT d.dataset_id, v.* FROM (SELECT DISTINCT dataset_id FROM pd) d JOIN (VALUES {", ".join(
    f"({O.q(c)}, {O.q(r)}, {O.q(w)}, [{', '.join(str(i) for i in ix)}])" for c, r, w, ix in _APPROVALS)})
       AS v(candidate_id, reviewer, why, approved) ON true),
per AS (SELECT dataset_id, candidate_id, bool_or(decision = 'DENIED') AS any_denied,
               list(action_idx) FILTER (WHERE decision = 'REQUIRES_REVIEW') AS reviewable
        FROM ad GROUP BY dataset_id, candidate_id),
j AS (SELECT ap.*, CASE
        WHEN length(trim(ap.reviewer)) = 0 THEN 'REVIEWER_REQUIRED'
        WHEN length(trim(ap.why)) = 0 THEN 'REASON_REQUIRED'
        WHEN pd.status = 'DENIED' THEN 'DENIED_DECISION'
        WHEN coalesce(per.any_denied, false) THEN 'DENIED_ACTION'
        WHEN coalesce(pd.status, '') <> 'REQUIRES_REVIEW' THEN 'NOT_AWAITING_REVIEW'
        WHEN coalesce(len(per.reviewable), 0) = 0 THEN 'NOTHING_TO_REVIEW'
        WHEN NOT list_has_all(per.reviewable, ap.approved) THEN 'INDEX_NOT_REVIEWABLE' END AS error
      FROM ap LEFT JOIN pd ON pd.dataset_id = ap.dataset_id AND pd.candidate_id = ap.candidate_id
      LEFT JOIN per ON per.dataset_id = ap.dataset_id AND per.candidate_id = ap.candidate_id),
res AS (SELECT j.dataset_id, j.candidate_id,
               bool_and(ad.decision = 'APPROVED' OR list_contains(j.approved, ad.action_idx)) AS ok
        FROM j JOIN ad ON ad.dataset_id = j.dataset_id AND ad.candidate_id = j.candidate_id
        WHERE j.error IS NULL GROUP BY j.dataset_id, j.candidate_id)
SELECT dataset_id, candidate_id, CASE WHEN ok THEN 'APPROVED' ELSE 'DENIED' END AS status, ok AS can_execute
FROM res
UNION ALL SELECT dataset_id, candidate_id, error, false FROM j WHERE error IS NOT NULL
"""


@register("human_resolution", _HUMAN_SQL)
def human_resolution(spark, sf_dir):
    """V6: documents' plans held for review (PII) resolved by a reviewer, all-or-nothing."""
    audits, findings = _two_fleets(spark, sf_dir)
    docs = audits.filter(F.col("dataset_id") != "orders")
    plans, acts = G.candidate_batch(spark, docs, ORDERS_CANDIDATES)
    pd_, ad = authorize(audits, findings, plans, acts, G.safe_policy(audits))
    requests = F.array(*[F.struct(
        F.lit(c).alias("candidate_id"), F.lit(r).alias("reviewer_reference"),
        F.lit(w).alias("review_reason"), F.array(*[F.lit(i) for i in ix]).cast("array<int>")
        .alias("approved")) for c, r, w, ix in _APPROVALS])
    approvals = docs.select("dataset_id", F.explode(requests).alias("a")).select("dataset_id", "a.*")
    res, rejected = PO.resolve_human_review(pd_, ad, approvals)
    return res.select("dataset_id", "candidate_id", "status", "can_execute").unionByName(
        rejected.select("dataset_id", "candidate_id", F.col("error").alias("status"),
                        F.lit(False).alias("can_execute")))


_GATE_SQL = f"""
WITH pd AS (SELECT candidate_id, status FROM ({_policy_sql([(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)])}) z),
acts AS (SELECT * FROM {_actions_values(ORDERS_CANDIDATES)}),
ex AS (SELECT candidate_id, bool_and(action IN ({_EXE})) AS exe FROM acts GROUP BY candidate_id)
SELECT 'orders' AS dataset_id, pd.candidate_id,
  (pd.status = 'APPROVED' AND coalesce(ex.exe, true)) AS ready,
  concat_ws(',', CASE WHEN pd.status <> 'APPROVED' THEN 'NOT_APPROVED' END,
                 CASE WHEN NOT coalesce(ex.exe, true) THEN 'ACTION_NOT_APPROVED' END,
                 CASE WHEN NOT coalesce(ex.exe, true) THEN 'ACTION_NOT_EXECUTABLE' END) AS failed_checks
FROM pd LEFT JOIN ex ON ex.candidate_id = pd.candidate_id
"""


@register("execution_gate", _GATE_SQL)
def execution_gate(spark, sf_dir):
    """V7: which approved plans may run against the source as it is now."""
    src = D.dirty_orders(spark, sf_dir)
    before = audit(src, order_col="_row_id", columns=D.ORDERS_COLUMNS, materialize=True)
    plans, acts = G.candidate_batch(spark, before.audits, ORDERS_CANDIDATES, ["orders"])
    decided, per_action = authorize(before.audits, before.findings, plans, acts, G.safe_policy(before.audits))
    return PO.execution_gate(plans, acts, decided, per_action, source_fingerprints(src, D.ORDERS_COLUMNS)) \
        .select(*PO.PLAN_KEYS, "ready", F.array_join("failed_checks", ",").alias("failed_checks"))


_BAD_BATCH = dict(ORDERS_CANDIDATES)
_BAD_BATCH["c_dedupe_again"] = DEDUPE_PLAN
_BAD_BATCH["bad id!"] = [("FIX_EVERYTHING", ["priority"])]


_REPAIR = ", ".join(O.q(a) for a in K.REPAIR_ACTIONS)
_BATCH_SQL = f"""
WITH fp AS (SELECT dataset_id, fingerprint FROM ({O.fingerprint_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)}) x),
acts AS (SELECT * FROM {_actions_values(_BAD_BATCH)}),
plans AS (SELECT fp.dataset_id, c.candidate_id, 'plan ' || c.candidate_id AS summary, fp.fingerprint
          FROM fp JOIN (SELECT DISTINCT candidate_id FROM acts) c ON true),
sig AS (SELECT candidate_id, string_agg(action || ':' || array_to_string(list_sort(list_distinct(cols)), '|'),
                                        ';' ORDER BY action_idx) AS signature
        FROM acts GROUP BY candidate_id)
SELECT dataset_id, candidate_id, 'BAD_SOURCE_FINGERPRINT' AS violation FROM plans
  WHERE NOT coalesce(regexp_full_match(fingerprint, '[0-9a-f]{{64}}'), false)
UNION ALL SELECT dataset_id, candidate_id, 'BAD_SUMMARY' FROM plans
  WHERE summary IS NULL OR length(summary) NOT BETWEEN 1 AND 1000
UNION ALL SELECT p.dataset_id, a.candidate_id, 'UNKNOWN_ACTION' FROM acts a JOIN plans p USING (candidate_id)
  WHERE a.action IS NULL OR a.action NOT IN ({_REPAIR})
UNION ALL SELECT p.dataset_id, a.candidate_id, 'BAD_JUSTIFICATION' FROM acts a JOIN plans p USING (candidate_id)
  WHERE length('step ' || a.action_idx || ' of ' || a.candidate_id) NOT BETWEEN 1 AND 500
UNION ALL SELECT dataset_id, NULL, 'TOO_MANY_CANDIDATES' FROM plans GROUP BY dataset_id
  HAVING count(*) > {K.MAX_CANDIDATES}
UNION ALL SELECT dataset_id, candidate_id, 'DUPLICATE_CANDIDATE_ID' FROM plans GROUP BY dataset_id, candidate_id
  HAVING count(*) > 1
UNION ALL SELECT dataset_id, candidate_id, 'BAD_CANDIDATE_ID' FROM plans
  WHERE NOT coalesce(regexp_full_match(candidate_id, '[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}'), false)
UNION ALL SELECT dataset_id, NULL, 'MIXED_SOURCE_FINGERPRINTS' FROM plans GROUP BY dataset_id
  HAVING count(DISTINCT fingerprint) > 1
UNION ALL SELECT p.dataset_id, p.candidate_id, 'DUPLICATE_STRATEGY' FROM plans p
  LEFT JOIN sig USING (candidate_id)
  WHERE (SELECT count(*) FROM plans q LEFT JOIN sig s2 USING (candidate_id)
         WHERE coalesce(s2.signature, '') = coalesce(sig.signature, '')) > 1
"""


@register("batch_validation", _BATCH_SQL)
def batch_validation(spark, sf_dir):
    """V1-V3: schema, batch-size, id and repeated-strategy rules on a proposed batch."""
    o = audit(D.dirty_orders(spark, sf_dir), order_col="_row_id", columns=D.ORDERS_COLUMNS,
              materialize=True)
    plans, acts = G.candidate_batch(spark, o.audits, _BAD_BATCH, ["orders"])
    return PO.plan_violations(plans, acts).unionByName(PO.batch_violations(plans, acts))


# ---------------------------------------------------------------- lineage (L1/L2)
from ..operators.lineage import export_check, lineage as lineage_op  # noqa: E402


_LINEAGE_SQL = f"""
WITH b AS (SELECT * FROM ({_BEFORE_A}) x1),
a AS (SELECT * FROM ({_AFTER_A}) x2),
sfp AS (SELECT fingerprint FROM ({O.fingerprint_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)}) x3),
ofp AS (SELECT dataset_id AS candidate_id, fingerprint FROM ({_TRIAL_FP_SQL}) x4),
acts AS (SELECT * FROM {_actions_values(ORDERS_CANDIDATES)}),
ex AS (SELECT candidate_id, string_agg(action, ',' ORDER BY action_idx) AS executed_actions
       FROM acts GROUP BY candidate_id)
SELECT 'orders' AS dataset_id, a.dataset_id AS candidate_id,
  sfp.fingerprint AS source_fingerprint_sha256, ofp.fingerprint AS output_fingerprint_sha256,
  b.status AS source_audit_status, a.status AS output_audit_status, 'safe-repairs' AS policy_id,
  coalesce(ex.executed_actions, '') AS executed_actions, true AS source_preserved
FROM a JOIN b ON true JOIN sfp ON true JOIN ofp ON ofp.candidate_id = a.dataset_id
LEFT JOIN ex ON ex.candidate_id = a.dataset_id
"""


@register("lineage", _LINEAGE_SQL)
def lineage_query(spark, sf_dir):
    """L1: fingerprints recomputed from data; plan, decision and audits must all bind."""
    before, trial, _ = _orders_trial(spark, sf_dir)
    src = D.dirty_orders(spark, sf_dir)
    cur_src = identity_stats(src, ["dataset_id"], D.ORDERS_COLUMNS).select("dataset_id", "fingerprint")
    cur_out = identity_stats(trial.outputs, PO.PLAN_KEYS, D.ORDERS_COLUMNS).select(
        *PO.PLAN_KEYS, "fingerprint")
    plans = trial.plan_decisions.select(*PO.PLAN_KEYS, "source_fingerprint")
    ok, bad = lineage_op(cur_src, cur_out, before.audits, trial.after.audits, plans,
                         trial.plan_decisions, trial.action_decisions)
    return ok.select(*PO.PLAN_KEYS, "source_fingerprint_sha256", "output_fingerprint_sha256",
                     "source_audit_status", "output_audit_status", "policy_id",
                     "executed_actions", "source_preserved")


_EXPORT_SQL = f"""
WITH r AS ({_RECOMMENDATION_SQL}),
ofp AS (SELECT dataset_id AS candidate_id, fingerprint FROM ({_TRIAL_FP_SQL}) x1)
SELECT r.dataset_id, r.recommended_candidate_id AS candidate_id,
  ofp.fingerprint AS output_fingerprint_sha256,
  true AS output_reproduced, true AS source_unchanged, true AS export_allowed
FROM r JOIN ofp ON ofp.candidate_id = r.recommended_candidate_id
"""


@register("export_check", _EXPORT_SQL)
def export_check_query(spark, sf_dir):
    """L2: the recommended candidate re-run from the source reproduces its trial output."""
    a = _orders_analysis(spark, sf_dir)
    chosen = a.recommendations.filter(F.col("recommended_candidate_id").isNotNull()).select(
        "dataset_id", F.col("recommended_candidate_id").alias("candidate_id"))
    return export_check(D.dirty_orders(spark, sf_dir), D.ORDERS_COLUMNS, chosen,
                        a.trial.action_decisions, a.trial.trials,
                        a.before.audits.select("dataset_id", "fingerprint"))


# ---------------------------------------------------------------- sheet grids
from ..operators import layout as LY  # noqa: E402


@register("grid_headers", O.header_candidates_sql(D.ORDER_WORKBOOKS_SQL))
def grid_headers(spark, sf_dir):
    """Scored header-row candidates of every order workbook."""
    return LY.header_candidates(D.order_workbooks(spark, sf_dir))


# G6/G7 in SQL: neighbour suppression as a recursive walk over each sheet's
# candidates in rank order (the kept header rows are the walk's state), then
# the dominant-area / unique-strong-header selection and the confidence.
_CHOICE_CTES = f"""
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY workbook, sheet ORDER BY score DESC, header_row) AS k
      FROM ({O.header_candidates_sql(D.ORDER_WORKBOOKS_SQL)}) z),
walk AS (
  SELECT workbook, sheet, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS kept
  FROM (SELECT DISTINCT workbook, sheet FROM o) s
  UNION ALL
  SELECT w.workbook, w.sheet, w.k + 1,
    CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.header_row) <= 1)) = 0
         THEN list_append(w.kept, o.header_row) ELSE w.kept END
  FROM walk w JOIN o ON o.workbook = w.workbook AND o.sheet = w.sheet AND o.k = w.k + 1),
fin AS MATERIALIZED (SELECT workbook, sheet, kept FROM walk
        QUALIFY row_number() OVER (PARTITION BY workbook, sheet ORDER BY k DESC) = 1),
rk AS MATERIALIZED (SELECT o.*, row_number() OVER (PARTITION BY o.workbook ORDER BY o.score DESC, o.sheet, o.header_row) AS rank
       FROM o JOIN fin ON fin.workbook = o.workbook AND fin.sheet = o.sheet
       WHERE list_contains(fin.kept, o.header_row)),
wb AS (SELECT workbook, max(score) FILTER (WHERE rank = 1) AS top_score,
              max(supporting_rows) FILTER (WHERE rank = 1) AS top_support,
              max(score) FILTER (WHERE rank = 2) AS run_score
       FROM rk GROUP BY workbook),
cred AS (SELECT *, row_number() OVER (PARTITION BY workbook ORDER BY estimated_table_area DESC, score DESC, rank) AS ak
         FROM rk WHERE score >= 75 AND supporting_rows >= 3 AND estimated_data_rows >= 3),
dom AS (SELECT a.workbook, a.sheet, a.header_row FROM cred a JOIN cred b ON b.workbook = a.workbook AND b.ak = 2
        WHERE a.ak = 1 AND a.sheet <> b.sheet AND a.estimated_data_rows >= 10
          AND a.estimated_data_rows * 2 >= b.estimated_data_rows * 3
          AND a.estimated_table_area >= 3 * greatest(1, b.estimated_table_area)
          AND NOT EXISTS (SELECT 1 FROM rk c WHERE c.workbook = a.workbook AND c.sheet = a.sheet
                          AND c.header_row <> a.header_row AND c.score >= 73)),
gap AS (SELECT *, CASE WHEN run_score IS NULL THEN 100 ELSE top_score - run_score END AS g FROM wb),
strong AS (SELECT t.workbook, t.sheet, t.header_row FROM rk t JOIN gap ON gap.workbook = t.workbook
           WHERE t.rank = 1 AND gap.top_score >= 73 AND gap.g >= 12 AND gap.top_support >= 1
             AND NOT (gap.run_score IS NOT NULL AND gap.run_score >= 70 AND gap.g < 20)),
sel AS MATERIALIZED (SELECT workbook, sheet, header_row, 'dominant_table_area' AS basis FROM dom
        UNION ALL SELECT workbook, sheet, header_row, 'unique_strong_header' FROM strong
        WHERE workbook NOT IN (SELECT workbook FROM dom))
"""

_LAYOUT_SQL = f"""
WITH RECURSIVE {_CHOICE_CTES}
SELECT wb.workbook,
  CASE WHEN sel.workbook IS NOT NULL THEN 'high' WHEN wb.top_score >= 58 THEN 'review' ELSE 'unresolved' END AS confidence,
  sel.sheet AS recommended_sheet, sel.header_row AS recommended_header_row, sel.basis AS selection_basis,
  CAST((SELECT count(*) FROM rk WHERE rk.workbook = wb.workbook AND rk.score >= 73
        AND rk.supporting_rows >= 1) AS INTEGER) AS detected_table_count,
  sel.header_row - 1 AS leading_note_rows
FROM wb LEFT JOIN sel ON sel.workbook = wb.workbook
"""

_GRID_RECORDS_SQL = f"""
WITH RECURSIVE {_CHOICE_CTES},
cells AS MATERIALIZED (SELECT * FROM ({D.ORDER_WORKBOOKS_SQL}) z),
c AS MATERIALIZED (SELECT cells.*, sel.header_row FROM cells JOIN sel ON sel.workbook = cells.workbook AND sel.sheet = cells.sheet),
hdr AS (SELECT workbook, sheet, col, {O.strip_sql('value')} AS "column" FROM c WHERE "row" = header_row)
SELECT b.workbook, b.sheet, b."row", b.col, coalesce(hdr."column", '') AS "column", coalesce(CAST(b.value AS VARCHAR), '') AS value
FROM c b LEFT JOIN hdr ON hdr.workbook = b.workbook AND hdr.sheet = b.sheet AND hdr.col = b.col
WHERE b."row" > b.header_row
"""


@register("layout_choices", _LAYOUT_SQL)
def layout_choices(spark, sf_dir):
    """Neighbour suppression, dominant-area / strong-header choice per workbook."""
    return LY.layout_summary(LY.choose_tables(LY.header_candidates(D.order_workbooks(spark, sf_dir))))


@register("grid_records", _GRID_RECORDS_SQL)
def grid_records(spark, sf_dir):
    """Records below each workbook's chosen header, as (workbook, row, column, value)."""
    cells = D.order_workbooks(spark, sf_dir)
    ch = LY.choose_tables(LY.header_candidates(cells)).filter("selected").select(
        "workbook", "sheet", "header_row")
    recs, _ = LY.grid_to_table(cells, ch)
    return recs


# ---------------------------------------------------------------- streaming gate
import os  # noqa: E402
import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..streaming.gate import start_gate, start_windows, utc_event_time, window_totals  # noqa: E402


def _stream_events(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    # A pattern, because a stream takes a plain path for a folder: the table may be a file or a folder of parts.
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
         .parquet(f"{sf_dir.rstrip('/')}/events.parque[t]"))
    uid = F.when(F.col("event_id") % 23 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string"))
    return s.select(F.col("event_type").alias("dataset_id"), F.col("event_id").alias("_row_id"),
                    uid.alias("user_id"), "props", utc_event_time(F.col("ts")).alias("ts"))


_STREAM_QUALITY_SQL = """
SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, event_type AS dataset_id,
  CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) FILTER (WHERE event_id % 23 = 0) AS BIGINT) AS missing_user_id
FROM events GROUP BY ALL
"""


@register("stream_quality", _STREAM_QUALITY_SQL)
def stream_quality(spark, sf_dir):
    """Streaming: daily row and missing counts per event type, counted by the stream alone.

    The stream runs to the end of the input (``availableNow``); every micro-batch adds
    its counts per window, so rows that come late are in the totals.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    start_windows(_stream_events(spark, sf_dir), columns=["user_id"], ts_col="ts", window="1 day",
                  out=f"{base}/out", checkpoint=f"{base}/ck").awaitTermination()
    counts = spark.read.schema("window_start bigint, dataset_id string, rows bigint, missing_user_id bigint, "
                               "batch_id bigint").parquet(f"{base}/out")
    return window_totals(counts, ["user_id"])


# The events table is one file and the stream reads one file per trigger, so
# the whole table is micro-batch 0; its audit is the fleet audit of that batch.
_STREAM_GATE_SQL = ("SELECT CAST(0 AS BIGINT) AS batch_id, dataset_id, status, row_count, quality_score FROM ("
                    + O.audit_sql(D.EVENTS_FLEET_SQL, ["user_id", "props"], output="audits") + ") a")


@register("stream_gate", _STREAM_GATE_SQL)
def stream_gate(spark, sf_dir):
    """Streaming: per micro-batch audit with READY / QUARANTINE routing (foreachBatch)."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gate-{uuid.uuid4().hex}"
    q = start_gate(_stream_events(spark, sf_dir).drop("ts"), columns=["user_id", "props"],
                   out=f"{base}/out", checkpoint=f"{base}/ck")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out/audits").select(
        "batch_id", "dataset_id", "status", "row_count", "quality_score")
