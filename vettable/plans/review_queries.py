"""Registered queries over reviews, public evidence, plans that come back, CSV files and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import evidence as EV
from ..operators import review as RV
from ..operators.audit import audit
from ..operators.policy import PLAN_KEYS
from ..session import ensure_checkpoint_dir
from ..sources.csv import read_csv
from ..sources.sinks import report_json, write_csv
from ..sources.tables import read_table
from . import catalog as C
from . import derived as D
from . import governed as G
from . import oracle as O
from . import run_queries as R

register = C.register

# Documents as tables of contact text: one dataset per language.
_COLUMNS = ["business_email", "source"]
_CONTACT_SOURCE = "SELECT lang AS dataset_id, doc_id AS _row_id, text AS business_email, source FROM documents"


def _contacts(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("_row_id"), F.col("text").alias("business_email"), "source")
    return audit(d, order_col="_row_id", columns=_COLUMNS, materialize=True)


_OFFER_SQL = f"""
WITH f AS (SELECT * FROM ({O.audit_sql(_CONTACT_SOURCE, _COLUMNS)}) x),
pub AS (SELECT dataset_id, list_sort(list(DISTINCT "column")) AS public_contact FROM f
        WHERE code IN ('PII_COLUMN_NAME', 'PII_VALUE_PATTERN') AND "column" = 'business_email' GROUP BY dataset_id),
opt AS (SELECT dataset_id, list_sort(list(DISTINCT "column")) AS optional FROM f WHERE code = 'MISSING_VALUES' GROUP BY dataset_id)
SELECT coalesce(pub.dataset_id, opt.dataset_id) AS dataset_id, array_to_string(public_contact, ',') AS public_contact,
       array_to_string(optional, ',') AS optional
FROM pub FULL OUTER JOIN opt ON opt.dataset_id = pub.dataset_id
"""


@register("review_offers", _OFFER_SQL)
def review_offers(spark, sf_dir):
    """The columns of each dataset that a reviewer may declare."""
    r = _contacts(spark, sf_dir)
    return RV.offerable_choices(r.findings).select("dataset_id", F.array_join("public_contact", ",").alias("public_contact"),
                                                   F.array_join("optional", ",").alias("optional"))


# (kind, column, reviewer, reason, time); the second reviewer speaks for one language alone.
_DECLARED = [("public_contact", "business_email", "analyst-1", "Shared mailbox of the desk.", 1767225600),
             ("optional", "source", "analyst-2", "Unknown for old rows.", 1767225700)]


def _declarations(audits):
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.lit(w).alias("reviewer_reference"),
                              F.lit(why).alias("reason"), F.lit(t).cast("bigint").alias("reviewed_at")) for k, c, w, why, t in _DECLARED])
    return audits.select("dataset_id", F.explode(both).alias("d")).select("dataset_id", "d.*").filter(
        (F.col("kind") == "public_contact") | (F.col("dataset_id") == "de"))


_DECLARED_SQL = f"""
SELECT l.dataset_id, v.* FROM (SELECT DISTINCT lang AS dataset_id FROM documents) l JOIN (VALUES {", ".join(
    f"({O.q(k)}, {O.q(c)}, {O.q(w)}, {O.q(why)}, {t})" for k, c, w, why, t in _DECLARED)})
  AS v(kind, "column", reviewer, reason, made) ON v.kind = 'public_contact' OR l.dataset_id = 'de'"""


@register("review_digests", f"""
SELECT dataset_id, sha256('{{"declarations":[' || string_agg('{{"column":"' || "column" || '","kind":"' || kind || '","reason":"' || reason
    || '","reviewed_at":' || made || ',"reviewer_reference":"' || reviewer || '"}}', ',' ORDER BY "column", kind) || ']}}') AS review_digest
FROM ({_DECLARED_SQL}) x GROUP BY dataset_id
""")
def review_digests(spark, sf_dir):
    """The digest of every declaration of a dataset, whoever made it."""
    return RV.review_digest(_declarations(_contacts(spark, sf_dir).audits))


@register("review_validity", f"""
WITH o AS ({_OFFER_SQL}), d AS ({_DECLARED_SQL})
SELECT d.dataset_id, concat_ws(',',
  CASE WHEN NOT coalesce(bool_or(o.public_contact = 'business_email'), false) THEN 'PUBLIC_CHOICE_NOT_OFFERED' END,
  CASE WHEN bool_or(d.kind = 'optional' AND NOT coalesce(contains(o.optional, 'source'), false)) THEN 'OPTIONAL_CHOICE_NOT_OFFERED' END,
  CASE WHEN d.dataset_id = 'fr' THEN 'STALE_FINGERPRINT' END) AS checks
FROM d LEFT JOIN o ON o.dataset_id = d.dataset_id GROUP BY d.dataset_id
""")
def review_validity(spark, sf_dir):
    """Reviews against what is offered now; one was made on another state of its dataset."""
    r = _contacts(spark, sf_dir)
    claimed = r.audits.select("dataset_id", F.when(F.col("dataset_id") == "fr", "0" * 64).otherwise(F.col("fingerprint")).alias("fingerprint"))
    v = RV.review_validity(_declarations(r.audits), r.findings, r.audits, claimed)
    return v.select("dataset_id", F.array_join("checks", ",").alias("checks"))


_ISSUES = "'[' || string_agg('{{\"code\":\"' || code || '\",\"severity\":\"' || severity || '\"' || CASE WHEN \"column\" IS NULL THEN '' ELSE ',\"column\":\"' || \"column\" || '\"' END || ',\"count\":' || \"count\" || '}}', ',' ORDER BY ord) || ']'".replace("{{", "{").replace("}}", "}")


@register("public_audits", f"""
WITH a AS (SELECT * FROM ({C._REVIEWED_A}) x), f AS (SELECT * FROM ({C._REVIEWED_F}) y),
fp AS (SELECT dataset_id, fingerprint FROM ({O.fingerprint_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)}) z)
SELECT a.dataset_id, a.status, fp.fingerprint, a.row_count, a.column_count, a.duplicate_row_count, a.quality_score,
  coalesce((SELECT {_ISSUES} FROM f WHERE NOT accepted), '[]') AS issues,
  coalesce((SELECT {_ISSUES} FROM f WHERE accepted), '[]') AS accepted_issues
FROM a JOIN fp ON fp.dataset_id = a.dataset_id
""")
def public_audits(spark, sf_dir):
    """E5: what readers outside may see of an audit, declared issues apart from the others."""
    r = audit(D.dirty_orders(spark, sf_dir), order_col="_row_id", columns=D.ORDERS_COLUMNS, materialize=True,
              reviews=RV.review_sets(C._reviews(spark)))
    return EV.public_audit(r.audits, r.findings)


@register("restored_plans", f"""
WITH al AS (SELECT DISTINCT dataset_id, column_ref AS alias FROM ({C._ALIAS_SQL}) x WHERE column_ref IS NOT NULL),
names AS (SELECT dataset_id, "column", printf('column_%03d', dense_rank() OVER (PARTITION BY dataset_id ORDER BY "column")) AS alias
          FROM (SELECT DISTINCT dataset_id, "column" FROM (SELECT * FROM ({O.audit_sql(D.DIRTY_ORDERS_SQL, D.ORDERS_COLUMNS)}) a
                UNION ALL SELECT * FROM ({O.audit_sql(C.DOC_SOURCE_SQL, ["text"])}) b) c WHERE "column" IS NOT NULL) d)
SELECT l.dataset_id, 'known' AS candidate_id, coalesce(n1."column", '?') AS columns, n1."column" IS NOT NULL AS accepted
FROM (SELECT 'orders' AS dataset_id UNION ALL SELECT DISTINCT lang FROM documents) l
LEFT JOIN names n1 ON n1.dataset_id = l.dataset_id AND n1.alias = 'column_001'
UNION ALL SELECT dataset_id, 'unknown', '?', false FROM (SELECT 'orders' AS dataset_id UNION ALL SELECT DISTINCT lang FROM documents) m
""")
def restored_plans(spark, sf_dir):
    """Plans that name columns by alias, with the real names again; an unknown alias rejects its plan."""
    audits, findings = C._two_fleets(spark, sf_dir)
    steps = F.array(*[F.struct(F.lit(c).alias("candidate_id"), F.array(F.lit(a)).alias("columns"))
                      for c, a in (("known", "column_001"), ("unknown", "column_999"))])
    acts = audits.select("dataset_id", F.explode(steps).alias("s")).select(
        "dataset_id", "s.candidate_id", F.lit(0).alias("action_idx"), F.lit("TRIM_OUTER_WHITESPACE").alias("action"), "s.columns")
    restored, unknown = EV.restore_columns(acts, EV.column_aliases(findings))
    bad = unknown.select(*PLAN_KEYS, F.lit(True).alias("bad")).distinct()
    names = F.array_join(F.transform("columns", lambda c: F.coalesce(c, F.lit("?"))), ",")
    return restored.join(bad, PLAN_KEYS, "left").select(*PLAN_KEYS, names.alias("columns"), F.col("bad").isNull().alias("accepted"))


@register("csv_round_trip", f"SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in D.ORDERS_COLUMNS)} FROM ({D.DIRTY_ORDERS_SQL}) x")
def csv_round_trip(spark, sf_dir):
    """S6 then S1: every order written as CSV parts and read back verbatim (blanks kept, null and empty alike)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(D.dirty_orders(spark, sf_dir), path, D.ORDERS_COLUMNS)
    return read_csv(spark, path, with_row_id=False)[0]


@register("governed_reports", f"""
WITH g AS ({R._GOVERNED_SQL})
SELECT dataset_id, v.run, outcome, CASE WHEN v.run = 'without_audit' AND outcome = 'REPAIRED' THEN 'audit_after' ELSE '' END AS missing,
  NOT (v.run = 'without_audit' AND outcome = 'REPAIRED') AS complete, output_fingerprint
FROM g JOIN (VALUES ('whole'), ('without_audit')) AS v(run) ON true
""")
def governed_reports(spark, sf_dir):
    """The report of every dataset of a governed run, and the same without one piece of evidence."""
    src = D.fleet_orders(spark, sf_dir)
    audits = audit(src, order_col="_row_id", columns=D.FLEET_COLUMNS, materialize=True).audits
    plans, acts = R._fleet_batch(spark, audits)
    run = C.G.cut(G.govern(src, D.FLEET_COLUMNS, plans, acts, R._fleet_policy(audits)))
    both = report_json(run).withColumn("run", F.lit("whole")).unionByName(
        report_json(run.drop("audit_after")).withColumn("run", F.lit("without_audit")))
    return both.select("dataset_id", "run", F.get_json_object("report", "$.outcome").alias("outcome"),
                       F.array_join("missing", ",").alias("missing"), "complete",
                       F.get_json_object("report", "$.lineage.output_fingerprint_sha256").alias("output_fingerprint"))
