"""Evidence-based recommendation among repair candidates.

Profiles are rows ``(dataset_id, candidate_id, code, column, sev, cnt)``; the
source audit enters as the pseudo-candidate ``@source`` (``@`` cannot occur
in a valid candidate id), and the duplicate count as the pseudo-finding
``@duplicates``. "X improves on Y" is then one null-safe full outer join of
two profiles and a ``bool_and`` / ``bool_or`` per pair - no weights.

Pairs are formed only inside a dataset and only among its candidates, whose
number the batch rule (V2) caps at five: at most 20 ordered pairs per
dataset, however large the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .compare import finding_profile
from .policy import PLAN_KEYS

SOURCE = "@source"
DUPS = "@duplicates"


def profiles(before_audits: DataFrame, before_findings: DataFrame, after_audits: DataFrame,
             after_findings: DataFrame) -> DataFrame:
    bp = finding_profile(before_findings, ["dataset_id"]).withColumn("candidate_id", F.lit(SOURCE))
    ap = finding_profile(after_findings, PLAN_KEYS)
    bd = before_audits.select("dataset_id", F.lit(SOURCE).alias("candidate_id"),
                              F.lit(DUPS).alias("code"), F.lit(None).cast("string").alias("column"),
                              F.col("duplicate_row_count").cast("bigint").alias("sev"),
                              F.lit(0).cast("bigint").alias("cnt"))
    ad = after_audits.select(*PLAN_KEYS, F.lit(DUPS).alias("code"),
                             F.lit(None).cast("string").alias("column"),
                             F.col("duplicate_row_count").cast("bigint").alias("sev"),
                             F.lit(0).cast("bigint").alias("cnt"))
    cols = ["dataset_id", "candidate_id", "code", "column",
            F.col("sev").cast("bigint").alias("sev"), F.col("cnt").cast("bigint").alias("cnt")]
    return (bp.select(*cols).unionByName(ap.select(*cols)).unionByName(bd.select(*cols))
            .unionByName(ad.select(*cols)))


def improves(pairs: DataFrame, prof: DataFrame) -> DataFrame:
    """C1 for each pair ``(dataset_id, x, y)``: x is nowhere worse and somewhere better."""
    px = pairs.join(prof.withColumnRenamed("candidate_id", "x"), on=["dataset_id", "x"]) \
        .select("dataset_id", "x", "y", "code", "column", F.col("sev").alias("sx"),
                F.col("cnt").alias("cx"))
    py = pairs.join(prof.withColumnRenamed("candidate_id", "y"), on=["dataset_id", "y"]) \
        .select(F.col("dataset_id").alias("d2"), F.col("x").alias("x2"), F.col("y").alias("y2"),
                F.col("code").alias("code2"), F.col("column").alias("col2"),
                F.col("sev").alias("sy"), F.col("cnt").alias("cy"))
    cond = ((px["dataset_id"] == py["d2"]) & (px["x"] == py["x2"]) & (px["y"] == py["y2"])
            & (px["code"] == py["code2"]) & px["column"].eqNullSafe(py["col2"]))
    j = px.join(py, cond, how="full_outer").select(
        F.coalesce("dataset_id", "d2").alias("dataset_id"), F.coalesce("x", "x2").alias("x"),
        F.coalesce("y", "y2").alias("y"),
        F.coalesce("sx", F.lit(0)).alias("sx"), F.coalesce("cx", F.lit(0)).alias("cx"),
        F.coalesce("sy", F.lit(0)).alias("sy"), F.coalesce("cy", F.lit(0)).alias("cy"))
    agg = j.groupBy("dataset_id", "x", "y").agg(
        F.bool_and((F.col("sx") <= F.col("sy")) & (F.col("cx") <= F.col("cy"))).alias("le"),
        F.bool_or((F.col("sx") < F.col("sy")) | (F.col("cx") < F.col("cy"))).alias("lt"))
    out = pairs.join(agg, on=["dataset_id", "x", "y"], how="left")
    return out.select("dataset_id", "x", "y",
                      F.coalesce(F.col("le") & F.col("lt"), F.lit(False)).alias("improves"))


def recommend(evaluations: DataFrame, before_audits: DataFrame, before_findings: DataFrame,
              after_audits: DataFrame, after_findings: DataFrame, trials: DataFrame,
              plan_actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C3-C6. Returns ``(candidate_rows, recommendations)``."""
    from ..session import cut
    prof = cut(profiles(before_audits, before_findings, after_audits, after_findings))
    passing = evaluations.filter(F.col("status") == "NO_AUDIT_REGRESSION").select(*PLAN_KEYS)
    # One improvement pass over both kinds of pairs: (candidate, source) for
    # C1, and ordered pairs of distinct passing candidates for C2 (a superset
    # of the improving ones; filtered below).
    vs_pairs = passing.select("dataset_id", F.col("candidate_id").alias("x"), F.lit(SOURCE).alias("y"))
    cand_pairs = (passing.select("dataset_id", F.col("candidate_id").alias("x"))
                  .join(passing.select("dataset_id", F.col("candidate_id").alias("y")), on="dataset_id")
                  .filter(F.col("x") != F.col("y")))
    imp_all = cut(improves(vs_pairs.unionByName(cand_pairs), prof))
    vs_source = imp_all.filter(F.col("y") == SOURCE)
    rows = (evaluations.join(vs_source.select("dataset_id", F.col("x").alias("candidate_id"),
                                              "improves"), on=PLAN_KEYS, how="left")
            .select(*PLAN_KEYS, F.col("status").alias("evaluation_status"),
                    F.when(F.col("status") != "NO_AUDIT_REGRESSION", F.lit("EXCLUDED"))
                    .when(~F.coalesce("improves", F.lit(False)), F.lit("NO_MEASURED_IMPROVEMENT"))
                    .otherwise(F.lit("IMPROVING")).alias("disposition")))
    improving = rows.filter(F.col("disposition") == "IMPROVING").select(*PLAN_KEYS)
    a = after_audits.select(*PLAN_KEYS, "status", "quality_score", "fingerprint", "row_count",
                            "column_count", "duplicate_row_count")
    imp = (imp_all.filter(F.col("y") != SOURCE)
           .join(improving.select("dataset_id", F.col("candidate_id").alias("x")),
                 on=["dataset_id", "x"], how="left_semi")
           .join(improving.select("dataset_id", F.col("candidate_id").alias("y")),
                 on=["dataset_id", "y"], how="left_semi"))
    ax = a.select("dataset_id", F.col("candidate_id").alias("x"), F.col("status").alias("stx"),
                  F.col("quality_score").alias("qx"))
    ay = a.select("dataset_id", F.col("candidate_id").alias("y"), F.col("status").alias("sty"),
                  F.col("quality_score").alias("qy"))
    dom = (imp.join(ax, on=["dataset_id", "x"]).join(ay, on=["dataset_id", "y"])
           .filter((F.col("qx") >= F.col("qy")) & ~((F.col("sty") == "READY") & (F.col("stx") != "READY"))
                   & F.col("improves"))
           .select("dataset_id", F.col("y").alias("candidate_id")).distinct())
    # C4: skyline = improving and not dominated.
    short = improving.join(dom, on=PLAN_KEYS, how="left_anti")
    # Collapse only identical outputs with identical audit evidence.
    pj = prof.join(short, on=PLAN_KEYS, how="left_semi").groupBy(*PLAN_KEYS).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("code", "column", "sev", "cnt"))))
        .alias("profile"))
    n_act = plan_actions.groupBy(*PLAN_KEYS).agg(F.count("*").alias("n_actions"))
    fin = (short.join(a, on=PLAN_KEYS, how="left").join(pj, on=PLAN_KEYS, how="left")
           .join(trials.select(*PLAN_KEYS, "output_fingerprint"), on=PLAN_KEYS, how="left")
           .join(n_act, on=PLAN_KEYS, how="left")
           .withColumn("n_actions", F.coalesce("n_actions", F.lit(0))))
    w = Window.partitionBy("dataset_id")
    ident = F.to_json(F.struct("output_fingerprint", "fingerprint", "status", "quality_score",
                               "row_count", "column_count", "duplicate_row_count", "profile"))
    fin = (fin.withColumn("_id", ident)
           .withColumn("_nid", F.size(F.collect_set("_id").over(w)))
           .withColumn("_same", F.min(F.coalesce(F.col("output_fingerprint") == F.col("fingerprint"),
                                                 F.lit(False)).cast("int")).over(w))
           .withColumn("_n", F.count("*").over(w))
           .withColumn("_min", F.min("n_actions").over(w))
           .withColumn("_nmin", F.count(F.when(F.col("n_actions") == F.col("_min"), 1)).over(w)))
    collapse = (F.col("_n") > 1) & (F.col("_nid") == 1) & (F.col("_same") == 1) & (F.col("_nmin") == 1)
    final = fin.filter(~collapse | (F.col("n_actions") == F.col("_min")))
    rec = final.groupBy("dataset_id").agg(
        F.array_sort(F.collect_list("candidate_id")).alias("shortlist"))
    datasets = evaluations.select("dataset_id").distinct()
    recs = datasets.join(rec, on="dataset_id", how="left").select(
        "dataset_id",
        F.when(F.coalesce(F.size("shortlist"), F.lit(0)) == 1, F.lit("RECOMMENDED"))
        .when(F.coalesce(F.size("shortlist"), F.lit(0)) > 1, F.lit("HUMAN_CHOICE_REQUIRED"))
        .otherwise(F.lit("NO_IMPROVING_CANDIDATE")).alias("status"),
        F.when(F.size("shortlist") == 1, F.col("shortlist")[0]).alias("recommended_candidate_id"),
        F.coalesce(F.array_join("shortlist", ","), F.lit("")).alias("shortlisted_candidate_ids"))
    return rows, recs
