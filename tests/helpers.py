from pyspark.sql import functions as F

from vettable.operators.audit import audit
from vettable.sources.csv import read_csv


def load(spark, path, dataset_id="ds"):
    df, hdr = read_csv(spark, path)
    cols = [c for c in df.columns if c != "_row_id"]
    return df.withColumn("dataset_id", F.lit(dataset_id)), cols, hdr


def audit_csv(spark, path, dataset_id="ds", reviews=None):
    df, cols, hdr = load(spark, path, dataset_id)
    r = audit(df, columns=cols, order_col="_row_id", raw_header=hdr, reviews=reviews)
    a = r.audits.collect()[0].asDict()
    f = [x.asDict() for x in r.findings.orderBy("ord").collect()]
    return a, f


def codes(findings, include_accepted=False):
    return [x["code"] for x in findings if include_accepted or not x["accepted"]]
