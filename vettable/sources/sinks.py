"""Sinks for repaired tables and machine-readable reports.

S6 writes CSV with a header, minimal quoting, UTF-8, and both null and ``''``
as an empty field. Spark omits a row whose only cell is empty when
``emptyValue`` is ``''``; a one-column output therefore keeps Spark's
default and writes ``""`` for such a row, as the reference writer does.
Rows are written in ``_row_id`` order; the output path must differ from
the source.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SinkError(ValueError):
    pass


def write_csv(df: DataFrame, path: str, columns: list[str], *, source_path: str | None = None,
              order_col: str | None = "_row_id", single_file: bool = False) -> None:
    """Write the repaired rows: range-partitioned by ``order_col`` and sorted, so that
    parts in name order keep row order. ``single_file`` gives one part through one
    task, for outputs known to be small."""
    if source_path is not None and source_path.rstrip("/") == path.rstrip("/"):
        raise SinkError("output and source have the same path")
    out = df
    one_col = len(columns) == 1
    if one_col:
        out = out.withColumn(columns[0], F.coalesce(F.col(columns[0]), F.lit("")))
    if order_col is not None:
        out = (out.coalesce(1).sortWithinPartitions(order_col) if single_file
               else out.repartitionByRange(order_col).sortWithinPartitions(order_col))
    elif single_file:
        out = out.coalesce(1)
    w = (out.select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite")
         .option("header", True).option("quote", '"').option("escape", '"')
         .option("nullValue", "").option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n")
         .option("encoding", "UTF-8"))
    if not one_col:
        w = w.option("emptyValue", "")
    w.csv(path)


REPORT_FIELDS = ("outcome", "reason", "audit_before", "plan", "decision", "audit_after", "comparison", "lineage")
REQUIRED_FOR_REPAIRED = ("audit_after", "comparison", "lineage")


def report_json(run: DataFrame) -> DataFrame:
    """``dataset_id, report, complete, missing``: one nested JSON document per dataset of a governed run.

    Every report has the same fields in the same order (``REPORT_FIELDS``, then any
    others); a column that the run lacks is null in it. A REPAIRED outcome needs its
    audit, comparison and lineage after the repair: what is absent, as a value or as
    a column, is named in ``missing`` and makes the report incomplete.
    """
    def held(name: str):
        return F.col(name) if name in run.columns else F.lit(None).cast("string")
    others = [c for c in run.columns if c not in ("dataset_id", *REPORT_FIELDS)]
    doc = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "dataset_id", *[held(c).alias(c) for c in REPORT_FIELDS],
                             *others), {"ignoreNullFields": "false"})
    missing = F.when(held("outcome") == "REPAIRED", F.array_compact(F.array(*[
        F.when(held(c).isNull(), F.lit(c)) for c in REQUIRED_FOR_REPAIRED])))
    missing = F.coalesce(missing, F.array().cast("array<string>"))
    return run.select("dataset_id", doc.alias("report"), (F.size(missing) == 0).alias("complete"), missing.alias("missing"))


def write_report(reports: DataFrame, path: str) -> None:
    """Write complete reports as JSON lines; refuses any incomplete REPAIRED report."""
    if not path.endswith(".json") and not path.endswith(".jsonl") and "." in path.rsplit("/", 1)[-1]:
        raise SinkError("reports have the suffix .json")
    if reports.filter(~F.col("complete")).take(1):
        raise SinkError("a REPAIRED report without its evidence")
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def parse_report(text: str) -> dict:
    return json.loads(text)
