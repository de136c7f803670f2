"""Table scan. Typed columns enter the audit as text.

Only the projected columns are cast, so Catalyst prunes the parquet scan to
them (``ReadSchema`` shows exactly the audited columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, spread over the cluster when its files give too few splits.

    Projections and filters written after this still reach the parquet scan
    (Catalyst pushes them below the round-robin exchange).
    """
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


#: The most that ``spread`` shuffles.
SPREAD_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (file sizes for a scan), no job."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else str(size.toString()))


def as_text(df: DataFrame, columns: list[str] | None = None,
            keep: list[str] | None = None) -> DataFrame:
    """Project ``columns`` cast to string, plus untouched ``keep`` columns."""
    columns = columns or [c for c in df.columns if c not in (keep or [])]
    out: list[Column] = [F.col(k) for k in (keep or [])]
    out += [F.col(c).cast("string").alias(c) for c in columns]
    return df.select(*out)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan of few bytes over the cluster when it yields too few splits.

    A small file with one row group would otherwise run all the per-row checks in
    a single task. A scan of more than ``SPREAD_BYTES`` is never shuffled, however
    many cores there are: its row groups give it splits. The checks read file
    sizes and the planned partition count, never the data.
    """
    if estimated_bytes(df) > SPREAD_BYTES:
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
