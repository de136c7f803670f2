"""Quality gate for arriving data (Structured Streaming).

* :func:`start_gate` audits every micro-batch with the batch audit and routes
  its rows: batches whose datasets are READY go to ``ready/``, the rest to
  ``quarantine/``; findings and audit records are appended as evidence. Each
  write is keyed by ``batch_id`` (partition overwrite), so a replayed batch
  after a failure rewrites the same partition: exactly-once results.
* :func:`windowed_quality` keeps running missing/blank counts per dataset in
  event-time windows with a watermark, so late rows are counted until the
  watermark passes and state stays bounded.
* :func:`start_windows` counts every row exactly once, however late: each
  micro-batch adds its own counts per window as rows under its batch id
  (overwritten when a batch is replayed), and :func:`window_totals` adds them up.

All state and output live under folders given by the caller (on a cluster:
under the shared folder named by ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.audit import audit, qcol


def _write(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def gate_batch(batch: DataFrame, batch_id: int, *, columns: list[str], out: str,
               order_col: str = "_row_id") -> None:
    """Audit one micro-batch and route its rows (used by ``foreachBatch``)."""
    batch.persist()  # the audit and both routes read it; its source may not be read twice alike
    r = audit(batch, columns=columns, order_col=order_col, materialize=True)
    tag = F.lit(batch_id).cast("bigint").alias("batch_id")
    _write(r.audits.select(tag, "*"), f"{out}/audits")
    _write(r.findings.select(tag, "*"), f"{out}/findings")
    ready = r.audits.filter(F.col("status") == "READY").select("dataset_id")
    rows = batch.select(tag, "*")
    _write(rows.join(ready, on="dataset_id", how="left_semi"), f"{out}/ready")
    _write(rows.join(ready, on="dataset_id", how="left_anti"), f"{out}/quarantine")
    batch.unpersist()


def start_gate(stream: DataFrame, *, columns: list[str], out: str, checkpoint: str,
               available_now: bool = True):
    """Start the gate; returns the ``StreamingQuery``."""
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: gate_batch(df, bid, columns=columns, out=out)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def utc_event_time(ts):
    """A wall-clock (time-zone-less) timestamp read as UTC, whatever the session zone."""
    return F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                            F.second(ts).cast("decimal(8,6)"), F.lit("UTC"))


def windowed_quality(stream: DataFrame, *, columns: list[str], ts_col: str, window: str = "1 hour",
                     watermark: str = "2 hours") -> DataFrame:
    """Missing/blank counts per dataset and event-time window (append mode)."""
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        v = T.strip(T.na_fold(qcol(c)))
        aggs.append(F.count_if(~F.coalesce(v != F.lit(""), F.lit(False))).alias(f"missing_{c}"))
    return (stream.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window).alias("window"), "dataset_id").agg(*aggs)
            .select(F.unix_seconds(F.col("window.start")).alias("window_start"), "dataset_id",
                    *["rows"] + [f"missing_{c}" for c in columns]))


def start_windows(stream: DataFrame, *, columns: list[str], ts_col: str, out: str, checkpoint: str, window: str = "1 hour"):
    """Start counting rows and missing cells per dataset and event-time window; returns the ``StreamingQuery``.

    State is the table under ``out``: one small row per batch, window and dataset, so
    nothing is dropped for being late and nothing is kept in memory.
    """
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        v = T.strip(T.na_fold(qcol(c)))
        aggs.append(F.count_if(~F.coalesce(v != F.lit(""), F.lit(False))).alias(f"missing_{c}"))

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window(ts_col, window).alias("window"), "dataset_id").agg(*aggs)
        _write(counts.select(F.lit(batch_id).cast("bigint").alias("batch_id"),
                             F.unix_seconds(F.col("window.start")).alias("window_start"), "dataset_id",
                             "rows", *[f"missing_{c}" for c in columns]), out)
    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start())


def window_totals(counts: DataFrame, columns: list[str]) -> DataFrame:
    """The windows of :func:`start_windows` so far: late rows of later batches added to those before."""
    return counts.groupBy("window_start", "dataset_id").agg(
        F.sum("rows").alias("rows"), *[F.sum(f"missing_{c}").alias(f"missing_{c}") for c in columns])
