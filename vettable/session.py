"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]")
             .appName("vettable")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             # Plans here are built from hundreds of column expressions; the
             # per-call error call-site capture costs five JVM round trips each.
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is read from
    the session and never overridden. Only an unset value in local mode (one
    process, one disk) gets a fresh scratch folder; on a cluster it is an error,
    since every executor would write to its own disk.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="vettable-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df):
    """Materialize a small evidence table and cut its lineage.

    Evidence tables hold one row per dataset, candidate or finding, so they
    are tiny next to the data. They are written once as parquet under the
    shared checkpoint folder (reliable storage, survives executor loss) and
    read back: one job, later plans stay small, no downstream use re-scans
    the source, and the optimizer sees the true size when it decides whether
    a join side is small enough to broadcast.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/evidence/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
