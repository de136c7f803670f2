"""File manifest and byte fingerprints.

``binaryFile`` reads each file as one row (path, length, content). Hashing
is ``sha2(content, 256)`` in the JVM. A file is one row, so this suits the
bounded files the gate accepts; large tables use the table fingerprint (S9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``dataset_id`` (= path), path, file_name, length, sha256, content.

    ``binaryFile`` skips zero-length files, so those are added from the
    file-system listing with empty content.
    """
    plist = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.format("binaryFile").load(plist)
    read = df.select(F.col("path").alias("dataset_id"), "path",
                     F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
                     F.col("length").cast("bigint").alias("length"),
                     F.sha2(F.col("content"), 256).alias("sha256"), "content")
    empty = (path_status(spark, plist).filter(F.col("is_file") & (F.col("length") == 0))
             .select(F.col("path").alias("dataset_id"), "path",
                     F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
                     F.col("length"), F.sha2(F.lit(bytearray(b"")), 256).alias("sha256"),
                     F.lit(bytearray(b"")).alias("content")))
    return read.unionByName(empty.join(read.select("path"), on="path", how="left_anti")
                            .select(*read.columns))


def path_status(spark: SparkSession, paths: list[str]) -> DataFrame:
    """P1/P2 inputs: qualified path, whether it exists, is a regular file, its length.

    Metadata only (Hadoop FileSystem on the driver); no file content is read.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        q = fs.makeQualified(hp).toString()
        exists = bool(fs.exists(hp))
        st = fs.getFileStatus(hp) if exists else None
        is_file = bool(st.isFile()) if st is not None else False
        rows.append((q, exists, is_file, int(st.getLen()) if is_file else 0))
    return spark.createDataFrame(rows, "path string, exists boolean, is_file boolean, length bigint")


def texts_as_files(df: DataFrame, id_col: str, text_col: str, name_col: str | None = None
                   ) -> DataFrame:
    """Treat each text value as the bytes of one CSV file (UTF-8)."""
    content = F.encode(F.col(text_col), "UTF-8")
    name = F.col(name_col) if name_col else F.concat(F.col(id_col).cast("string"), F.lit(".csv"))
    return df.select(F.col(id_col).cast("string").alias("dataset_id"), name.alias("path"),
                     name.alias("file_name"), F.octet_length(content).cast("bigint").alias("length"),
                     F.sha2(content, 256).alias("sha256"), content.alias("content"))
