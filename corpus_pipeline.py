"""A corpus pipeline over the documents table: five stages, each one operator of vettable.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the shared checkpoint folder and read again as the next stage's
documents. All but the last return the columns of the documents.

1. quality: documents that the compression classifier scores under 0.3 go.
2. near_duplicates: of every component of the n-gram Jaccard join (shingles of
   five words, 0.8 or more) the document with the smallest id stays.
3. decontamination: documents that are mostly benchmark passages go; in the
   others the passages are cut out of the text (and ``n_chars`` follows).
4. mix: the documents are put in the order of the Pfair schedule of their
   sources. All stay; the order of rows in the written files is the result.
5. token_ids: token-id files in the order of the rows that stage 4 wrote; one
   row per document, read back from the files.

Defined results: a null or empty text is scored as it is, has no shingles or benchmark
words (so it stays), and is the end id alone in the files; rows with a null id all stay
and are never linked; of rows that repeat an id the second stage keeps one, if they
have words; ties go to the smallest id; an empty table passes through all stages and
gives no rows; extra columns pass through stages 1 to 4 whatever their names.

Token ids, compressed sizes and shingle components are beyond SQL, so there is
no ORACLE_SQL; the tests replay the stages by brute force.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettable.llm import decontaminate, jaccard_join, mixing, quality, token_ids
from vettable.llm.common import written
from vettable.llm.queries import table, tokenizer_file

REJECT_BELOW = 0.3
END_ID = 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = "_quality_score"
    return quality.score_quality(docs, model, out=score).filter(F.col(score) >= REJECT_BELOW).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return clean


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def row_order(docs: DataFrame, part: str = "_part", row: str = "_row") -> DataFrame:
    """Id and text of ``docs`` with their place in the files they were read from: columns ``part`` and ``row``."""
    try:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
        # Files of other names (no number) count as the first part.
        number = F.when(name == "", F.lit("0")).otherwise(name).cast("long")
        return docs.select("doc_id", "text", number.alias(part), F.col("_metadata.row_index").alias(row))
    except AnalysisException:  # not read from files
        return docs.select("doc_id", "text", F.lit(0).cast("long").alias(part), F.monotonically_increasing_id().alias(row))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.token_id_output(row_order(docs), tokenizer_file(), END_ID, order=["_part", "_row"])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mix", mix_stage),
    ("token_ids", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
