"""Operator 3: token counts of documents by a separator scan over flat token files.

Flat files hold nothing but little-endian ids; an end-of-document id closes
each document. There is no index, so lengths come from the positions of that
id. Each file is cut into blocks of ``BLOCK_IDS`` ids that are searched
independently (a vectorised comparison per block). A document that crosses
block borders is stitched by a prefix scan: every block reports the ids after
its last separator (its carry) and the position of its first one; the scan adds
the carries of blocks without a separator, and the sum is added to the first
document that ends in a later block.

``write_flat_files`` produces such files from documents. With every token file
goes an id file of the same task (8-byte document ids, same order), committed
together, so names, not lengths, carry the order of documents.

Defined results: null and empty texts are documents of no tokens (their end id
is not counted); null ``doc_id`` stays null; repeated rows are separate
documents; empty tables give no rows; other columns are ignored. An end id that
also occurs inside a document would split it, so the writer refuses vocabularies
in which an ordinary token has that id and encodes its string as plain text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import map_arrow, shared_path
from .tokenise import id_bytes, read_definition, worker_encoder

BLOCK_IDS = 1 << 20
#: Documents of one file; bounds what a scanning task reads at once.
FILE_DOCS = 20_000
#: Stands for a null document id in the id files.
NULL_ID = -(1 << 63)


@dataclass
class FlatFiles:
    path: str
    width: int
    end_id: int


def write_flat_files(docs: DataFrame, tokenizer_path: str, end_token: str, *, text: str = "text",
                     doc_id: str = "doc_id") -> FlatFiles:
    """One token file and one id file per input partition, in input order (no shuffle of texts)."""
    from tokenizers import Tokenizer

    definition = read_definition(tokenizer_path)
    tok = Tokenizer.from_str(definition)
    end_id = tok.token_to_id(end_token)
    if end_id is None or end_token not in [a["content"] for a in json.loads(definition)["added_tokens"]]:
        raise ValueError(f"{end_token!r} is not an added token, so its id could occur inside a document")
    width = id_bytes(tok.get_vocab_size())
    end = int(end_id).to_bytes(width, "little")

    def flat(batches):
        enc = worker_encoder(definition, True)
        n = 0
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = enc.encode([t or "" for t in part.column("text").to_pylist()])
                docs_ = [NULL_ID if d is None else d for d in part.column("doc_id").to_pylist()]
                raw = [d.to_bytes(8, "little", signed=True) for d in docs_]
                m = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["ids"] * m + ["tokens"] * m), pa.array(list(range(n, n + m)) * 2, pa.int64()),
                     pa.array(raw + ids, pa.binary())], names=["kind", "seq", "value"])
                n += m

    path = shared_path(docs.sparkSession, "flat-tokens")
    # The text writer closes each row with the separator: that is the end id itself.
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    (map_arrow(base, flat, "kind string, seq long, value binary")
     .sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value"))
     .write.partitionBy("kind").option("maxRecordsPerFile", FILE_DOCS)
     .option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(path))
    return FlatFiles(path, width, end_id)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; ``part`` follows the file names, so it orders the files of a task."""
    name = r"/part-(\d+)-[^/]*\.c(\d+)"
    number = [F.regexp_extract("path", name, i).cast("long") for i in (1, 2)]
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
            .select((number[0] * 1_000_000 + number[1]).alias("part"), "content"))


def separator_scan(spark: SparkSession, path: str, end_id: int, width: int = 2,
                   block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents of the flat files at ``path``: ``(part, ordinal, start, n_tokens)``.

    ``start`` counts ids (end ids included) from the start of the file ``part``;
    ``n_tokens`` leaves the end id out. Ids after the last separator of a file
    make a last, unclosed document.
    """
    dtype = f"<u{width}"

    def scan(batches):
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("content")):
                ids = np.frombuffer(raw.as_buffer(), dtype)
                for block, at in enumerate(range(0, len(ids), block_ids)):
                    piece = ids[at:at + block_ids]
                    ends = np.flatnonzero(piece == end_id)
                    carry = len(piece) - 1 - int(ends[-1]) if len(ends) else len(piece)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part]), pa.array([block]), pa.array([len(ends)]), pa.array([carry]),
                         pa.array([np.diff(ends, prepend=-1) - 1], pa.list_(pa.int64()))],
                        names=["part", "block", "n_ends", "carry", "lengths"])

    found = map_arrow(_files(spark, path), scan,
                      "part long, block long, n_ends long, carry long, lengths array<long>")
    # The prefix scan, over one row per block. A run is a stretch of blocks without a separator and the
    # block with one that ends it; the open carry before a block is what its run has gathered so far,
    # and the carry of the block with a separator before the run.
    w = Window.partitionBy("part").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    in_run = Window.partitionBy("part", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("n_ends") > 0
    blocks = (found.withColumn("run", F.count(F.when(has, 1)).over(before))
              .withColumn("opened", F.last(F.when(has, F.col("carry")), True).over(before))
              .withColumn("ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
              .withColumn("final", F.lead("block").over(w).isNull())
              .withColumn("carried", F.coalesce(F.sum("carry").over(in_run), F.lit(0))
                          + F.coalesce("opened", F.lit(0)))
              # Ids behind the last separator of a file: one more document, which no block closes.
              .withColumn("lengths", F.when(F.col("final") & (F.col("carry") > 0),
                                            F.concat("lengths", F.array("carry"))).otherwise(F.col("lengths"))))
    docs = (blocks.select("part", "ordinal", "carried", F.posexplode("lengths").alias("k", "n"))
            .select("part", (F.col("ordinal") + F.col("k")).alias("ordinal"),
                    (F.col("n") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens")))
    inside = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("start", F.coalesce(F.sum(F.col("n_tokens") + 1).over(inside), F.lit(0)))


def document_ids(spark: SparkSession, files: FlatFiles) -> DataFrame:
    """``(part, ordinal, doc_id)`` of the id files: fixed records of 8 bytes and a separator."""
    record = np.dtype([("id", "<i8"), ("end", f"V{files.width}")])

    def read(batches):
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("content").to_pylist()):
                ids = np.frombuffer(raw, record)["id"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part)), pa.array(np.arange(len(ids))),
                     pa.array(ids, mask=ids == NULL_ID)], names=["part", "ordinal", "doc_id"])

    return map_arrow(_files(spark, f"{files.path}/kind=ids"), read, "part long, ordinal long, doc_id long")


def token_counts(docs: DataFrame, tokenizer_path: str, end_token: str, **columns: str) -> DataFrame:
    """Write flat files, scan them, and name the documents: ``doc_id, part, ordinal, start, n_tokens``."""
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, part long, ordinal long, start long, n_tokens long")
    files = write_flat_files(docs, tokenizer_path, end_token, **columns)
    counts = separator_scan(spark, f"{files.path}/kind=tokens", files.end_id, files.width)
    return (document_ids(spark, files).join(counts, ["part", "ordinal"])
            .select("doc_id", "part", "ordinal", "start", "n_tokens"))
