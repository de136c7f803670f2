"""Operator 5: token-id output in frequency-ranked, byte-aligned variable-length files.

Format. An id is stored as its frequency rank (0 = the most frequent id of the
corpus), so most values need one byte. Four values share one control byte (two
bits each: stored bytes minus one); data bytes follow in a separate run, least
significant byte first. A file is a sequence of blocks, each closed by one
marker byte ``\\n``::

    b"TIDV" | n_docs u32 | n_ids u32 | n_data u32
    doc_id i64 x n_docs | has_doc_id u8 x n_docs | tokens u32 x n_docs
    control bytes ceil(n_ids / 4) | data bytes n_data | b"\\n"

A folder holds the files (``parts``) and beside them the table that decodes them (``ranks``:
one Parquet row with ``vocabulary[rank] = id`` as bytes, the end id and the SHA-256 of the
tokenizer's definition), so a reader needs the folder alone. Files are named by ascending position (``part-00000``, ``part-00001``, ...), and
inside them documents stand in order, so the concatenation of all files is the
corpus in ascending ``doc_id`` order. A block holds about ``BLOCK_IDS`` ids (more
only if one document is longer). Decoding is a numpy table lookup on the
control bytes.

Method. Tokenise once (Arrow batches in tasks), count ids with one partial
histogram per task, rank them on the driver (at most one row per vocabulary
entry), range-partition the compressed ids by the order columns, and write
blocks with Spark's text writer, which works on every file system Spark does.
A file holds about ``FILE_BYTES``, so a reader task never needs more.

Defined results: null text and empty text give a document of the end id alone;
null ``doc_id`` sorts first and is kept; repeated ``doc_id`` are all kept,
ordered by their ids; an empty table gives no files and no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import map_arrow, shared_path, written
from .tokenise import read_definition, token_ids

MAGIC = b"TIDV"
MARKER = b"\n"
BLOCK_IDS = 1 << 18
FILE_BYTES = 32 << 20

#: Stored bytes of the four values behind each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    bits = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    bits[:len(v)] = size - 1
    control = (bits.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    kept = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind ``encode_values``: lengths by table lookup, then gathers."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(doc_ids: list[int | None], values: list[np.ndarray]) -> bytes:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint32)
    control, data = encode_values(flat)
    head = np.array([len(doc_ids), len(flat), len(data)], "<u4").tobytes()
    ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    return MAGIC + head + ids + known + np.array([len(v) for v in values], "<u4").tobytes() + control + data


def decode_blocks(content: bytes):
    """Yield (doc_ids, tokens per document, values) of each block of a file."""
    at = 0
    while at < len(content):
        if content[at:at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        n_docs, n_ids, n_data = (int(x) for x in np.frombuffer(content, "<u4", 3, at + 4))
        at += 16
        ids = np.frombuffer(content, "<i8", n_docs, at)
        at += 8 * n_docs
        known = np.frombuffer(content, np.uint8, n_docs, at)
        at += n_docs
        tokens = np.frombuffer(content, "<u4", n_docs, at)
        at += 4 * n_docs
        n_control = -(-n_ids // 4)
        values = decode_values(content[at:at + n_control], content[at + n_control:at + n_control + n_data], n_ids)
        at += n_control + n_data
        if content[at:at + 1] != MARKER:
            raise ValueError(f"block is not closed at byte {at}")
        at += 1
        yield [int(i) if k else None for i, k in zip(ids, known)], tokens, values


def parts_path(path: str) -> str:
    return f"{path.rstrip('/')}/parts"


def read_ranks(spark: SparkSession, path: str) -> tuple[np.ndarray, int, str]:
    """(``vocabulary[rank] = id``, end id, tokenizer's SHA-256) of a folder of token files."""
    row = spark.read.parquet(f"{path.rstrip('/')}/ranks").first()
    return np.frombuffer(bytes(row["vocabulary"]), "<u4"), row["end_id"], row["tokenizer_sha256"]


def frequency_ranks(tokens: DataFrame, vocab_size: int, width: str) -> np.ndarray:
    """``vocabulary[rank] = id`` over all documents: most frequent first, ties by id.

    One histogram per task, so at most vocabulary x tasks narrow rows are
    shuffled and one row per vocabulary entry reaches the driver.
    """
    def count(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(vocab_size, np.int64)
        for b in batches:
            values = b.column("ids").to_pylist()
            for at in range(0, len(values), 512):
                flat = b"".join([unpack(v) for v in values[at:at + 512]])
                total += np.bincount(np.frombuffer(flat, width), minlength=vocab_size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    rows = map_arrow(tokens.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab_size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return np.lexsort((np.arange(vocab_size), -counts)).astype(np.uint32)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, *, text: str = "text",
                      doc_id: str = "doc_id", order: list[str] | None = None) -> str:
    """Tokenise ``docs``, append ``end_id`` to each and write the files in ``order`` (default ``doc_id``).

    The folder of the files.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    definition = read_definition(tokenizer_path)
    vocab_size = max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1)
    width = "<u2" if vocab_size <= 1 << 16 else "<u4"
    order = order or [doc_id]
    base = docs.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                       F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = [f"o{i}" for i in range(len(order))]
    tokens = written(token_ids(base, definition, compress=True).drop("text"), "token-ids", codec="none")
    vocabulary = frequency_ranks(tokens, vocab_size, width)
    rank = np.argsort(vocabulary).astype(np.uint32)

    size = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    n_files = max(1, 2 * size // FILE_BYTES + 1, min(spark.sparkContext.defaultParallelism, size >> 18))
    end = rank[end_id:end_id + 1]

    def pack(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        ids: list[int | None] = []
        values: list[np.ndarray] = []
        n = 0
        for b in batches:
            for d, v in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                ids.append(d)
                values.append(np.concatenate([rank[np.frombuffer(unpack(v), width)], end]))
                n += len(values[-1])
                if n >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([encode_block(ids, values)], pa.binary())], names=["b"])
                    ids, values, n = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([encode_block(ids, values)], pa.binary())], names=["b"])

    path = shared_path(spark, "token-files")
    ordered = tokens.repartitionByRange(n_files, *keys, "doc_id").sortWithinPartitions(*keys, "doc_id", "ids")
    (map_arrow(ordered.select("doc_id", "ids"), pack, "b binary")
     .select(F.col("b").cast("string").alias("value"))  # raw bytes: the cast changes none
     .write.option("encoding", "ISO-8859-1").option("lineSep", MARKER.decode("latin-1")).text(parts_path(path)))
    ranks = [(bytearray(vocabulary.astype("<u4").tobytes()), end_id, hashlib.sha256(definition.encode()).hexdigest())]
    (spark.createDataFrame(ranks, "vocabulary binary, end_id long, tokenizer_sha256 string").coalesce(1)
     .write.parquet(f"{path}/ranks"))
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files of a folder alone: ``doc_id, start, n_tokens, ids_crc32``."""
    vocabulary, _, _ = read_ranks(spark, path)

    def unpack(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                part = int(path.rsplit("/part-", 1)[1].split("-", 1)[0])
                at = 0
                for doc_ids, tokens, values in decode_blocks(content):
                    ids = vocabulary[values].astype("<u4")
                    ends = np.cumsum(tokens, dtype=np.int64)
                    crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), tokens.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(crc), part)), pa.array(doc_ids, pa.int64()),
                         pa.array(at + ends - tokens), pa.array(tokens.astype(np.int64)), pa.array(crc, pa.int64())],
                        names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])
                    at += int(ends[-1]) if len(ends) else 0

    raw = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(parts_path(path))
           .filter("length > 0").select("path", "content"))
    rows = written(map_arrow(raw, unpack, "part long, doc_id long, at long, n_tokens long, ids_crc32 long"),
                   "token-rows")
    # One row per file: the running total over files is small however large the corpus is.
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.groupBy("part").agg(F.sum("n_tokens").alias("t"))
            .select("part", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("base")))
    return rows.join(base, "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"),
                                          "n_tokens", "ids_crc32")


def token_id_output(docs: DataFrame, tokenizer_path: str, end_id: int, *, text: str = "text",
                    doc_id: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """Write ``docs`` as token files and read them back: one row per document."""
    path = write_token_files(docs, tokenizer_path, end_id, text=text, doc_id=doc_id, order=order)
    return read_token_files(docs.sparkSession, path)
