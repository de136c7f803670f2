"""Helpers shared by the operators of this subpackage.

* ``written`` / ``shared_path``: intermediate tables and files go to the folder
  that ``spark.checkpoint.dir`` names, which all executors share. A lost
  executor never costs more than its running tasks.
* ``append_columns``: columns computed per Arrow batch inside tasks.
* ``ascii_words`` / ``space_words``: the two word rules, as byte operations.
* ``components``: connected components of an edge table, distributed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: A-Z to a-z, every other byte unchanged.
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)
#: A-Z to a-z; ASCII bytes that are neither a digit nor a letter become blanks.
WORD_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
    else 32
    for b in range(256))


def ascii_words(raw: bytes) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the A-Z-lowered UTF-8 text.

    Every byte of a non-ASCII character is >= 0x80, so working on bytes gives
    exactly the words of the character rule.
    """
    return raw.translate(WORD_TABLE).split()


def space_words(raw: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the A-Z-lowered UTF-8 text."""
    return raw.translate(LOWER_TABLE).split()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    values = batch.column(column).cast(pa.binary()).to_pylist()
    return [v if v is not None else b"" for v in values]


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{kind}-{uuid.uuid4().hex}"


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, kind: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage.

    The query's shuffle files go when it ends. No later query reads them, but they would stay on
    the executors' disks until the driver happens to collect its garbage. A value that the user has set stays.
    """
    spark = df.sparkSession
    path = shared_path(spark, kind)
    unset = spark.conf.get(_SHUFFLE_CLEANUP, None) is None
    if unset:
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if unset:
            spark.conf.unset(_SHUFFLE_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Broadcast hint only when ``rows`` (a counted number) of ``row_bytes`` in memory are under ``limit``.

    A row in a broadcast relation takes 64 bytes at least, however short its values.

    Beyond it Spark's own choice (sort-merge join, AQE skew handling) applies.
    """
    return F.broadcast(df) if rows * max(row_bytes, 64) <= limit else df


#: Bytes of one piece of an Arrow batch.
PIECE_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches to Python, if the session leaves Spark's default (64 MB).

    A batch is held in the JVM's direct memory and in the worker, once per task
    that runs; by Spark's rule of 10,000 rows it is a whole split of documents.
    Results don't depend on it. A value that the user has set stays.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(PIECE_BYTES))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` on batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches``, in slices of about ``PIECE_BYTES``, a row at least.

    What a task derives from a batch (words, hashes, output rows) can be several
    times the batch; slices bound it whatever the rows hold.
    """
    for b in batches:
        step = max(1, b.num_rows * PIECE_BYTES // max(b.nbytes, PIECE_BYTES))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def append_columns(df: DataFrame, fields: list[T.StructField],
                   make: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]]) -> DataFrame:
    """``df`` plus ``fields``, computed batch by batch; same-named input columns are replaced.

    ``make`` receives the batches of a partition and yields, for each batch, one
    Arrow array per field, so it may hold state (models, caches) per partition.
    """
    names = [f.name for f in fields]
    keep = [f.name for f in df.schema.fields if f.name not in names]
    schema = T.StructType([df.schema[k] for k in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tap():
            for b in pieces(batches):
                held.append(b)
                yield b
        for arrays in make(tap()):
            b = held.pop(0)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + arrays, names=keep + names)

    return map_arrow(df, run, schema)


def components(edges: DataFrame, kind: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(id, root)``, root = smallest id.

    Alternating large-star / small-star rounds: every round is two grouped
    minimums and two joins over the edges (and one query that tells whether
    stars are left), so the number of rounds grows with
    the logarithm of the longest chain. Each round's edges are written to the
    shared folder. A hub with very many neighbours never meets in one task: the
    minimum is a map-side-combined aggregate, and the join back is a plain
    equi-join that AQE splits when a key is skewed. Ids without an edge are
    absent from the result.
    """
    spark = edges.sparkSession
    e = (edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = written(e, kind)
    before: tuple | None = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node hang on the smallest id around it (every edge has a > b).
        low = (_ends(e, [F.col("b").alias("m")], [F.col("a").alias("m")]).groupBy("id").agg(F.min("m").alias("m"))
               .select(F.col("id").alias("n"), F.least("id", "m").alias("m")))
        e1 = e.join(low, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        low = e1.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        e2 = (e1.join(low, F.col("a") == F.col("n"))
              .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                        F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
              .select("s.a", "s.b").filter("a <> b").distinct())
        e = written(e2, kind)
        now, settled = _state(e)
        if settled or now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)


def _ends(e: DataFrame, at_a: list[Column], at_b: list[Column]) -> DataFrame:
    """Two rows of each edge ``(a, b)``, from one scan: ``id`` is ``a`` with the columns ``at_a``, and ``b`` with ``at_b``."""
    rows = F.array(F.struct(F.col("a").alias("id"), *at_a), F.struct(F.col("b").alias("id"), *at_b))
    return e.select(F.explode(rows).alias("s")).select("s.*")


def _state(e: DataFrame) -> tuple[tuple, bool]:
    """Count and hash of the edges, and whether they are stars: every ``a`` hangs on one ``b``, which hangs on none."""
    no = F.lit(0).cast("long")
    ends = _ends(e, [F.lit(1).cast("long").alias("up"), no.alias("down"), F.xxhash64("a", "b").alias("h")],
                 [no.alias("up"), F.lit(1).cast("long").alias("down"), no.alias("h")])
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"),
                                   F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    n, h, most, chained = nodes.agg(F.sum("up"), F.sum("h"), F.max("up"), F.max(F.least("up", "down"))).first()
    return (n, h), (most or 0) <= 1 and not chained


def unused_name(names: list[str], stem: str) -> str:
    """A column name that is none of ``names``."""
    taken = {n.lower() for n in names}
    while stem in taken:
        stem += "_"
    return stem
