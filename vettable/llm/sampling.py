"""Bounded, repeatable samples of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of this remainder are held out of every fit.
HELD_OUT_FOLD = 0
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; an id that is null is not held out."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def per_class(rows: DataFrame, label: str, key: str, bound: int) -> tuple[DataFrame, dict]:
    """(about ``bound`` rows of each class, rows per class over the whole table).

    Rows are kept whose hash lies under the class's share, so no class is ever
    gathered in one task and the choice repeats. The class count must be small
    (the labels of a classifier).
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows, counts
    unit = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, bound / n))])
    return rows.filter(unit < share[F.col(label)]), counts
