"""Redacted row preview.

The first rows in row order (a top-k, planned as ``TakeOrderedAndProject``,
so no full sort), at most 12 populated values per row, each stripped,
contact-like values replaced by ``[sensitive value]`` and long text cut to
67 characters plus ``...``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators.audit import qcol

REDACTED = "[sensitive value]"


def preview_text(c: Column) -> Column:
    s = T.strip(c)
    return (F.when(s.rlike("(?i)" + K.SENSITIVE_PREVIEW), F.lit(REDACTED))
            .when(F.length(s) > K.PREVIEW_MAX_CHARS,
                  F.concat(F.substring(s, 1, K.PREVIEW_KEEP_CHARS), F.lit("...")))
            .otherwise(s))


def preview(df: DataFrame, columns: list[str], order_col: str, *, rows: int = K.PREVIEW_ROWS,
            per_row: int = K.PREVIEW_VALUES_PER_ROW, sep: str = " | ") -> DataFrame:
    """``row_number, populated_cells, preview`` for the first ``rows`` rows."""
    first = df.select(order_col, *[qcol(c) for c in columns]).orderBy(order_col).limit(rows)
    cells = F.array(*[qcol(c).cast("string") for c in columns])
    present = F.filter(cells, lambda x: x.isNotNull() & (T.strip(x) != ""))
    out = first.select(
        F.col(order_col).alias("row_key"),
        F.size(present).cast("int").alias("populated_cells"),
        F.array_join(F.transform(F.slice(present, 1, per_row), preview_text), sep).alias("preview"))
    return out.filter(F.col("populated_cells") > 0)
