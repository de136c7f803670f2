"""The executable repairs as lazy DataFrame transforms.

Repairs work on the verbatim view (text as written, ``''`` for empty) and
carry ``_row_id`` so that "keep the first copy" and output order survive the
de-duplication shuffle. Nothing here touches the source: each transform
returns a new logical plan over it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .audit import qcol

ROW_ID = "_row_id"


class RepairError(ValueError):
    """A repair that is not safe to run as requested."""


def _require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise RepairError(f"no such columns: {missing}")


def trim_outer_whitespace(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """strip Unicode whitespace at both ends of the named columns."""
    _require(df, columns)
    if not columns:
        return df
    return df.withColumns({c: T.strip(qcol(c)) for c in columns})


def standardize_missing_markers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """cells whose stripped lower-case text is a missing marker become null."""
    if not columns:
        raise RepairError("marking missing values needs a list of columns")
    _require(df, columns)

    def fix(c: Column) -> Column:
        return F.when(F.lower(T.strip(c)).isin(*K.MISSING_MARKERS), F.lit(None).cast("string")) \
                .otherwise(c)
    return df.withColumns({c: fix(qcol(c)) for c in columns})


def remove_exact_duplicates(df: DataFrame, columns: Sequence[str] = (),
                            keys: Sequence[str] = (), data_columns: Sequence[str] | None = None
                            ) -> DataFrame:
    """whole-row de-duplication keeping the first copy (lowest ``_row_id``).

    Exact duplicates share every cell, so the row itself is the grouping key
    (null, a cell marked as missing, equals null; ``apply_plan`` reads source
    nulls as ``''``) and only ``min(_row_id)`` is aggregated: a fixed-width buffer, so Spark plans a hash aggregate with
    map-side combine, and a row repeated across a third of the table
    collapses before it is shuffled.
    """
    if columns:
        raise RepairError("rows are de-duplicated whole; no columns can be named")
    keys = list(keys)
    data = list(data_columns) if data_columns is not None else [
        c for c in df.columns if c not in keys and c != ROW_ID]
    kept = df.groupBy(*keys, *[qcol(c) for c in data]).agg(F.min(ROW_ID).alias(ROW_ID))
    return kept.select(*keys, ROW_ID, *[qcol(c) for c in data])


def apply_action(df: DataFrame, action: str, columns: Sequence[str], *, keys: Sequence[str] = (),
                 data_columns: Sequence[str] | None = None) -> DataFrame:
    if action == "TRIM_OUTER_WHITESPACE":
        return trim_outer_whitespace(df, columns)
    if action == "REMOVE_EXACT_DUPLICATES":
        return remove_exact_duplicates(df, columns, keys=keys, data_columns=data_columns)
    if action == "STANDARDIZE_MISSING_MARKERS":
        return standardize_missing_markers(df, columns)
    if action in K.REPAIR_ACTIONS:
        raise RepairError(f"{action} is known but never executed")
    raise RepairError(f"no such action: {action}")


def apply_plan(df: DataFrame, actions: Sequence[tuple[str, Sequence[str]]], *,
               keys: Sequence[str] = (), data_columns: Sequence[str] | None = None) -> DataFrame:
    """compose the actions in plan order into one lazy plan."""
    data = list(data_columns) if data_columns is not None else [
        c for c in df.columns if c not in keys and c != ROW_ID]
    # The verbatim view holds text; a null cell is an empty one.
    out = df.withColumns({c: F.coalesce(qcol(c), F.lit("")) for c in data})
    for action, columns in actions:
        out = apply_action(out, action, list(columns), keys=keys, data_columns=data)
    return out


def executable(actions: Sequence[tuple[str, Sequence[str]]]) -> bool:
    return all(a in K.EXECUTABLE_ACTIONS for a, _ in actions)


def only_action(actions: Sequence[tuple[str, Sequence[str]]], action: str) -> None:
    """a single-action execution context may contain only that action."""
    others = [a for a, _ in actions if a != action]
    if others:
        raise RepairError(f"only {action} may run here, not {others}")
