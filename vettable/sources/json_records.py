"""S3: JSON records as a table of text cells.

Each JSON text is one flat record (JSON lines), or a document holding an
array of records / ``{"records": [...]}``. ``try_parse_json`` (VARIANT) decides
what is valid: invalid JSON, duplicate keys and non-finite numbers give null.
``from_json`` to a map gives keys in the order of the text and scalars as text: integers
as written, other numbers in the shortest form of a double (``1.0`` stays ``1.0``,
``1.50`` becomes ``1.5``), null as ``''``, booleans as ``true`` / ``false``.
Nested values, empty objects, scalars, empty keys and, where limits are given, keys
or values that are too long reject a record; too many rows or columns refuse a
dataset (:func:`refusals`). The key union keeps first-seen order (row order, then
position in the record); :func:`json_rows` carries it as data, so datasets have
headers of their own and no key list reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def _parsed(df: DataFrame, text_col: str, keys: list[str], order_col: str, documents: bool,
            max_cell_length: int | None = None) -> DataFrame:
    """One row per record: ``keys..., _row_id, _m (its map, keys in order), _bad``."""
    v = F.try_parse_json(F.col(text_col))
    if documents:
        one = F.json_object_keys(F.col(text_col))
        wrapped = (F.size(one) == 1) & (F.get(one, 0) == "records")
        found = F.when(wrapped, F.variant_get(v, "$.records", "variant")).otherwise(v)
        texts = F.when(wrapped, F.from_json(text_col, "struct<records:array<string>>")["records"]).otherwise(
            F.from_json(text_col, "array<string>"))
        whole = df.select(*keys, F.col(order_col).alias("_doc"), found.alias("_found"), texts.alias("_texts"))
        rec = whole.select(*keys, "_doc", "_texts", F.posexplode_outer(F.try_variant_get("_found", "$", "array<variant>"))
                           .alias("_i", "_v"))
        rec = rec.select(*keys, F.struct("_doc", "_i").alias("_row_id"), "_v", F.from_json(F.get("_texts", F.col("_i")), _MAP).alias("_m"))
    else:
        rec = df.select(*keys, F.col(order_col).alias("_row_id"), v.alias("_v"), F.from_json(text_col, _MAP).alias("_m"))
    kind = F.schema_of_variant("_v")

    def nested(x: Column) -> Column:
        return F.schema_of_variant(x).startswith("OBJECT") | F.schema_of_variant(x).startswith("ARRAY")
    bad = (F.when(F.col("_v").isNull(), "INVALID_JSON_OR_DUPLICATE_KEY").when(~kind.startswith("OBJECT"), "NOT_AN_OBJECT")
           .when(kind == "OBJECT<>", "EMPTY_OBJECT")
           .when(F.exists(F.map_values(F.try_variant_get("_v", "$", "map<string,variant>")), nested), "NESTED_VALUE")
           .when(F.array_contains(F.map_keys("_m"), ""), "EMPTY_KEY"))
    if max_cell_length is not None:
        long = lambda x: F.coalesce(F.length(x) > max_cell_length, F.lit(False))
        bad = bad.when(F.exists(F.map_keys("_m"), long) | F.exists(F.map_values("_m"), long), "CELL_TOO_LARGE")
    return rec.select(*keys, "_row_id", "_m", kind.alias("_kind"), F.try_variant_get("_v", "$", "map<string,variant>").alias("_types"),
                      bad.alias("_bad"))


def json_cells(df: DataFrame, text_col: str, *, keys: list[str] | None = None,
               order_col: str = "_row_id", documents: bool = False,
               max_cell_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Long cells ``(keys..., _row_id, _pos, column, value, value_type)`` and rejects.

    ``documents=False``: each text is one record. ``True``: each text is an
    array of records or ``{"records": [...]}``; ``_row_id`` is then the struct
    (text order, index), which orders the records however many a text holds. Both outputs are narrow transforms of the
    input: no shuffle.
    """
    keys = keys or ["dataset_id"]
    checked = _parsed(df, text_col, keys, order_col, documents, max_cell_length)
    cells = checked.filter("_bad is null").select(*keys, "_row_id", "_types", F.posexplode("_m").alias("_pos", "column", "value"))
    cells = cells.select(*keys, "_row_id", F.col("_pos").cast("int").alias("_pos"), "column",
                         F.coalesce("value", F.lit("")).alias("value"),
                         F.schema_of_variant(F.try_element_at("_types", F.col("column"))).alias("value_type"))
    return cells, checked.filter("_bad is not null").select(*keys, "_row_id", F.col("_bad").alias("reason"))


def key_union(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Columns of each dataset in first-seen order: ``keys..., column, position``.

    A key occurs once per record, so its first sighting is (min record id,
    that record's position): ``min`` and ``min_by`` have fixed-width buffers,
    so this is a hash aggregate combined map-side.
    """
    keys = keys or ["dataset_id"]
    first = cells.groupBy(*keys, "column").agg(F.min("_row_id").alias("_r"),
                                                F.min_by("_pos", "_row_id").alias("_p"))
    w = Window.partitionBy(*keys).orderBy("_r", "_p")
    return first.select(*keys, "column", F.row_number().over(w).cast("int").alias("position"))


def json_rows(df: DataFrame, text_col: str, *, keys: list[str] | None = None, order_col: str = "_row_id",
              documents: bool = False, max_cell_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``rows(keys..., _row, values)``, ``headers(keys..., names)``) as ``file_audit.audit_rows`` takes them.

    The accepted records of a dataset under its key union; absent keys are ``''``.
    """
    keys = keys or ["dataset_id"]
    good = _parsed(df, text_col, keys, order_col, documents, max_cell_length).filter("_bad is null")
    seen = good.select(*keys, "_row_id", F.posexplode("_m").alias("_pos", "column", "value"))
    headers = key_union(seen, keys).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("names"))
    rows = good.join(headers, keys).select(*keys, F.col("_row_id").alias("_row"), F.transform(
        "names", lambda n: F.coalesce(F.try_element_at("_m", n), F.lit(""))).alias("values"))
    return rows, headers


def refusals(df: DataFrame, text_col: str, *, keys: list[str] | None = None, order_col: str = "_row_id",
             documents: bool = False, max_rows: int | None = None, max_columns: int | None = None,
             max_cell_length: int | None = None) -> DataFrame:
    """``keys..., reason, records``: why a dataset as a whole can't be taken (a rejected record refuses all of it)."""
    keys = keys or ["dataset_id"]
    cells, rejects = json_cells(df, text_col, keys=keys, order_col=order_col, documents=documents,
                                max_cell_length=max_cell_length)
    out = rejects.groupBy(*keys, "reason").agg(F.count("*").alias("records"))
    size = cells.groupBy(*keys).agg(F.count_distinct("_row_id").alias("rows"), F.count_distinct("column").alias("columns"))
    for limit, what, name in ((max_rows, "rows", "TOO_MANY_ROWS"), (max_columns, "columns", "TOO_MANY_COLUMNS")):
        if limit is not None:
            out = out.unionByName(size.filter(F.col(what) > limit).select(*keys, F.lit(name).alias("reason"),
                                                                          F.col("rows").alias("records")))
    return out


def json_table(df: DataFrame, text_col: str, columns: list[str], *, keys: list[str] | None = None,
               order_col: str = "_row_id", documents: bool = False) -> DataFrame:
    """Wide text table over the given key union; absent key -> ``''``.

    Every accepted record becomes one row by a projection over its parsed
    map - the cells of a record never leave its task.
    """
    keys = keys or ["dataset_id"]
    good = _parsed(df, text_col, keys, order_col, documents).filter("_bad is null")
    return good.select(*keys, "_row_id", *[
        F.coalesce(F.try_element_at("_m", F.lit(c)), F.lit("")).alias(c) for c in columns])
