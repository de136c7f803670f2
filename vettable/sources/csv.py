"""Raw CSV scan with every cell as verbatim text.

The header is taken as written (raw), then the data rows are read with an
explicit all-string schema so Spark never renames, infers or interprets a
value. ``multiLine`` keeps quoted line breaks inside one record; it makes a
file one split, which fits the per-file character of a CSV source. Large
tabular inputs belong in a columnar table read by :mod:`.tables`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

CORRUPT = "_corrupt_record"
ROW_ID = "_row_id"


def frame_names(raw_header: list[str]) -> list[str]:
    """Column names a data-frame reader gives a raw header.

    Blank names become ``Unnamed: <position>``; repeated names get ``.1``,
    ``.2`` ... in order of appearance, skipping names already taken.
    """
    names = [h if h != "" else f"Unnamed: {i}" for i, h in enumerate(raw_header)]
    taken: set[str] = set()
    counts: dict[str, int] = {}
    out = []
    for n in names:
        if n in taken:
            k = counts.get(n, 0)
            cand = n
            while cand in taken:
                k += 1
                cand = f"{n}.{k}"
            counts[n] = k
            n = cand
        taken.add(n)
        out.append(n)
    return out


def _reader(spark: SparkSession, schema: Ty.StructType | None, header: bool):
    r = (spark.read.option("header", header).option("multiLine", True)
         .option("escape", '"').option("quote", '"').option("encoding", "UTF-8")
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("enforceSchema", True))
    return r.schema(schema) if schema is not None else r


def read_raw_header(spark: SparkSession, path: str) -> list[str]:
    """First record of the file, parsed as CSV (one row to the driver)."""
    first = _reader(spark, None, False).csv(path).limit(1).collect()
    if not first:
        return []
    return ["" if v is None else v for v in first[0]]


def read_csv(spark: SparkSession, path: str, *, with_row_id: bool = True,
             raw_header: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Verbatim view of one CSV: string cells, empty stays ``''`` (never null).

    Returns ``(frame, raw_header)``. The frame has the reader-style column
    names of :func:`frame_names`, plus ``_row_id`` (file order) when asked.
    """
    if raw_header is None:
        raw_header = read_raw_header(spark, path)
    names = frame_names(raw_header)
    schema = Ty.StructType([Ty.StructField(f"_c{i}", Ty.StringType()) for i in range(len(names))])
    df = _reader(spark, schema, True).csv(path)
    cols = [F.coalesce(F.col(f"_c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
    if with_row_id:
        cols.append(F.monotonically_increasing_id().alias(ROW_ID))
        # Row ids are fixed at the scan (file order); spreading afterwards keeps them.
        from .tables import spread
        return spread(df.select(*cols)), raw_header
    return df.select(*cols), raw_header
