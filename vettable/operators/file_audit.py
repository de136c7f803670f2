"""Audits where the columns are data: fleets of files or records with headers of their own.

``audit`` (in :mod:`.audit`) needs one list of columns for all datasets. Here a
dataset brings its header as an array and its rows as arrays of cells, so one
plan audits datasets of any shape and no column list reaches the driver:

* ``rows(keys..., _row, values array<string>)`` and ``headers(keys..., names
  array<string>)`` (the header as written);
* cells are counted per (dataset, position) in one map-side-combined aggregate;
  duplicates and fingerprints shuffle digests, as in :func:`.audit.identity_stats`
  and with the same results.

:func:`audit_files` adds the gate: a file that preflight blocks, or that the gate
accepts and a reader can't read, becomes an audit of status BLOCKED, score 0 and
one CRITICAL finding (A12); the others are parsed and audited.

Rows of equal content count as duplicates; a dataset without rows has no audit
unless the gate blocks it; null cells are empty cells of the verbatim view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import cut
from .audit import AuditResult, fold_identity
from .preflight import fields, preflight, text_of

READ_FAILURE = "CSV_READ_FAILURE"


def frame_names(names: Column) -> Column:
    """Column names a data-frame reader gives a header: blanks numbered, repeats with ``.1``, ``.2`` ..."""
    named = F.transform(names, lambda x, i: F.when(x == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(x))

    def add(out: Column, x: Column) -> Column:
        others = F.filter(F.transform(F.sequence(F.lit(1), F.size(out) + 1),
                                      lambda k: F.concat(x, F.lit("."), k.cast("string"))),
                          lambda c: ~F.array_contains(out, c))
        return F.concat(out, F.array(F.when(F.array_contains(out, x), F.get(others, 0)).otherwise(x)))
    repeats = F.size(F.array_distinct(named)) < F.size(named)
    return F.when(repeats, F.aggregate(named, F.array().cast("array<string>"), add)).otherwise(named)


def _array_identity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row and duplicate counts and fingerprints; the encodings of ``audit.identity_stats`` over arrays."""
    def encoded(cell: Column) -> Column:
        return F.concat(F.length(cell).cast("string"), F.lit(":"), cell)
    folded = F.transform("values", lambda x: F.coalesce(encoded(T.na_fold(x)), F.lit("~")))
    verbatim = F.transform("values", lambda x: encoded(F.coalesce(x, F.lit(""))))
    digest = F.unhex(F.sha2(F.array_join(folded, ","), 256))
    signature = F.array_join(F.transform("frame", encoded), ",")
    return fold_identity(rows.select(*keys, signature.alias("_sig"), digest.alias("_d"),
                                     F.sha2(F.array_join(verbatim, ","), 256).alias("_h")), [*keys, "_sig"], F.col("_sig"))


def _cell_stats(cells: DataFrame, keys: list[str], sample: int) -> DataFrame:
    """Counts per (dataset, position) of ``cells(keys..., _row, pos, name, raw)``."""
    at = [*keys, "pos", "name"]
    v, norm = T.strip(T.na_fold(F.col("raw"))), T.normalize_name_col(F.col("name"))
    some = F.coalesce(v != "", F.lit(False))
    limits = sorted(set(K.COORDINATE_LIMITS.values()))
    names = {m: [n for n, x in K.COORDINATE_LIMITS.items() if x == m] for m in limits}
    inside = F.lit(False)
    for m in limits:
        inside = F.when(norm.isin(*names[m]), T.valid_coordinate(v, m)).otherwise(inside)
    is_place = norm.isin(*K.COORDINATE_LIMITS)
    c = cells.select(*at, "_row", some.alias("some"), (some & is_place & ~inside).alias("off"),
                     (some & T.pii_match(v) & ~(is_place & inside)).alias("pii"),
                     (some & T.injection_match(v)).alias("told"), (some & T.is_numeric(v)).alias("num"))
    stats = cut(c.groupBy(*at).agg(
        F.count_if(~F.col("some")).alias("missing"), F.count_if("some").alias("filled"), F.count_if("off").alias("off"),
        F.count_if("pii").alias("pii"), F.count_if("told").alias("told"),
        F.min(F.when(F.col("num"), F.col("_row"))).alias("first_num"),
        F.min(F.when(F.col("some") & ~F.col("num"), F.col("_row"))).alias("first_text")))
    mixed = F.col("first_num").isNotNull() & F.col("first_text").isNotNull()
    # Where a column has more values than the sample, the later of the two firsts must lie inside it.
    late = stats.filter(mixed & (F.col("filled") > sample)).select(
        *at, F.greatest("first_num", "first_text").alias("_cut"))
    if late.take(1):
        ranks = (c.filter("some").join(late, at).filter(F.col("_row") <= F.col("_cut"))
                 .groupBy(*at).agg(F.count("*").alias("rank")))
        stats = stats.join(ranks, at, "left")
    else:
        stats = stats.withColumn("rank", F.lit(None).cast("bigint"))
    in_sample = (F.col("filled") <= sample) | F.coalesce(F.col("rank") <= sample, F.lit(False))
    return stats.withColumn("mixed", F.when(mixed & in_sample, F.least("filled", F.lit(sample))).otherwise(0))


def _score(audited: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """A13/A14 from the findings: status, score and number."""
    per = findings.groupBy(*keys).agg(F.sum(T.penalty(F.col("severity"))).alias("_lost"), F.count("*").alias("_n"))
    return audited.join(per, keys, "left").select(
        *keys, F.when(F.col("_n").isNull(), "READY").otherwise("QUARANTINED").alias("status"), "fingerprint", "row_count",
        "column_count", "duplicate_row_count",
        F.greatest(F.lit(0), F.lit(100) - F.coalesce("_lost", F.lit(0))).cast("int").alias("quality_score"),
        F.coalesce("_n", F.lit(0)).cast("int").alias("finding_count"))


def audit_rows(rows: DataFrame, headers: DataFrame, *, keys=("dataset_id",), fingerprints: DataFrame | None = None,
               type_sample_limit: int = K.TYPE_SAMPLE_LIMIT) -> AuditResult:
    """A1-A11, A13, A14 of every dataset of ``rows``; see the module text for the inputs."""
    keys = list(keys)
    heads = cut(headers.select(*keys, "names", frame_names(F.col("names")).alias("frame"),
                               F.transform("names", T.normalize_name_col).alias("norms")))
    wide = rows.join(heads.select(*keys, "frame"), keys).withColumn(
        "values", F.transform("frame", lambda _, i: F.coalesce(F.get("values", i), F.lit(""))))
    ident = _array_identity(wide, keys).drop("_sig")
    if fingerprints is not None:
        ident = ident.drop("fingerprint").join(fingerprints.select(*keys, "fingerprint"), keys, "left")
    cells = wide.select(*keys, "_row", "frame", F.posexplode("values").alias("pos", "raw")).select(
        *keys, "_row", "pos", F.get("frame", F.col("pos")).alias("name"), "raw")
    stats = _cell_stats(cells, keys, type_sample_limit)
    ident = cut(ident.join(heads.select(*keys, F.size("names").alias("column_count")), keys))

    def finding(group: int, part: int, code: str, severity: str, count, column=None) -> Column:
        return F.struct(F.lit(group).alias("group"), (F.lit(0) if column is None else F.col("pos")).alias("pos"),
                        F.lit(part).alias("part"), F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                        F.lit(None).cast("string").alias("column") if column is None else column.alias("column"),
                        count.cast("bigint").alias("count"))
    norm = T.normalize_name_col(F.col("name"))
    per_column = stats.select(*keys, F.explode(F.array(
        finding(2, 0, "MISSING_VALUES", "WARNING", F.col("missing"), F.col("name")),
        finding(4, 0, "PII_COLUMN_NAME", "CRITICAL", norm.isin(*K.PII_COLUMN_NAMES).cast("int"), F.col("name")),
        finding(4, 1, "INVALID_COORDINATE", "WARNING", F.col("off"), F.col("name")),
        finding(4, 2, "PII_VALUE_PATTERN", "CRITICAL", F.col("pii"), F.col("name")),
        finding(4, 3, "PROMPT_INJECTION_PATTERN", "CRITICAL", F.col("told"), F.col("name")),
        finding(4, 4, "MIXED_NUMERIC_TEXT", "WARNING", F.col("mixed"), F.col("name")))).alias("f"))
    unnamed = F.filter("norms", lambda n: (n == "") | n.startswith("unnamed"))
    named = F.filter("norms", lambda n: n != "")
    twice = F.filter(F.array_distinct(named), lambda n: F.size(F.filter(named, lambda m: m == n)) > 1)
    per_header = heads.join(ident.select(*keys), keys, "left_semi").select(*keys, F.explode(F.array(
        finding(0, 0, "SUSPICIOUS_COLUMN_NAME", "WARNING", F.size(unnamed)),
        finding(1, 0, "AMBIGUOUS_COLUMN_NAMES", "CRITICAL", F.size(twice)))).alias("f"))
    per_dataset = ident.select(*keys, finding(3, 0, "DUPLICATE_ROWS", "WARNING", F.col("duplicate_row_count")).alias("f"))
    found = per_column.unionByName(per_header).unionByName(per_dataset).filter("f.count > 0")
    emitted = Window.partitionBy(*keys).orderBy("f.group", "f.pos", "f.part")
    findings = cut(found.select(*keys, (F.row_number().over(emitted) - 1).cast("int").alias("ord"), "f.code", "f.severity",
                                "f.column", "f.count", F.lit(False).alias("accepted")))
    return AuditResult(findings=findings, audits=_score(ident, findings, keys))


def file_rows(texts: DataFrame) -> DataFrame:
    """``dataset_id, _row, values, width`` of CSV texts ``(dataset_id, text)``: the records after each header.

    Lines of blanks alone are no records, as for a reader. Fields are numbered by
    windows over a file's own pieces, so a file's records are spread afterwards.
    """
    piece = texts.select("dataset_id", F.posexplode(fields(F.col("text"))).alias("at", "p")).select("dataset_id", "at", "p.*")
    before = Window.partitionBy("dataset_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = piece.withColumns({"_row": F.coalesce(F.sum(F.col("closes").cast("bigint")).over(before), F.lit(0)),
                                "field": F.coalesce(F.sum((~F.col("more")).cast("bigint")).over(before), F.lit(0))})
    whole = placed.groupBy("dataset_id", "_row", "field").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat("body", F.when(F.col("more"), '"').otherwise(""))
                                                                     .alias("text")))), lambda x: x["text"]), "").alias("value"),
        F.bool_or("quoted").alias("quoted"))
    records = whole.groupBy("dataset_id", "_row").agg(
        F.sort_array(F.collect_list(F.struct("field", "value"))).alias("v"),
        (~F.bool_or("quoted") & (F.count("*") == 1) & F.max(F.col("value").rlike(r"^[ \t]*\z"))).alias("blank_line"))
    return records.filter("_row > 0 and not blank_line").select(
        "dataset_id", "_row", F.transform("v", lambda x: x["value"]).alias("values"), F.size("v").alias("width"))


def blocked(gate: DataFrame, fingerprints: DataFrame | None = None) -> AuditResult:
    """Audits and findings of ``gate(dataset_id, risk_flag)``: status BLOCKED, score 0, one CRITICAL finding."""
    j = gate.select("dataset_id", "risk_flag")
    j = (j.join(fingerprints.select("dataset_id", "fingerprint"), "dataset_id", "left") if fingerprints is not None
         else j.withColumn("fingerprint", F.lit(None).cast("string")))
    zero = F.lit(0).cast("bigint")
    audits = j.select("dataset_id", F.lit("BLOCKED").alias("status"), "fingerprint", zero.alias("row_count"),
                      F.lit(0).alias("column_count"), zero.alias("duplicate_row_count"), F.lit(0).alias("quality_score"),
                      F.lit(1).alias("finding_count"))
    findings = j.select("dataset_id", F.lit(0).alias("ord"), F.coalesce("risk_flag", F.lit("PREFLIGHT_BLOCKED")).alias("code"),
                        F.lit("CRITICAL").alias("severity"), F.lit(None).cast("string").alias("column"),
                        F.lit(1).cast("bigint").alias("count"), F.lit(False).alias("accepted"))
    return AuditResult(findings=findings, audits=audits)


def audit_files(files: DataFrame, paths: DataFrame | None = None, **limits) -> AuditResult:
    """Gate and audit of every file of ``files(dataset_id, path, length, sha256, content)``; one audit row each."""
    gate = cut(preflight(files, paths=paths, **limits))
    hashes = files.select("dataset_id", F.col("sha256").alias("fingerprint"))
    accepted = gate.filter("status = 'ACCEPTED'").select("dataset_id", "header", "data_row_count", "overlong")
    texts = files.join(accepted.select("dataset_id"), "dataset_id", "left_semi").select(
        "dataset_id", text_of(F.col("content")).alias("text"))
    rows = cut(file_rows(texts))
    # The reader must find the records that the gate counted, none longer than the header.
    seen = rows.groupBy("dataset_id").agg(
        F.count_if(F.exists("values", lambda x: T.strip(x) != "")).alias("read"), F.max("width").alias("widest"))
    checked = cut(accepted.join(seen, "dataset_id", "left").withColumn(
        "fails", F.col("overlong") | ~F.col("read").eqNullSafe(F.col("data_row_count")) | (F.col("widest") > F.size("header"))))
    good = checked.filter("not fails")
    found = audit_rows(rows.join(good.select("dataset_id"), "dataset_id", "left_semi").drop("width"),
                       good.select("dataset_id", F.col("header").alias("names")), fingerprints=hashes)
    stopped = gate.filter("status = 'BLOCKED'").select("dataset_id", "risk_flag").unionByName(
        checked.filter("fails").select("dataset_id", F.lit(READ_FAILURE).alias("risk_flag")))
    out = blocked(stopped, hashes)
    return AuditResult(findings=found.findings.unionByName(out.findings), audits=found.audits.unionByName(out.audits))
