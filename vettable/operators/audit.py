"""Audit checks A1-A14 as column expressions over a fleet of datasets.

A dataset is the set of rows sharing the values of ``keys`` (``dataset_id``
alone, or ``dataset_id`` + ``candidate_id`` for repair trials). All datasets in
one DataFrame share its columns.

Physical plan, per call, all lazily joined on ``keys``:

1. ``checks``: one ``groupBy(keys).agg`` with every per-column conditional
   count (missing, PII, coordinate, injection, type sample bounds). Partial
   aggregation runs map-side, so a dataset that holds a third of all rows
   costs one buffer per task, not a hot shuffle partition.
2. ``identity``: per row a 256-bit digest of the NA-folded row (duplicates)
   and of the verbatim row (fingerprint). ``groupBy(keys, digest)`` shuffles
   32-byte keys plus 8 additive limbs, never whole rows.
3. ``type sample`` (only for columns whose first numeric and first text
   value were both seen): the rank of the later of the two among non-empty
   values, counted exactly with a second narrow scan. This replaces
   ``head(2000)`` per column without sorting or collecting anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import cut


def qcol(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class AuditResult:
    findings: DataFrame   # keys..., ord, code, severity, column, count, accepted
    audits: DataFrame     # keys..., status, fingerprint, row_count, column_count,
                          # duplicate_row_count, quality_score, finding_count


def header_issue_counts(raw_header: list[str]) -> tuple[int, int]:
    """A2/A3 on one header list: (suspicious names, ambiguous normalized names)."""
    norm = [T.normalize_name(h) for h in raw_header]
    suspicious = sum(1 for n in norm if not n or n.startswith("unnamed"))
    seen: dict[str, int] = {}
    for n in norm:
        if n:
            seen[n] = seen.get(n, 0) + 1
    ambiguous = sum(1 for n, c in seen.items() if c > 1)
    return suspicious, ambiguous


def header_findings(headers: DataFrame, keys: list[str]) -> DataFrame:
    """A1-A3 and A6 over a header table ``(keys..., position, name)``.

    For fleets whose datasets have different headers (many CSV files).
    Output rows: ``keys..., code, severity, column, count``.
    """
    h = headers.withColumn("norm", T.normalize_name_col(F.col("name")))
    susp = (h.filter((F.col("norm") == "") | F.col("norm").startswith("unnamed"))
            .groupBy(*keys).agg(F.count("*").alias("count"))
            .select(*keys, F.lit("SUSPICIOUS_COLUMN_NAME").alias("code"),
                    F.lit("WARNING").alias("severity"),
                    F.lit(None).cast("string").alias("column"), "count"))
    amb = (h.filter(F.col("norm") != "").groupBy(*keys, "norm").count()
           .filter("count > 1").groupBy(*keys).agg(F.count("*").alias("count"))
           .select(*keys, F.lit("AMBIGUOUS_COLUMN_NAMES").alias("code"),
                   F.lit("CRITICAL").alias("severity"),
                   F.lit(None).cast("string").alias("column"), "count"))
    pii = (h.filter(F.col("norm").isin(*K.PII_COLUMN_NAMES))
           .select(*keys, F.lit("PII_COLUMN_NAME").alias("code"),
                   F.lit("CRITICAL").alias("severity"), F.col("name").alias("column"),
                   F.lit(1).cast("bigint").alias("count")))
    return susp.unionByName(amb).unionByName(pii)


def _finding(code: str, severity: str, column: str | None, count: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                    F.lit(column).cast("string").alias("column"),
                    count.cast("bigint").alias("count"))


N_LIMBS = 16  # 16 x 16-bit limbs = the 256 bits of SHA-256


def limb_words(hexdigest: str) -> list[str]:
    """SQL of a hex SHA-256 column as signed 64-bit words ``<name>_w0`` .. (four limbs a word), to select before :func:`limbs`."""
    return [f"cast(conv(substring({hexdigest}, {1 + 16 * g}, 16), 16, -10) as bigint) as {hexdigest}_w{g}"
            for g in range(N_LIMBS // 4)]


def limbs(hexdigest: str) -> list[str]:
    """SQL of the 16-bit limbs from the words of :func:`limb_words`. Summed as BIGINT
    they cannot overflow below 2^47 rows per dataset."""
    return [f"(shiftright({hexdigest}_w{i // 4}, {16 * (3 - i % 4)}) & 65535)" for i in range(N_LIMBS)]


def identity_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Row count, duplicate count (NA-folded view) and multiset fingerprint.

    Output: ``keys..., row_count, duplicate_row_count, fingerprint``.
    """
    folded = [T.na_fold(qcol(c)) for c in columns]
    verbatim = [F.coalesce(qcol(c), F.lit("")) for c in columns]
    fp_hex = F.sha2(F.concat_ws(",", *[F.concat(F.length(v).cast("string"), F.lit(":"), v)
                                       for v in verbatim]), 256)
    rows = df.select(*[F.col(k) for k in keys], T.row_digest(folded).alias("_d"), fp_hex.alias("_h"))
    return fold_identity(rows, keys, F.lit(signature(columns)))


def signature(columns: list[str]) -> str:
    """The columns' part of a fingerprint."""
    return ",".join(f"{len(c)}:{c}" for c in columns)


def fingerprint_of(sig: Column, rows: Column, sums: list[Column]) -> Column:
    """S9 of the number of rows and the summed limbs.

    The sums are hashed unreduced: modulo 65,536 that many copies of any row would add nothing.
    """
    return F.sha2(F.concat_ws("|", sig, rows.cast("string"), *[x.cast("string") for x in sums]), 256)


def fold_identity(rows: DataFrame, keys: list[str], sig: Column) -> DataFrame:
    """Counts and fingerprint of ``rows(keys..., _d digest, _h hex SHA-256)``; ``sig`` is constant per key."""
    per_digest = rows.selectExpr(*[f"`{k}`" for k in keys], "_d", *limb_words("_h")).groupBy(*keys, "_d").agg(
        F.expr("count(*) as _n"), *[F.expr(f"sum({x}) as _l{i}") for i, x in enumerate(limbs("_h"))])
    agg = per_digest.groupBy(*keys).agg(
        F.expr("sum(_n) as row_count"), F.expr("sum(_n) - count(*) as duplicate_row_count"),
        *[F.expr(f"sum(_l{i}) as _l{i}") for i in range(N_LIMBS)])
    return agg.select(*keys, "row_count", "duplicate_row_count",
                      fingerprint_of(sig, F.col("row_count"), [F.col(f"_l{i}") for i in range(N_LIMBS)])
                      .alias("fingerprint"))


def column_checks(df: DataFrame, keys: list[str], columns: list[str], order: Column) -> DataFrame:
    """Pass 1: every per-column conditional count in one aggregation.

    ``live`` counts the rows with a non-blank cell: a dataset without any holds no
    records for the gate, whatever its number of rows.
    """
    blank = F.lit(True)
    for name in columns:
        blank = blank & (T.strip(F.coalesce(qcol(name), F.lit(""))) == "")
    aggs: list[Column] = [F.count_if(~blank).alias("live")]
    for i, name in enumerate(columns):
        v = T.strip(T.na_fold(qcol(name)))
        ne = F.coalesce(v != F.lit(""), F.lit(False))
        norm = T.normalize_name(name)
        aggs.append(F.count_if(~ne).alias(f"m{i}"))
        aggs.append(F.count_if(ne).alias(f"n{i}"))
        pii = ne & T.pii_match(v)
        limit = K.COORDINATE_LIMITS.get(norm)
        if limit is not None:
            valid = T.valid_coordinate(v, limit)
            aggs.append(F.count_if(ne & ~valid).alias(f"c{i}"))
            pii = pii & ~valid
        aggs.append(F.count_if(pii).alias(f"p{i}"))
        aggs.append(F.count_if(ne & T.injection_match(v)).alias(f"j{i}"))
        num = T.is_numeric(v)
        aggs.append(F.min(F.when(ne & num, order)).alias(f"fn{i}"))
        aggs.append(F.min(F.when(ne & ~num, order)).alias(f"ft{i}"))
    return df.groupBy(*keys).agg(*aggs)


def _greatest(cols: list[Column]) -> Column:
    """Largest non-null value (null when all are null); any number of columns."""
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def sample_ranks(df: DataFrame, keys: list[str], columns: list[str], order: Column,
                 checks: DataFrame, type_sample_limit: int) -> DataFrame:
    """Pass 2: rank of the type-sample cut, only where both kinds were seen.

    ``checks`` is materialized (one row per dataset), so whether any column
    needs this pass is known before planning it; when none does, the data is
    not read again. Otherwise only rows at or before a cut are counted, and
    the cheap order comparison runs before the text test.
    """
    thresholds = checks.select(*keys, *[
        F.when(F.col(f"fn{i}").isNotNull() & F.col(f"ft{i}").isNotNull()
               & (F.col(f"n{i}") > type_sample_limit),
               F.greatest(F.col(f"fn{i}"), F.col(f"ft{i}"))).alias(f"t{i}")
        for i in range(len(columns))])
    needed = thresholds.filter(_greatest([F.col(f"t{i}") for i in range(len(columns))])
                               .isNotNull()) if columns else thresholds.limit(0)
    if not needed.take(1):
        return thresholds.select(*keys, *[F.lit(None).cast("bigint").alias(f"r{i}")
                                          for i in range(len(columns))])
    probe = df.select(*keys, order.alias("_o"), *[qcol(c).alias(f"v{i}") for i, c in enumerate(columns)])
    cut_at = _greatest([F.col(f"t{i}") for i in range(len(columns))])
    joined = probe.join(needed, on=keys, how="inner").filter(F.col("_o") <= cut_at)
    return joined.groupBy(*keys).agg(*[
        F.count_if((F.col("_o") <= F.col(f"t{i}"))
                   & F.coalesce(T.strip(T.na_fold(F.col(f"v{i}"))) != F.lit(""), F.lit(False)))
        .alias(f"r{i}") for i in range(len(columns))])


def audit(df: DataFrame, *, keys: list[str] | tuple[str, ...] = ("dataset_id",),
          columns: list[str] | None = None, order_col: str | None = None,
          raw_header: list[str] | None = None, reviews: DataFrame | None = None,
          fingerprints: DataFrame | None = None,
          type_sample_limit: int = K.TYPE_SAMPLE_LIMIT, materialize: bool = False) -> AuditResult:
    """Audit every dataset of ``df`` (verbatim string cells, null allowed).

    ``order_col`` gives row order for the type sample (A10). Without it a
    ``monotonically_increasing_id`` of the scan is used, which is only stable
    on a deterministic scan, never on the output of a shuffle.
    ``raw_header`` is the header as written in the file (defaults to
    ``columns``). ``reviews``: ``keys..., public_columns array<string>,
    optional_columns array<string>`` (R4). ``fingerprints``: ``keys...,
    fingerprint`` (file SHA-256, S8); default is the table fingerprint (S9).
    ``materialize`` checkpoints the one-row-per-dataset result so that later
    evidence joins neither re-scan the source nor grow the plan.

    A dataset none of whose rows holds a non-blank cell is BLOCKED (A12): score 0,
    one CRITICAL finding, as a file that the gate finds without records.
    """
    keys = list(keys)
    if columns is None:
        columns = [c for c in df.columns if c not in keys and c != order_col]
    if order_col is None:
        order_col = "_row_order"
        df = df.withColumn(order_col, F.monotonically_increasing_id())
    order = F.col(order_col)
    df = df.select(*keys, order_col, *[qcol(c) for c in columns])

    checks = cut(column_checks(df, keys, columns, order))
    ranked = sample_ranks(df, keys, columns, order, checks, type_sample_limit)

    ident = identity_stats(df, keys, columns)
    if fingerprints is not None:
        ident = ident.drop("fingerprint").join(
            fingerprints, on=[k for k in keys if k in fingerprints.columns], how="left")

    wide = checks.join(ranked, on=keys, how="left").join(ident, on=keys, how="left")
    return assemble(wide, keys, columns, raw_header, reviews=reviews, type_sample_limit=type_sample_limit,
                    materialize=materialize)


def assemble(wide: DataFrame, keys: list[str], columns: list[str], raw_header: list[str] | None = None, *,
             reviews: DataFrame | None = None, type_sample_limit: int = K.TYPE_SAMPLE_LIMIT,
             materialize: bool = False) -> AuditResult:
    """Findings, score and status from the counts of every dataset (one row per ``keys``)."""
    raw_header = list(raw_header) if raw_header is not None else list(columns)
    # ---- findings in emission order ----
    suspicious, ambiguous = header_issue_counts(raw_header)
    items: list[Column] = []
    if suspicious:
        items.append(_finding("SUSPICIOUS_COLUMN_NAME", "WARNING", None, F.lit(suspicious)))
    if ambiguous:
        items.append(_finding("AMBIGUOUS_COLUMN_NAMES", "CRITICAL", None, F.lit(ambiguous)))
    for i, name in enumerate(columns):
        items.append(_finding("MISSING_VALUES", "WARNING", name, F.col(f"m{i}")))
    items.append(_finding("DUPLICATE_ROWS", "WARNING", None, F.col("duplicate_row_count")))
    for i, name in enumerate(columns):
        norm = T.normalize_name(name)
        if norm in K.PII_COLUMN_NAMES:
            items.append(_finding("PII_COLUMN_NAME", "CRITICAL", name, F.lit(1)))
        if norm in K.COORDINATE_LIMITS:
            items.append(_finding("INVALID_COORDINATE", "WARNING", name, F.col(f"c{i}")))
        items.append(_finding("PII_VALUE_PATTERN", "CRITICAL", name, F.col(f"p{i}")))
        items.append(_finding("PROMPT_INJECTION_PATTERN", "CRITICAL", name, F.col(f"j{i}")))
        both = F.col(f"fn{i}").isNotNull() & F.col(f"ft{i}").isNotNull()
        in_sample = (F.col(f"n{i}") <= type_sample_limit) | (F.col(f"r{i}") <= type_sample_limit)
        sample = F.least(F.col(f"n{i}"), F.lit(type_sample_limit))
        items.append(_finding("MIXED_NUMERIC_TEXT", "WARNING", name,
                              F.when(both & in_sample, sample).otherwise(F.lit(0))))
    dead = F.coalesce(F.col("live") == 0, F.lit(False))
    found = F.when(dead, F.array(_finding("HEADER_ONLY_FILE", "CRITICAL", None, F.lit(1)))).otherwise(
        F.filter(F.array(*items), lambda x: x["count"] > 0))

    if reviews is not None:
        wide = wide.join(reviews, on=[k for k in keys if k in reviews.columns], how="left")
        pub = F.coalesce(F.col("public_columns"), F.array().cast("array<string>"))
        opt = F.coalesce(F.col("optional_columns"), F.array().cast("array<string>"))
    else:
        pub = opt = F.array().cast("array<string>")

    def accepted(x: Column) -> Column:
        return F.coalesce(
            (F.array_contains(pub, x["column"])
             & x["code"].isin("PII_COLUMN_NAME", "PII_VALUE_PATTERN"))
            | (F.array_contains(opt, x["column"]) & (x["code"] == "MISSING_VALUES")),
            F.lit(False))

    tagged = F.transform(found, lambda x: F.struct(
        x["code"].alias("code"), x["severity"].alias("severity"),
        x["column"].alias("column"), x["count"].alias("count"),
        accepted(x).alias("accepted")))
    wide = wide.select(*keys, tagged.alias("_f"), "fingerprint", dead.alias("dead"),
                       *[F.when(dead, 0).otherwise(F.col(c)).alias(c) for c in ("row_count", "duplicate_row_count")])
    if materialize:
        wide = cut(wide)
    remaining = F.filter(F.col("_f"), lambda x: ~x["accepted"])
    total_penalty = F.aggregate(remaining, F.lit(0), lambda acc, x: acc + T.penalty(x["severity"]))

    audits = wide.select(
        *keys,
        F.when(F.col("dead"), F.lit("BLOCKED")).when(F.size(remaining) == 0, F.lit("READY"))
        .otherwise(F.lit("QUARANTINED")).alias("status"),
        F.col("fingerprint"),
        F.col("row_count"),
        F.when(F.col("dead"), 0).otherwise(len(columns)).alias("column_count"),
        F.col("duplicate_row_count"),
        F.when(F.col("dead"), 0).otherwise(F.greatest(F.lit(0), F.lit(100) - total_penalty)).cast("int")
        .alias("quality_score"),
        F.size(remaining).alias("finding_count"),
    )
    findings = wide.select(*keys, F.posexplode("_f").alias("ord", "f")).select(
        *keys, F.col("ord").cast("int").alias("ord"), "f.code", "f.severity", "f.column",
        "f.count", "f.accepted")
    return AuditResult(findings=findings, audits=audits)


def contact_conflicts(df: DataFrame, *, keys=("dataset_id",), columns: list[str]) -> DataFrame:
    """R3 counts: per public-contact-named column, cells incompatible with its kind."""
    keys = list(keys)
    aggs = []
    names = []
    for name in columns:
        kind = K.PUBLIC_CONTACT_COLUMNS.get(T.normalize_name(name))
        if kind is None:
            continue
        v = T.strip(T.na_fold(qcol(name)))
        ne = F.coalesce(v != F.lit(""), F.lit(False))
        aggs.append(F.count_if(ne & T.contact_incompatible(v, kind)).alias(f"x{len(names)}"))
        names.append(name)
    if not aggs:
        return df.sparkSession.createDataFrame(
            [], ", ".join(f"{k} string" for k in keys) + ", column string, conflicts bigint")
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"x{i}").cast("bigint").alias("conflicts"))
        for i, n in enumerate(names)])).alias("c")).select(*keys, "c.column", "c.conflicts")
