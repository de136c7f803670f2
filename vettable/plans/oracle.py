"""Independent SQL formulations of the checks, for the DuckDB oracle.

These strings are written for DuckDB (RE2 regexes: no lookaround, so the
digit guards of the phone pattern become ``(?:^|[^0-9])`` / ``(?:[^0-9]|$)``,
which is equivalent for a containment test). They restate the rules in
plain SQL - window ``row_number`` for the type sample, ``GROUP BY`` over all
columns for duplicates - rather than reusing the Spark plan.
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions.text import normalize_name

# RE2 knows neither lookaround nor Unicode classes by letter, so blanks, digits and word edges are
# spelled out; an edge consumes its neighbour, which changes nothing for a containment test.
_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SEP = "[-." + _S[1:]
_D = r"\p{Nd}"
_W = r"[\p{L}\p{N}_]"
_OPEN, _CLOSE = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
SSN_RE2 = f"{_OPEN}{_D}{{3}}-{_D}{{2}}-{_D}{{4}}{_CLOSE}"
PII_RE2 = (
    f"(?i)(?:(?:{_OPEN}[A-Z0-9_]|{_W}[.%+-])[A-Z0-9._%+-]*@[A-Z0-9.-]+\\.[A-Z]{{2,}}{_CLOSE})"
    f"|(?:{SSN_RE2})"
    f"|(?:(?:^|[^{_D}])(?:\\+?1{_SEP}?)?(?:\\(?{_D}{{3}}\\)?{_SEP}?){_D}{{3}}{_SEP}?{_D}{{4}}(?:[^{_D}]|$))"
)
INJECTION_RE2 = (
    f"(?i){_OPEN}(?:(?:ignore|disregard|override){_S}+(?:all{_S}+)?(?:previous|prior|system){_S}+instructions?"
    f"|reveal{_S}+(?:the{_S}+)?system{_S}+prompt"
    f"|you{_S}+are{_S}+(?:now{_S}+)?(?:chatgpt|an?{_S}+ai)"
    f"|developer{_S}+message"
    f"|system{_S}+prompt){_CLOSE}"
)
NUMBER_RE2 = r"(?i)[+-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?|inf|infinity)"
INF_RE2 = r"(?i)[+-]?(?:inf|infinity)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


NA_LIST = ", ".join(q(t) for t in K.NA_TOKENS)
STRIP_LIT = q(K.STRIP_CHARS)


def strip_sql(x: str) -> str:
    return f"trim({x}, {STRIP_LIT})"


def numeric_sql(s: str) -> str:
    dbl = f"TRY_CAST({s} AS DOUBLE)"
    return (f"(regexp_full_match({s}, {q(NUMBER_RE2)}) AND (regexp_full_match({s}, {q(INF_RE2)}) "
            f"OR coalesce(NOT isnan({dbl}) AND abs({dbl}) < 'inf'::DOUBLE, false)))")


def coordinate_sql(s: str, limit: int) -> str:
    return (f"(regexp_full_match({s}, {q(K.DECIMAL_VALUE)}) AND coalesce("
            f"abs(TRY_CAST({s} AS DECIMAL(38,30))) <= {limit}, "
            f"abs(TRY_CAST({s} AS DOUBLE)) <= {limit}, false))")


def _header_counts(header: list[str]) -> tuple[int, int]:
    norm = [normalize_name(h) for h in header]
    suspicious = sum(1 for n in norm if not n or n.startswith("unnamed"))
    seen: dict[str, int] = {}
    for n in norm:
        if n:
            seen[n] = seen.get(n, 0) + 1
    return suspicious, sum(1 for c in seen.values() if c > 1)


def audit_sql(source_sql: str, columns: list[str], *, header: list[str] | None = None,
              order: str = "_row_id", output: str = "findings",
              codes: tuple[str, ...] | None = None, accepted: str = "false") -> str:
    """SQL for the findings (or the audit record) of every dataset_id of a source.

    ``accepted`` is a SQL predicate over ``code`` / ``"column"`` marking
    findings covered by a reviewer declaration (they do not count in the score).
    """
    header = header or columns
    n = len(columns)
    fold = ", ".join(
        f"CASE WHEN {ident(c)} IN ({NA_LIST}) THEN NULL ELSE {ident(c)} END AS f{i}"
        for i, c in enumerate(columns))
    live = "(" + " OR ".join(f"coalesce({strip_sql(ident(c))} <> '', false)" for c in columns) + ")"
    strips = ", ".join(f"{strip_sql(f'f{i}')} AS s{i}" for i in range(n))
    metrics = []
    for i, c in enumerate(columns):
        s = f"s{i}"
        ne = f"coalesce({s} <> '', false)"
        metrics.append(f"count(*) FILTER (WHERE NOT {ne}) AS m{i}")
        limit = K.COORDINATE_LIMITS.get(normalize_name(c))
        pii = f"{ne} AND regexp_matches({s}, {q(PII_RE2)})"
        if limit is not None:
            valid = coordinate_sql(s, limit)
            metrics.append(f"count(*) FILTER (WHERE {ne} AND NOT {valid}) AS c{i}")
            pii += f" AND NOT {valid}"
        metrics.append(f"count(*) FILTER (WHERE {pii}) AS p{i}")
        metrics.append(f"count(*) FILTER (WHERE {ne} AND regexp_matches({s}, {q(INJECTION_RE2)})) AS j{i}")
    samples = []
    for i in range(n):
        samples.append(f"""t{i} AS (
  SELECT dataset_id, count(*) AS sample, bool_or(num) AS has_num, bool_or(NOT num) AS has_txt
  FROM (SELECT dataset_id, {numeric_sql(f's{i}')} AS num,
               row_number() OVER (PARTITION BY dataset_id ORDER BY {order}) AS rn
        FROM s WHERE s{i} <> '') z
  WHERE rn <= {K.TYPE_SAMPLE_LIMIT} GROUP BY dataset_id)""")
    fcols = ", ".join(f"f{i}" for i in range(n))
    parts = []
    suspicious, ambiguous = _header_counts(header)

    def row(key: int, code: str, sev: str, column: str | None, count: str, frm: str = "a") -> str:
        col = "NULL" if column is None else q(column)
        return (f"SELECT {frm}.dataset_id, {key} AS k, {q(code)} AS code, {q(sev)} AS severity, "
                f"CAST({col} AS VARCHAR) AS \"column\", CAST({count} AS BIGINT) AS \"count\" FROM a")
    if suspicious:
        parts.append(row(0, "SUSPICIOUS_COLUMN_NAME", "WARNING", None, str(suspicious)))
    if ambiguous:
        parts.append(row(1, "AMBIGUOUS_COLUMN_NAMES", "CRITICAL", None, str(ambiguous)))
    for i, c in enumerate(columns):
        parts.append(row(100 + i, "MISSING_VALUES", "WARNING", c, f"a.m{i}"))
    parts.append(row(10000, "DUPLICATE_ROWS", "WARNING", None, "a.dups"))
    for i, c in enumerate(columns):
        norm = normalize_name(c)
        base = 20000 + 10 * i
        if norm in K.PII_COLUMN_NAMES:
            parts.append(row(base, "PII_COLUMN_NAME", "CRITICAL", c, "1"))
        if norm in K.COORDINATE_LIMITS:
            parts.append(row(base + 1, "INVALID_COORDINATE", "WARNING", c, f"a.c{i}"))
        parts.append(row(base + 2, "PII_VALUE_PATTERN", "CRITICAL", c, f"a.p{i}"))
        parts.append(row(base + 3, "PROMPT_INJECTION_PATTERN", "CRITICAL", c, f"a.j{i}"))
        parts.append(row(base + 4, "MIXED_NUMERIC_TEXT", "WARNING", c,
                         f"CASE WHEN a.h{i} AND a.x{i} THEN a.sample{i} ELSE 0 END"))
    sample_cols = ", ".join(
        f"coalesce(t{i}.sample, 0) AS sample{i}, coalesce(t{i}.has_num, false) AS h{i}, "
        f"coalesce(t{i}.has_txt, false) AS x{i}" for i in range(n))
    sample_joins = " ".join(f"LEFT JOIN t{i} ON t{i}.dataset_id = g.dataset_id" for i in range(n))
    code_filter = ""
    if codes:
        code_filter = " AND code IN (" + ", ".join(q(c) for c in codes) + ")"
    sql = f"""
WITH src AS ({source_sql}),
v AS (SELECT dataset_id, {order}, {fold}, {live} AS live FROM src),
s AS (SELECT *, {strips} FROM v),
g AS (SELECT dataset_id, count(*) AS row_count, count(*) FILTER (WHERE live) AS live_rows, {", ".join(metrics)} FROM s GROUP BY dataset_id),
d AS (SELECT dataset_id, CAST(sum(cnt - 1) AS BIGINT) AS dups
      FROM (SELECT dataset_id, count(*) AS cnt FROM v GROUP BY dataset_id, {fcols}) z GROUP BY dataset_id),
{", ".join(samples)},
a AS (SELECT g.*, d.dups, {sample_cols} FROM g JOIN d ON d.dataset_id = g.dataset_id {sample_joins}),
cand AS ({" UNION ALL ".join(parts)}),
fnd AS (SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY k) - 1 AS INTEGER) AS ord,
               code, severity, "column", "count", coalesce({accepted}, false) AS accepted
        FROM cand WHERE "count" > 0 AND dataset_id IN (SELECT dataset_id FROM g WHERE live_rows > 0)
        UNION ALL SELECT dataset_id, 0, 'HEADER_ONLY_FILE', 'CRITICAL', NULL, 1, false FROM g WHERE live_rows = 0)
"""
    if output == "findings":
        return sql + f"SELECT * FROM fnd WHERE true{code_filter}"
    pen = "CASE severity WHEN 'INFO' THEN 2 WHEN 'WARNING' THEN 10 WHEN 'CRITICAL' THEN 25 ELSE 0 END"
    return sql + f"""
SELECT a.dataset_id,
  CASE WHEN a.live_rows = 0 THEN 'BLOCKED' WHEN coalesce(p.n, 0) = 0 THEN 'READY' ELSE 'QUARANTINED' END AS status,
  CAST(CASE WHEN a.live_rows = 0 THEN 0 ELSE a.row_count END AS BIGINT) AS row_count,
  CAST(CASE WHEN a.live_rows = 0 THEN 0 ELSE {n} END AS INTEGER) AS column_count,
  CAST(CASE WHEN a.live_rows = 0 THEN 0 ELSE a.dups END AS BIGINT) AS duplicate_row_count,
  CAST(CASE WHEN a.live_rows = 0 THEN 0 ELSE greatest(0, 100 - coalesce(p.pen, 0)) END AS INTEGER) AS quality_score,
  CAST(coalesce(p.n, 0) AS INTEGER) AS finding_count
FROM a LEFT JOIN (SELECT dataset_id, count(*) AS n, sum({pen}) AS pen FROM fnd WHERE NOT accepted
                  GROUP BY dataset_id) p
  ON p.dataset_id = a.dataset_id
"""


def fingerprint_sql(source_sql: str, columns: list[str]) -> str:
    """S9 in SQL: additive multiset hash of per-row SHA-256 over verbatim cells."""
    parts = ", ".join(
        f"CAST(length(coalesce({ident(c)}, '')) AS VARCHAR) || ':' || coalesce({ident(c)}, '')"
        for c in columns)
    limbs = ", ".join(f"sum(('0x' || substr(h, {1 + 4 * i}, 4))::UBIGINT::HUGEINT) AS l{i}"
                      for i in range(16))
    sig = ",".join(f"{len(c)}:{c}" for c in columns)
    hexes = ", ".join(f"l{i}::VARCHAR" for i in range(16))
    return f"""
WITH src AS ({source_sql}),
r AS (SELECT dataset_id, sha256(concat_ws(',', {parts})) AS h FROM src),
l AS (SELECT dataset_id, count(*) AS n, {limbs} FROM r GROUP BY dataset_id)
SELECT dataset_id, CAST(n AS BIGINT) AS row_count,
       sha256(concat_ws('|', {q(sig)}, CAST(n AS VARCHAR), {hexes})) AS fingerprint
FROM l
"""


def markers_sql(col: str) -> str:
    markers = ", ".join(q(m) for m in K.MISSING_MARKERS)
    return (f"CASE WHEN lower({strip_sql(ident(col))}) IN ({markers}) THEN NULL "
            f"ELSE {ident(col)} END")


def dedupe_sql(source_sql: str, columns: list[str], keys: str = "dataset_id") -> str:
    cols = ", ".join(ident(c) for c in columns)
    return (f"SELECT {keys}, min(_row_id) AS _row_id, {cols} FROM ({source_sql}) z "
            f"GROUP BY {keys}, {cols}")


def apply_sql(source_sql: str, columns: list[str], actions: list[tuple[str, list[str]]],
              keys: str = "dataset_id") -> str:
    """A plan's output as SQL: each action wraps the previous query; source nulls are empty cells."""
    sql = (f"SELECT {keys}, _row_id, " + ", ".join(f"coalesce({ident(c)}, '') AS {ident(c)}" for c in columns)
           + f" FROM ({source_sql}) y")
    for action, cols in actions:
        if action == "REMOVE_EXACT_DUPLICATES":
            sql = dedupe_sql(sql, columns, keys)
            continue
        sel = []
        for c in columns:
            if c in cols and action == "TRIM_OUTER_WHITESPACE":
                sel.append(f"{strip_sql(ident(c))} AS {ident(c)}")
            elif c in cols and action == "STANDARDIZE_MISSING_MARKERS":
                sel.append(f"{markers_sql(c)} AS {ident(c)}")
            else:
                sel.append(ident(c))
        sql = f"SELECT {keys}, _row_id, {', '.join(sel)} FROM ({sql}) z"
    return sql


def label_score_sql(v: str) -> str:
    """G2 label score in SQL (same rule order)."""
    raw = strip_sql(v)
    words = f"regexp_extract_all({raw}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')"
    n = f"length({raw})"
    letters = f"length(regexp_replace({raw}, '[^\\p{{L}}]', '', 'g'))"
    vocab = "[" + ", ".join(q(w) for w in K.COLUMN_LABELS) + "]"
    return f"""CASE
  WHEN {v} IS NULL THEN 0.0
  WHEN {n} = 0 OR {n} > 90 OR regexp_matches({raw}, '(?i)^(?:https?://|www\\.)') OR strpos({raw}, '@') > 0 THEN 0.0
  WHEN len({words}) = 0 THEN 0.0
  WHEN len({words}) > 8 THEN 0.1
  WHEN {letters} / greatest(1, {n}) < 0.45 THEN 0.1
  WHEN {n} > 55 THEN 0.2
  WHEN len({words}) > 5 THEN 0.3
  WHEN regexp_matches({raw}, '\\p{{Nd}}') THEN 0.3
  WHEN list_has_any(list_transform({words}, lambda w: lower(w)), {vocab}) THEN 1.0
  WHEN {n} <= 3 AND NOT regexp_full_match({raw}, '\\p{{L}}+') THEN 0.15
  WHEN len({words}) = 1 AND {n} <= 2 THEN 0.25
  WHEN len({words}) >= 3 THEN 0.55
  ELSE 0.67 END"""


def header_candidates_sql(cells_sql: str) -> str:
    """G3-G5 in SQL: candidate header rows, score and extent."""
    return f"""
WITH c AS (SELECT * FROM ({cells_sql}) z WHERE "row" BETWEEN 1 AND {K.MAX_SCAN_ROWS}
           AND col BETWEEN 0 AND {K.MAX_SCAN_COLUMNS - 1}),
p AS (SELECT workbook, sheet, "row", col, value, {label_score_sql('value')} AS label
      FROM c WHERE value IS NOT NULL AND {strip_sql('value')} <> ''),
ext AS (SELECT workbook, sheet, max("row") AS max_row FROM c GROUP BY workbook, sheet),
wid AS (SELECT workbook, sheet, max(w) AS width FROM (SELECT workbook, sheet, "row", count(*) AS w
        FROM p GROUP BY ALL) z GROUP BY workbook, sheet),
hdr AS (SELECT p.workbook, p.sheet, p."row" AS h, count(*) AS npos, avg(label) AS quality,
               count(*) FILTER (WHERE label >= 0.95) AS known,
               count(DISTINCT lower({strip_sql('value')})) AS distinct_labels
        FROM p GROUP BY ALL),
hd AS (SELECT hdr.*, ext.max_row, wid.width FROM hdr JOIN ext USING (workbook, sheet) JOIN wid USING (workbook, sheet)
       WHERE npos >= 2 AND quality >= 0.35 AND width >= 2 AND h < max_row AND max_row >= 2),
grid AS (SELECT workbook, sheet, h, npos, max_row, unnest(range(h + 1, max_row + 1)) AS r FROM hd),
hits AS (SELECT a.workbook, a.sheet, a."row" AS h, b."row" AS r, count(*) AS hit
         FROM p a JOIN p b ON a.workbook = b.workbook AND a.sheet = b.sheet AND a.col = b.col AND b."row" > a."row"
         GROUP BY ALL),
cov AS (SELECT grid.*, coalesce(hits.hit, 0) / grid.npos AS cv FROM grid
        LEFT JOIN hits ON hits.workbook = grid.workbook AND hits.sheet = grid.sheet AND hits.h = grid.h AND hits.r = grid.r),
per AS (SELECT workbook, sheet, h, min(r) FILTER (WHERE cv < 0.5) AS first_gap,
               max(cv) FILTER (WHERE r <= h + 6) AS max_cov, avg(cv) FILTER (WHERE r <= h + 6) AS align,
               count(*) FILTER (WHERE r <= h + 6) AS n_follow
        FROM cov GROUP BY ALL),
j AS (SELECT hd.*, per.first_gap, per.max_cov, per.align, per.n_follow,
             coalesce(per.first_gap, hd.max_row + 1) - hd.h - 1 AS est
      FROM hd JOIN per USING (workbook, sheet, h) WHERE per.max_cov >= 0.45),
s AS (SELECT *, least(est, n_follow) AS ongoing,
             least(1.0, least(est, n_follow) / least(3, n_follow)) AS consistency FROM j)
SELECT workbook, sheet, CAST(h AS INTEGER) AS header_row,
  CAST(greatest(0, least(100, round_even(100 * (0.35 * quality + 0.17 * align
       + 0.15 * least(1.0, npos / width) + 0.12 * consistency + 0.10 * (distinct_labels / npos)
       + 0.11 * (known / npos))
       - CASE WHEN consistency < 0.33 THEN 13 ELSE 0 END - CASE WHEN ongoing = 0 THEN 15 ELSE 0 END, 0))) AS INTEGER) AS score,
  CAST(ongoing AS INTEGER) AS supporting_rows, CAST(npos AS INTEGER) AS column_count,
  CAST(est AS INTEGER) AS estimated_data_rows, CAST(est * npos AS INTEGER) AS estimated_table_area
FROM s
"""
