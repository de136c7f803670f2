"""SQL twins of the gate and of audits of files, for the DuckDB oracle.

A record is read here as a string with one letter per field (blank or not, long
or not, unreadable), cut at line ends; the Spark side folds over the fields.
"""

from __future__ import annotations

from ..functions import constants as K
from . import oracle as O

_FIELD = (r'"(?:[^"]|"")*"(?:,|\r\n|\n|\r)|(?:[^",\r\n][^,\r\n]*)?(?:,|\r\n|\n|\r)|"(?s:.*)')
_QUOTED = r'"(?:[^"]|"")*"(?:,|\r\n|\n|\r)'
_END = r"(?:,|\r\n|\n|\r)$"


def _steady(d: str) -> str:
    n = f"list_transform(lines, lambda x: len(string_split(x, {O.q(d)})) - 1)"
    return f"(len(lines) > 0 AND list_min({n}) > 0 AND list_min({n}) = list_max({n}))"


def gate_ctes(docs_sql: str, *, max_bytes: int | None = None, max_rows: int | None = None,
              max_columns: int | None = None, max_cell: int | None = None) -> str:
    """CTEs up to ``gate`` over ``docs_sql(dataset_id, text)``, each text the bytes of a ``.csv`` file."""
    def above(x: str, limit: int | None) -> str:
        return "false" if limit is None else f"coalesce({x} > {limit}, false)"
    signatures = " OR ".join(f"encode(text)[1:{len(s)}] = unhex('{s.hex()}')" for s in K.BINARY_SIGNATURES)
    cell = K.READER_FIELD_LIMIT if max_cell is None else max_cell
    strip = O.strip_sql
    return f"""
d AS (SELECT dataset_id, text, CAST(strlen(text) AS BIGINT) AS size,
             CASE WHEN strlen(text) <= {K.SNIFF_BYTES} THEN text ELSE try(decode(encode(text)[1:{K.SNIFF_BYTES}])) END AS sample
      FROM ({docs_sql}) z0),
e AS (SELECT *, list_filter(string_split_regex(sample, '\\r?\\n'), lambda x: trim(x, ' ') <> '')[1:5] AS lines FROM d),
b AS (SELECT *, CASE WHEN {_steady(',')} THEN ',' WHEN {_steady(';')} THEN ';' WHEN {_steady(chr(9))} THEN chr(9)
                     WHEN {_steady('|')} THEN '|' WHEN contains(sample, ',') THEN ',' END AS delim FROM e),
f AS (SELECT *, CASE WHEN size = 0 THEN 'EMPTY_FILE' WHEN {above('size', max_bytes)} THEN 'FILE_TOO_LARGE'
                     WHEN {signatures} OR contains(sample, chr(0)) THEN 'BINARY_OR_ENCRYPTED_CONTENT'
                     WHEN sample IS NULL THEN 'UNSUPPORTED_ENCODING' WHEN {strip('sample')} = '' THEN 'EMPTY_FILE'
                     WHEN coalesce(delim, ',') <> ',' THEN 'NON_COMMA_DELIMITER' END AS b_flag FROM b),
v AS (SELECT dataset_id, list_transform(regexp_extract_all(text || chr(10), {O.q(_FIELD)}), lambda t: {{
        'v': CASE WHEN starts_with(t, '"') THEN replace(regexp_extract(t, '^"((?s:.*))"{_END}', 1), '""', '"')
                  ELSE regexp_replace(t, {O.q(_END)}, '') END,
        'n': regexp_matches(t, '[\\r\\n]$') , 'q': starts_with(t, '"'),
        'e': starts_with(t, '"') AND NOT regexp_full_match(t, {O.q(_QUOTED)})}}) AS vals
      FROM f WHERE b_flag IS NULL),
sh AS (SELECT *, string_split(array_to_string(list_transform(vals, lambda x:
          CASE WHEN x.e OR length(x.v) > {K.READER_FIELD_LIMIT} THEN 'E'
               WHEN {strip('x.v')} = '' THEN CASE WHEN length(x.v) > {cell} THEN 'B' ELSE 'b' END
               ELSE CASE WHEN length(x.v) > {cell} THEN 'X' ELSE 'x' END END
          || CASE WHEN x.n THEN chr(10) ELSE '' END), ''), chr(10)) AS recs FROM v),
br AS (SELECT *, list_position(list_transform(recs, lambda r: contains(r, 'E')), true) AS bad FROM sh),
gd AS (SELECT *, CASE WHEN bad IS NULL THEN recs[1:len(recs) - 1] ELSE recs[1:bad - 1] END AS good FROM br),
hd AS (SELECT *, length(good[1]) AS width, list_filter(good[2:], lambda r: regexp_matches(r, '[xX]')) AS rest FROM gd),
fx AS (SELECT *, list_transform(vals[1:width], lambda x: x.v) AS names, len(rest) AS n,
              list_position(list_transform(rest, lambda r: length(r) <> width), true) AS uneven,
              list_position(list_transform(rest, lambda r: regexp_matches(r, '[BX]')), true) AS far FROM hd),
bh AS (SELECT *, CASE WHEN len(good) = 0 THEN 'BROKEN'
                      WHEN len(list_filter(names, lambda c: {strip('c')} <> '')) = 0 THEN 'MISSING_HEADER'
                      WHEN {above('width', max_columns)} THEN 'TOO_MANY_COLUMNS'
                      WHEN {above('list_max(list_transform(names, lambda c: length(c)))', max_cell)} THEN 'CELL_TOO_LARGE'
                      END AS bad_header FROM fx),
st AS (SELECT *, CASE WHEN bad_header IS NULL THEN
                   least({f"CASE WHEN n > {max_rows} THEN {max_rows} + 1 END" if max_rows else "NULL::BIGINT"},
                         uneven, {"NULL::BIGINT" if max_cell is None else "far"}) END AS stop FROM bh),
sf AS (SELECT dataset_id, vals, names, CASE
         WHEN bad_header = 'BROKEN' THEN 'MALFORMED_CSV' WHEN bad_header IS NOT NULL THEN bad_header
         WHEN {f"n > {max_rows} AND stop = {max_rows} + 1" if max_rows else "false"} THEN 'TOO_MANY_ROWS'
         WHEN uneven = stop THEN 'MALFORMED_CSV' WHEN stop IS NOT NULL THEN 'CELL_TOO_LARGE'
         WHEN bad IS NOT NULL THEN 'MALFORMED_CSV' WHEN n = 0 THEN 'HEADER_ONLY_FILE' END AS s_flag,
         bad_header, bad IS NOT NULL AND stop IS NULL AND coalesce(bad_header, '') IN ('', 'BROKEN') AS unread,
         width, coalesce(stop, n) AS counted FROM st),
gate AS (SELECT f.dataset_id, CASE WHEN coalesce(b_flag, s_flag) IS NULL THEN 'ACCEPTED' ELSE 'BLOCKED' END AS status,
           coalesce(b_flag, s_flag) AS risk_flag,
           CASE WHEN b_flag IN ('FILE_TOO_LARGE', 'BINARY_OR_ENCRYPTED_CONTENT', 'UNSUPPORTED_ENCODING')
                     OR (b_flag = 'EMPTY_FILE' AND size = 0) THEN NULL ELSE 'utf-8' END AS encoding,
           CASE WHEN b_flag IN ('FILE_TOO_LARGE', 'BINARY_OR_ENCRYPTED_CONTENT', 'UNSUPPORTED_ENCODING', 'EMPTY_FILE') THEN NULL
                WHEN b_flag = 'NON_COMMA_DELIMITER' THEN delim ELSE ',' END AS delimiter,
           CASE WHEN NOT unread AND coalesce(bad_header, '') <> 'MISSING_HEADER' THEN CAST(width AS INTEGER) END AS column_count,
           CASE WHEN NOT unread AND bad_header IS NULL THEN CAST(counted AS BIGINT) END AS data_row_count,
           size AS file_size_bytes, CASE WHEN NOT unread THEN names END AS header, sha256(text) AS fingerprint
         FROM f LEFT JOIN sf ON sf.dataset_id = f.dataset_id)"""


_NORM = f"trim(regexp_replace(lower({O.strip_sql('{0}')}), '[^a-z0-9]+', '_', 'g'), '_')"


def preflight_sql(docs_sql: str, **limits: int) -> str:
    return f"""WITH {gate_ctes(docs_sql, **limits)}
SELECT dataset_id, status, risk_flag, encoding, delimiter, column_count, data_row_count, file_size_bytes FROM gate"""


def header_findings_sql(docs_sql: str) -> str:
    names = ", ".join(O.q(n) for n in K.PII_COLUMN_NAMES)
    return f"""WITH {gate_ctes(docs_sql)},
h AS (SELECT dataset_id, unnest(header) AS name FROM gate WHERE header IS NOT NULL),
m AS (SELECT dataset_id, name, {_NORM.format('name')} AS norm FROM h)
SELECT dataset_id, 'SUSPICIOUS_COLUMN_NAME' AS code, 'WARNING' AS severity, CAST(NULL AS VARCHAR) AS "column",
       CAST(count(*) AS BIGINT) AS "count" FROM m WHERE norm = '' OR starts_with(norm, 'unnamed') GROUP BY dataset_id
UNION ALL SELECT dataset_id, 'AMBIGUOUS_COLUMN_NAMES', 'CRITICAL', NULL, CAST(count(*) AS BIGINT)
  FROM (SELECT dataset_id, norm FROM m WHERE norm <> '' GROUP BY ALL HAVING count(*) > 1) z GROUP BY dataset_id
UNION ALL SELECT dataset_id, 'PII_COLUMN_NAME', 'CRITICAL', name, CAST(1 AS BIGINT) FROM m WHERE norm IN ({names})"""


def file_audit_sql(docs_sql: str, output: str = "audits", **limits: int) -> str:
    """Audits (or findings) of every file: the blocked ones from the gate, the others cell by cell."""
    s = O.strip_sql
    na = ", ".join(O.q(t) for t in K.NA_TOKENS)
    places = {m: ", ".join(O.q(n) for n, x in K.COORDINATE_LIMITS.items() if x == m) for m in set(K.COORDINATE_LIMITS.values())}
    inside = "CASE " + " ".join(f"WHEN norm IN ({names}) THEN {O.coordinate_sql('x', m)}" for m, names in places.items()) + " ELSE false END"
    place = "norm IN (" + ", ".join(O.q(n) for n in K.COORDINATE_LIMITS) + ")"
    pii = ", ".join(O.q(n) for n in K.PII_COLUMN_NAMES)
    sql = f"""WITH {gate_ctes(docs_sql, **limits)},
p AS (SELECT dataset_id, unnest(vals, recursive := true), generate_subscripts(vals, 1) AS i FROM sf
      WHERE dataset_id IN (SELECT dataset_id FROM gate WHERE status = 'ACCEPTED')),
r0 AS (SELECT *, coalesce(sum(CASE WHEN n THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rec FROM p),
r AS (SELECT dataset_id, rec, row_number() OVER (PARTITION BY dataset_id, rec ORDER BY i) AS pos, v,
             count(*) OVER (PARTITION BY dataset_id, rec) AS wide, q FROM r0),
h AS (SELECT dataset_id, pos, v AS name, {_NORM.format('v')} AS norm FROM r WHERE rec = 0),
body AS (SELECT r.* FROM r WHERE rec > 0 AND NOT (wide = 1 AND NOT q AND regexp_full_match(v, '[ \\t]*'))),
hw AS (SELECT dataset_id, count(*) AS w FROM h GROUP BY dataset_id),
failing AS (SELECT DISTINCT body.dataset_id FROM body JOIN hw ON hw.dataset_id = body.dataset_id WHERE wide > w),
recs AS (SELECT DISTINCT dataset_id, rec FROM body WHERE dataset_id NOT IN (SELECT dataset_id FROM failing)),
cell AS (SELECT recs.dataset_id, recs.rec, h.pos, h.name, h.norm, coalesce(body.v, '') AS raw FROM recs
         JOIN h ON h.dataset_id = recs.dataset_id
         LEFT JOIN body ON body.dataset_id = recs.dataset_id AND body.rec = recs.rec AND body.pos = h.pos),
c AS (SELECT *, CASE WHEN raw IN ({na}) THEN NULL ELSE raw END AS fold FROM cell),
x0 AS (SELECT *, {s('fold')} AS x FROM c),
x1 AS (SELECT *, coalesce(x <> '', false) AS ne, {inside} AS inside FROM x0),
x2 AS (SELECT *, ne AND {O.numeric_sql('x')} AS num,
              CASE WHEN ne THEN row_number() OVER (PARTITION BY dataset_id, pos, ne ORDER BY rec) END AS rn FROM x1),
per AS (SELECT dataset_id, pos, name, norm, count(*) FILTER (WHERE NOT ne) AS missing, count(*) FILTER (WHERE ne) AS filled,
          count(*) FILTER (WHERE ne AND {place} AND NOT inside) AS off,
          count(*) FILTER (WHERE ne AND regexp_matches(x, {O.q(O.PII_RE2)}) AND NOT ({place} AND inside)) AS pii,
          count(*) FILTER (WHERE ne AND regexp_matches(x, {O.q(O.INJECTION_RE2)})) AS told,
          coalesce(bool_or(num) FILTER (WHERE rn <= {K.TYPE_SAMPLE_LIMIT}), false) AS nums,
          coalesce(bool_or(NOT num) FILTER (WHERE rn <= {K.TYPE_SAMPLE_LIMIT}), false) AS texts
        FROM x2 GROUP BY ALL),
frame AS (SELECT *, CASE WHEN name = '' THEN 'Unnamed: ' || (pos - 1) ELSE name END AS base FROM per),
framed AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, base ORDER BY pos) - 1 AS k FROM frame),
col AS (SELECT *, base || CASE WHEN k = 0 THEN '' ELSE '.' || k END AS col FROM framed),
dup AS (SELECT dataset_id, count(*) AS n, count(*) - count(DISTINCT key) AS dups FROM (
          SELECT dataset_id, rec, list(coalesce('v' || fold, '~') ORDER BY pos) AS key FROM c GROUP BY dataset_id, rec) z
        GROUP BY dataset_id),
cand AS (
  SELECT dataset_id, 0 AS g, 0 AS pos, 0 AS part, 'SUSPICIOUS_COLUMN_NAME' AS code, 'WARNING' AS severity, CAST(NULL AS VARCHAR) AS "column",
         count(*) FILTER (WHERE norm = '' OR starts_with(norm, 'unnamed')) AS "count" FROM per GROUP BY dataset_id
  UNION ALL SELECT dataset_id, 1, 0, 0, 'AMBIGUOUS_COLUMN_NAMES', 'CRITICAL', NULL, count(*) FROM
    (SELECT dataset_id, norm FROM per WHERE norm <> '' GROUP BY ALL HAVING count(*) > 1) z GROUP BY dataset_id
  UNION ALL SELECT dataset_id, 2, pos, 0, 'MISSING_VALUES', 'WARNING', col, missing FROM col
  UNION ALL SELECT dataset_id, 3, 0, 0, 'DUPLICATE_ROWS', 'WARNING', NULL, dups FROM dup
  UNION ALL SELECT dataset_id, 4, pos, 0, 'PII_COLUMN_NAME', 'CRITICAL', col, 1 FROM col WHERE norm IN ({pii})
  UNION ALL SELECT dataset_id, 4, pos, 1, 'INVALID_COORDINATE', 'WARNING', col, off FROM col
  UNION ALL SELECT dataset_id, 4, pos, 2, 'PII_VALUE_PATTERN', 'CRITICAL', col, pii FROM col
  UNION ALL SELECT dataset_id, 4, pos, 3, 'PROMPT_INJECTION_PATTERN', 'CRITICAL', col, told FROM col
  UNION ALL SELECT dataset_id, 4, pos, 4, 'MIXED_NUMERIC_TEXT', 'WARNING', col,
    CASE WHEN nums AND texts THEN least(filled, {K.TYPE_SAMPLE_LIMIT}) ELSE 0 END FROM col),
stopped AS (SELECT dataset_id, risk_flag, fingerprint FROM gate WHERE status = 'BLOCKED'
            UNION ALL SELECT dataset_id, 'CSV_READ_FAILURE', fingerprint FROM gate WHERE dataset_id IN (SELECT dataset_id FROM failing)),
fnd AS (SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY g, pos, part) - 1 AS INTEGER) AS ord, code, severity,
               "column", CAST("count" AS BIGINT) AS "count" FROM cand WHERE "count" > 0
        UNION ALL SELECT dataset_id, 0, risk_flag, 'CRITICAL', NULL, 1 FROM stopped)"""
    if output == "findings":
        return sql + "\nSELECT * FROM fnd"
    pen = "CASE severity WHEN 'INFO' THEN 2 WHEN 'WARNING' THEN 10 WHEN 'CRITICAL' THEN 25 ELSE 0 END"
    return sql + f"""
SELECT dup.dataset_id, CASE WHEN l.n IS NULL THEN 'READY' ELSE 'QUARANTINED' END AS status, g.fingerprint,
       CAST(dup.n AS BIGINT) AS row_count, g.column_count, CAST(dup.dups AS BIGINT) AS duplicate_row_count,
       CAST(greatest(0, 100 - coalesce(l.lost, 0)) AS INTEGER) AS quality_score, CAST(coalesce(l.n, 0) AS INTEGER) AS finding_count
FROM dup JOIN gate g ON g.dataset_id = dup.dataset_id
LEFT JOIN (SELECT dataset_id, sum({pen}) AS lost, count(*) AS n FROM fnd GROUP BY dataset_id) l ON l.dataset_id = dup.dataset_id
UNION ALL SELECT dataset_id, 'BLOCKED', fingerprint, 0, 0, 0, 0, 1 FROM stopped"""
