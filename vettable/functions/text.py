"""Column expressions shared by every operator.

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _lit_set(values) -> list[Column]:
    return [F.lit(v) for v in values]


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (same set as Python's str.strip)."""
    return F.btrim(c, F.lit(K.STRIP_CHARS))


def na_fold(c: Column) -> Column:
    """Audit view of one cell: exact default NA tokens become null."""
    return F.when(c.isin(*K.NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def nonempty(c: Column) -> Column:
    """Cell of the audit view holds text that is not blank after strip.

    ``c`` must already be NA-folded. Null-safe: returns false for null.
    """
    return F.coalesce(strip(c) != F.lit(""), F.lit(False))


def normalize_name(name: str) -> str:
    """Column-name normalization for header comparisons (metadata, driver side)."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def normalize_name_col(c: Column) -> Column:
    """Same normalization as a column expression, for header tables."""
    lowered = F.lower(strip(c))
    return F.regexp_replace(F.regexp_replace(lowered, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def unicode_pattern(pattern: str, ignore_case: bool = True) -> str:
    r"""Java form of ``pattern`` where ``\d``, ``\s``, ``\w`` and ``\b`` cover all of Unicode.

    ``\s`` also takes the separators U+001C to U+001F, which Java's class leaves out.
    """
    return ("(?iU)" if ignore_case else "(?U)") + pattern.replace(r"\s", r"[\s\x1C-\x1F]")


def pii_match(v: Column) -> Column:
    """Email, NNN-NN-NNNN or North-American phone contained in ``v``.

    Digits, blanks and word boundaries are those of Unicode: a phone number
    written with no-break spaces or full-width digits counts.

    The alternation is split into three searches; each has a cheap literal
    pre-filter that every match must satisfy, so long texts without '@' or
    '-' skip the costlier regex entirely.
    """
    email = (F.instr(v, "@") > 0) & v.rlike(unicode_pattern(K.PII_EMAIL))
    ssn = (F.instr(v, "-") > 0) & v.rlike(unicode_pattern(K.PII_SSN, False))
    # Ten digits at least: no shorter text can hold a phone number.
    phone = (F.length(v) >= 10) & v.rlike(unicode_pattern(K.PII_PHONE, False))
    return email | ssn | phone


def injection_match(v: Column) -> Column:
    # The shortest phrase the pattern accepts ("you are a ai") has 12 characters.
    return (F.length(v) >= 12) & v.rlike(unicode_pattern(K.PROMPT_INJECTION))


_NUMBER_SHAPE = r"(?i)^[+-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?|inf|infinity)$"
_INF_SHAPE = r"(?i)^[+-]?(?:inf|infinity)$"


def is_numeric(v: Column) -> Column:
    """Text that a numeric parse accepts: decimal or exponent notation, or inf.

    A finite literal that overflows a double (``1e400``) does not count.
    ``v`` is a stripped, non-empty value.
    """
    as_dbl = v.try_cast("double")
    finite = ~F.isnan(as_dbl) & (F.abs(as_dbl) < F.lit(float("inf")))
    # Every accepted text starts with a sign, a dot, a digit or the i of inf.
    lead = F.substring(v, 1, 1).isin(*list("+-.0123456789iI"))
    return lead & v.rlike(_NUMBER_SHAPE) & (v.rlike(_INF_SHAPE) | F.coalesce(finite, F.lit(False)))


def valid_coordinate(v: Column, limit: int) -> Column:
    """Whole-cell finite decimal within [-limit, limit]."""
    shape = v.rlike("^" + K.DECIMAL_VALUE + "$")
    # Exact decimal comparison; values with more than 8 integer digits do not
    # fit DECIMAL(38,30) and fall back to the double (always out of range).
    as_dec = v.try_cast("decimal(38,30)")
    as_dbl = v.try_cast("double")
    magnitude_ok = F.coalesce(F.abs(as_dec) <= F.lit(limit), F.abs(as_dbl) <= F.lit(float(limit)))
    return shape & F.coalesce(magnitude_ok, F.lit(False))


def contact_incompatible(v: Column, kind: str) -> Column:
    """A declared public phone/email cell that also looks like other PII."""
    whole = K.PHONE_VALUE if kind == "phone" else K.EMAIL_VALUE
    ssn = v.rlike(unicode_pattern(K.SSN_VALUE, False))
    return ssn | (pii_match(v) & ~v.rlike(unicode_pattern(r"^(?:" + whole + r")\z")))


def severity_rank(sev: Column) -> Column:
    expr = None
    for name, rank in K.SEVERITY_RANK.items():
        expr = (F.when(sev == name, F.lit(rank)) if expr is None
                else expr.when(sev == name, F.lit(rank)))
    return expr.otherwise(F.lit(0))


def penalty(sev: Column) -> Column:
    expr = None
    for name, pts in K.PENALTIES.items():
        expr = (F.when(sev == name, F.lit(pts)) if expr is None
                else expr.when(sev == name, F.lit(pts)))
    return expr.otherwise(F.lit(0))


def row_digest(cols: list[Column]) -> Column:
    """256-bit digest of an ordered tuple of nullable strings.

    Each cell is length-prefixed and null has its own token, so the encoding is
    injective; equal digests mean equal rows (SHA-256 collision aside).
    Returned as 32 raw bytes, the smallest shuffle key for duplicate work.
    """
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~"))
             for c in cols]
    return F.unhex(F.sha2(F.concat_ws(",", *parts), 256))
