"""Fixed values.

Everything in this module must stay equal to the behaviour being reproduced:
token lists, name lists, patterns, limits and penalties. They are written out
plainly, in their natural order, and are not derived from anything.
"""

from __future__ import annotations

# --- fixed values: audit view NA tokens (exact, case- and space-sensitive) ---
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- fixed values: repair missing markers (compared after strip + lower) ---
MISSING_MARKERS = ("", "na", "n/a", "nan", "none", "null")

# --- fixed values: sensitive column names (normalized form) ---
PII_COLUMN_NAMES = (
    "address",
    "date_of_birth",
    "dob",
    "driver_license",
    "email",
    "email_address",
    "first_name",
    "full_name",
    "last_name",
    "name",
    "passport",
    "phone",
    "phone_number",
    "social_security_number",
    "ssn",
)

# --- fixed values: columns that may be declared public contact (normalized -> kind) ---
PUBLIC_CONTACT_COLUMNS = {
    "public_phone": "phone",
    "public_phone_number": "phone",
    "business_phone": "phone",
    "business_phone_number": "phone",
    "public_email": "email",
    "public_email_address": "email",
    "business_email": "email",
    "business_email_address": "email",
}

# --- fixed values: coordinate columns (normalized name -> absolute limit) ---
COORDINATE_LIMITS = {
    "latitude": 90,
    "lat": 90,
    "center_latitude": 90,
    "longitude": 180,
    "lon": 180,
    "lng": 180,
    "center_longitude": 180,
}

# --- fixed values: value patterns (case-insensitive search) ---
# Sensitive value: an email, an NNN-NN-NNNN number, or a North-American phone.
PII_EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PII_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PII_PHONE = r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)"
# Whole-value shapes used to check declared public contact columns.
EMAIL_VALUE = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE_VALUE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?:\s*(?:ext\.?|x)\s*\d{1,6})?"
SSN_VALUE = r"\b\d{3}-\d{2}-\d{4}\b"
# Whole-cell decimal accepted as a coordinate.
DECIMAL_VALUE = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
# Instruction-manipulation text.
PROMPT_INJECTION = (
    r"(?:\b(?:ignore|disregard|override)\s+(?:all\s+)?"
    r"(?:previous|prior|system)\s+instructions?\b)"
    r"|(?:\breveal\s+(?:the\s+)?system\s+prompt\b)"
    r"|(?:\byou\s+are\s+(?:now\s+)?(?:chatgpt|an?\s+ai)\b)"
    r"|(?:\bdeveloper\s+message\b)"
    r"|(?:\bsystem\s+prompt\b)"
)

# Contact values hidden in a row preview (email or North-American phone).
SENSITIVE_PREVIEW = (
    r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
    r"|(?<!\d)(?:\+?1[.\s-]?)?\(?\d{3}\)?[.\s-]?\d{3}[.\s-]?\d{4}(?!\d)"
)
PREVIEW_ROWS = 25
PREVIEW_VALUES_PER_ROW = 12
PREVIEW_MAX_CHARS = 70
PREVIEW_KEEP_CHARS = 67

# --- fixed values: scoring ---
PENALTIES = {"INFO": 2, "WARNING": 10, "CRITICAL": 25}
SEVERITY_RANK = {"INFO": 1, "WARNING": 2, "CRITICAL": 3}
TYPE_SAMPLE_LIMIT = 2000

# --- fixed values: repair actions ---
REPAIR_ACTIONS = (
    "REMOVE_EXACT_DUPLICATES",
    "TRIM_OUTER_WHITESPACE",
    "STANDARDIZE_MISSING_MARKERS",
    "RENAME_COLUMNS",
    "FILL_MISSING_VALUES",
    "CONVERT_COLUMN_TYPE",
    "DROP_ROWS",
    "REDACT_PII",
)
EXECUTABLE_ACTIONS = (
    "TRIM_OUTER_WHITESPACE",
    "REMOVE_EXACT_DUPLICATES",
    "STANDARDIZE_MISSING_MARKERS",
)
CRITICAL_REVIEW_CODES = (
    "AMBIGUOUS_COLUMN_NAMES",
    "PII_COLUMN_NAME",
    "PII_VALUE_PATTERN",
    "PROMPT_INJECTION_PATTERN",
)
MAX_CANDIDATES = 5

# Whitespace removed by a text strip: every code point that Python's str.isspace()
# accepts (derived by rule, 29 characters).
STRIP_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# --- fixed values: preflight ceilings of the single-file tool ---
MAX_FILE_SIZE_BYTES = 10 * 1024 * 1024
MAX_ROWS = 100_000
MAX_COLUMNS = 200
MAX_CELL_LENGTH = 10_000
SNIFF_BYTES = 64 * 1024
READER_FIELD_LIMIT = 131072  # longest field that a CSV reader takes
# Leading bytes of binary, archive or encrypted content.
BINARY_SIGNATURES = (
    b"PK\x03\x04",          # ZIP or Office archive
    b"\x1f\x8b",            # GZIP archive
    b"%PDF-",               # PDF document
    b"\xd0\xcf\x11\xe0",    # Office binary document
    b"Salted__",            # OpenSSL encrypted content
    b"\x89PNG",             # PNG image
    b"\xff\xd8\xff",         # JPEG image
)

# --- fixed values: sheet layout detection ---
MAX_SCAN_ROWS = 60
MAX_SCAN_COLUMNS = 200
MAX_CHOICES = 5
UNEVALUATED_FORMULA = "[UNEVALUATED_EXCEL_FORMULA]"
# Generic column-label vocabulary.
COLUMN_LABELS = (
    "id", "item", "name", "description", "category", "type", "status",
    "date", "time", "email", "phone", "contact", "manager", "address",
    "street", "city", "state", "zip", "country", "region", "amount",
    "price", "cost", "total", "quantity", "qty", "count", "number",
    "code", "product", "customer", "record", "source", "url", "link",
    "website", "distance", "miles", "latitude", "longitude", "notes",
    "location", "first", "last", "company", "department", "score",
    "rating", "reference", "motel", "hotel", "availability", "room",
    "reservation", "owner", "team", "order", "identifier", "units",
    "model", "value", "year", "month", "day", "unit", "revenue",
)
