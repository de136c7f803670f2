"""One registered query per operator: the operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, decontaminate, fingerprints, jaccard_join, language, license_scan, mixing,
               paragraph_dedup, quality, spelling, token_counts, token_ids, warc)
from .sampling import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@register
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# Windows as lists of words, joined by equality: no automaton.
ORACLE["op2_benchmark_decontamination"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS MATERIALIZED (
  SELECT DISTINCT item, w[s:s + least(len(w), 10) - 1] AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0) z),
lens AS (SELECT DISTINCT len(k) AS n FROM win),
pos AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n) z),
m AS MATERIALIZED (SELECT p.doc_id, p.s, p.n, v.item FROM pos p JOIN win v ON p.k = v.k),
hit AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT doc_id, s, n FROM m) y) z GROUP BY doc_id),
found AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


@register
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer_file(), "<|endoftext|>")


@register
def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return paragraph_dedup.repeated_paragraphs(docs)


@register
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_ids.token_id_output(docs, tokenizer_file(), end_id=2)


@register
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.components_by_jaccard(docs)


@register
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.schedule(docs, keep=["doc_id", "source"]).select(
        "doc_id", "source", "block", "release", "deadline", "slot", "balanced")


@register
def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.edit_likeness(docs)


@register
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("text")


def _license_sql() -> str:
    """The same blocks as lists of words: no order of words, no filters, every block is counted."""
    quote = lambda words: "string_split('" + " ".join(words) + "', ' ')"
    values = ", ".join(f"({k}, '{t.label}', {str(t.exact).lower()}, {quote(t.words)}, '{' '.join(t.name)}', {t.threshold!r})"
                       for k, t in enumerate(license_scan.default_templates()))
    return rf"""
WITH t(k, label, exact, words, name, threshold) AS (VALUES {values}),
tt AS (SELECT *, len(words) AS n, len(list_distinct(words)) AS m,
              CAST(ceil(threshold * len(list_distinct(words)) - 1e-9) AS BIGINT) AS need FROM t),
d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT doc_id, k, w[s + 1:s + 2 * n] AS blk
  FROM (SELECT doc_id, w, k, n, unnest(range(0, len(w), n)) AS s FROM d, tt WHERE len(w) > 0) z),
m AS (
  SELECT doc_id, label, exact, k, c / m AS held
  FROM (SELECT b.doc_id, b.blk, tt.*, len(list_intersect(list_distinct(b.blk), list_distinct(tt.words))) AS c
        FROM b JOIN tt ON tt.k = b.k) z
  WHERE c >= need AND contains(' ' || array_to_string(blk, ' ') || ' ',
    CASE WHEN exact THEN ' ' || array_to_string(words, ' ') || ' ' WHEN name = '' THEN ' ' ELSE ' ' || name || ' ' END)),
places AS (
  SELECT doc_id, i, label
  FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d) z JOIN tt ON exact AND w[i + 1:i + n] = words),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(held) AS score
          FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN every ON every.doc_id = d.doc_id
"""


ORACLE["op9_license_scan"] = _license_sql()


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(docs)
    return (language.predict_language(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


@register
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
    return collocations.top_phrases(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# Phrases as lists of words, counted by grouping.
ORACLE["op11_phrase_collocations"] = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) z),
f AS MATERIALIZED (
  SELECT lang, k, w[i:i + k - 1] AS ph, count(*) AS c
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM p JOIN (VALUES (1), (2), (3)) AS s(k) ON len(w) >= k) z GROUP BY ALL),
tot AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, ph, c AS a FROM f WHERE k > 1 AND c >= 10),
cut AS (
  SELECT cand.lang, cand.k, cand.ph, cand.a, s.pos, fl.c AS l, fr.c AS r,
         (1000000::HUGEINT * cand.a * cand.a) // (fl.c::HUGEINT * fr.c) AS score
  FROM cand JOIN (VALUES (1), (2)) AS s(pos) ON s.pos < cand.k
  JOIN f fl ON fl.lang = cand.lang AND fl.ph = cand.ph[1:s.pos]
  JOIN f fr ON fr.lang = cand.lang AND fr.ph = cand.ph[s.pos + 1:cand.k]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, pos) = 1),
held AS (SELECT lang, ph, max(a) AS longer
         FROM (SELECT lang, ph[1:2] AS ph, a FROM cand WHERE k = 3
               UNION ALL SELECT lang, ph[2:3], a FROM cand WHERE k = 3) z GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.ph, ' ') AS phrase FROM best
         LEFT JOIN held ON held.lang = best.lang AND held.ph = best.ph
         WHERE held.longer IS NULL OR 100 * held.longer < 50 * best.a)
SELECT kept.lang, CAST(row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
       phrase, a, l, r, CAST(tot.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN tot ON tot.lang = kept.lang QUALIFY rank <= 2000
"""


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_forms(docs).select("word", "form", "root", "n", "n_near", "form_n")


@register
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# No archive: sizes, digests and the smallest id of equal payloads straight from the table.
ORACLE["op13_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN CAST(first_id AS BIGINT) END AS refers_to
FROM f
"""
