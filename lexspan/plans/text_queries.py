"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import ascii_fold, nfc
from ..operators.evidence import evidence_form
from .registry import query, table

_PASSAGES = "(SELECT DISTINCT source_id, ordinal, text FROM passages)"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, sf_dir).distinct()


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as they come, some twice. What follows from a row alone is computed first; its copies go after that, so that no text is shuffled."""
    return table(spark, sf_dir, "passages").select("source_id", "ordinal", "text")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "judgments").select("source_id", "clean_text").distinct()


@query(r"""
SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '\r\n?', chr(10), 'g'), '\x00', '', 'g'), '[\x{00A0}\x{2007}\x{202F}]', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{4,}', repeat(chr(10), 3), 'g'),
  '^[\s\x0B\x{0085}\p{Z}]+|[\s\x0B\x{0085}\p{Z}]+$', '', 'g')) AS digest
FROM (SELECT DISTINCT page_id, text FROM fetched_pages)
""")
def text_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetched_pages").select("page_id", "text")
    return pages.select("page_id", F.sha2(T.normalize_newlines("text").cast("binary"), 256).alias("digest")).distinct()


@query(r"""
SELECT page_id, length(t) AS n_chars, len(string_split(t, chr(10))) AS n_lines FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'),
    '<[^>]*>', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{2,}', chr(10), 'g') AS t
  FROM (SELECT DISTINCT page_id, html FROM fetched_pages))
""")
def text_without_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetched_pages").select("page_id", "html")
    t = F.regexp_replace(F.regexp_replace(T.strip_tags(T.without_raw("html")), "[ \t]+\n", "\n"), "\n{2,}", "\n")
    return pages.select("page_id", F.length(t).cast("bigint").alias("n_chars"), F.size(F.split(t, "\n")).cast("bigint").alias("n_lines")).distinct()


#: One pass over the parts between ampersands, as the operator does it.
_ENTITY = "CASE lower(m) " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in {k: v.replace("'", "''") for k, v in T.ENTITIES.items()}.items()) + " ELSE CASE WHEN code > 0 AND code < 1114112 AND NOT code BETWEEN 55296 AND 57343 THEN chr(code) END END"


@query(rf"""
WITH raw AS (SELECT DISTINCT page_id, html FROM fetched_pages),
  cut AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[\s>/].*?</script\s*>', '', 'g'), '(?is)<style[\s>/].*?</style\s*>', '', 'g'),
      '(?i)</(?:{T.BLOCK_TAGS})\s*>', chr(10) || chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)<li\b[^>]*>', '• ', 'g'), '<[^>]+>', '', 'g') AS t FROM raw),
  parts AS (SELECT page_id, string_split(t, '&') AS s FROM cut),
  pieces AS (SELECT page_id, i, s[i] AS p, CASE WHEN i > 1 THEN regexp_extract(s[i], '^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z]{{2,8}});', 1) ELSE '' END AS m FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM parts)),
  coded AS (SELECT *, CASE WHEN starts_with(lower(m), '#x') THEN CAST('0x' || substr(m, 3) AS INT) WHEN starts_with(m, '#') THEN CAST(substr(m, 2) AS INT) END AS code FROM pieces),
  text AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN p ELSE coalesce(CASE WHEN m <> '' THEN {_ENTITY} END || substr(p, length(m) + 2), '&' || p) END, '' ORDER BY i) AS t FROM coded GROUP BY page_id)
SELECT r.page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '\x00', '', 'g'), '[\x{{00A0}}\x{{2007}}\x{{202F}}]', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{4,}}', repeat(chr(10), 3), 'g'), '^[\s\x0B\x{{0085}}\p{{Z}}]+|[\s\x0B\x{{0085}}\p{{Z}}]+$', '', 'g') AS text
FROM (SELECT DISTINCT page_id FROM raw) r LEFT JOIN text USING (page_id)
""")
def text_of_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain, entities included."""
    pages = table(spark, sf_dir, "fetched_pages").select("page_id", "html").distinct()
    return pages.select("page_id", T.html_to_text("html").alias("text"))


@query(rf"""
SELECT source_id, ordinal,
  CASE WHEN letters > 0 THEN floor(capitals::DOUBLE / letters * 1000 + 0.5) / 1000.0 ELSE 0.0 END AS upper_ratio,
  CASE WHEN regexp_matches(text, '[\x{{0370}}-\x{{03FF}}\x{{1F00}}-\x{{1FFF}}]') THEN 'el' ELSE 'en' END AS lang,
  coalesce(nullif(regexp_extract(text, '^\s*\[(\d{{1,4}})\]', 1), ''), nullif(regexp_extract(text, '^\s*\((\d{{1,4}})\)', 1), ''), nullif(regexp_extract(text, '^\s*(\d{{1,4}})[.)](?:\s|$)', 1), ''), '') AS number,
  regexp_matches(text, '^\s*(?:[•‣▪–-]\s|\(?\d{{1,4}}[.)]\s|\(?[a-zα-ω][)]\s)') AS list_item,
  length(regexp_replace(text, '[^(\[«“]', '', 'g')) AS opened, length(regexp_replace(text, '[^)\]»”]', '', 'g')) AS closed
FROM (SELECT *, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS capitals, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters FROM {_PASSAGES} WHERE text IS NOT NULL)
""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = delivered(spark, sf_dir).where("text is not null")
    return p.select(
        "source_id", "ordinal", T.uppercase_ratio("text").alias("upper_ratio"), T.script_hint("text").alias("lang"), T.paragraph_number("text").alias("number"), T.is_list_item("text").alias("list_item"),
        F.length(F.regexp_replace("text", r"[^(\[«“]", "")).cast("bigint").alias("opened"), F.length(F.regexp_replace("text", r"[^)\]»”]", "")).cast("bigint").alias("closed"),
    ).distinct()


#: Words that begin headings in the test corpus; operators take such lists from the caller.
HEADING_WORDS = ("costs", "the facts", "conclusion", "έξοδα", "κατάληξη", "giderler", "sonuç")


@query(rf"""
SELECT source_id, ordinal FROM (
  SELECT *, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS capitals, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
    lower(regexp_replace(text, '^[\s\x{{0085}}\p{{Z}}]+|[\s\x{{0085}}\p{{Z}}]+$', '', 'g')) AS low FROM {_PASSAGES} WHERE text IS NOT NULL)
WHERE length(text) <= 120 AND ((letters > 0 AND floor(capitals::DOUBLE / letters * 1000 + 0.5) / 1000.0 >= 0.6)
  OR {" OR ".join(f"starts_with(low, '{w}')" for w in HEADING_WORDS)})
""")
def text_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, sf_dir).where(T.is_heading("text", HEADING_WORDS)).select("source_id", "ordinal").distinct()


@query(r"""
SELECT source_id, 'doc_' || substr(sha256(clean_text), 1, 24) AS content_id, source_id = 'src_' || substr(sha256(clean_text), 1, 24) AS agrees
FROM (SELECT DISTINCT source_id, clean_text FROM judgments)
""")
def text_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "judgments")
    return j.select("source_id", T.content_id("clean_text").alias("content_id"), (F.col("source_id") == T.content_id("clean_text", "src_")).alias("agrees")).distinct()


@query(r"""
SELECT p.source_id, p.ordinal, 1 + length(substr(j.clean_text, 1, p.start_offset)) - length(replace(substr(j.clean_text, 1, p.start_offset), chr(10), '')) AS line,
  substr(j.clean_text, p.start_offset + 1, p.end_offset - p.start_offset) = p.text AS agrees
FROM (SELECT DISTINCT source_id, ordinal, text, start_offset, end_offset FROM passages WHERE start_offset IS NOT NULL AND end_offset IS NOT NULL) p
JOIN (SELECT DISTINCT source_id, clean_text FROM judgments) j USING (source_id)
""")
def text_lines_of_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "passages").select("source_id", "ordinal", "text", "start_offset", "end_offset").where("start_offset is not null and end_offset is not null").distinct()
    found = F.substr(F.col("clean_text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    joined = p.join(judgments(spark, sf_dir), "source_id")
    return joined.select("source_id", "ordinal", T.line_at("clean_text", F.col("start_offset")).cast("bigint").alias("line"), (found == F.col("text")).alias("agrees"))


@query(r"""
SELECT source_id, field_path, anchor_id, sha256(trim(regexp_replace(regexp_replace(nfc_normalize(quote), '[\x{00A0}\x{2007}\x{202F}]', ' ', 'g'), '[\s\x0B\x{0085}\x{001C}-\x{001F}\p{Z}]+', ' ', 'g'))) AS digest
FROM (SELECT DISTINCT source_id, field_path, anchor_id, quote FROM anchors)
""")
def text_evidence_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFC, no-break spaces as spaces, white space squeezed: the form in which quotations are compared."""
    a = table(spark, sf_dir, "anchors").select("source_id", "field_path", "anchor_id", "quote").distinct()
    return a.select("source_id", "field_path", "anchor_id", F.sha2(evidence_form("quote").cast("binary"), 256).alias("digest"))


@query(r"""
SELECT DISTINCT field_path, supports_path, regexp_replace(regexp_replace(regexp_replace(supports_path, '\[\d*\]', '', 'g'), '\.{2,}', '.', 'g'), '^\.|\.$', '', 'g') AS canonical,
  regexp_replace(regexp_replace(lower(supports_path), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug
FROM (SELECT field_path, unnest(supports) AS supports_path FROM anchors)
""")
def text_field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "anchors").select("field_path", F.explode("supports").alias("supports_path")).distinct()
    return a.select("field_path", "supports_path", T.field_path("supports_path").alias("canonical"), T.slug("supports_path", "_", 10_000).alias("slug"))


@query(r"""
SELECT page_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  CASE WHEN text IS NOT NULL THEN '[omitted: ' || length(text) || ' characters]' END AS compact
FROM (SELECT DISTINCT page_id, title, text FROM fetched_pages)
""")
def text_escape_and_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "fetched_pages").select("page_id", "title", "text").distinct()
    return pages.select("page_id", T.escape_html("title").alias("escaped"), T.omitted("text").alias("compact"))


@query(r"""
SELECT url, title, regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80), '-$', '') AS file_name
FROM (SELECT DISTINCT url, title FROM diagnostics)
""")
def text_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "diagnostics").select("url", "title").distinct()
    return d.select("url", "title", T.slug(ascii_fold("title")).alias("file_name"))


@query(r"""
SELECT source_id, ordinal, array_to_string(list_filter(list_transform(string_split_regex(text, '[.;]'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '\d{1,2}[./]\d{1,2}[./]\d{4}')), '. ') AS kept
FROM (SELECT DISTINCT source_id, ordinal, text FROM passages WHERE text IS NOT NULL)
""")
def text_without_dated_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir).where("text is not null")
    return p.select("source_id", "ordinal", T.without_clauses("text", r"\d{1,2}[./]\d{1,2}[./]\d{4}").alias("kept"))


@query(r"""
SELECT source_id, arg_min(citation, ordinal) AS citation, min(ordinal) AS ordinal FROM (
  SELECT source_id, ordinal, coalesce(nullif(regexp_extract(text, '(?:Appl\.|Case No\.|Civil Appeal|Action No\.|Προσφυγή|Πολ\. Έφεση|Αγωγή Αρ\.|Υπόθ\. Αρ\.) (\d+/\d{4})', 1), ''), nullif(regexp_extract(text, 'No\. (\d+/\d{4})', 1), '')) AS citation
  FROM (SELECT DISTINCT source_id, ordinal, text FROM passages) WHERE ordinal <= 40)
WHERE citation IS NOT NULL GROUP BY source_id
""")
def text_first_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two patterns in the first forty passages, the earliest passage deciding."""
    patterns = (r"(?:Appl\.|Case No\.|Civil Appeal|Action No\.|Προσφυγή|Πολ\. Έφεση|Αγωγή Αρ\.|Υπόθ\. Αρ\.) (\d+/\d{4})", r"No\. (\d+/\d{4})")
    head = delivered(spark, sf_dir).where("ordinal <= 40").select("source_id", "ordinal", T.first_match("text", patterns).alias("citation")).where("citation is not null")
    return head.groupBy("source_id").agg(F.min_by("citation", "ordinal").alias("citation"), F.min("ordinal").alias("ordinal"))


@query(r"""
SELECT event_id, greatest(0.0, least(1.0, value / 100.0)) AS confidence, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind,
  lpad(CAST(greatest(CAST(value AS INT), 0) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(greatest(CAST(value AS INT), 0) % 60 AS VARCHAR), 2, '0') AS clock,
  CAST(floor(greatest(0.0, least(1.0, value / 100.0)) * 100 + 0.5) AS INT) AS percent,
  CASE WHEN value >= 75 THEN 'good' WHEN value >= 50 THEN 'fair' ELSE 'poor' END AS grade, 'E' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS label
FROM (SELECT event_id, event_type, floor(value) AS value FROM events)
""")
def text_display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").cast("double").alias("value"))
    c = T.clamp01(F.col("value") / 100.0, 0.5)
    return e.select(
        "event_id", c.alias("confidence"), T.one_of("event_type", ("view", "click"), "other").alias("kind"), T.clock(F.col("value")).alias("clock"), T.percent(c).alias("percent"),
        T.bucket(F.col("value"), ((75, "good"), (50, "fair")), "poor").alias("grade"), F.format_string("E%06d", "event_id").alias("label"),
    )
