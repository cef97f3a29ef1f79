"""Sources: pages, charsets, links, request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pages as P
from ..sources.requests import first_error, parse_bodies
from .registry import query, table

HOSTS = ("rulings.example", "decisions.example", "appeals.example")
ROUTES = (("labour-tribunal.", "labour"), ("asylum-court.", "asylum"), ("rent-control.", "rent"), ("/doc/", "document"))

_HOSTS_SQL = ", ".join(f"'{h}'" for h in HOSTS)
_CHARSET_SQL = """CASE WHEN regexp_matches(c, '^utf-?8$') THEN 'utf-8' WHEN regexp_matches(c, '^(?:windows|cp|x-cp)-?1253$') THEN 'windows-1253'
  WHEN regexp_matches(c, '^(?:iso-?8859-?7|greek8?|elot-?928)$') THEN 'iso-8859-7' WHEN regexp_matches(c, '^(?:iso-?8859-?1|latin-?1|us-ascii|ascii|windows-?1252|cp-?1252)$') THEN 'windows-1252' WHEN c <> '' THEN c ELSE 'utf-8' END"""


_DECODED = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')"
for _name, _char in {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "''", "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—", "hellip": "…", "euro": "€", "amp": "&"}.items():
    _DECODED = f"regexp_replace({_DECODED}, '(?i)&{_name};', '{_char}', 'g')"


def fetched(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "fetched_pages").select(*columns).distinct()


@query("""
SELECT DISTINCT page_id FROM fetched_pages WHERE length(trim(text, ' ')) >= 80 AND octet_length(encode(html)) <= 14000000
""")
def source_accepted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.accepted(table(spark, sf_dir, "fetched_pages")).select("page_id").distinct()


@query(f"""
SELECT page_id, regexp_matches(url, '^https://') AND regexp_extract(url, '^https?://([^/]+)', 1) IN ({_HOSTS_SQL}) AS allowed,
  CASE WHEN contains(lower(url), 'labour-tribunal.') THEN 'labour' WHEN contains(lower(url), 'asylum-court.') THEN 'asylum' WHEN contains(lower(url), 'rent-control.') THEN 'rent' WHEN contains(lower(url), '/doc/') THEN 'document' ELSE 'other' END AS route
FROM (SELECT DISTINCT page_id, url FROM fetched_pages)
""")
def source_hosts_and_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetched(spark, sf_dir, "page_id", "url").select("page_id", P.allowed_host(F.col("url"), HOSTS).alias("allowed"), P.routed(F.col("url"), ROUTES, "other").alias("route"))


@query(f"""
SELECT page_id, {_CHARSET_SQL} AS charset FROM (
  SELECT page_id, lower(regexp_replace(trim(replace(replace(coalesce(nullif(trim(charset), ''), nullif(regexp_extract(substr(html, 1, 16000), '(?i)charset\\s*=\\s*["'']?([\\w-]+)', 1), '')), '"', ''), '''', '')), '[_\\s]', '-', 'g')) AS c
  FROM (SELECT DISTINCT page_id, charset, html FROM fetched_pages))
""")
def source_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetched(spark, sf_dir, "page_id", "charset", "html").select("page_id", P.declared_charset(F.col("charset"), F.col("html")).alias("charset"))


def _undefined(charset: str) -> str:
    """The bytes, as SQL, that a charset gives no character."""
    out = []
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(charset)
        except UnicodeDecodeError:
            out.append(f"'{b:02X}'")
    return ", ".join(out)


_C0 = ", ".join(f"'{b:02X}'" for b in (*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F))
_C1 = ", ".join(f"'{b:02X}'" for b in range(0x80, 0xA0))


@query(f"""
WITH b AS (SELECT DISTINCT page_id, html, list_transform(range(1, CAST(octet_length(encode(html)) + 1 AS BIGINT)), lambda i: substr(hex(encode(html)), 2 * i - 1, 2)) AS bytes FROM fetched_pages WHERE html IS NOT NULL),
  p AS (SELECT page_id, length(html) AS n, len(bytes) AS m,
      10 * length(regexp_replace(html, '[^\\x{{FFFD}}]', '', 'g')) + length(regexp_replace(html, '[^\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g')) AS u,
      10 * len(list_filter(bytes, lambda x: x IN ({_undefined("windows-1253")}))) + len(list_filter(bytes, lambda x: x IN ({_C0}))) AS w,
      10 * len(list_filter(bytes, lambda x: x IN ({_undefined("iso-8859-7")}))) + len(list_filter(bytes, lambda x: x IN ({_C0}, {_C1}))) AS g FROM b)
SELECT page_id, CASE WHEN u <= least(w, g) THEN 'utf-8' WHEN w <= g THEN 'windows-1253' ELSE 'iso-8859-7' END AS charset, CAST(least(u, w, g) AS INT) AS penalty, CASE WHEN u <= least(w, g) THEN n ELSE m END AS n_chars FROM p
""")
def source_best_decodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's bytes (in UTF-8) against three charsets."""
    raw = fetched(spark, sf_dir, "page_id", "html").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return P.best_decoding(raw, ["page_id"], "content", ("utf-8", "windows-1253", "iso-8859-7")).select("page_id", "charset", "penalty", F.length("text").alias("n_chars"))


@query(f"""
SELECT page_id, nullif(trim(regexp_replace({_DECODED}, '[\\s\\x0B\\x{{0085}}\\p{{Z}}]+', ' ', 'g')), '') AS title
FROM (SELECT DISTINCT page_id, html FROM fetched_pages)
""")
def source_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every page, entities decoded."""
    return fetched(spark, sf_dir, "page_id", "html").select("page_id", P.page_title(F.col("html")).alias("title"))


@query(f"""
WITH found AS (SELECT page_id, url, generate_subscripts(h, 1) AS pos, unnest(h) AS href FROM (
    SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*["'']?([^"''\\s>#]+)', 1) AS h FROM (SELECT DISTINCT page_id, url, html FROM fetched_pages))),
  absolute AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END AS link FROM found),
  once AS (SELECT page_id, link, min(pos) AS pos FROM absolute WHERE regexp_extract(link, '^https://([^/]+)', 1) IN ({_HOSTS_SQL}) AND NOT regexp_matches(link, '/gazette/') GROUP BY ALL)
SELECT page_id, position, link FROM (SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS position FROM once) WHERE position <= 5
""")
def source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.links(fetched(spark, sf_dir, "page_id", "url", "html"), "page_id", "url", "html", HOSTS, first=5, skip="/gazette/")


@query("""
SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'not_json' WHEN json_type(props) <> 'OBJECT' THEN 'not_object' END AS error, CAST(json_extract(props, '$.k') AS INT) AS k FROM events
""")
def source_request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_bodies(table(spark, sf_dir, "events"), "props", "k int").select("event_id", "error", F.col("parsed.k").alias("k"))


@query("""
SELECT job_id, kind, requested_at, CASE WHEN client IS NULL THEN 'no_client' WHEN run_mode IS NULL OR run_mode NOT IN ('full', 'sections') THEN 'bad_mode' WHEN received_at < requested_at THEN 'early' END AS error
FROM (SELECT DISTINCT * FROM job_requests)
""")
def source_request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "job_requests").distinct()
    error = first_error((F.col("client").isNull(), "no_client"), (F.col("run_mode").isNull() | ~F.col("run_mode").isin("full", "sections"), "bad_mode"), (F.col("received_at") < F.col("requested_at"), "early"))
    return r.select("job_id", "kind", "requested_at", error.alias("error"))
