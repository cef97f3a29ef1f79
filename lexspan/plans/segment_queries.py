"""Documents to passages, and measures of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..operators import segment as S
from .registry import query, table
from .text_queries import judgments, passages

ABBREVIATIONS = ("κ", "Αρ", "Υπόθ", "Πολ", "βλ", "άρθ", "No", "Mr", "Mrs", "Dr", "cf", "viz")
#: Words that open another proposition in a long paragraph without sentence ends.
TRANSITIONS = ("Κρίνουμε", "Θεωρούμε", "We find", "We hold", "It follows")


@query(r"""
WITH cut AS (SELECT source_id, list_filter(list_transform(string_split_regex(clean_text, '\n[ \t]*\n\s*'), lambda x: regexp_replace(x, '^[\s\x0B\x{0085}\p{Z}]+|[\s\x0B\x{0085}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS b,
    list_filter(list_transform(string_split(clean_text, chr(10)), lambda x: regexp_replace(x, '^[\s\x0B\x{0085}\p{Z}]+|[\s\x0B\x{0085}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS l
  FROM (SELECT DISTINCT source_id, clean_text FROM judgments)),
  chosen AS (SELECT source_id, CASE WHEN len(b) <= 5 AND len(l) >= 12 THEN l ELSE b END AS parts FROM cut)
SELECT source_id, CAST(generate_subscripts(parts, 1) AS INT) AS block_no, unnest(parts) AS block FROM chosen
""")
def segment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judgments(spark, sf_dir).select("source_id", F.posexplode(S.blocks(F.col("clean_text"))).alias("i", "block"))
    return found.select("source_id", (F.col("i") + 1).alias("block_no"), "block")


_SEP = "chr(31)"


@query(r"""
WITH marked AS (SELECT source_id, ordinal, text, regexp_replace(text, '([.!?;…][»”"'')]{0,2})\s+([«“"(]?[\p{Lu}\d])', '\1' || chr(30) || '\2', 'g') AS m FROM (SELECT DISTINCT source_id, ordinal, text FROM passages WHERE text IS NOT NULL)),
  parts AS (SELECT source_id, ordinal, CASE WHEN length(text) <= 180 THEN [text] ELSE string_split(m, chr(30)) END AS p FROM marked)
SELECT source_id, ordinal, list_reduce(p, lambda done, part: done || CASE WHEN
    length(regexp_replace(regexp_extract(done, '[^\x1f]*$'), '[^(]', '', 'g')) > length(regexp_replace(regexp_extract(done, '[^\x1f]*$'), '[^)]', '', 'g'))
    OR length(regexp_replace(regexp_extract(done, '[^\x1f]*$'), '[^«]', '', 'g')) > length(regexp_replace(regexp_extract(done, '[^\x1f]*$'), '[^»]', '', 'g'))
    OR length(regexp_replace(regexp_extract(done, '[^\x1f]*$'), '[^“]', '', 'g')) > length(regexp_replace(regexp_extract(done, '[^\x1f]*$'), '[^”]', '', 'g'))
    OR regexp_matches(regexp_extract(done, '[^\x1f]*$'), '(?:^|[\s(])(?:κ|Αρ|Υπόθ|Πολ|βλ|άρθ|No|Mr|Mrs|Dr|cf|viz)\.$') OR regexp_matches(part, '^\p{Ll}') THEN ' ' ELSE chr(31) END || part) AS merged
FROM parts
""")
def segment_merged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir).where("text is not null")
    return p.select("source_id", "ordinal", F.array_join(S.merge_fragments(S.rough_sentences(F.col("text")), ABBREVIATIONS), "\x1f").alias("merged"))


_TRIM = "'^[\\s\\x0B\\x{0085}\\p{Z}]+|[\\s\\x0B\\x{0085}\\p{Z}]+$'"
_LAST = "regexp_extract(done, '[^\\x1f]*$')"


def _cleaned(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: regexp_replace(x, {_TRIM}, '', 'g')), lambda x: x <> '')"


def _more(opening: str, closing: str) -> str:
    return f"length(regexp_replace({_LAST}, '[^{opening}]', '', 'g')) > length(regexp_replace({_LAST}, '[^{closing}]', '', 'g'))"


#: The whole cut in SQL: blocks, sentences, the left fold of fragments, the cutting of long units, the cursor over places.
_PASSAGES = f"""
  lists AS (SELECT source_id, {_cleaned("string_split_regex(clean_text, '\\n[ \\t]*\\n\\s*')")} AS b, {_cleaned("string_split(clean_text, chr(10))")} AS l FROM docs),
  counted AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '^(?:\\[?\\d{{1,4}}\\]?|\\(\\d{{1,4}}\\))\\s*[.)]?\\s'))) AS k FROM lists),
  chosen AS (SELECT source_id, CASE WHEN len(b) <= 5 AND len(l) >= 12 OR len(b) < 12 AND len(l) >= 20 AND k >= greatest(5, floor(len(l) * 0.18)) THEN l ELSE b END AS blocks FROM counted),
  block AS (SELECT source_id, i AS block, blocks[i] AS t FROM (SELECT source_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM chosen)),
  rough AS (SELECT *, {_cleaned("CASE WHEN length(t) <= 180 THEN [t] ELSE string_split(regexp_replace(t, '([.!?;…][»”\"'')]{0,2})\\s+([«“\"(]?[\\p{Lu}\\d])', '\\1' || chr(30) || '\\2', 'g'), chr(30)) END")} AS p FROM block),
  parts AS (SELECT source_id, block, CASE WHEN length(t) > 900 AND len(p) <= 1 THEN {_cleaned("string_split(regexp_replace(t, '(^|[^\\p{L}\\p{N}])(" + "|".join(TRANSITIONS) + ")([^\\p{L}\\p{N}]|$)', '\\1' || chr(30) || '\\2\\3', 'g'), chr(30))")} ELSE p END AS p FROM rough),
  merged AS (SELECT source_id, block, string_split(list_reduce(p, lambda done, part: done || CASE WHEN {_more("(", ")")} OR {_more("«", "»")} OR {_more("“", "”")}
      OR regexp_matches({_LAST}, '(?:^|[\\s(])(?:{"|".join(ABBREVIATIONS)})\\.$') OR regexp_matches(part, '^[«“"''(\\[]*\\p{{Ll}}') OR regexp_matches({_LAST}, '(?:\\p{{Lu}}\\.){{2,}}$')
      OR length(part) <= 180 AND regexp_matches(part, '^(?:\\p{{Lu}}[\\p{{L}}''’.-]+|\\(?\\d{{4}}\\)|\\d+\\(\\p{{Lu}}\\))') AND regexp_matches({_LAST}, '(?:^|[^\\p{{L}}\\p{{N}}])(?:ν|[vV][sS]?)\\.|\\(βλ\\.|,') THEN ' ' ELSE chr(31) END || part), chr(31)) AS m FROM parts WHERE len(p) > 0),
  unit AS (SELECT source_id, block, i AS unit, m[i] AS t FROM (SELECT source_id, block, m, unnest(range(1, len(m) + 1)) AS i FROM merged)),
  piece AS (SELECT source_id, block, unit, 0 AS piece, CAST(NULL AS VARCHAR) AS t, t AS rest FROM unit
    UNION ALL
    SELECT source_id, block, unit, piece + 1, regexp_replace(substr(rest, 1, cut), {_TRIM}, '', 'g'), CASE WHEN cut >= length(rest) THEN NULL ELSE regexp_replace(substr(rest, cut + 1), {_TRIM}, '', 'g') END FROM (
      SELECT *, CASE WHEN length(rest) <= 7000 THEN length(rest) ELSE coalesce(nullif(greatest({", ".join(f"CASE WHEN strpos(reverse(substr(rest, 1, 7000)), {mark[::-1]!r}) > 0 AND 7001 - strpos(reverse(substr(rest, 1, 7000)), {mark[::-1]!r}) - {len(mark)} >= 2500 THEN 7001 - strpos(reverse(substr(rest, 1, 7000)), {mark[::-1]!r}) ELSE 0 END".replace(repr(chr(10)), "chr(10)") for mark in S.MARKERS)}), 0), 7000) END AS cut
      FROM piece WHERE rest IS NOT NULL AND rest <> '')),
  numbered AS (SELECT source_id, block, t, row_number() OVER (PARTITION BY source_id ORDER BY block, unit, piece) AS i, count(*) OVER (PARTITION BY source_id) AS n FROM piece WHERE t IS NOT NULL AND t <> ''),
  packed AS (SELECT d.source_id, d.clean_text, u.parts FROM docs d JOIN (SELECT source_id, list(t ORDER BY i) AS parts FROM numbered GROUP BY source_id) u ON u.source_id = d.source_id),
  place AS (SELECT source_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS start, CAST(1 AS BIGINT) AS cursor, true AS hit FROM packed
    UNION ALL
    SELECT source_id, i, CASE WHEN at_ > 0 THEN cursor + at_ - 1 ELSE cursor END, CASE WHEN at_ > 0 THEN cursor + at_ - 1 ELSE cursor END + size, at_ > 0 FROM (
      SELECT p.source_id, p.i + 1 AS i, p.cursor, length(k.parts[p.i + 1]) AS size, strpos(substr(k.clean_text, p.cursor), k.parts[p.i + 1]) AS at_ FROM place p JOIN packed k ON k.source_id = p.source_id WHERE p.i < len(k.parts)))
"""


@query(f"""
WITH RECURSIVE docs AS (SELECT DISTINCT source_id, clean_text FROM judgments WHERE length(clean_text) >= 80), {_PASSAGES}
SELECT u.source_id, 'P' || lpad(CAST(u.i AS VARCHAR), 6, '0') AS id, CAST(u.i AS INT) AS ordinal, 'B' || lpad(CAST(u.block AS VARCHAR), 5, '0') AS block_id, u.t AS text,
  CASE WHEN n = 1 THEN 1.0 ELSE floor((u.i - 1)::DOUBLE / (n - 1) * 1000000 + 0.5) / 1000000.0 END AS rel_pos, CAST(p.start - 1 AS INT) AS start_offset, CAST(p.cursor - 1 AS INT) AS end_offset
FROM numbered u JOIN place p ON p.source_id = u.source_id AND p.i = u.i
""")
def segment_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.passages(judgments(spark, sf_dir), "source_id", "clean_text", ABBREVIATIONS, transitions=TRANSITIONS)


@query(r"""
WITH RECURSIVE j AS (SELECT DISTINCT source_id, clean_text FROM judgments),
  b AS (SELECT source_id, clean_text, list_filter(list_transform(string_split_regex(clean_text, '\n[ \t]*\n\s*'), lambda x: regexp_replace(x, '^[\s\x0B\x{0085}\p{Z}]+|[\s\x0B\x{0085}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS parts FROM j),
  places AS (SELECT source_id, 0 AS i, 1 AS start, 1 AS cursor FROM b
    UNION ALL
    SELECT source_id, i, place, place + n FROM (
      SELECT a.source_id, a.i + 1 AS i, length(b.parts[a.i + 1]) AS n, CASE WHEN strpos(substr(b.clean_text, a.cursor), b.parts[a.i + 1]) > 0 THEN a.cursor + strpos(substr(b.clean_text, a.cursor), b.parts[a.i + 1]) - 1 ELSE a.cursor END AS place
      FROM places a JOIN b ON b.source_id = a.source_id WHERE a.i < len(b.parts)))
SELECT source_id, CAST(i AS INT) AS ordinal, CAST(start - 1 AS INT) AS start_offset, CAST(cursor - 1 AS INT) AS end_offset FROM places WHERE i > 0
""")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block's place, sought from where the last one ended."""
    parts = judgments(spark, sf_dir).select("source_id", "clean_text", F.filter(F.transform(F.split("clean_text", S.BLANK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "").alias("parts"))
    return S.located(parts, "source_id", "clean_text", "parts").select("source_id", "ordinal", "start_offset", "end_offset")


@query(r"""
SELECT source_id, ordinal, CASE WHEN n = 1 THEN 1.0 ELSE floor((rn - 1)::DOUBLE / (n - 1) * 1000000 + 0.5) / 1000000.0 END AS rel_pos, 'P' || lpad(CAST(rn AS VARCHAR), 6, '0') AS id
FROM (SELECT source_id, ordinal, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM (SELECT DISTINCT source_id, ordinal FROM passages))
""")
def segment_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ordered.numbered(table(spark, sf_dir, "passages").select("source_id", "ordinal").distinct(), "source_id", "ordinal")
    rel = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.floor((F.col("rn") - 1) / (F.col("n") - 1) * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0))
    return numbered.select("source_id", "ordinal", rel.alias("rel_pos"), F.format_string("P%06d", "rn").alias("id"))


@query("""
SELECT source_id, CAST(count(*) AS BIGINT) AS n_passages, CAST(sum(n) AS BIGINT) AS passage_chars, CAST(min(n) AS INT) AS minimum, CAST(l[CAST(floor((len(l) - 1) * 0.5) AS INT) + 1] AS INT) AS median,
  CAST(l[CAST(floor((len(l) - 1) * 0.9) AS INT) + 1] AS INT) AS p90, CAST(l[CAST(floor((len(l) - 1) * 0.95) AS INT) + 1] AS INT) AS p95, CAST(l[CAST(floor((len(l) - 1) * 0.99) AS INT) + 1] AS INT) AS p99,
  CAST(max(n) AS INT) AS maximum, CAST(count_if(n >= 6900) AS BIGINT) AS n_at_max
FROM (SELECT source_id, length(text) AS n, list(length(text) ORDER BY length(text)) OVER (PARTITION BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM (SELECT DISTINCT source_id, ordinal, text FROM passages WHERE text IS NOT NULL))
GROUP BY source_id, l
""")
def segment_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import length_diagnostics

    sized = table(spark, sf_dir, "passages").where("text is not null").select("source_id", "ordinal", F.length("text").alias("chars")).distinct()
    return length_diagnostics(sized, "source_id", F.col("chars"), 6900)


@query(f"""
WITH clean AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\x00', '', 'g'), '[\\x{{00A0}}\\x{{2007}}\\x{{202F}}]', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g'), {_TRIM}, '', 'g') AS t FROM documents),
  cut AS (SELECT 'doc_' || substr(sha256(t), 1, 24) AS source_id, list_filter(list_transform(string_split_regex(t, '\\n[ \\t]*\\n\\s*'), lambda x: regexp_replace(x, {_TRIM}, '', 'g')), lambda x: x <> '') AS b, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, {_TRIM}, '', 'g')), lambda x: x <> '') AS l FROM clean WHERE length(t) >= 80),
  sizes AS (SELECT source_id, list_sort(list_transform(CASE WHEN len(b) <= 5 AND len(l) >= 12 THEN l ELSE b END, lambda x: length(x))) AS s FROM cut)
SELECT source_id, CAST(len(s) AS BIGINT) AS n_passages, CAST(list_sum(s) AS BIGINT) AS passage_chars, CAST(s[1] AS INT) AS minimum, CAST(s[CAST(floor((len(s) - 1) * 0.5) AS INT) + 1] AS INT) AS median, CAST(s[CAST(floor((len(s) - 1) * 0.9) AS INT) + 1] AS INT) AS p90,
  CAST(s[CAST(floor((len(s) - 1) * 0.95) AS INT) + 1] AS INT) AS p95, CAST(s[CAST(floor((len(s) - 1) * 0.99) AS INT) + 1] AS INT) AS p99, CAST(s[-1] AS INT) AS maximum, CAST(len(list_filter(s, lambda x: x >= 6900)) AS BIGINT) AS n_at_max FROM sizes
""")
def flow_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts to clean, content-addressed documents, to blocks, to the diagnostics of each document's blocks."""
    from ..functions import text as T
    from ..operators.report import length_diagnostics

    clean = table(spark, sf_dir, "documents").select(T.normalize_newlines("text").alias("t")).where(F.length("t") >= 80)
    sizes = clean.select(T.content_id("t").alias("source_id"), F.transform(S.blocks(F.col("t")), lambda b: F.length(b)).alias("sizes")).distinct()  # equal texts have one id
    return length_diagnostics(sizes.select("source_id", F.explode_outer("sizes").alias("chars")), "source_id", F.col("chars"), 6900)


_RANK = "CAST(s[CAST(floor((len(s) - 1) * {}) AS INT) + 1] AS INT)"


@query(f"""
WITH RECURSIVE clean AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\x00', '', 'g'), '[\\x{{00A0}}\\x{{2007}}\\x{{202F}}]', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g'), {_TRIM}, '', 'g') AS t FROM documents),
  docs AS (SELECT 'doc_' || substr(sha256(t), 1, 24) AS source_id, t AS clean_text FROM clean WHERE length(t) >= 80), {_PASSAGES},
  sizes AS (SELECT p.source_id, list(p.cursor - p.start ORDER BY p.cursor - p.start) AS s, count(*) FILTER (NOT p.hit) AS j FROM place p WHERE p.i > 0 GROUP BY p.source_id)
SELECT source_id, CAST(len(s) AS BIGINT) AS n_passages, CAST(list_sum(s) AS BIGINT) AS passage_chars, CAST(s[1] AS INT) AS minimum, {_RANK.format(0.5)} AS median, {_RANK.format(0.9)} AS p90, {_RANK.format(0.95)} AS p95, {_RANK.format(0.99)} AS p99,
  CAST(s[-1] AS INT) AS maximum, CAST(len(list_filter(s, lambda x: x >= 6900)) AS BIGINT) AS n_at_max, CAST(j AS BIGINT) AS n_joined FROM sizes
""")
def flow_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: raw texts to clean documents, blocks, sentences, merged and split units, their places, diagnostics.

    Besides the lengths, how many passages aren't in the text as they stand.
    """
    from ..functions import text as T
    from ..operators.report import length_diagnostics

    clean = table(spark, sf_dir, "documents").select(T.normalize_newlines("text").alias("t")).where(F.length("t") >= 80)
    cut = clean.select(T.content_id("t").alias("source_id"), "t", S.pieces(F.col("t"), ABBREVIATIONS, TRANSITIONS)["text"].alias("parts"))
    sizes = cut.select("source_id", F.transform(S.offsets(F.col("t"), F.col("parts")), lambda x: F.struct((x["e"] - x["s"]).alias("n"), x["found"].alias("found"))).alias("sizes")).distinct()  # equal texts have one id
    joined = sizes.select("source_id", F.size(F.filter("sizes", lambda x: ~x["found"])).cast("bigint").alias("n_joined"), "sizes.n")
    sized = joined.select(F.struct("source_id", "n_joined").alias("d"), F.explode_outer("n").alias("chars"))
    measured = length_diagnostics(sized, "d", F.col("chars"), 6900)
    return measured.select("d.source_id", *measured.columns[1:], "d.n_joined")
