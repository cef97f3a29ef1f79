"""Evidence held against sections, readiness and the strict gate, review context, and smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import evidence as E
from ..operators import limiter, model, spans
from ..sources.pages import allowed_host
from . import report_queries, span_queries
from .evidence_queries import _A, _CLAIMS, _FORM, _ISSUES, _JUDGED, _P, WEIGHTS, anchors, checked, issues, passages
from .evidence_queries import _SHARE as _GROUP_SHARE
from .registry import query, table
from .source_queries import _HOSTS_SQL, HOSTS
from .span_queries import _ASSIGNED, _CANDIDATES, _VOTES

SECTION_RULES = (
    E.Rule("identity.name", shortest=3, allow_title=True),
    E.Rule("identity.", prefix=True, shortest=5, allow_quoted=True),
    E.Rule("analysis.reasons", kinds=("body", "list"), denied_speakers=("witness",), shortest=12),
    E.Rule("outcome.", prefix=True, kinds=("body", "heading", "list"), shortest=8, allow_quoted=True),
)
#: Each document's title as evidence for a field that may rest on it and for one that may not.
_WITH_TITLES = f"""(SELECT source_id, field_path, anchor_id, passage_ids, quote FROM {_A} UNION ALL
  SELECT source_id, f, 'T' || f, ['TITLE'], q FROM (SELECT source_id, min(title) AS t FROM judgments WHERE title IS NOT NULL GROUP BY source_id), LATERAL (SELECT unnest(['identity.name', 'identity.name2', 'identity.name']) AS f, unnest([substr(t, 1, 12), substr(t, 1, 12), 'x' || t]) AS q, unnest([1, 2, 3]) AS k) WHERE k < 3)"""


def with_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "judgments").where("title is not null").groupBy("source_id").agg(F.min("title").alias("t"))
    named = t.select("source_id", F.explode(F.array(F.lit("identity.name"), F.lit("identity.name2"))).alias("field_path"), F.substring("t", 1, 12).alias("quote"))
    named = named.select("source_id", "field_path", F.concat(F.lit("T"), "field_path").alias("anchor_id"), F.array(F.lit("TITLE")).alias("passage_ids"), "quote")
    return anchors(spark, sf_dir).select("source_id", "field_path", "anchor_id", "passage_ids", "quote").unionByName(named)


@query(f"""
WITH {_CANDIDATES}, {_VOTES}, {_ASSIGNED},
  a AS {_WITH_TITLES},
  named AS (SELECT *, len(passage_ids) AS requested, unnest(CASE WHEN len(passage_ids) > 0 THEN passage_ids ELSE [NULL] END) AS id FROM a),
  met AS (SELECT n.*, p.ordinal, p.text, s.kind, s.speaker FROM named n LEFT JOIN {_P} p ON p.source_id = n.source_id AND p.id = n.id LEFT JOIN assigned s ON s.source_id = n.source_id AND s.ordinal = p.ordinal),
  found AS (SELECT source_id, field_path, anchor_id, any_value(quote) AS quote, any_value(requested) AS requested, any_value(passage_ids) AS ids, count(ordinal) AS found, coalesce(count(ordinal) = any_value(requested) AND max(ordinal) - min(ordinal) + 1 = count(ordinal) AND count(DISTINCT ordinal) = count(ordinal), false) AS unbroken,
      string_agg(text, ' ' ORDER BY ordinal) AS text, count(kind) AS n_sections, list_distinct(list(kind)) AS kinds, list_distinct(list(speaker)) AS speakers, arg_min(kind, ordinal) AS k1, arg_min(speaker, ordinal) AS s1, coalesce(bool_or(kind = 'quotation'), false) AS quoted FROM met GROUP BY source_id, field_path, anchor_id),
  formed AS (SELECT f.*, {_FORM.format("quote")} AS q, {_FORM.format("coalesce(text, '')")} AS t, {_FORM.format("coalesce(j.title, '')")} AS n, coalesce(requested = 1 AND ids[1] = 'TITLE', false) AS is_title,
      CASE WHEN field_path = 'identity.name' THEN 3 WHEN starts_with(field_path, 'identity.') THEN 5 WHEN field_path = 'analysis.reasons' THEN 12 WHEN starts_with(field_path, 'outcome.') THEN 8 ELSE 2 END AS shortest
    FROM found f LEFT JOIN (SELECT source_id, min(title) AS title FROM judgments GROUP BY source_id) j ON j.source_id = f.source_id),
  failing AS (SELECT *, CASE WHEN q IS NULL OR length(q) < shortest THEN 'short_quote' WHEN is_title THEN CASE WHEN NOT (field_path = 'identity.name' AND coalesce(contains(n, q) AND q <> '', false)) THEN 'title_mismatch' END WHEN NOT unbroken THEN 'passages_invalid' WHEN NOT coalesce(contains(t, q) AND q <> '', false) THEN 'not_found' END AS failed FROM formed),
  policed AS (SELECT *, CASE WHEN failed IS NOT NULL OR is_title THEN [] ELSE list_filter([
      CASE WHEN (field_path = 'analysis.reasons' AND len(list_filter(kinds, lambda x: x NOT IN ('body', 'list'))) > 0) OR (starts_with(field_path, 'outcome.') AND len(list_filter(kinds, lambda x: x NOT IN ('body', 'heading', 'list'))) > 0) THEN 'wrong_kind' END,
      CASE WHEN field_path = 'analysis.reasons' AND list_contains(speakers, 'witness') THEN 'wrong_speaker' END,
      CASE WHEN quoted AND NOT (starts_with(field_path, 'outcome.') OR (starts_with(field_path, 'identity.') AND field_path <> 'identity.name')) THEN 'quoted_not_allowed' END], lambda x: x IS NOT NULL) END AS policy FROM failing)
SELECT source_id, field_path, anchor_id, array_to_string(CASE WHEN failed IS NOT NULL THEN [failed] WHEN is_title THEN [] ELSE list_sort(list_concat(CASE WHEN n_sections < found THEN ['section_missing'] ELSE [] END, policy)) END, ',') AS flags, failed IS NULL AND len(policy) = 0 AS kept,
  CASE WHEN is_title THEN 'title' ELSE coalesce(k1, 'other') END AS kind, CASE WHEN is_title THEN 'court' ELSE coalesce(s1, 'unknown') END AS speaker FROM policed
""")
def evidence_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors judged by the spans that their passages lie in, not by what they say of themselves; titles as evidence."""
    runs = spans.islands(span_queries.assigned(spark, sf_dir))
    sections = runs.select("source_id", F.explode(F.sequence("start_ordinal", "end_ordinal")).alias("ordinal"), "kind", "speaker", (F.col("kind") == "quotation").alias("quoted"))
    titles = table(spark, sf_dir, "judgments").groupBy("source_id").agg(F.min("title").alias("title"))
    return E.section_verdicts(with_titles(spark, sf_dir), passages(spark, sf_dir), sections, titles, SECTION_RULES).withColumn("flags", F.array_join("flags", ","))


READY_PENALTIES = {"critical": (15, -1), "material": (3, 15), "minor": (1, 3)}
POINTS = {"official": 4, "pasted": 2, "map": 8, "approve": 4, "reject": 20}
_READY = f"""
  scores AS (SELECT source_id, CAST({" + ".join(_GROUP_SHARE.format(g, w) for g, w in WEIGHTS.items())} AS BIGINT) AS score FROM (SELECT *, string_split(field_path, '.')[1] AS g FROM checked) GROUP BY source_id),
  lost AS (SELECT source_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'material') AS m, count(*) FILTER (severity = 'minor') AS k FROM issues GROUP BY source_id),
  origin AS (SELECT source_id, bool_or(regexp_matches(coalesce(url, ''), '^https://') AND regexp_extract(coalesce(url, ''), '^https?://([^/]+)', 1) IN ({_HOSTS_SQL})) AS official, bool_or(url IS NOT NULL AND url <> '') AS has_url FROM judgments GROUP BY source_id),
  parts AS (SELECT s.source_id, s.score, CASE WHEN coalesce(o.official, false) THEN 4 WHEN NOT coalesce(o.has_url, false) THEN 2 ELSE 0 END AS source, CASE WHEN p.source_id IS NOT NULL THEN 8 ELSE 0 END AS map, coalesce(l.c, 0) AS n_critical,
      coalesce(l.c, 0) * 15 + least(coalesce(l.m, 0) * 3, 15) + least(coalesce(l.k, 0), 3) AS penalty, CASE WHEN coalesce(l.c, 0) + coalesce(l.m, 0) + coalesce(l.k, 0) = 0 THEN 'approve' WHEN coalesce(l.k, 0) >= 3 THEN 'reject' ELSE 'review' END AS recommendation
    FROM scores s LEFT JOIN lost l ON l.source_id = s.source_id LEFT JOIN origin o ON o.source_id = s.source_id LEFT JOIN (SELECT DISTINCT source_id FROM passages) p ON p.source_id = s.source_id),
  ready AS (SELECT *, CASE recommendation WHEN 'approve' THEN 4 WHEN 'reject' THEN -20 ELSE 0 END AS review FROM parts),
  final AS (SELECT *, greatest(0, least(100, score + source + map + review - penalty)) AS final FROM ready)"""


def ready(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, problems = checked(spark, sf_dir), issues(spark, sf_dir)
    url = F.col("url")
    sources = table(spark, sf_dir, "judgments").groupBy("source_id").agg(F.bool_or(allowed_host(url, HOSTS)).alias("official"), F.bool_or(F.coalesce(url != "", F.lit(False))).alias("has_url"))
    counted = found.select("source_id").distinct().join(problems.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "minor").alias("k")), "source_id", "left")
    reviews = counted.select("source_id", F.when(F.coalesce("n", F.lit(0)) == 0, "approve").when(F.col("k") >= 3, "reject").otherwise("review").alias("recommendation"))
    ordinals = table(spark, sf_dir, "passages").select("source_id", "ordinal").distinct()
    maps = spans.covers(spans.islands(span_queries.assigned(spark, sf_dir)), ordinals)
    return C.readiness(C.completeness(found, WEIGHTS), problems, maps, sources, reviews, READY_PENALTIES, POINTS), found


@query(f"WITH {_JUDGED}, {_CLAIMS}, {_ISSUES}, {_READY} SELECT source_id, score, source, map, review, CAST(penalty AS BIGINT) AS penalty, CAST(n_critical AS BIGINT) AS n_critical, recommendation, CAST(final AS BIGINT) AS final FROM final")
def claim_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score with all its terms: claims, source, section map, penalties, review."""
    return ready(spark, sf_dir)[0]


@query(f"""WITH {_JUDGED}, {_CLAIMS}, {_ISSUES}, {_READY},
  good AS (SELECT source_id, bool_or(field_path = 'identity.parties') AS a, bool_or(field_path IN ('analysis.reasons', 'analysis.issues')) AS b, bool_or(field_path = 'facts.events' AND length(value) > 0 AND substr(value, 1, 1) IN ('Τ', 'Η', 'Ο', 'T', 'I')) AS c FROM checked WHERE status = 'available' GROUP BY source_id)
SELECT f.source_id, CAST(final AS BIGINT) AS final, final >= 40 AND n_critical <= 0 AND recommendation <> 'reject' AND coalesce(g.a, false) AND coalesce(g.b, false) AND coalesce(g.c, false) AS strict FROM final f LEFT JOIN good g ON g.source_id = f.source_id""")
def claim_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict gate; the coded field is the first letter of the events here, its vocabulary five letters."""
    scored, found = ready(spark, sf_dir)
    coded = found.withColumn("value", F.when(F.col("field_path") == "facts.events", F.substring("value", 1, 1)).otherwise(F.col("value")))
    return C.strictly_ready(scored, coded, 40, ("identity.parties",), ("analysis.reasons", "analysis.issues"), ("facts.events", ("Τ", "Η", "Ο", "T", "I"))).select("source_id", "final", "strict")


RULES_OF_REVIEW = (("^missing_identity", "identity.parties", None), ("^missing_outcome", "outcome.costs", r"\d"), ("^missing_facts", "analysis.issues", None), ("^anchor_rejected$", "authorities.cited", r"^\d"))


@query(f"""WITH {_JUDGED}, {_CLAIMS}, {_ISSUES},
  ok AS (SELECT source_id, bool_or(field_path = 'identity.parties') AS r1, bool_or(field_path = 'outcome.costs' AND NOT coalesce(regexp_matches(value, '\\d'), false)) AS r2, bool_or(field_path = 'analysis.issues') AS r3, bool_or(field_path = 'authorities.cited' AND NOT coalesce(regexp_matches(value, '^\\d'), false)) AS r4 FROM checked WHERE status = 'available' GROUP BY source_id)
SELECT i.* FROM issues i LEFT JOIN ok ON ok.source_id = i.source_id WHERE NOT coalesce((starts_with(code, 'missing_identity') AND r1) OR (starts_with(code, 'missing_outcome') AND r2) OR (starts_with(code, 'missing_facts') AND r3) OR (code = 'anchor_rejected' AND r4), false)""")
def claim_settled_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that none of four rules settles by what the claims have after all."""
    return C.suppressed_by(issues(spark, sf_dir), checked(spark, sf_dir), RULES_OF_REVIEW)


@query(f"""
WITH p AS (SELECT DISTINCT source_id, ordinal, id FROM passages), n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM p),
  named AS (SELECT DISTINCT source_id, unnest(passage_ids) AS id FROM {_A})
SELECT n.source_id, n.ordinal, rn <= 45 AS in_head, n - rn < 90 AS in_tail, m.id IS NOT NULL AS named FROM n LEFT JOIN named m ON m.source_id = n.source_id AND m.id = n.id WHERE rn <= 45 OR n - rn < 90 OR m.id IS NOT NULL
""")
def model_review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer sees of each document: the first 45 passages, the last 90, and those that evidence names."""
    return model.review_context(table(spark, sf_dir, "passages").select("source_id", "ordinal", "id"), anchors(spark, sf_dir))


@query("""
SELECT DISTINCT source_id, url, concat_ws(' ', coalesce(nullif(trim(title, ' '), ''), nullif(trim(source_db, ' '), '')), coalesce(nullif(trim(charset, ' '), ''), nullif(trim(language_hint, ' '), ''))) AS shown FROM judgments
""")
def text_field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of structures, by the first member of each that has one."""
    pair = lambda a, b: F.struct(F.col(a).alias("text"), F.col(b).alias("name"))
    j = table(spark, sf_dir, "judgments")
    return j.select("source_id", "url", T.flattened(F.array(pair("title", "source_db"), pair("charset", "language_hint")), ("text", "name")).alias("shown")).distinct()


@query(f"SELECT source_id, field_path, anchor_id, round(greatest(0.9, len(passage_ids) / 4.0), 6) AS confidence FROM {_A} WHERE regexp_matches(quote, '\\d') AND regexp_matches(quote, '(?i)(?:section|άρθρο|exhibit|τεκμ|€)')")
def evidence_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors whose quotation has a number and names what it counts; their confidence is 0.9 at least."""
    a = anchors(spark, sf_dir).where(T.matches_all("quote", (r"\d", "(?iu)(?:section|άρθρο|exhibit|τεκμ|€)")))
    return a.select("source_id", "field_path", "anchor_id", F.round(T.at_least(F.size("passage_ids") / 4.0, 0.9), 6).alias("confidence"))


@query(f"SELECT count(*) FILTER (state = 'open') AS active, count(*) AS jobs FROM ({report_queries._STATES})")
def state_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs are active."""
    return report_queries.state_jobs(spark, sf_dir).agg(F.count_if(F.col("state") == "open").alias("active"), F.count("*").alias("jobs"))


@query(report_queries.limited_sql(600_000_000, 2))
def state_second_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same limiter with other numbers: two accepted requests in ten minutes."""
    r = table(spark, sf_dir, "job_requests").distinct()
    return limiter.sliding_log(r, "client", "requested_at", ["job_id", "kind", "received_at"], 600, 2).select("job_id", "client", "kind", "requested_at", "received_at", "accepted")


