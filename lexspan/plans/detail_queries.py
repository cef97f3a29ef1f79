"""Smaller operators of claims, flags and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import spans
from .evidence_queries import _CLAIMS, _ISSUES, _JUDGED, checked, issues, judged
from .registry import query, table
from .span_queries import _ASSIGNED, _CANDIDATES, _VOTES, assigned
from .text_queries import text_first_citation


def anchors(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "anchors").select(*columns).distinct()


@query(r"""
SELECT source_id, field_path, anchor_id, TRY_CAST(regexp_extract(supports[1], '(?i)(?:issues|reasons|events)\D{0,3}(\d{1,3})', 1) AS INT) AS number,
  CASE kind WHEN 'orders' THEN 'O' WHEN 'reasons' THEN 'R' WHEN 'facts' THEN 'F' ELSE '' END AS code,
  concat_ws('; ', 'kind: ' || nullif(kind, ''), 'speaker: ' || nullif(speaker, '')) AS summary,
  CASE WHEN exact_match IS NULL THEN '–' WHEN exact_match THEN 'Yes' ELSE 'No' END AS shown, CASE WHEN passage_ids IS NULL THEN '–' ELSE array_to_string(passage_ids, ', ') END AS places
FROM (SELECT DISTINCT source_id, field_path, anchor_id, supports, kind, speaker, exact_match, passage_ids FROM anchors)
""")
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = anchors(spark, sf_dir, "source_id", "field_path", "anchor_id", "supports", "kind", "speaker", "exact_match", "passage_ids")
    return a.select(
        "source_id", "field_path", "anchor_id", T.ordinal_after(F.get("supports", F.lit(0)), ["issues", "reasons", "events"]).alias("number"), T.mapped("kind", {"orders": "O", "reasons": "R", "facts": "F"}).alias("code"),
        T.labelled([("kind", F.col("kind")), ("speaker", F.col("speaker"))]).alias("summary"), T.plain_value(F.col("exact_match"), "boolean").alias("shown"), T.plain_value(F.col("passage_ids"), "array").alias("places"),
    )


@query(f"""
WITH {_JUDGED} SELECT source_id, field_path, anchor_id, array_to_string(list_filter(flags, lambda x: NOT starts_with(x, 'not_')), ',') AS without_prefix,
  array_to_string(list_filter(flags, lambda x: x IN ('not_found', 'kind_missing'))[1:1], ',') AS within FROM judged
""")
def text_flag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(F.lit("not_found"), F.lit("kind_missing"))
    return judged(spark, sf_dir).select("source_id", "field_path", "anchor_id", F.array_join(T.without_prefix(F.col("flags"), "not_"), ",").alias("without_prefix"), F.array_join(T.within(F.col("flags"), allowed, 1), ",").alias("within"))


@query("""
SELECT url, generated_at, field_path, CAST(value AS VARCHAR) AS value FROM (SELECT url, generated_at, length.minimum AS minimum, length.median AS median, length.maximum AS maximum, n_passages FROM (SELECT DISTINCT * FROM diagnostics))
UNPIVOT INCLUDE NULLS (value FOR field_path IN (minimum, median, maximum, n_passages))
""")
def claim_fields_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "diagnostics").distinct().select("url", "generated_at", "length.minimum", "length.median", "length.maximum", "n_passages")
    keyed = d.withColumn("__key", F.struct("url", "generated_at"))
    return C.fields_long(keyed, "__key", ["minimum", "median", "maximum", "n_passages"]).select("__key.url", "__key.generated_at", "field_path", "value")


@query(f"""
WITH {_CANDIDATES}, {_VOTES}, {_ASSIGNED}, runs AS (SELECT *, sum(starts) OVER (PARTITION BY source_id ORDER BY ordinal) AS span_no FROM (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL OR kind <> lag(kind) OVER w THEN 1 ELSE 0 END AS starts FROM assigned WINDOW w AS (PARTITION BY source_id ORDER BY ordinal)))
SELECT source_id, CAST(span_no AS BIGINT) AS span_no, kind, min(ordinal) AS start_ordinal, max(ordinal) AS end_ordinal FROM runs GROUP BY source_id, span_no, kind
""")
def span_kind_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by kind alone, as spans are shown."""
    return spans.islands(assigned(spark, sf_dir), label=("kind",)).select("source_id", "span_no", "kind", "start_ordinal", "end_ordinal")


@query(r"""
WITH head AS (SELECT source_id, ordinal, coalesce(nullif(regexp_extract(text, '(?:Appl\.|Case No\.|Civil Appeal|Action No\.|Προσφυγή|Πολ\. Έφεση|Αγωγή Αρ\.|Υπόθ\. Αρ\.) (\d+/\d{4})', 1), ''), nullif(regexp_extract(text, 'No\. (\d+/\d{4})', 1), '')) AS citation FROM (SELECT DISTINCT source_id, ordinal, text FROM passages) WHERE ordinal <= 40),
  cited AS (SELECT source_id, arg_min(citation, ordinal) AS value FROM head WHERE citation IS NOT NULL GROUP BY source_id),
""" + f"{_JUDGED}, {_CLAIMS}, " + r"""
  docket AS (SELECT source_id, status, CASE WHEN status IN ('available', 'conflicted') THEN value ELSE '' END AS value FROM checked WHERE field_path = 'identity.docket')
SELECT coalesce(d.source_id, f.source_id) AS source_id, CASE WHEN f.value IS NOT NULL AND coalesce(status, '') <> 'available' THEN 'available' ELSE status END AS status, CASE WHEN f.value IS NOT NULL AND coalesce(status, '') <> 'available' THEN f.value ELSE d.value END AS value
FROM docket d FULL JOIN cited f ON d.source_id = f.source_id
""")
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The docket of each document from its first citation, unless a claim has it."""
    docket = checked(spark, sf_dir).where("field_path = 'identity.docket'")
    found = text_first_citation(spark, sf_dir).select("source_id", F.col("citation").alias("value"))
    return C.grounded(docket, found, "identity.docket", 0.97).select("source_id", "status", "value")


@query("""
SELECT source_id, min(label) AS label FROM (SELECT DISTINCT source_id, upper(speaker) AS label FROM anchors WHERE speaker IS NOT NULL) g
WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.source_id = g.source_id AND a.field_path LIKE 'identity.%' AND lower(a.speaker) = lower(g.label)) GROUP BY source_id, lower(label)
""")
def claim_new_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "anchors").where("speaker is not null")
    have = a.where("field_path like 'identity.%'").select("source_id", F.col("speaker").alias("label"))
    return C.not_present(a.select("source_id", F.upper("speaker").alias("label")).distinct(), have, "source_id", "label")


_N = "CAST(regexp_extract(supports[1], '\\d+') AS INT)"


@query(f"""
SELECT i.source_id, i.number, r.anchor_id FROM (SELECT DISTINCT source_id, {_N} AS number FROM anchors WHERE field_path = 'analysis.issues' AND supports[1] LIKE '%[%') i
LEFT JOIN (SELECT source_id, {_N} AS number, min(anchor_id) AS anchor_id FROM anchors WHERE field_path = 'analysis.reasons' AND supports[1] LIKE '%[%' GROUP BY ALL) r ON i.source_id = r.source_id AND i.number = r.number
""")
def claim_numbered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "anchors").select("source_id", "field_path", "anchor_id", F.get("supports", F.lit(0)).alias("s")).where("s like '%[%'")
    a = a.select("source_id", "field_path", "anchor_id", F.regexp_extract("s", r"\d+", 0).cast("int").alias("number"))
    items = a.where("field_path = 'analysis.issues'").select("source_id", "number").distinct()
    return C.first_by_number(items, a.where("field_path = 'analysis.reasons'"), "source_id", "number", "anchor_id").select("source_id", "number", "anchor_id")


@query(f"""
WITH {_JUDGED}, {_CLAIMS}, {_ISSUES}
SELECT source_id, code, field_path, message, CASE WHEN severity = 'critical' AND NOT regexp_matches(code, 'docket') THEN 'material' WHEN severity IN ('critical', 'material') THEN severity ELSE 'minor' END AS severity
FROM issues i WHERE NOT (code = 'anchor_rejected' AND EXISTS (SELECT 1 FROM checked c WHERE c.source_id = i.source_id AND c.field_path = i.field_path AND c.status = 'available'))
""")
def claim_review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that a settled claim doesn't contradict, with severities capped."""
    kept = C.suppressed(issues(spark, sf_dir), checked(spark, sf_dir), "^anchor_rejected$")
    return kept.withColumn("severity", C.capped_severity(F.col("severity"), F.col("code"), ("critical", "material", "minor"), "critical", "material", "docket"))
