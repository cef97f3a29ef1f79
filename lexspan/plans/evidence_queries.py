"""Evidence, claims, issues, scores and tags over the anchors of the test corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import evidence as E
from ..operators import facets
from .registry import query, table

RULES = (
    E.Rule("identity.", prefix=True, shortest=5),
    E.Rule("analysis.reasons", kinds=("reasons", "argument", "facts", "orders"), denied_speakers=("witness",), shortest=12),
    E.Rule("outcome.", prefix=True, kinds=("orders", "reasons", "heading_block", "facts", "argument"), shortest=8),
)

_A = "(SELECT DISTINCT source_id, field_path, anchor_id, passage_ids, quote, kind, speaker FROM anchors)"
_P = "(SELECT DISTINCT source_id, id, ordinal, text FROM passages)"
_FORM = "trim(regexp_replace(regexp_replace(nfc_normalize({}), '[\\x{{00A0}}\\x{{2007}}\\x{{202F}}]', ' ', 'g'), '[\\s\\x0B\\x{{0085}}\\x{{001C}}-\\x{{001F}}\\p{{Z}}]+', ' ', 'g'))"
_FOUND = f"""
  named AS (SELECT *, len(passage_ids) AS requested, unnest(CASE WHEN len(passage_ids) > 0 THEN passage_ids ELSE [NULL] END) AS id FROM {_A}),
  found AS (SELECT n.source_id, field_path, anchor_id, any_value(n.quote) AS quote, any_value(n.kind) AS kind, any_value(n.speaker) AS speaker, any_value(requested) AS requested, count(p.ordinal) AS found,
      coalesce(count(p.ordinal) = any_value(requested) AND max(p.ordinal) - min(p.ordinal) + 1 = count(p.ordinal) AND count(DISTINCT p.ordinal) = count(p.ordinal), false) AS unbroken, string_agg(p.text, ' ' ORDER BY p.ordinal) AS text
    FROM named n LEFT JOIN {_P} p ON n.source_id = p.source_id AND n.id = p.id GROUP BY n.source_id, field_path, anchor_id)"""
_JUDGED = f"""{_FOUND},
  formed AS (SELECT *, {_FORM.format("quote")} AS q, {_FORM.format("coalesce(text, '')")} AS t, CASE WHEN starts_with(field_path, 'identity.') THEN 5 WHEN field_path = 'analysis.reasons' THEN 12 WHEN starts_with(field_path, 'outcome.') THEN 8 ELSE 2 END AS shortest FROM found),
  flagged AS (SELECT *, coalesce(contains(t, q) AND q <> '', false) AS exact, list_sort(list_filter([
      CASE WHEN q IS NULL OR length(q) < shortest THEN 'short_quote' END, CASE WHEN found < requested THEN 'unknown_passage' END, CASE WHEN found = requested AND NOT unbroken THEN 'not_contiguous' END,
      CASE WHEN NOT coalesce(contains(t, q) AND q <> '', false) THEN 'not_found' END,
      CASE WHEN (field_path = 'analysis.reasons' AND kind NOT IN ('reasons', 'argument', 'facts', 'orders')) OR (starts_with(field_path, 'outcome.') AND kind NOT IN ('orders', 'reasons', 'heading_block', 'facts', 'argument')) THEN 'kind_not_allowed' END,
      CASE WHEN field_path = 'analysis.reasons' AND speaker = 'witness' THEN 'speaker_not_allowed' END, CASE WHEN kind IS NULL THEN 'kind_missing' END], lambda x: x IS NOT NULL)) AS flags FROM formed),
  judged AS (SELECT source_id, field_path, anchor_id, flags, exact, len(list_filter(flags, lambda x: x <> 'kind_missing')) = 0 AS kept FROM flagged)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "anchors").select("source_id", "field_path", "anchor_id", "passage_ids", "quote", "kind", "speaker").distinct()


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "passages").select("source_id", "id", "ordinal", "text").distinct()


@query(f"WITH {_FOUND} SELECT source_id, field_path, anchor_id, CAST(requested AS INT) AS requested, found, unbroken FROM found")
def evidence_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contiguous(anchors(spark, sf_dir), table(spark, sf_dir, "passages").select("source_id", "id", "ordinal", F.xxhash64("text").alias("copy")).distinct())


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verdicts(anchors(spark, sf_dir), passages(spark, sf_dir), RULES)


@query(f"WITH {_JUDGED} SELECT source_id, field_path, anchor_id, array_to_string(flags, ',') AS flags, kept, exact FROM judged")
def evidence_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))


@query(f"SELECT source_id, field_path, min(anchor_id) AS anchor_id FROM (SELECT *, {_FORM.format('quote')} AS q FROM {_A}) GROUP BY source_id, field_path, q")
def evidence_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_of_each_quote(anchors(spark, sf_dir)).select("source_id", "field_path", "anchor_id")


@query(f"WITH {_JUDGED} SELECT flag, count(*) AS anchors, count(DISTINCT source_id) AS sources FROM (SELECT source_id, unnest(flags) AS flag FROM judged) GROUP BY flag")
def evidence_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = judged(spark, sf_dir).select("source_id", F.explode("flags").alias("flag"))
    return flags.groupBy("flag").agg(F.count("*").alias("anchors"), F.count_distinct("source_id").alias("sources"))


#: Raw claims as a model might give them: the label of exactness that came with the anchors sets the status.
_CLAIMS = """
  raw AS (SELECT source_id, field_path, CASE WHEN bool_or(exact_match) AND NOT bool_and(exact_match) THEN 'conflicted' WHEN bool_or(exact_match) THEN 'available' WHEN bool_or(exact_match) IS NULL THEN 'unknown' ELSE 'unavailable' END AS status,
    min(quote) AS value, count(*) / 4.0 AS confidence FROM (SELECT DISTINCT source_id, field_path, anchor_id, quote, exact_match FROM anchors) GROUP BY source_id, field_path),
  counts AS (SELECT source_id, field_path, count(*) AS n FROM judged WHERE kept GROUP BY ALL),
  checked AS (SELECT r.source_id, r.field_path, CASE WHEN status = 'available' AND coalesce(length(trim(value, ' ')) > 0, false) AND coalesce(n, 0) > 0 THEN 'available' WHEN status IN ('unavailable', 'conflicted') THEN status ELSE 'indeterminate' END AS status, value, confidence, coalesce(n, 0) AS n
    FROM raw r LEFT JOIN counts c ON r.source_id = c.source_id AND r.field_path = c.field_path)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "anchors").select("source_id", "field_path", "anchor_id", "quote", "exact_match").distinct()
    any_, all_ = F.bool_or("exact_match"), F.bool_and("exact_match")
    status = F.when(any_ & ~all_, "conflicted").when(any_, "available").when(any_.isNull(), "unknown").otherwise("unavailable")
    return rows.groupBy("source_id", "field_path").agg(status.alias("status"), F.min("quote").alias("value"), (F.count("*") / 4.0).alias("confidence"), F.lit(None).cast("array<string>").alias("conflicts"))


@query(f"""WITH {_JUDGED}, {_CLAIMS} SELECT source_id, field_path, status, CASE WHEN status IN ('available', 'conflicted') AND coalesce(length(trim(value, ' ')) > 0, false) THEN sha256(value) ELSE sha256('') END AS value,
  CASE WHEN status = 'indeterminate' THEN 0.0 ELSE CAST(confidence AS DOUBLE) END AS confidence, CASE WHEN status = 'indeterminate' THEN 0 ELSE n END AS n_evidence, CASE WHEN status = 'conflicted' THEN 'sources disagree' ELSE '' END AS conflicts FROM checked""")
def claim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = C.validated(claims(spark, sf_dir), judged(spark, sf_dir)).drop("rejected")
    return checked.withColumns({"value": F.sha2(F.col("value").cast("binary"), 256), "conflicts": F.array_join("conflicts", ",")})


REQUIRED = {"identity.docket": "critical", "outcome.orders": "material", "facts.events": "minor"}
WEIGHTS = {"identity": 30, "analysis": 30, "outcome": 20, "facts": 10, "authorities": 10}
PENALTIES = {"critical": (15, 60), "material": (3, 15), "minor": (1, 3)}


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validated(claims(spark, sf_dir), judged(spark, sf_dir))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checked(spark, sf_dir)
    missing = C.missing_fields(found, found.select("source_id").distinct(), REQUIRED)
    rejected = found.select("source_id", F.lit("anchor_rejected").alias("code"), F.lit("minor").alias("severity"), "field_path", F.explode("rejected").alias("message"))
    return C.distinct_issues(missing, rejected)


_ISSUES = """
  wanted AS (SELECT source_id, r.path AS field_path, r.severity AS severity FROM (SELECT DISTINCT source_id FROM anchors), (SELECT unnest([{path: 'identity.docket', severity: 'critical'}, {path: 'outcome.orders', severity: 'material'}, {path: 'facts.events', severity: 'minor'}]) AS r)),
  issues AS (
    SELECT source_id, 'missing_' || regexp_replace(field_path, '[^a-z]+', '_', 'g') AS code, severity, field_path, 'no evidence for ' || field_path AS message FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM checked c WHERE c.source_id = w.source_id AND c.field_path = w.field_path AND c.status = 'available')
    UNION SELECT DISTINCT source_id, 'anchor_rejected', 'minor', field_path, list_filter(flags, lambda x: x <> 'kind_missing')[1] FROM judged WHERE NOT kept)"""


@query(f"WITH {_JUDGED}, {_CLAIMS}, {_ISSUES} SELECT * FROM issues")
def claim_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir)


@query(f"WITH {_JUDGED}, {_CLAIMS}, {_ISSUES} SELECT source_id, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'material') AS n_material, count(*) FILTER (severity = 'minor') AS n_minor, bool_or(severity = 'critical') AS any_critical FROM issues GROUP BY source_id")
def claim_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import severity_counts

    return severity_counts(issues(spark, sf_dir), "source_id", ("critical", "material", "minor"))


_SHARE = "CASE WHEN count(*) FILTER (g = '{0}' AND status <> 'unavailable') > 0 THEN floor((count(*) FILTER (g = '{0}' AND status = 'available'))::DOUBLE / (count(*) FILTER (g = '{0}' AND status <> 'unavailable')) * {1} + 0.5) ELSE 0 END"
_SCORES = f"""
  scores AS (SELECT source_id, CAST({" + ".join(_SHARE.format(g, w) for g, w in WEIGHTS.items())} AS BIGINT) AS score FROM (SELECT *, string_split(field_path, '.')[1] AS g FROM checked) GROUP BY source_id),
  lost AS (SELECT source_id, CAST(least(count(*) FILTER (severity = 'critical') * 15, 60) + least(count(*) FILTER (severity = 'material') * 3, 15) + least(count(*) FILTER (severity = 'minor'), 3) AS BIGINT) AS penalty FROM issues GROUP BY source_id),
  final AS (SELECT source_id, score, coalesce(penalty, 0) AS penalty, greatest(0, least(100, score - coalesce(penalty, 0))) AS final FROM scores LEFT JOIN lost USING (source_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score_sheet(checked(spark, sf_dir), WEIGHTS, REQUIRED, PENALTIES, "minor")


@query(f"WITH {_JUDGED}, {_CLAIMS}, {_ISSUES}, {_SCORES} SELECT *, CASE WHEN final >= 40 THEN 'continue' ELSE 'skipped' END AS outcome FROM final")
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gate(scored(spark, sf_dir), 40, "skipped")


@query("""
SELECT source_id, field_path, CASE WHEN version_n >= version_o THEN new_value ELSE old_value END AS value, greatest(version_n, version_o) AS version FROM (
  SELECT source_id, field_path, min(kind) AS old_value, max(speaker) AS new_value, 1 AS version_o, CAST(1 + count(*) % 2 AS INT) AS version_n FROM (SELECT DISTINCT source_id, field_path, anchor_id, kind, speaker FROM anchors) GROUP BY source_id, field_path)
""")
def claim_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "anchors").select("source_id", "field_path", "anchor_id", "kind", "speaker").distinct().groupBy("source_id", "field_path")
    old = rows.agg(F.min("kind").alias("value"), F.lit(1).alias("version"))
    new = rows.agg(F.max("speaker").alias("value"), (F.lit(1) + F.count("*") % 2).cast("int").alias("version"))
    return C.upsert(old, new)


@query("""
WITH t AS (SELECT source_id, kind AS tag, field_path, anchor_id, 0 AS part FROM anchors UNION ALL SELECT source_id, upper(speaker), field_path, anchor_id, 1 FROM anchors UNION ALL SELECT source_id, speaker, field_path, anchor_id, 2 FROM anchors),
  f AS (SELECT source_id, lower(trim(tag)) AS folded, min({p: part, f: field_path, a: anchor_id, t: trim(tag)}) AS best FROM t WHERE trim(tag) <> '' GROUP BY source_id, lower(trim(tag)))
SELECT source_id, tag, rank FROM (SELECT source_id, best.t AS tag, CAST(row_number() OVER (PARTITION BY source_id ORDER BY best) AS INT) AS rank FROM f) WHERE rank <= 6
""")
def facet_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "anchors")
    part = lambda c, i: a.select("source_id", c.alias("tag"), F.lit(i).alias("part"), "field_path", "anchor_id")
    union = part(F.col("kind"), 0).unionByName(part(F.upper("speaker"), 1)).unionByName(part(F.col("speaker"), 2))
    return facets.gathered(union, "source_id", F.col("tag"), ("part", "field_path", "anchor_id")).where("rank <= 6")


@query("""
SELECT url, array_to_string(list_filter(tags, lambda x, i: list_position(list_transform(tags, lambda y: lower(translate(y, 'ΣςİIı', 'σσiii'))), lower(translate(x, 'ΣςİIı', 'σσiii'))) = i)[1:5], '|') AS tags
FROM (SELECT url, list_filter(list_transform(string_split_regex(title, '[ ,]+'), lambda x: trim(x)), lambda x: x <> '') AS tags FROM (SELECT DISTINCT url, title FROM diagnostics WHERE title IS NOT NULL))
""")
def facet_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five words of every title, once each whatever their case."""
    d = table(spark, sf_dir, "diagnostics").select("url", "title").distinct().where("title is not null")
    return d.select("url", F.array_join(facets.facet([F.split("title", "[ ,]+")], 5), "|").alias("tags"))


@query("""
SELECT source_id, field_path, CAST(row_number() OVER (PARTITION BY source_id ORDER BY CAST(regexp_extract(field_path, '\\d+') AS INT)) AS INT) AS position
FROM (SELECT DISTINCT source_id, supports[1] AS field_path FROM anchors WHERE starts_with(supports[1], 'analysis.issues['))
""")
def facet_numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = table(spark, sf_dir, "anchors").select("source_id", F.get("supports", F.lit(0)).alias("field_path")).where("field_path like 'analysis.issues[%'").distinct()
    return a.select("source_id", "field_path", F.row_number().over(Window.partitionBy("source_id").orderBy(facets.numeric_aware(F.col("field_path")))).alias("position"))
