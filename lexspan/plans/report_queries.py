"""Batch reports, metrics rows, limits and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import limiter, report, timeline
from .evidence_queries import _CLAIMS, _ISSUES, _JUDGED, _SCORES, issues, scored
from .registry import query, table


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat row for each diagnosed document; a missing length or count is a failure."""
    d = table(spark, sf_dir, "diagnostics").distinct()
    return d.select("url", "title", "n_passages", F.col("passage_chars"), F.col("length.maximum").alias("longest"), "n_at_max", F.col("length").isNotNull().alias("ok"), (F.col("html_chars") / 1000.0).alias("seconds"))


@query("""
SELECT count(*) AS attempted, count(*) FILTER (length IS NOT NULL) AS succeeded, count(*) FILTER (length IS NULL) AS failed, count(*) FILTER (length IS NOT NULL AND coalesce(n_at_max, 0) = 0) AS strict,
  CAST(floor(avg(CASE WHEN length IS NOT NULL THEN floor(n_passages + 0.5) END) + 0.5) AS BIGINT) AS mean_passages, CAST(floor(avg(CASE WHEN length IS NOT NULL THEN floor(html_chars / 1000.0 + 0.5) END) + 0.5) AS BIGINT) AS mean_seconds
FROM (SELECT DISTINCT * FROM diagnostics)
""")
def report_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    return report.batch_summary(m, F.col("ok"), {"passages": F.col("n_passages"), "seconds": F.col("seconds")}, F.coalesce("n_at_max", F.lit(0)) == 0)


@query("""
SELECT * FROM (SELECT -2 AS position, '| title | n_passages | longest |' AS line UNION ALL SELECT -1, '|---|---|---|' UNION ALL
  SELECT position, '| ' || replace(substr(coalesce(title, ''), 1, 60), '|', '/') || ' | ' || n_passages || ' | ' || coalesce(CAST(longest AS VARCHAR), '') || ' |' FROM (
    SELECT title, n_passages, length.maximum AS longest, row_number() OVER (ORDER BY url, generated_at, n_at_max, html_chars, length.maximum) AS position FROM (SELECT DISTINCT * FROM diagnostics)))
""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each diagnosed document."""
    d = table(spark, sf_dir, "diagnostics").distinct().select("title", "n_passages", F.col("length.maximum").alias("longest"), "url", "generated_at", "n_at_max", "html_chars")
    placed = report.numbered_lines(d, ("url", "generated_at", "n_at_max", "html_chars", "longest"))
    return report.markdown_table(placed, "position", ("title", "n_passages", "longest"))


def _escaped(c: str) -> str:
    return f"""replace(replace(replace(replace(replace(coalesce(CAST({c} AS VARCHAR), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


@query(f"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY url, generated_at, n_at_max, html_chars, length.maximum) AS position FROM (SELECT DISTINCT * FROM diagnostics))
SELECT 0 AS position, '<table><tr><th>title</th><th>n_passages</th><th>longest</th></tr>' AS line UNION ALL SELECT count(*) + 1, '</table>' FROM d UNION ALL
SELECT position, '<tr><td>' || {_escaped("title")} || CASE WHEN length IS NULL THEN '</td><td colspan="2" class="failed">no lengths of ' || {_escaped("url")} || '</td></tr>' ELSE '</td><td>' || {_escaped("n_passages")} || '</td><td>' || {_escaped("length.maximum")} || '</td></tr>' END FROM d
""")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each diagnosed document; one without lengths is a failure and says so."""
    d = table(spark, sf_dir, "diagnostics").distinct().select("title", "n_passages", F.col("length.maximum").alias("longest"), "url", "generated_at", "n_at_max", "html_chars", F.col("length").isNull().alias("failed"))
    placed = report.numbered_lines(d, ("url", "generated_at", "n_at_max", "html_chars", "longest"))
    return report.html_table(placed, "position", ("title", "n_passages", "longest"), F.col("failed"), F.concat(F.lit("no lengths of "), F.coalesce("url", F.lit(""))))


@query("""
SELECT DISTINCT source_id, url, '[omitted: ' || length(original_html) || ' characters]' AS original_html, '[omitted: ' || length(clean_text) || ' characters]' AS clean_text FROM judgments
""")
def report_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments without their long texts, the raw lengths and times dropped."""
    j = table(spark, sf_dir, "judgments").select("source_id", "url", "original_html", "clean_text", "n_chars", "retrieved_at")
    return report.compacted(j, ("original_html", "clean_text"), ("n_chars", "retrieved_at")).distinct()


@query(f"WITH {_JUDGED}, {_CLAIMS}, {_ISSUES}, {_SCORES} SELECT CAST(final // 10 AS BIGINT) AS decile, count(*) AS documents, CAST(sum(penalty) AS BIGINT) AS penalties, count(*) FILTER (final >= 40) AS passed FROM final GROUP BY 1")
def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("decile", F.floor(F.col("final") / 10))
    return s.groupBy("decile").agg(F.count("*").alias("documents"), F.sum("penalty").alias("penalties"), F.count_if(F.col("final") >= 40).alias("passed"))


@query(f"""WITH {_JUDGED}, {_CLAIMS}, {_ISSUES},
  first AS (SELECT source_id, title FROM (SELECT source_id, title, row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at NULLS FIRST, title NULLS FIRST) AS k FROM judgments) WHERE k = 1),
  size AS (SELECT source_id, length(max(clean_text)) AS n FROM judgments GROUP BY source_id),
  per AS (SELECT source_id, '[' || string_agg('{{"code":' || to_json(code) || ',"severity":' || to_json(severity) || ',"field_path":' || to_json(field_path) || '}}', ',' ORDER BY code, severity, field_path) || ']' AS issues FROM issues GROUP BY source_id)
SELECT f.source_id, '{{' || concat_ws(',', '"title":' || to_json(title), '"text":"[omitted: ' || n || ' characters]"', '"issues":' || issues) || '}}' AS record FROM first f JOIN size s ON s.source_id = f.source_id LEFT JOIN per p ON p.source_id = f.source_id""")
def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record a document, long texts left out, its issues inside."""
    per = issues(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("code", "severity", "field_path"))).alias("issues"))
    j = table(spark, sf_dir, "judgments").groupBy("source_id").agg(F.min_by("title", F.struct("retrieved_at", "title")).alias("title"), F.max("clean_text").alias("t"))
    record = F.struct("title", F.concat(F.lit("[omitted: "), F.length("t").cast("string"), F.lit(" characters]")).alias("text"), "issues")
    return j.join(per, "source_id", "left").select("source_id", F.to_json(record).alias("record"))


def limited_sql(micros: int, most: int) -> str:
    """The sliding log in SQL: accepted times within the span are kept; rejected requests leave no trace."""
    live = f"list_filter(f.log, lambda x: r.t - x < {micros})"
    return f"""WITH RECURSIVE r AS (SELECT *, coalesce(client, '') AS c, epoch_us(requested_at) AS t, row_number() OVER (PARTITION BY coalesce(client, '') ORDER BY requested_at, job_id, kind, received_at) AS n FROM (SELECT DISTINCT * FROM job_requests)),
  f AS (SELECT c, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS log, true AS ok FROM (SELECT DISTINCT c FROM r)
    UNION ALL SELECT f.c, r.n, CASE WHEN len({live}) < {most} THEN list_append({live}, r.t) ELSE {live} END, len({live}) < {most} FROM f JOIN r ON r.c = f.c AND r.n = f.n + 1)
SELECT r.job_id, r.client, r.kind, r.requested_at, r.received_at, f.ok AS accepted FROM r JOIN f ON f.c = r.c AND f.n = r.n"""


@query(limited_sql(3_600_000_000, 12))
def state_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve accepted requests an hour for each client."""
    r = table(spark, sf_dir, "job_requests").distinct()
    return limiter.sliding_log(r, "client", "requested_at", ["job_id", "kind", "received_at"]).select("job_id", "client", "kind", "requested_at", "received_at", "accepted")


@query("""
WITH RECURSIVE r AS (SELECT coalesce(client, '') AS c, epoch_us(requested_at) AS t, row_number() OVER (PARTITION BY coalesce(client, '') ORDER BY requested_at, job_id, kind, received_at) AS n FROM (SELECT DISTINCT * FROM job_requests)),
  f AS (SELECT c, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS log, true AS ok FROM (SELECT DISTINCT c FROM r)
    UNION ALL SELECT f.c, r.n, CASE WHEN len(list_filter(f.log, lambda x: r.t - x < 3600000000)) < 12 THEN list_append(list_filter(f.log, lambda x: r.t - x < 3600000000), r.t) ELSE list_filter(f.log, lambda x: r.t - x < 3600000000) END,
      len(list_filter(f.log, lambda x: r.t - x < 3600000000)) < 12 FROM f JOIN r ON r.c = f.c AND r.n = f.n + 1)
SELECT c AS client, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM f WHERE n > 0 GROUP BY c
""")
def state_rate_limit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = state_rate_limit(spark, sf_dir)
    return decided.groupBy(F.coalesce("client", F.lit("")).alias("client")).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


STEPS = [(0, "preparing", 5), (60, "labelling", 30), (240, "extracting", 60), (600, "reviewing", 90)]


@query("""
SELECT job_id, kind, requested_at, elapsed, stage, max(p) OVER (PARTITION BY job_id ORDER BY requested_at, kind, received_at ROWS UNBOUNDED PRECEDING) AS progress FROM (
  SELECT *, CASE WHEN elapsed >= 600 THEN 'reviewing' WHEN elapsed >= 240 THEN 'extracting' WHEN elapsed >= 60 THEN 'labelling' ELSE 'preparing' END AS stage, CAST(CASE WHEN elapsed >= 600 THEN 90 WHEN elapsed >= 240 THEN 60 WHEN elapsed >= 60 THEN 30 ELSE 5 END AS INT) AS p
  FROM (SELECT *, (epoch_us(requested_at) - min(epoch_us(requested_at)) OVER (PARTITION BY job_id)) // 1000000 AS elapsed FROM (SELECT DISTINCT job_id, kind, requested_at, received_at FROM job_requests)))
""")
def state_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "job_requests").select("job_id", "kind", "requested_at", "received_at").distinct()
    return timeline.progress_log(r, "job_id", "requested_at", ["kind", "received_at"], STEPS).select("job_id", "kind", "requested_at", "elapsed", "stage", "progress")


_STATES = """SELECT job_id, created_at, last_at, CASE WHEN created_at IS NULL THEN 'unknown' WHEN cancel IS NOT NULL AND cancel >= created_at AND epoch_us(cancel) <= epoch_us(created_at) + 720000000 THEN 'cancelled' WHEN epoch_us(last_at) > epoch_us(created_at) + 720000000 THEN 'timed_out' ELSE 'open' END AS state
  FROM (SELECT job_id, min(requested_at) FILTER (kind = 'create') AS created_at, min(requested_at) FILTER (kind = 'cancel') AS cancel, max(requested_at) AS last_at FROM job_requests GROUP BY job_id)"""


@query(_STATES)
def state_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.final_states(table(spark, sf_dir, "job_requests"), "job_id", "requested_at", "kind", 720)


@query(f"SELECT job_id, last_at FROM ({_STATES}) WHERE epoch_us(TIMESTAMPTZ '2024-01-01 00:00:00+00') - epoch_us(last_at) > 7200000000")
def state_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-01T00:00:00Z"))
    return timeline.expired(state_jobs(spark, sf_dir), now, 7200).select("job_id", "last_at")


@query("SELECT client, count(*) AS requests, count(DISTINCT job_id) AS jobs, count(*) FILTER (kind = 'create') AS created FROM (SELECT DISTINCT * FROM job_requests) GROUP BY client")
def state_client_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "job_requests").distinct()
    return r.groupBy("client").agg(F.count("*").alias("requests"), F.count_distinct("job_id").alias("jobs"), F.count_if(F.col("kind") == "create").alias("created"))
