"""Windows, votes, spans: candidates here come from plain rules over passages, where a model would give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, spans, windows
from ..operators.lineage import cut
from .registry import query, table


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a passage: the least text where copies differ in nothing that counts here."""
    return table(spark, sf_dir, "passages").select("source_id", "ordinal", "text").distinct()


_P = "(SELECT DISTINCT source_id, ordinal, text FROM passages)"


@query(f"""
WITH RECURSIVE s AS (SELECT source_id, list(ordinal ORDER BY ordinal) AS o, list(length(coalesce(text, '')) + 120 ORDER BY ordinal) AS c FROM {_P} GROUP BY source_id HAVING sum(length(coalesce(text, '')) + 120) <= 64 * 5620),
  t AS (SELECT source_id, o, list_transform(range(1, len(c) + 1), lambda i: list_sum(c[1:i])) AS a, len(c) AS n FROM s),
  w AS (
    SELECT source_id, 0 AS idx, 1 AS f, greatest(1, len(list_filter(a, lambda x: x <= 5500))) AS l FROM t
    UNION ALL
    SELECT source_id, idx + 1, f2, greatest(f2, len(list_filter(a, lambda x: x - a[f2 - 1] <= 5500))) FROM (
      SELECT w.source_id, w.idx, t.a, greatest(least(w.l + 1, w.f + 12), greatest(w.f, w.l - 7, len(list_filter(t.a, lambda x: t.a[w.l] - x >= 900)) + 1)) AS f2
      FROM w JOIN t USING (source_id) WHERE w.l < t.n))
SELECT source_id, CAST(idx AS INT) AS window_idx, o[f] AS first_ordinal, o[l] AS last_ordinal, CAST(NULL AS VARCHAR) AS error FROM w JOIN t USING (source_id)
UNION ALL
SELECT source_id, NULL, NULL, NULL, 'too_many_windows' FROM {_P} GROUP BY source_id HAVING sum(length(coalesce(text, '')) + 120) > 64 * 5620
""")
def window_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "passages").select("source_id", "ordinal", F.length(F.coalesce("text", F.lit(""))).alias("chars")).distinct()
    return windows.windows(sized, chars="chars")


@query(f"""
SELECT source_id, ordinal, rn, n, least(rn - 1, n - rn) AS from_edge FROM (
  SELECT source_id, ordinal, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM {_P})
WHERE rn <= 40 OR n - rn < 60
""")
def window_head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 and last 60 passages of each document, the numbering spread over ranges."""
    numbered = ordered.numbered(table(spark, sf_dir, "passages").select("source_id", "ordinal").distinct(), "source_id", "ordinal")
    near = numbered.where("rn <= 40 or n - rn < 60")
    return near.select("source_id", "ordinal", "rn", "n", F.least(F.col("rn") - 1, F.col("n") - F.col("rn")).alias("from_edge"))


STEP, REACH = 8, 12
_KIND = "CASE WHEN regexp_matches(text, '^\\s*[«“„\"]') THEN 'quotation' WHEN regexp_matches(text, '^\\s*\\(?\\d+[.)]') THEN 'list' WHEN length(text) <= 40 THEN 'heading' ELSE 'body' END"
_SPEAKER = "CASE WHEN regexp_matches(text, '^[QΕ]\\. ') THEN 'counsel' WHEN regexp_matches(text, '^[AΑ]\\. ') THEN 'witness' ELSE 'unknown' END"
#: Runs of one label within each of the windows [8k + 1, 8k + 12] are its candidates.
_CANDIDATES = f"""
  in_window AS (SELECT source_id, ordinal, {_KIND} AS kind, {_SPEAKER} AS speaker, k AS window_idx FROM (
    SELECT source_id, ordinal, text, unnest(range(CAST(greatest(0, (ordinal - 5) // 8) AS BIGINT), (ordinal - 1) // 8 + 1)) AS k FROM {_P} WHERE text IS NOT NULL AND ordinal >= 1) WHERE ordinal > 8 * k AND ordinal <= 8 * k + 12),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id, window_idx ORDER BY ordinal) - row_number() OVER (PARTITION BY source_id, window_idx, kind, speaker ORDER BY ordinal) AS island FROM in_window),
  candidates AS (SELECT source_id, CAST(window_idx AS BIGINT) AS window_idx, kind, speaker, min(ordinal) AS start_ordinal, max(ordinal) AS end_ordinal, min(ordinal) AS seq, 0.5 + least(count(*), 5) * 0.08 AS confidence FROM numbered GROUP BY source_id, window_idx, kind, speaker, island)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    text = F.col("text")
    kind = F.when(F.regexp_like(text, F.lit('^\\s*[«“„"]')), "quotation").when(F.regexp_like(text, F.lit("^\\s*\\(?\\d+[.)]")), "list").when(F.length(text) <= 40, "heading").otherwise("body")
    speaker = F.when(F.regexp_like(text, F.lit("^[QΕ]\\. ")), "counsel").when(F.regexp_like(text, F.lit("^[AΑ]\\. ")), "witness").otherwise("unknown")
    last = F.floor((F.col("ordinal") - 1) / STEP)
    labels = table(spark, sf_dir, "passages").where("text is not null and ordinal >= 1").select("source_id", "ordinal", kind.alias("kind"), speaker.alias("speaker")).distinct()
    p = labels.select("source_id", "ordinal", "kind", "speaker", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("ordinal") - 5) / STEP)), last)).alias("window_idx"))
    p = p.where((F.col("ordinal") > STEP * F.col("window_idx")) & (F.col("ordinal") <= STEP * F.col("window_idx") + REACH))
    w = Window.partitionBy("source_id", "window_idx").orderBy("ordinal")
    runs = p.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("source_id", "window_idx", "kind", "speaker").orderBy("ordinal")))
    return runs.groupBy("source_id", "window_idx", "kind", "speaker", "island").agg(
        F.min("ordinal").alias("start_ordinal"), F.max("ordinal").alias("end_ordinal"), F.min("ordinal").alias("seq"), (F.lit(0.5) + F.least(F.count("*"), F.lit(5)) * 0.08).alias("confidence"), F.lit("").alias("heading")
    ).drop("island")


_VOTES = """
  votes AS (SELECT source_id, ordinal, kind, speaker, round(sum(confidence + CASE WHEN least(ordinal - start_ordinal, end_ordinal - ordinal) >= 2 THEN 0.03 ELSE 0 END), 9) AS score, count(*) AS votes, min({w: window_idx, s: seq}) AS first_seq
    FROM (SELECT *, unnest(range(start_ordinal, end_ordinal + 1)) AS ordinal FROM candidates) GROUP BY source_id, ordinal, kind, speaker)"""
_ASSIGNED = f"""
  ranked AS (SELECT *, score / votes AS mean, row_number() OVER w AS rank, lead(score / votes) OVER w AS second FROM votes WINDOW w AS (PARTITION BY source_id, ordinal ORDER BY round(score + least(0.2, (votes - 1) * 0.08), 9) DESC, first_seq)),
  assigned AS (SELECT p.source_id, p.ordinal, coalesce(r.kind, 'other') AS kind, coalesce(r.speaker, 'unknown') AS speaker, coalesce(r.mean, 0.25) AS mean, r.kind IS NOT NULL AS voted, coalesce(r.second IS NOT NULL AND abs(r.mean - r.second) < 0.08, false) AS doubtful
    FROM (SELECT DISTINCT source_id, ordinal FROM passages) p LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (source_id, ordinal))"""


@query(f"WITH {_CANDIDATES} SELECT source_id, window_idx, kind, speaker, start_ordinal, end_ordinal, round(confidence, 6) AS confidence FROM candidates")
def span_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("source_id", "window_idx", "kind", "speaker", "start_ordinal", "end_ordinal", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_CANDIDATES} SELECT source_id, seq, kind, CASE WHEN source_id IS NULL OR least(s, e) <= 8 * window_idx OR greatest(s, e) > 8 * window_idx + 12 THEN 'outside_window' WHEN s > e THEN 'reversed' END AS flag, CAST(least(s, e) AS INT) AS start_ordinal, CAST(greatest(s, e) AS INT) AS end_ordinal, window_idx, speaker FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN end_ordinal ELSE start_ordinal END AS s, CASE WHEN seq % 3 = 0 THEN start_ordinal WHEN seq % 5 = 0 THEN end_ordinal + 12 ELSE end_ordinal END AS e FROM candidates)")
def span_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with some ranges reversed and some reaching out of their window, to show what becomes of them."""
    c = candidates(spark, sf_dir)
    third, fifth = F.col("seq") % 3 == 0, F.col("seq") % 5 == 0
    spoiled = c.withColumn("s", F.when(third, F.col("end_ordinal")).otherwise(F.col("start_ordinal"))).withColumn("e", F.when(third, F.col("start_ordinal")).when(fifth, F.col("end_ordinal") + 12).otherwise(F.col("end_ordinal")))
    spoiled = spoiled.drop("start_ordinal", "end_ordinal").withColumnsRenamed({"s": "start_ordinal", "e": "end_ordinal"})
    w = c.select("source_id", "window_idx").distinct().select("source_id", "window_idx", (F.col("window_idx") * STEP + 1).alias("first_ordinal"), (F.col("window_idx") * STEP + REACH).alias("last_ordinal"))
    return spans.valid_candidates(spoiled, w).select("source_id", "window_idx", "seq", "kind", "speaker", "flag", "start_ordinal", "end_ordinal")


@query(f"WITH {_CANDIDATES}, {_VOTES} SELECT source_id, ordinal, kind, speaker, round(score, 6) AS score, votes FROM votes")
def span_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.votes(candidates(spark, sf_dir)).select("source_id", "ordinal", "kind", "speaker", F.round("score", 6).alias("score"), "votes")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.assignments(table(spark, sf_dir, "passages").select("source_id", "ordinal").distinct(), spans.votes(candidates(spark, sf_dir)))


@query(f"WITH {_CANDIDATES}, {_VOTES}, {_ASSIGNED} SELECT source_id, ordinal, kind, speaker, round(mean, 6) AS mean, voted, doubtful FROM assigned")
def span_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("source_id", "ordinal", "kind", "speaker", F.round("mean", 6).alias("mean"), "voted", "doubtful")


@query(f"""
WITH {_CANDIDATES}, {_VOTES}, {_ASSIGNED},
  runs AS (SELECT *, sum(starts) OVER (PARTITION BY source_id ORDER BY ordinal) AS span_no FROM (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL OR kind <> lag(kind) OVER w OR speaker <> lag(speaker) OVER w THEN 1 ELSE 0 END AS starts FROM assigned WINDOW w AS (PARTITION BY source_id ORDER BY ordinal)))
SELECT source_id, CAST(span_no AS BIGINT) AS span_no, kind, speaker, min(ordinal) AS start_ordinal, max(ordinal) AS end_ordinal, count(*) AS passages FROM runs GROUP BY source_id, span_no, kind, speaker
""")
def span_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.islands(assigned(spark, sf_dir)).select("source_id", "span_no", "kind", "speaker", "start_ordinal", "end_ordinal", "passages")


#: The fold in SQL: from left to right, up to three absorbable places at a time.
_SMOOTHED = f"""
  marks AS (SELECT a.*, NOT voted OR coalesce(regexp_matches(p.text, '^[\\s_\\-–—=·•.*]{{3,}}$'), false) AS soft FROM assigned a LEFT JOIN {_P} p ON p.source_id = a.source_id AND p.ordinal = a.ordinal),
  lists AS (SELECT source_id, list(ordinal ORDER BY ordinal) AS o, list(kind || chr(31) || speaker ORDER BY ordinal) AS l, list(soft ORDER BY ordinal) AS s, count(*) AS n FROM marks GROUP BY source_id),
  fold AS (SELECT source_id, CAST(1 AS BIGINT) AS pos, l AS done FROM lists
    UNION ALL
    SELECT source_id, upto + 1, CASE WHEN soft AND pos > 1 AND upto < n AND done[pos - 1] = done[upto + 1] AND done[pos] <> done[pos - 1] THEN list_concat(list_concat(done[1 : pos - 1], list_transform(range(pos, upto + 1), lambda i: done[pos - 1])), done[upto + 1 : n]) ELSE done END
    FROM (SELECT f.source_id, f.pos, f.done, k.n, k.s[f.pos] AS soft, CASE WHEN NOT k.s[f.pos] OR f.pos + 1 > k.n OR NOT k.s[f.pos + 1] THEN f.pos WHEN f.pos + 2 > k.n OR NOT k.s[f.pos + 2] THEN f.pos + 1 ELSE f.pos + 2 END AS upto FROM fold f JOIN lists k ON k.source_id = f.source_id WHERE f.pos <= k.n)),
  smooth AS (SELECT source_id, o[i] AS ordinal, string_split(done[i], chr(31))[1] AS kind, string_split(done[i], chr(31))[2] AS speaker, done[i] <> l[i] AS changed FROM (
    SELECT f.source_id, f.done, k.o, k.l, unnest(range(1, k.n + 1)) AS i FROM fold f JOIN lists k ON k.source_id = f.source_id WHERE f.pos > k.n))"""
#: Runs of the smoothed labels, then one after the other merged into the span before where that is possible.
_MERGED = """
  runs AS (SELECT *, sum(starts) OVER (PARTITION BY source_id ORDER BY ordinal) AS span_no FROM (SELECT s.*, a.mean, CASE WHEN lag(s.ordinal) OVER w IS NULL OR s.kind <> lag(s.kind) OVER w OR s.speaker <> lag(s.speaker) OVER w THEN 1 ELSE 0 END AS starts FROM smooth s JOIN assigned a ON a.source_id = s.source_id AND a.ordinal = s.ordinal WINDOW w AS (PARTITION BY s.source_id ORDER BY s.ordinal))),
  spans AS (SELECT source_id, CAST(span_no AS BIGINT) AS no, kind, speaker, min(ordinal) AS a, max(ordinal) AS b, floor(avg(mean) * 10000 + 0.5) / 10000.0 AS confidence, count(*) AS n FROM runs GROUP BY source_id, span_no, kind, speaker),
  join_ AS (SELECT source_id, no, CAST(1 AS BIGINT) AS grp, kind, speaker, a, b, CAST(confidence AS DOUBLE) AS confidence, n FROM spans WHERE no = 1
    UNION ALL
    SELECT source_id, no, CASE WHEN voice IS NULL THEN grp + 1 ELSE grp END, kind, coalesce(voice, mine), CASE WHEN voice IS NULL THEN a2 ELSE a END, b2, CASE WHEN voice IS NULL THEN c2 ELSE floor((confidence * n + c2 * n2) / (n + n2) * 10000 + 0.5) / 10000.0 END, CASE WHEN voice IS NULL THEN n2 ELSE n + n2 END
    FROM (SELECT j.source_id, s.no, j.grp, s.kind, s.speaker AS mine, j.a, s.a AS a2, s.b AS b2, j.confidence, s.confidence AS c2, j.n, s.n AS n2,
        CASE WHEN j.kind <> s.kind THEN NULL WHEN j.speaker = s.speaker OR s.speaker = 'unknown' THEN j.speaker WHEN j.speaker = 'unknown' THEN s.speaker WHEN least(j.speaker, s.speaker) = 'counsel' AND greatest(j.speaker, s.speaker) = 'witness' THEN 'hearing' END AS voice
      FROM join_ j JOIN spans s ON s.source_id = j.source_id AND s.no = j.no + 1)),
  merged AS (SELECT source_id, grp, arg_max(kind, no) AS kind, arg_max(speaker, no) AS speaker, max(a) AS a, max(b) AS b, arg_max(confidence, no) AS confidence, max(n) AS n FROM join_ GROUP BY source_id, grp)"""


@query(f"WITH RECURSIVE {_CANDIDATES}, {_VOTES}, {_ASSIGNED}, {_SMOOTHED} SELECT source_id, ordinal, kind, speaker, changed FROM smooth")
def span_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.smoothed(cut(assigned(spark, sf_dir)), table(spark, sf_dir, "passages")).select("source_id", "ordinal", "kind", "speaker", "changed")


@query(f"""WITH RECURSIVE {_CANDIDATES}, {_VOTES}, {_ASSIGNED}, {_SMOOTHED}, {_MERGED}
SELECT source_id, 'S' || lpad(CAST(grp AS VARCHAR), 5, '0') AS span_id, kind, speaker, a AS start_ordinal, b AS end_ordinal, round(confidence, 3) AS confidence, n AS passages FROM merged""")
def span_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_spans(spark, sf_dir).withColumn("confidence", F.round("confidence", 3)).drop("heading")


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every step reads its input twice, rows and summaries of ranges: what a step gives is written once
    smooth = cut(spans.smoothed(cut(assigned(spark, sf_dir)), table(spark, sf_dir, "passages")).drop("changed"))
    return spans.merged(cut(spans.islands(smooth)), pairs={frozenset(("counsel", "witness")): "hearing"})


@query(f"""WITH RECURSIVE {_CANDIDATES}, {_VOTES}, {_ASSIGNED}, {_SMOOTHED}, {_MERGED},
  spoiled AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY a) AS k, count(*) OVER (PARTITION BY source_id) AS m FROM merged),
  kept AS (SELECT * FROM spoiled WHERE NOT (m % 2 = 0 AND k = m)),
  ends AS (SELECT source_id, min(ordinal) AS f, max(ordinal) AS l, count(*) AS n FROM (SELECT DISTINCT source_id, ordinal FROM passages) GROUP BY source_id),
  got AS (SELECT source_id, min(a) AS f, max(b) AS l, sum(n) AS n FROM kept GROUP BY source_id)
SELECT e.source_id, coalesce(e.f = g.f AND e.l = g.l, false) AS complete, coalesce(e.n = g.n, false) AS overlap_free FROM ends e LEFT JOIN got g ON g.source_id = e.source_id""")
def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by merged spans, of which every second document has lost its last, to show what becomes of it."""
    merged = merged_spans(spark, sf_dir)
    sized = merged.groupBy("source_id").agg(F.count("*").alias("__m"), F.max("start_ordinal").alias("__last"))
    kept = merged.join(sized, "source_id").where("not (__m % 2 = 0 and start_ordinal = __last)").drop("__m", "__last")
    return spans.covers(kept, table(spark, sf_dir, "passages").select("source_id", "ordinal").distinct())


_REASONED = """
  reasoned AS (SELECT *, kind || ' by ' || speaker || repeat('!', CAST(seq % 4 AS INT)) AS rationale, [ 'P' || lpad(CAST(start_ordinal AS VARCHAR), 6, '0'), 'P' || lpad(CAST(end_ordinal AS VARCHAR), 6, '0')] AS ids FROM candidates),
  said AS (SELECT source_id, ordinal, kind, speaker, arg_max(rationale, {a: length(rationale), b: -window_idx, c: -seq}) AS rationale, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM (SELECT *, unnest(range(start_ordinal, end_ordinal + 1)) AS ordinal FROM reasoned) GROUP BY ALL)"""


def reasoned_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = F.concat("kind", F.lit(" by "), "speaker", F.expr("repeat('!', cast(seq % 4 as int))"))
    ids = F.array(F.format_string("P%06d", "start_ordinal"), F.format_string("P%06d", "end_ordinal"))
    return spans.votes(candidates(spark, sf_dir).withColumns({"rationale": why, "evidence_ids": ids}))


@query(f"WITH {_CANDIDATES}, {_REASONED} SELECT source_id, ordinal, kind, speaker, rationale, array_to_string(ids, ',') AS evidence_ids FROM said")
def span_vote_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rationale and the evidence ids of each label over each passage."""
    return reasoned_votes(spark, sf_dir).select("source_id", "ordinal", "kind", "speaker", "rationale", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query(f"""
WITH {_CANDIDATES}, {_VOTES}, {_ASSIGNED}, {_REASONED},
  runs AS (SELECT *, sum(starts) OVER (PARTITION BY source_id ORDER BY ordinal) AS span_no FROM (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL OR kind <> lag(kind) OVER w OR speaker <> lag(speaker) OVER w THEN 1 ELSE 0 END AS starts FROM assigned WINDOW w AS (PARTITION BY source_id ORDER BY ordinal))),
  met AS (SELECT r.source_id, CAST(span_no AS BIGINT) AS span_no, s.ordinal, s.rationale, s.ids FROM runs r JOIN said s ON s.source_id = r.source_id AND s.ordinal = r.ordinal AND s.kind = r.kind AND s.speaker = r.speaker)
SELECT source_id, span_no, arg_max(rationale, {{a: length(rationale), b: -ordinal, c: rationale}}) AS rationale, array_to_string(list_sort(list_distinct(flatten(list(ids))))[1:16], ',') AS evidence_ids FROM met GROUP BY source_id, span_no
""")
def span_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span's longest rationale and first sixteen evidence ids."""
    voted = reasoned_votes(spark, sf_dir)
    runs = spans.islands(spans.assignments(table(spark, sf_dir, "passages").select("source_id", "ordinal").distinct(), voted))
    return spans.evidence_of_spans(runs, voted).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_NOTE, _REFERENCE = r"^\s*[\[(]?(\d+)[.)\]]", r"(?:παρ\.|para\.|Τεκμ\.|τεκμήριο|exhibit|section) (\d+)"


@query(f"""
WITH {_CANDIDATES}, {_VOTES}, {_ASSIGNED},
  notes AS (SELECT source_id, ordinal, regexp_extract(text, '^\\s*[\\[(]?(\\d+)[.)\\]]', 1) AS marker FROM {_P} WHERE regexp_extract(text, '^\\s*[\\[(]?(\\d+)[.)\\]]', 1) <> ''),
  refs AS (SELECT DISTINCT source_id, ordinal AS from_ordinal, unnest(regexp_extract_all(text, '(?:παρ\\.|para\\.|Τεκμ\\.|τεκμήριο|exhibit|section) (\\d+)', 1)) AS marker FROM {_P}),
  noted AS (SELECT DISTINCT n.source_id, n.ordinal FROM notes n JOIN refs r ON r.source_id = n.source_id AND r.marker = n.marker WHERE from_ordinal < n.ordinal AND from_ordinal >= n.ordinal - 400)
SELECT a.source_id, a.ordinal, CASE WHEN n.ordinal IS NOT NULL AND kind = 'list' THEN 'law' ELSE kind END AS kind, round(CASE WHEN n.ordinal IS NOT NULL AND kind = 'list' THEN greatest(0.97, mean) ELSE mean END, 6) AS mean, n.ordinal IS NOT NULL AND kind = 'list' AS relabelled
FROM assigned a LEFT JOIN noted n ON n.source_id = a.source_id AND n.ordinal = a.ordinal
""")
def span_relabelled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered passages whose number a passage up to 400 before refers to become law, at a confidence of 0.97 at least."""
    notes = spans.referenced_notes(keyed(spark, sf_dir), _NOTE, _REFERENCE, back=400)
    turned = spans.relabelled_notes(assigned(spark, sf_dir), notes, "law", of_kinds=("list",))
    return turned.select("source_id", "ordinal", "kind", F.round("mean", 6).alias("mean"), "relabelled")


@query(f"""
WITH notes AS (SELECT source_id, ordinal, regexp_extract(text, '^\\s*[\\[(]?(\\d+)[.)\\]]', 1) AS marker FROM {_P} WHERE regexp_extract(text, '^\\s*[\\[(]?(\\d+)[.)\\]]', 1) <> ''),
  refs AS (SELECT DISTINCT source_id, ordinal AS from_ordinal, unnest(regexp_extract_all(text, '(?:παρ\\.|para\\.|Τεκμ\\.|τεκμήριο|exhibit|section) (\\d+)', 1)) AS marker FROM {_P})
SELECT source_id, ordinal, marker, max(from_ordinal) AS referenced_from FROM notes JOIN refs USING (source_id, marker) WHERE from_ordinal < ordinal AND from_ordinal >= ordinal - 44 GROUP BY source_id, ordinal, marker
""")
def span_referenced_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.referenced_notes(keyed(spark, sf_dir), r"^\s*[\[(]?(\d+)[.)\]]", r"(?:παρ\.|para\.|Τεκμ\.|τεκμήριο|exhibit|section) (\d+)")
