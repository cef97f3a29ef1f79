"""Claims as rows (document, field path, status, value, confidence), their validation, issues and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("available", "unavailable", "indeterminate", "conflicted")


def meaningful(value: Column) -> Column:
    return F.coalesce(F.length(F.trim(value)) > 0, F.lit(False))


def summarised(evidence: DataFrame) -> DataFrame:
    """(document, field_path, n_evidence, rejected): kept anchors, and the reasons for which others were not, each once.

    Reasons are a handful of names, so the set is small however many anchors a field has.
    """
    reason = F.element_at(F.array_remove("flags", "kind_missing"), 1) if "flags" in evidence.columns else F.lit("rejected")
    return evidence.groupBy("source_id", "field_path").agg(F.count_if("kept").alias("n_evidence"), F.array_sort(F.collect_set(F.when(~F.col("kept"), reason))).alias("rejected"))


def validated(claims: DataFrame, evidence: DataFrame, fallback: str = "", conflict_note: str = "sources disagree") -> DataFrame:
    """(document, field_path, status, value, confidence, n_evidence, conflicts) after checking each claim's evidence.

    An available claim needs a value and evidence, else it is indeterminate at confidence 0. An unavailable one has no
    value. A conflicted one keeps its value and has at least one note. Any other status is indeterminate.
    """
    counts = evidence if "n_evidence" in evidence.columns else summarised(evidence)
    joined = claims.join(counts, ["source_id", "field_path"], "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)).cast("bigint"))
    good = (F.col("status") == "available") & meaningful(F.col("value")) & (F.col("n_evidence") > 0)
    status = F.when(good, "available").when(F.col("status").isin("unavailable", "conflicted"), F.col("status")).otherwise("indeterminate")
    final = joined.withColumn("__s", status)
    rejected = F.coalesce("rejected", F.array().cast("array<string>")).alias("rejected")
    return final.select(
        "source_id", "field_path", F.col("__s").alias("status"), rejected,
        F.when(F.col("__s").isin("available", "conflicted") & meaningful(F.col("value")), F.col("value")).otherwise(F.lit(fallback)).alias("value"),
        F.when(F.col("__s") == "indeterminate", F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("__s") == "indeterminate", F.lit(0).cast("bigint")).otherwise(F.col("n_evidence")).alias("n_evidence"),
        F.when((F.col("__s") == "conflicted") & (F.size(F.coalesce("conflicts", F.array().cast("array<string>"))) == 0), F.array(F.lit(conflict_note))).otherwise(F.coalesce("conflicts", F.array().cast("array<string>"))).alias("conflicts"),
    )


def missing_fields(claims: DataFrame, documents: DataFrame, required: dict[str, str]) -> DataFrame:
    """(document, code, severity, field_path, message): required fields (path to severity) without an available claim."""
    wanted = documents.select("source_id", F.explode(F.array(*[F.struct(F.lit(p).alias("field_path"), F.lit(s).alias("severity")) for p, s in required.items()])).alias("r")).select("source_id", "r.field_path", "r.severity")
    absent = wanted.join(claims.where("status = 'available'").select("source_id", "field_path"), ["source_id", "field_path"], "left_anti")
    return absent.select("source_id", F.concat(F.lit("missing_"), F.regexp_replace("field_path", "[^a-z]+", "_")).alias("code"), "severity", "field_path", F.concat(F.lit("no evidence for "), "field_path").alias("message"))


def distinct_issues(*sources: DataFrame) -> DataFrame:
    """The union of issues, one of each (document, code, path, message): the earlier source's severity counts."""
    columns = ["source_id", "code", "severity", "field_path", "message"]
    tagged = [s.select(*columns, F.lit(i).alias("__source")) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    best = union.groupBy("source_id", "code", "field_path", "message").agg(F.min_by("severity", F.struct("__source", "severity")).alias("severity"))
    return best.select(*columns)


def capped_severity(severity: Column, code: Column, allowed: Sequence[str], top: str, lower: str, keeps_top: str) -> Column:
    """Known severities only, the top one lowered unless the code matches ``keeps_top``."""
    known = F.when(severity.isin(*allowed), severity).otherwise(F.lit(allowed[-1]))
    return F.when((known == top) & ~F.regexp_like(code, F.lit(keeps_top)), F.lit(lower)).otherwise(known)


def completeness(claims: DataFrame, weights: dict[str, int], group: Column | None = None) -> DataFrame:
    """(document, score): of each group's countable fields the available share, weighted and rounded, summed.

    Unavailable fields are no part of a group; one without countable fields scores 0. Groups are columns of one
    aggregate, so that claims are shuffled once.
    """
    name = group if group is not None else F.substring_index("field_path", ".", 1)
    parts = []
    for g, w in weights.items():
        mine = name == g
        countable = F.count_if(mine & (F.col("status") != "unavailable"))
        got = F.count_if(mine & (F.col("status") == "available"))
        parts.append(F.when(countable > 0, F.floor(got / countable * w + F.lit(0.5))).otherwise(F.lit(0)))
    return claims.groupBy("source_id").agg(sum(parts[1:], parts[0]).cast("bigint").alias("score"))


def penalised(scores: DataFrame, issues: DataFrame, penalties: dict[str, tuple[int, int]]) -> DataFrame:
    """(document, score, penalty, final): a penalty for each issue of a severity, up to its most; final within 0 and 100."""
    parts = [F.least(F.count_if(F.col("severity") == s) * p, F.lit(most)) for s, (p, most) in penalties.items()]
    total = sum(parts[1:], parts[0])
    lost = issues.groupBy("source_id").agg(total.cast("bigint").alias("penalty"))
    joined = scores.join(lost, "source_id", "left").withColumn("penalty", F.coalesce("penalty", F.lit(0)).cast("bigint"))
    return joined.withColumn("final", F.greatest(F.lit(0), F.least(F.lit(100), F.col("score") - F.col("penalty"))).cast("bigint"))


def score_sheet(checked: DataFrame, weights: dict[str, int], required: dict[str, str], penalties: dict[str, tuple[int, int]], rejected_severity: str) -> DataFrame:
    """(document, score, penalty, final) in one aggregate over validated claims.

    The same as :func:`completeness` less what :func:`penalised` takes for :func:`missing_fields` and for each reason
    of rejected anchors, without computing claims once for each.
    """
    group = F.substring_index("field_path", ".", 1)
    parts = []
    for g, w in weights.items():
        countable = F.count_if((group == g) & (F.col("status") != "unavailable"))
        parts.append(F.when(countable > 0, F.floor(F.count_if((group == g) & (F.col("status") == "available")) / countable * w + F.lit(0.5))).otherwise(F.lit(0)))
    losses = []
    for severity, (each, most) in penalties.items():
        count = F.lit(0)
        for path, s in required.items():
            if s == severity:
                count = count + F.when(F.count_if((F.col("field_path") == path) & (F.col("status") == "available")) == 0, 1).otherwise(0)
        if severity == rejected_severity:
            count = count + F.sum(F.size("rejected"))
        losses.append(F.least(count * each, F.lit(most)))
    sheet = checked.groupBy("source_id").agg(sum(parts[1:], parts[0]).cast("bigint").alias("score"), sum(losses[1:], losses[0]).cast("bigint").alias("penalty"))
    return sheet.withColumn("final", F.greatest(F.lit(0), F.least(F.lit(100), F.col("score") - F.col("penalty"))).cast("bigint"))


def readiness(scores: DataFrame, issues: DataFrame, maps: DataFrame, sources: DataFrame, reviews: DataFrame, penalties: dict[str, tuple[int, int]], points: dict[str, int]) -> DataFrame:
    """(document, score, source, map, review, penalty, n_critical, final): the completeness of claims with all that adds to it or takes from it.

    ``maps`` has (complete, overlap_free), ``sources`` (official, has_url), ``reviews`` (recommendation) by document; ``points`` the worth of
    'official', 'pasted', 'map', 'approve' and 'reject'. A penalty counts for each issue of its severity up to its most, none
    of which bounds the first severity if that is negative. The sum lies within 0 and 100.
    """
    lost = issues.groupBy("source_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"__{s}") for s in penalties],
    )
    joined = scores.join(lost, "source_id", "left").join(maps.select("source_id", "complete", "overlap_free"), "source_id", "left")
    joined = joined.join(sources.select("source_id", "official", "has_url"), "source_id", "left").join(reviews.select("source_id", "recommendation"), "source_id", "left")
    count = lambda s: F.coalesce(F.col(f"__{s}"), F.lit(0))
    parts = [count(s) * each if most < 0 else F.least(count(s) * each, F.lit(most)) for s, (each, most) in penalties.items()]
    found = joined.select(
        "source_id", "score",
        F.when(F.coalesce("official", F.lit(False)), points["official"]).when(~F.coalesce("has_url", F.lit(False)), points["pasted"]).otherwise(0).alias("source"),
        F.when(F.coalesce("complete", F.lit(False)) & F.coalesce("overlap_free", F.lit(False)), points["map"]).otherwise(0).alias("map"),
        F.when(F.col("recommendation") == "approve", points["approve"]).when(F.col("recommendation") == "reject", -points["reject"]).otherwise(0).alias("review"),
        sum(parts[1:], parts[0]).cast("bigint").alias("penalty"), count(next(iter(penalties))).cast("bigint").alias("n_critical"), F.coalesce("recommendation", F.lit("review")).alias("recommendation"),
    )
    total = F.col("score") + F.col("source") + F.col("map") + F.col("review") - F.col("penalty")
    return found.withColumn("final", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("bigint"))


def strictly_ready(ready: DataFrame, claims: DataFrame, least: int, all_of: Sequence[str], any_of: Sequence[str], coded: tuple[str, Sequence[str]]) -> DataFrame:
    """``ready`` with ``strict``: the least score, nothing critical, no rejection, every field of ``all_of`` and one of ``any_of`` available,
    the value of the ``coded`` field in its vocabulary."""
    path, vocabulary = coded
    good = F.col("status") == "available"
    skeleton = claims.groupBy("source_id").agg(
        *[F.bool_or(good & (F.col("field_path") == p)).alias(f"__a{i}") for i, p in enumerate(all_of)],
        F.bool_or(good & F.col("field_path").isin(*any_of)).alias("__any"),
        F.bool_or(good & (F.col("field_path") == path) & F.col("value").isin(*vocabulary)).alias("__coded"),
    )
    columns = [f"__a{i}" for i in range(len(all_of))] + ["__any", "__coded"]
    joined = ready.join(skeleton, "source_id", "left")
    strict = (F.col("final") >= least) & (F.col("n_critical") == 0) & (F.col("recommendation") != "reject")
    for c in columns:
        strict = strict & F.coalesce(c, F.lit(False))
    return joined.withColumn("strict", strict).drop(*columns)


def suppressed_by(issues: DataFrame, claims: DataFrame, rules: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """Issues without those that a rule settles: (code pattern, field, pattern): the field is available, and its value has no match."""
    settled = None
    for i, (code, path, unless) in enumerate(rules):
        good = (F.col("field_path") == path) & (F.col("status") == "available")
        if unless is not None:
            good = good & ~F.coalesce(F.regexp_like("value", F.lit(unless)), F.lit(False))
        settled = [*(settled or []), F.bool_or(good).alias(f"__r{i}")]
    by_document = claims.groupBy("source_id").agg(*settled)
    joined = issues.join(by_document, "source_id", "left")
    gone = F.lit(False)
    for i, (code, _, _) in enumerate(rules):
        gone = gone | (F.regexp_like("code", F.lit(code)) & F.coalesce(f"__r{i}", F.lit(False)))
    return joined.where(~gone).select(issues.columns)


def gate(scores: DataFrame, threshold: int, placeholder: str) -> DataFrame:
    """Rows that go on, and those below the threshold with a placeholder in place of a result: one branch each."""
    return scores.withColumn("outcome", F.when(F.col("final") >= threshold, F.lit("continue")).otherwise(F.lit(placeholder)))


def upsert(claims: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    """Last write wins for each (document, field): the greatest version of both tables, changes before claims at a tie."""
    both = claims.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    keys = ["source_id", "field_path"]
    rest = [c for c in claims.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new", *[c for c in rest if c != version])).alias("__best"))
    return best.select(*keys, "__best.*").select(*claims.columns)


def fields_long(records: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field_path, value) of every named field of nested records: what a recursive walk would visit."""
    return records.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field_path"), F.col(f).cast("string").alias("value")) for f in fields])).alias("f")).select(key, "f.field_path", "f.value")


def grounded(claims: DataFrame, found: DataFrame, path: str, confidence: float) -> DataFrame:
    """Claims with a field filled from what was found in the text, where it is not available already.

    ``found`` has (source_id, value), at most one row a document. A document without the field gets it.
    """
    named = found.select("source_id", F.lit(path).alias("field_path"), F.col("value").alias("__found"))
    joined = claims.join(named, ["source_id", "field_path"], "full")
    fill = F.col("__found").isNotNull() & (F.coalesce("status", F.lit("")) != "available")
    return joined.select(
        "source_id", "field_path", F.when(fill, "available").otherwise(F.col("status")).alias("status"), F.when(fill, F.col("__found")).otherwise(F.col("value")).alias("value"),
        F.when(fill, F.lit(confidence)).otherwise(F.col("confidence")).alias("confidence"),
    )


def not_present(generated: DataFrame, existing: DataFrame, key: str, name: str) -> DataFrame:
    """Generated rows whose name, in any case, a document doesn't have yet; of several spellings the least."""
    have = existing.select(key, F.lower(name).alias("__name")).distinct()
    new = generated.select(key, name, F.lower(name).alias("__name")).join(have, [key, "__name"], "left_anti")
    return new.groupBy(key, "__name").agg(F.min(name).alias(name)).select(key, name)


def first_by_number(items: DataFrame, anchors: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """Each item with the first anchor of its document and number; items without one keep a null."""
    first = anchors.groupBy(key, number).agg(F.min(order).alias(order))
    return items.join(first, [key, number], "left")


def suppressed(issues: DataFrame, claims: DataFrame, codes: str) -> DataFrame:
    """Issues without those whose code matches and whose field is available after all."""
    settled = claims.where("status = 'available'").select("source_id", "field_path")
    doubtful = F.regexp_like("code", F.lit(codes))
    return issues.where(~doubtful).unionByName(issues.where(doubtful).join(settled, ["source_id", "field_path"], "left_anti").select(issues.columns))
