"""Check quotations against the passages they name, under a policy given as data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_BREAK
from ..functions.unicode import nfc

KEY = ("source_id", "field_path", "anchor_id")


@dataclass(frozen=True)
class Rule:
    """What evidence a field may have; a field takes the first rule whose path it is, or begins with."""

    path: str
    prefix: bool = False
    kinds: Sequence[str] | None = None
    denied_speakers: Sequence[str] = ()
    shortest: int = 2
    allow_quoted: bool = False
    allow_title: bool = False


def evidence_form(c: Column | str) -> Column:
    """NFC, plain spaces, white space squeezed: the form in which quotations are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfc(c), NO_BREAK, " "), r"(?U)[\s\x{1C}-\x{1F}]+", " "))


def by_rule(path: Column, rules: Sequence[Rule], value) -> Column:
    """A field's value under the first rule that fits, as one expression: the policy is short and known."""
    out = value(None)
    for r in reversed(rules):
        fits = F.startswith(path, F.lit(r.path)) if r.prefix else path == r.path
        out = F.when(fits, value(r)).otherwise(out)
    return out


def contiguous(anchors: DataFrame, passages: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(key, requested, found, unbroken, text): the named passages of each anchor, in order; the text if the passages have one.

    An anchor names few passages; they meet on (source_id, id), so that a hot source is spread. A
    passage named twice breaks the sequence. With ``sections`` (source_id, ordinal, kind, speaker, quoted) also how many
    passages have one, the sections' kinds and speakers, the first of each, and whether any is quoted.
    """
    named = anchors.select(*KEY, F.size("passage_ids").alias("requested"), F.explode_outer("passage_ids").alias("id"))
    with_text = "text" in passages.columns
    joined = named.join(passages.select("source_id", "id", "ordinal", *(["text"] if with_text else [])), ["source_id", "id"], "left")
    more = []
    if sections is not None:
        s = sections.select("source_id", "ordinal", F.col("kind").alias("__kind"), F.col("speaker").alias("__speaker"), F.col("quoted").alias("__quoted"))
        joined = joined.join(s, ["source_id", "ordinal"], "left")
        more = [
            F.count("__kind").alias("n_sections"), F.array_sort(F.collect_set("__kind")).alias("kinds"), F.array_sort(F.collect_set("__speaker")).alias("speakers"),
            F.min_by("__kind", "ordinal").alias("section_kind"), F.min_by("__speaker", "ordinal").alias("section_speaker"), F.coalesce(F.bool_or("__quoted"), F.lit(False)).alias("quoted"),
        ]
    if with_text:
        more.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "text")))), lambda x: x["text"]), " ").alias("text"))
    grouped = joined.groupBy(*KEY, "requested").agg(
        F.count("ordinal").alias("found"),
        ((F.max("ordinal") - F.min("ordinal") + 1 == F.count("ordinal")) & (F.count_distinct("ordinal") == F.count("ordinal"))).alias("in_sequence"),
        *more,
    )
    rest = [c for c in grouped.columns if c not in (*KEY, "requested", "found", "in_sequence")]
    return grouped.select(*KEY, "requested", "found", F.coalesce((F.col("found") == F.col("requested")) & F.col("in_sequence"), F.lit(False)).alias("unbroken"), *rest)


def verdicts(anchors: DataFrame, passages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, flags, kept, exact) of each anchor. Only a missing kind is flagged without being held against it."""
    found = contiguous(anchors, passages)
    a = anchors.select(*KEY, "quote", "kind", "speaker")
    quote = evidence_form("quote")
    path = F.col("field_path")
    kinds = by_rule(path, rules, lambda r: F.array(*map(F.lit, r.kinds)) if r and r.kinds else F.lit(None).cast("array<string>"))
    denied = by_rule(path, rules, lambda r: F.array(*map(F.lit, r.denied_speakers)).cast("array<string>") if r and r.denied_speakers else F.lit(None).cast("array<string>"))
    shortest = by_rule(path, rules, lambda r: F.lit(r.shortest if r else 2))
    joined = a.join(found, list(KEY)).withColumns({"__q": quote, "__t": evidence_form("text")})
    exact = F.coalesce(F.contains("__t", F.col("__q")) & (F.col("__q") != ""), F.lit(False))
    tests = (
        (F.col("__q").isNull() | (F.length("__q") < shortest), "short_quote"),
        (F.col("found") < F.col("requested"), "unknown_passage"),
        ((F.col("found") == F.col("requested")) & ~F.col("unbroken"), "not_contiguous"),
        (~exact, "not_found"),
        (kinds.isNotNull() & F.col("kind").isNotNull() & ~F.coalesce(F.array_contains(kinds, F.col("kind")), F.lit(True)), "kind_not_allowed"),
        (denied.isNotNull() & F.coalesce(F.array_contains(denied, F.col("speaker")), F.lit(False)), "speaker_not_allowed"),
        (F.col("kind").isNull(), "kind_missing"),
    )
    flags = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in tests]))
    judged = joined.withColumns({"flags": F.array_sort(flags), "exact": exact})
    return judged.select(*KEY, "flags", (F.size(F.array_remove("flags", "kind_missing")) == 0).alias("kept"), "exact")


def section_verdicts(anchors: DataFrame, passages: DataFrame, sections: DataFrame, titles: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, flags, kept, kind, speaker) of each anchor, kind and speaker being those of the sections its passages lie in.

    ``sections`` has (source_id, ordinal, kind, speaker, quoted), one row a passage: spans spread into ordinals. An anchor that names
    ``TITLE`` is held against its document's title (``titles``: source_id, title). The first failure rejects: a short quote, a
    title that doesn't have it, passages that aren't there or not in sequence, a quote that isn't in them. What a policy
    forbids (kinds, speakers, quoted sections) is flagged in full and rejects; a passage without a section is only flagged.
    """
    found = contiguous(anchors, passages, sections)
    path = F.col("field_path")
    names = lambda values: F.array(*map(F.lit, values)).cast("array<string>") if values else F.lit(None).cast("array<string>")
    kinds = by_rule(path, rules, lambda r: names(r.kinds if r else None))
    denied = by_rule(path, rules, lambda r: names(r.denied_speakers if r else None))
    shortest = by_rule(path, rules, lambda r: F.lit(r.shortest if r else 2))
    quoted_allowed = by_rule(path, rules, lambda r: F.lit(bool(r and r.allow_quoted)))
    title_allowed = by_rule(path, rules, lambda r: F.lit(bool(r and r.allow_title)))
    joined = anchors.select(*KEY, "quote", (F.coalesce(F.size("passage_ids") == 1, F.lit(False)) & (F.coalesce(F.get("passage_ids", F.lit(0)), F.lit("")) == "TITLE")).alias("__title")).join(found, list(KEY))
    joined = joined.join(titles.select("source_id", F.col("title").alias("__doc_title")), "source_id", "left")
    joined = joined.withColumns({"__q": evidence_form("quote"), "__t": evidence_form("text"), "__n": evidence_form("__doc_title")})
    within = lambda c: F.coalesce(F.contains(c, F.col("__q")) & (F.col("__q") != ""), F.lit(False))
    failure = (
        F.when(F.col("__q").isNull() | (F.length("__q") < shortest), "short_quote")
        .when(F.col("__title"), F.when(~(title_allowed & within("__n")), "title_mismatch"))
        .when(~F.col("unbroken"), "passages_invalid")
        .when(~within("__t"), "not_found")
    )
    forbidden = (
        (kinds.isNotNull() & (F.size(F.array_except("kinds", F.coalesce(kinds, F.col("kinds")))) > 0), "wrong_kind"),
        (denied.isNotNull() & F.arrays_overlap("speakers", F.coalesce(denied, F.array().cast("array<string>"))), "wrong_speaker"),
        (F.col("quoted") & ~quoted_allowed, "quoted_not_allowed"),
    )
    policy = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for t, n in forbidden]))
    noted = F.array_compact(F.array(F.when(F.col("n_sections") < F.col("found"), F.lit("section_missing"))))
    judged = joined.withColumn("__failed", failure).withColumn("__policy", F.when(F.col("__failed").isNull() & ~F.col("__title"), policy).otherwise(F.array().cast("array<string>")))
    flags = F.when(F.col("__failed").isNotNull(), F.array("__failed")).when(F.col("__title"), F.array().cast("array<string>")).otherwise(F.array_sort(F.concat(noted, "__policy")))
    return judged.select(
        *KEY, flags.alias("flags"), (F.col("__failed").isNull() & (F.size("__policy") == 0)).alias("kept"),
        F.when(F.col("__title"), "title").otherwise(F.coalesce("section_kind", F.lit("other"))).alias("kind"), F.when(F.col("__title"), "court").otherwise(F.coalesce("section_speaker", F.lit("unknown"))).alias("speaker"),
    )


def first_of_each_quote(anchors: DataFrame) -> DataFrame:
    """One anchor for each (source, field, quote in comparison form): the least id."""
    columns = F.struct(*anchors.columns)
    best = anchors.withColumn("__q", evidence_form("quote")).groupBy("source_id", "field_path", "__q").agg(F.min_by(columns, "anchor_id").alias("__best"))
    return best.select("__best.*")
