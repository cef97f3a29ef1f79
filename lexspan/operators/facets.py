"""Tags of documents, gathered from several places, first spelling kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_folded


def facet(sources: Sequence[Column], most: int, pattern: str | None = None) -> Column:
    """The tags of arrays of strings in order, without repeats in any case, those matching a pattern, up to ``most``."""
    tags = distinct_folded(F.flatten(F.array(*[F.coalesce(s, F.array().cast("array<string>")) for s in sources])))
    if pattern:
        tags = F.filter(tags, lambda x: F.regexp_like(x, F.lit(pattern)))
    return F.slice(tags, 1, most)


def gathered(rows: DataFrame, key: str, tag: Column, order: Sequence[str]) -> DataFrame:
    """(key, tag, rank): distinct folded tags by first occurrence, each one's first spelling.

    Occurrences are combined before the shuffle; a key's distinct tags are ranked, not its rows.
    """
    from pyspark.sql import Window

    cleaned = rows.select(key, F.trim(tag).alias("tag"), F.struct(*order).alias("__at")).where("tag <> ''")
    firsts = cleaned.groupBy(key, F.lower("tag").alias("__folded")).agg(F.min_by("tag", F.struct("__at", "tag")).alias("tag"), F.min("__at").alias("__at"))
    return firsts.select(key, "tag", F.row_number().over(Window.partitionBy(key).orderBy("__at", "tag")).alias("rank"))


def numeric_aware(c: Column, width: int = 12) -> Column:
    """A sort key in which numbers count by value: 'art 9' comes before 'art 10'."""
    padded = F.transform(F.split(F.lower(c), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)"), lambda p: F.when(F.regexp_like(p, F.lit(r"^\d+$")), F.lpad(p, width, "0")).otherwise(p))
    return F.array_join(padded, "")
