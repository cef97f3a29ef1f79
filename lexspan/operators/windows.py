"""Greedy overlapping windows over the passages of a document."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowRule:
    """Size of a window in characters, what each passage costs besides, and how windows overlap and advance."""

    target: int = 5500
    each: int = 120
    overlap_passages: int = 8
    overlap_chars: int = 900
    advance: int = 12
    most: int = 64

    @property
    def longest(self) -> int:
        """No document above this can do with the most windows, each of which holds the target at best."""
        return self.most * (self.target + self.each)


def cut(costs: list[int], rule: WindowRule) -> list[tuple[int, int]] | None:
    """(first, last) of the windows over passages of these costs, or None if they are too many."""
    out, first, n = [], 0, len(costs)
    while first < n:
        if len(out) == rule.most:
            return None
        last, filled = first, costs[first]
        while last + 1 < n and filled + costs[last + 1] <= rule.target:
            last += 1
            filled += costs[last]
        out.append((first, last))
        if last == n - 1:
            break
        back, shared = last + 1, 0
        while back > first and last + 1 - back < rule.overlap_passages and shared < rule.overlap_chars:
            back -= 1
            shared += costs[back]
        first = max(back, min(last + 1, first + rule.advance))
    return out


def windows(passages: DataFrame, key: str = "source_id", order: str = "ordinal", text: str = "text", rule: WindowRule = WindowRule(), chars: str | None = None) -> DataFrame:
    """(key, window_idx, first_ordinal, last_ordinal, error).

    Each window depends on the one before, so a document is folded in one task, over numbers only. Documents that must
    exceed the most windows are told by their size beforehand: they become one row with an error, and
    what is folded is bounded. ``chars`` names a column of lengths, where texts were left behind already.
    """
    length = F.length(F.coalesce(text, F.lit(""))) if chars is None else F.col(chars)
    sized = passages.select(key, F.col(order).cast("int").alias("__o"), (length + rule.each).cast("int").alias("__c"))
    per = sized.groupBy(key).agg(F.sum("__c").alias("__all"))
    fits = per.where(F.col("__all") <= rule.longest).select(key)
    kind = passages.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, window_idx int, first_ordinal int, last_ordinal int, error string"

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("__o")
        ordinals, name = table.column("__o").to_pylist(), table.column(key)[0].as_py()
        found = cut(table.column("__c").to_pylist(), rule)
        rows = [(name, i, ordinals[a], ordinals[b], None) for i, (a, b) in enumerate(found)] if found is not None else [(name, None, None, None, "too_many_windows")]
        cols = list(zip(*rows))
        return pa.table([pa.array(cols[0], table.schema.field(key).type), *(pa.array(c, pa.int32()) for c in cols[1:4]), pa.array(cols[4], pa.string())], names=[key, "window_idx", "first_ordinal", "last_ordinal", "error"])

    folded = sized.join(fits, key, "left_semi").groupBy(key).applyInArrow(fold, schema)
    over = per.where(F.col("__all") > rule.longest).select(key, F.lit(None).cast("int").alias("window_idx"), F.lit(None).cast("int").alias("first_ordinal"), F.lit(None).cast("int").alias("last_ordinal"), F.lit("too_many_windows").alias("error"))
    return folded.unionByName(over)
