"""Problem 5: cut items above a size limit into overlapping pieces at natural boundaries.

The least number of pieces k follows from the size, the limit and the overlap. k equally long
pieces give k-1 target cuts; each is moved to the strongest boundary near it (paragraph, line,
sentence, clause, word, in that order, the nearer of equals). If a piece then exceeds the limit,
k grows by one. Positions and limits count code points.

Defined results: null and empty texts have no pieces; a text within the limit is one piece; a
text with no boundary at all is cut at the targets, never between a letter and its combining
mark while another place exists. Consecutive pieces share exactly ``overlap`` code points.
Repeated rows give their pieces once per row unless the caller drops duplicates. A limits table without the limit
asked for is an error as soon as there is a text; without an overlap there is none.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import arrow_map

#: Boundary patterns, strongest first; a cut is placed at the end of a match.
BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n\s*", r"(?:[.!?…;;·]['\"”»’)\]]*\s+|[。！？｡।॥։؟][”」』\"')\]]*\s*)", r"[,:—–;،、，：]\s*", r"\s+")]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``."""
    if overlap < 0 or overlap >= limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        size = (n + (k - 1) * overlap) / k
        # a piece may grow by what its target leaves below the limit, or by an eighth at least: a failure adds a piece
        slack = max(1, int(max(limit - size, size / 8)))
        pieces, start = [], 0
        for i in range(1, k):
            target = round(i * (size - overlap)) + overlap
            end = _snap(text, target, max(start + overlap + 1, target - slack), min(n - 1, start + limit, target + slack))
            if not start + overlap < end <= start + limit:
                break
            pieces.append((start, end))
            start = end - overlap
        if len(pieces) == k - 1 and n - start <= limit and n - start > overlap:
            return [*pieces, (start, n)]
        k += 1


def _snap(text: str, target: int, low: int, high: int) -> int:
    if low > high:
        return -1
    target = min(max(target, low), high)
    # a boundary may begin before the window, so the search starts a little earlier
    begin = max(0, low - 8)
    for pattern in BOUNDARIES:
        near = [m.end() for m in pattern.finditer(text, begin, high) if low <= m.end() <= high]
        if near:
            return min(near, key=lambda e: (abs(e - target), e))
    for d in range(high - low + 1):
        for e in (target - d, target + d):
            if low <= e <= high and not unicodedata.combining(text[e]) and text[e] not in "‍️" and text[e - 1] != "‍":
                return e
    return target


def split_oversized(items: DataFrame, keys: list[str], max_size: int | None = None, overlap: int | None = None, limits: DataFrame | None = None, limit_name: str = "passage", text_col: str = "text") -> DataFrame:
    """(keys, piece_no, n_pieces, start_pos, end_pos, piece) of each item.

    Limits come as numbers or from a ``limits`` table. Items within the limit stay in the JVM;
    only oversized ones go through Python. There is no shuffle: the limit is a scalar subquery.
    """
    if limits is not None:
        row = limits.where(F.col("limit_name") == limit_name)
        missing = F.raise_error(F.lit(f"no limit named {limit_name}")).cast("int")
        most, over = F.coalesce(row.agg(F.max("max_size")).scalar(), missing), F.coalesce(row.agg(F.max("overlap")).scalar(), F.lit(0))
    else:
        most, over = F.lit(max_size), F.lit(overlap or 0)
    sized = items.select(*keys, F.col(text_col).alias("__text"), most.alias("__max"), over.alias("__over"))
    sized = sized.where("char_length(__text) > 0")
    whole = sized.where("char_length(__text) <= __max").select(
        *keys, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_pos"), F.char_length("__text").alias("end_pos"), F.col("__text").alias("piece")
    )
    return whole.unionByName(cut_large(sized, keys))


def cut_large(sized: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of the rows above the limit; ``sized`` has keys, __text, __max and __over."""
    schema = ", ".join(f"{k} {sized.schema[k].dataType.simpleString()}" for k in keys) + ", piece_no int, n_pieces int, start_pos int, end_pos int, piece string"

    def factory():
        def chunk(cols):
            out = []
            for *key, text, most, over in zip(*cols):
                cuts = cut_points(text, most, over)
                out += [(*key, i, len(cuts), a, b, text[a:b]) for i, (a, b) in enumerate(cuts, 1)]
            return list(zip(*out)) if out else [[]] * (len(cols) + 2)

        return chunk

    return arrow_map(sized.where("char_length(__text) > __max"), [*keys, "__text", "__max", "__over"], schema, factory, chunk=32)
