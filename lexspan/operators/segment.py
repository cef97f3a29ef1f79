"""Cut cleaned documents into ordered passages with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A stretch of line feeds with an empty line between.
BLANK = r"\n[ \t]*\n\s*"
#: A line that begins with a paragraph's number.
NUMBERED = r"^(?:\[?\d{1,4}\]?|\(\d{1,4}\))\s*[.)]?\s"
#: A fragment that goes on: a small letter, also behind opening marks.
GOES_ON = r"^[«“\"'(\[]*\p{Ll}"
#: The end of a part that is unfinished whatever the abbreviations: initials.
INITIALS = r"(?:\p{Lu}\.){2,}$"
#: A short fragment that may be the rest of a citation, and what the part before it holds then.
CITATION = (r"^(?:\p{Lu}[\p{L}'’.-]+|\(?\d{4}\)|\d+\(\p{Lu}\))", r"(?i)(?<![\p{L}\p{N}])(?:ν|vs?)\.|\(βλ\.|,")
#: Where a long unit may be cut, all alike: the last of any of them counts.
MARKERS = ("\n", ". ", "; ", "\u00b7 ", "\u0387 ", ": ")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: within lambdas the engine shares no subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _clean(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def blocks(text: Column, few_blocks: int = 5, many_lines: int = 12, numbered: str | None = None) -> Column:
    """Blank-line blocks; the lines of a text that has few blocks and many lines.

    With a pattern of ``numbered`` lines, also the lines of a text of less than 12 blocks and at least 20 lines, if
    at least five of them and 18 % are numbered.
    """

    def choose(both: Column) -> Column:
        by_blank, by_line = both["blank"], both["line"]
        as_lines = (F.size(by_blank) <= few_blocks) & (F.size(by_line) >= many_lines)
        if numbered:
            n = F.size(F.filter(by_line, lambda x: F.regexp_like(x, F.lit(numbered))))
            as_lines |= (F.size(by_blank) < 12) & (F.size(by_line) >= 20) & (n >= F.greatest(F.lit(5), F.floor(F.size(by_line) * F.lit(0.18))))
        return F.when(as_lines, by_line).otherwise(by_blank)

    return _bound(F.struct(_clean(F.split(text, BLANK)).alias("blank"), _clean(F.split(text, "\n")).alias("line")), choose)


def rough_sentences(text: Column, longest_whole: int = 180) -> Column:
    """Short text whole; else cut after closing punctuation before a capital, an opening quote or a digit."""
    return F.when(F.length(text) <= longest_whole, F.array(text)).otherwise(F.split(text, r"(?<=[.!?;…][»”\"')]{0,2})\s+(?=[«“\"(]?[\p{Lu}\d])"))


def sentences(text: Column, transitions: Sequence[str] = (), longest_whole: int = 180, long: int = 900) -> Column:
    """Rough sentences; a long text without any boundary is cut before the words that open another's proposition.

    A heading or a rule of dashes needs no case of its own: the one is short, the other has no boundary.
    """
    rough = _clean(rough_sentences(text, longest_whole))
    if not transitions:
        return rough
    before = r"(?<![\p{L}\p{N}])(?=(?:" + "|".join(re.escape(t) for t in transitions) + r")(?![\p{L}\p{N}]))"
    return _bound(rough, lambda parts: F.when((F.length(text) > long) & (F.size(parts) <= 1), _clean(F.split(text, before))).otherwise(parts))


def split_long(text: Column, most: int = 7000, least: int = 2500) -> Column:
    """Pieces of at most ``most`` characters: cut behind the last marker from ``least`` on, else hard; again for the rest."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        window = F.substring(rest, 1, most)
        backwards = F.reverse(window)
        # the end of the last marker, whose beginning must not be before ``least``
        ends = [(most + 1 - F.position(F.lit(m[::-1]), backwards), len(m)) for m in MARKERS]
        at = F.greatest(*[F.when((end <= most) & (end - n >= least), end).otherwise(F.lit(0)) for end, n in ends])
        cut = F.transform(F.array(F.when(at > 0, at).otherwise(F.lit(most))), lambda c: F.struct(F.concat(state["out"], F.array(trim(F.substring(rest, F.lit(1), c)))).alias("out"), trim(F.substring(rest, c + 1, F.length(rest))).alias("rest")))
        return F.when(F.length(rest) > most, F.element_at(cut, 1)).otherwise(state)

    start = F.struct(F.array().cast("array<string>").alias("out"), text.alias("rest"))
    # a cut takes ``least`` characters at the least
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(least)).cast("int")))
    cut = F.aggregate(rounds, start, step, lambda state: F.filter(F.concat(state["out"], F.array(state["rest"])), lambda x: x != ""))
    return F.when(F.length(text) > most, cut).otherwise(F.array(text))


def merge_fragments(parts: Column, abbreviations: Sequence[str], goes_on: str = r"^\p{Ll}", ends: str | None = None, citation: tuple[str, str] | None = None) -> Column:
    """Left fold: a fragment is joined to what came before if that is unfinished.

    Unfinished is a merged part with an open bracket or quotation or a known abbreviation at its end,
    or one before a fragment that begins with a small letter (``goes_on``). Further patterns: an unfinished end
    (``ends``), and a ``citation``'s short rest with what stands before it. The test sees the merged part, so this is a
    fold, not a comparison of neighbours. It runs inside the JVM.
    """
    ending = "(?:^|[\\s(])(?:" + "|".join(a.replace(".", "\\.") for a in abbreviations) + ")\\.$"

    def step(state: Column, part: Column) -> Column:
        last = state["last"]
        count = lambda chars: F.length(last) - F.length(F.translate(last, chars, ""))
        open_ = (count("(") > count(")")) | (count("«") > count("»")) | (count("“") > count("”"))
        joined = open_ | F.regexp_like(last, F.lit(ending)) | F.regexp_like(part, F.lit(goes_on))
        if ends:
            joined |= F.regexp_like(last, F.lit(ends))
        if citation:
            joined |= (F.length(part) <= 180) & F.regexp_like(part, F.lit(citation[0])) & F.regexp_like(last, F.lit(citation[1]))
        grown = F.struct(state["out"].alias("out"), F.concat(last, F.lit(" "), part).alias("last"))
        return F.when(joined, grown).otherwise(F.struct(F.concat(state["out"], F.array(last)).alias("out"), part.alias("last")))

    def fold(parts: Column) -> Column:
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.element_at(parts, 1).alias("last"))
        return F.aggregate(rest, start, step, lambda state: F.concat(state["out"], F.array(state["last"])))

    return _bound(parts, fold)


def offsets(text: Column, parts: Column) -> Column:
    """An array of (s, e, found) for an array of parts: each sought from where the last one ended, else there."""

    def step(state: Column, part: Column) -> Column:
        # a fold with a cursor: positions are 1-based here and 0-based in the result; the array of one binds the place found
        def grown(p: Column) -> Column:
            s = F.when(p > 0, p).otherwise(state["cursor"])
            return F.struct((s + F.length(part)).alias("cursor"), F.concat(state["out"], F.array(F.struct((s - 1).alias("s"), (s - 1 + F.length(part)).alias("e"), (p > 0).alias("found")))).alias("out"))

        return F.element_at(F.transform(F.array(F.position(part, text, state["cursor"])), grown), 1)

    start = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<s:int,e:int,found:boolean>>").alias("out"))
    return F.aggregate(parts, start, step, lambda state: state["out"])


def located(documents: DataFrame, key: str, text_col: str, parts_col: str) -> DataFrame:
    """(key, ordinal, text, start_offset, end_offset): each part found from where the last one ended.

    A part that is not in the text as it stands (it was joined across a line break) begins at the cursor.
    """
    found = documents.select(key, F.posexplode(F.arrays_zip(F.col(parts_col).alias("text"), offsets(F.col(text_col), F.col(parts_col)).alias("at"))).alias("i", "p"))
    return found.select(key, (F.col("i") + 1).alias("ordinal"), F.col("p.text").alias("text"), F.col("p.at.s").alias("start_offset"), F.col("p.at.e").alias("end_offset"))


def pieces(text: Column, abbreviations: Sequence[str], transitions: Sequence[str] = ()) -> Column:
    """An array of (block, text): blocks, sentences, merged fragments, none above the limit."""

    def of_block(b: Column, i: Column) -> Column:
        merged = merge_fragments(sentences(b, transitions), abbreviations, GOES_ON, INITIALS, CITATION)
        return F.transform(F.flatten(F.transform(merged, lambda m: split_long(m))), lambda s: F.struct((i + 1).alias("block"), s.alias("text")))

    return F.flatten(F.transform(blocks(text, numbered=NUMBERED), of_block))


def passages(documents: DataFrame, key: str, text_col: str, abbreviations: Sequence[str], shortest: int = 80, transitions: Sequence[str] = ()) -> DataFrame:
    """(key, id, ordinal, block_id, text, rel_pos, start_offset, end_offset) of documents long enough: their pieces with their places.

    A projection and one explode: documents are cut where they are read, without a shuffle. Nothing here
    depends on other rows; the relative position follows from the array's size. (The outer form of explode
    keeps the optimizer from deriving a filter that would compute all pieces a second time.)
    """
    kept = documents.where(F.length(F.col(text_col)) >= shortest).select(key, F.col(text_col).alias("__text"), pieces(F.col(text_col), abbreviations, transitions).alias("__all"))
    zipped = F.arrays_zip(F.col("__all").alias("p"), offsets(F.col("__text"), F.col("__all.text")).alias("at"))
    flat = kept.select(key, F.size("__all").alias("__n"), zipped.alias("__z")).select(key, "__n", F.posexplode_outer("__z").alias("__i", "__p")).where("__p is not null")
    position = F.when(F.col("__n") == 1, F.lit(1.0)).otherwise(F.floor(F.col("__i") / (F.col("__n") - 1) * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0))
    return flat.select(
        key, F.format_string("P%06d", F.col("__i") + 1).alias("id"), (F.col("__i") + 1).alias("ordinal"), F.format_string("B%05d", F.col("__p.p.block")).alias("block_id"),
        F.col("__p.p.text").alias("text"), position.alias("rel_pos"), F.col("__p.at.s").alias("start_offset"), F.col("__p.at.e").alias("end_offset"),
    )
