"""Problem 6: one consistent form for text that looks the same.

Most text is already stable. A pattern built from the normalization quick-check properties of
Unicode finds unstable segments: characters that may change, with the starter before and the
combining marks after them as boundary context. Only these are normalized and spliced back into
the unchanged text.

The canonical form of a text is its NFC, with the compatibility forms that do not show (wide and
narrow forms, ligatures, positional Arabic forms, mathematical alphabets), invisible characters
removed, every white space a plain space or line feed, hyphens plain, and look-alike letters resolved word by word:
a word with letters of just one of the scripts that look-alikes come from is written in that script, any other
(look-alikes only, or scripts really mixed) has its look-alikes in Latin letters. A word's form follows from the word
alone, so that a stretch has the same form wherever it stands; the price is that a Greek or Cyrillic word made of
look-alikes only (the article in capitals, say) comes out in Latin letters. Visible differences stay:
case, accents, superscripts, fractions and digits of other scripts are not folded.

Words are unstable where scripts meet within them or where they are made of look-alikes only; all others are left as they are.

``same_looking`` compares a quotation with a text by their canonical forms, white space squeezed. A quotation may begin or
end within a word: then its outer words, where made of look-alikes only, are tried in each script.

Defined results: null stays null; empty stays empty; the form is idempotent.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import arrow_map

#: Compatibility kinds whose characters look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")
#: Characters that do not show.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: Letters that look the same: Latin, then Greek and Cyrillic in the same order; a point where there is none.
LATIN = "ABCEHIJKMNOPSTXYZaceijopsvxy"
GREEK = "ΑΒ.ΕΗΙ.ΚΜΝΟΡ.ΤΧΥΖ.....ο..ν.."
CYRILLIC = "АВСЕНІЈКМ.ОРЅТХУ.асеіјорѕ.ху"

TO_LATIN = {ord(x): a for a, *xs in zip(LATIN, GREEK, CYRILLIC) for x in xs if x != "."}
FROM_LATIN = {
    "GREEK": {ord(a): x for a, x in zip(LATIN, GREEK) if x != "."},
    "CYRILLIC": {ord(a): x for a, x in zip(LATIN, CYRILLIC) if x != "."},
}


def _same(ch: str) -> str:
    """What a single character becomes before composition."""
    if ch in INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0000 <= ord(ch) < 0xE0200:
        return ""
    if ch in "‐‑⁃﹣－":
        return "-"
    if ch in "µ":
        return "μ"
    if ch in "\n\t":
        return ch
    if ch in "\r\x0b\x0c\x85  ":
        return "\n"
    if ch.isspace() or ch == "ㅤ":
        return " "
    d = unicodedata.decomposition(ch)
    if d.startswith("<"):
        kind, *codes = d.split()
        if kind in SAME_LOOK or (kind == "<compat>" and unicodedata.category(ch)[0] == "L" and ch not in "ŉĿŀ" and len(codes) <= 3 and "LIGATURE" in unicodedata.name(ch, "")):
            return "".join(_same(chr(int(c, 16))) for c in codes)
    return ch


#: Code points that are stable one and all: ideographs, syllables, private use, surrogates, unassigned planes.
_STABLE = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x20000, 0x2F800), (0x2FA20, 0xE0000), (0xE0200, 0x110000))


@lru_cache(1)
def _tables() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    """What characters become; stretches of unstable ones; a character that may be one, which is found faster."""
    changed, unstable = {}, []
    cp = 0x80
    while cp < 0x110000:
        if after := next((b for a, b in _STABLE if a <= cp < b), None):
            cp = after
            continue
        ch = chr(cp)
        to = _same(ch)
        if to != ch:
            changed[cp] = to
        if to != ch or unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch) or _may_compose_back(ch):
            unstable.append(cp)
        cp += 1
    few = set(unstable)
    stable = [cp for cp in range(0x10000) if cp not in few]
    return changed, re.compile(f"[{_ranges(unstable)}]+"), re.compile(f"[^{_ranges(stable)}]")


def _ranges(points: list[int]) -> str:
    """The inside of a character class of ascending code points."""
    out: list[list[int]] = []
    for cp in points:
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _may_compose_back(ch: str) -> bool:
    """NFC quick check MAYBE without a combining class: vowel signs and jamo that join what stands before."""
    return unicodedata.category(ch) in ("Mc", "Mn") or 0x1160 <= ord(ch) <= 0x11FF


#: Scripts that share look-alikes, and the marks that may stand on a letter.
_SCRIPTS = {"LATIN": "A-Za-z\u00c0-\u024f\u1e00-\u1eff", "GREEK": "\u0370-\u03ff\u1f00-\u1fff", "CYRILLIC": "\u0400-\u052f"}
_MARKS = "[\u0300-\u036f]*+"


@lru_cache(1)
def _unstable_word() -> re.Pattern:
    """Where a word's letters may need another script: two scripts meet, or a word of look-alikes only stands free."""
    meets = "|".join(f"[{a}]{_MARKS}[{b}]" for x, a in _SCRIPTS.items() for y, b in _SCRIPTS.items() if x != y)
    alike = [cp for cp in (*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)) if _base(chr(cp)) in LATIN and chr(cp).isalpha()]
    return re.compile(f"{meets}|(?<![^\\W\\d_\u0300-\u036f])(?:[{_ranges(alike)}]{_MARKS})++(?![^\\W\\d_])")


def _base(ch: str) -> str:
    return unicodedata.normalize("NFD", ch)[0].translate(TO_LATIN)


_OTHER = re.compile("[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
_HEAD, _TAIL = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])*+"), re.compile(r"[^\W\d_]|[\u0300-\u036f]")


@lru_cache(65536)
def _of_word(word: str) -> str:
    """The word's form: in the one script its other letters are of, else with its look-alikes in Latin letters."""
    plain = unicodedata.normalize("NFD", word).translate(TO_LATIN)
    letters = {c for c in plain if c.isalpha()}
    own = {unicodedata.name(c, "").split(" ")[0] for c in letters if c not in LATIN}
    table = FROM_LATIN.get(next(iter(own)), {}) if len(own) == 1 else {}
    if table and {ord(c) for c in letters if c in LATIN} <= table.keys():
        plain = plain.translate(table)
    return unicodedata.normalize("NFC", plain)


def _unmix(text: str) -> str:
    """Unstable words in their own form; whole words are taken, the rest is left as it is."""
    parts, at = [], 0
    for m in _unstable_word().finditer(text):
        if m.end() <= at:
            continue
        start = m.start()
        while start > at and _TAIL.match(text[start - 1]):
            start -= 1
        end = _HEAD.match(text, m.end()).end()
        word = text[start:end]
        if word.isascii():
            continue
        parts += (text[at:start], _of_word(word))
        at = end
    parts.append(text[at:])
    return "".join(parts)


def canonical(text: str | None) -> str | None:
    if text is None or text.isascii() and "\r" not in text:
        return text
    changed, pattern, doubtful = _tables()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts, at = [], 0
    for m in pattern.finditer(text) if doubtful.search(text) else ():
        start = max(m.start() - 1, at)  # the starter that marks may attach to
        parts += (text[at:start], unicodedata.normalize("NFC", text[start : m.end()].translate(changed)))
        at = m.end()
    if parts:
        parts.append(text[at:])
        text = "".join(parts)
    if _OTHER.search(text):
        text = _unmix(text)
    return text


@lru_cache(65536)
def _script_of(word: str) -> str | None:
    """The script of a word's letters that have no look-alike, None where there is none, '' for more than one."""
    own = {unicodedata.name(c, "").split(" ")[0] for c in unicodedata.normalize("NFD", word).translate(TO_LATIN) if c.isalpha() and c not in LATIN}
    return None if not own else own.pop() if len(own) == 1 else ""


def in_context(text: str) -> str:
    """The canonical form for readers of a language, not for comparisons: words of look-alikes only are in the script of the nearest
    word before, else after, that has one, else in Latin letters."""
    form = canonical(text)
    if not _OTHER.search(text):
        return form
    words = list(_OUTER.finditer(form))
    script = next((s for w in words if (s := _script_of(w[0]))), "LATIN")
    parts, at = [], 0
    for w in words:
        own = _script_of(w[0])
        if own:
            script = own
        elif own is None and (table := FROM_LATIN.get(script)):
            plain = unicodedata.normalize("NFD", w[0])
            if all(ord(c) in table for c in plain if c.isalpha()):
                parts += (form[at : w.start()], unicodedata.normalize("NFC", plain.translate(table)))
                at = w.end()
    return "".join(parts) + form[at:]


_SPACES = re.compile(r"\s+")
_OUTER = re.compile(r"[^\W\d_]+")


def _squeezed(text: str) -> str:
    return _SPACES.sub(" ", text)


def _readings(quote: str) -> list[str]:
    """Canonical forms of a quotation that may be cut within words: outer words of look-alikes only in each script."""
    key = _squeezed(canonical(quote)).strip()
    out = [key]
    words = list(_OUTER.finditer(key))
    for m in {w.span(): w for w in words[:1] + words[-1:]}.values():
        if (m.start() == 0 or m.end() == len(key)) and all(_base(c) in LATIN for c in m[0]):
            for table in FROM_LATIN.values():
                plain = unicodedata.normalize("NFD", m[0])
                if all(ord(c) in table for c in plain if c.isalpha()):
                    form = unicodedata.normalize("NFC", plain.translate(table))
                    out += [k[: m.start()] + form + k[m.end() :] if m.end() < len(key) else k[: len(k) - (m.end() - m.start())] + form for k in list(out)]
    return list(dict.fromkeys(out))


def same_looking(quote: str, texts: list[str]) -> list[bool]:
    """Whether the quotation looks like a stretch of each text."""
    keys = [k for k in _readings(quote) if k]
    return [any(k in t for k in keys) for t in (_squeezed(canonical(t)) for t in texts)]


def canonicalize(df: DataFrame, keys: list[str], text_col: str, out_col: str = "canonical_text") -> DataFrame:
    """(keys, out_col) of each row, in one pass without a shuffle."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", {out_col} string"

    def factory():
        return lambda cols: (*cols[:-1], [canonical(t) for t in cols[-1]])

    return arrow_map(df, [*keys, text_col], schema, factory)


#: White space as Java's and Python's patterns see it differs; both sides of the exact test are as stored.
def _stored(quote: Column, text: Column) -> Column:
    return F.coalesce(F.contains(text, quote), F.lit(False))


#: A passage id with more rows than this share of the table, and more than so many, is hot: there are fewer than 1 / share of them.
HOT_SHARE, HOT_ROWS = 1e-4, 1000


def _without_copies(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (source_id, id, text), partitioned as the join needs it, so that texts are shuffled once.

    Copies of a hot id, of which there are fewer than 1 / HOT_SHARE, are combined before the shuffle instead,
    however many there are.
    """
    on = ["source_id", "id"]
    p = passages.select(*on, "text").where("text is not null and source_id is not null and id is not null")
    least = max(HOT_ROWS, int(passages.count() * HOT_SHARE))
    hot = F.broadcast(passages.groupBy(*on).count().where(F.col("count") > least).select(*on))
    return p.join(hot, on, "left_anti").repartition(*on).distinct(), p.join(hot, on, "left_semi").distinct()


def disguised_quotes(anchors: DataFrame, passages: DataFrame) -> DataFrame:
    """Keys of anchors whose quote is in none of its passages as stored, but looks like a stretch of one.

    Anchors meet their passages on (source_id, passage id), which spreads a hot source over all
    tasks; copies are combined on either side before they meet.
    Only pairs without an exact match are compared in canonical form. Null or blank quotes, null
    passage lists and passages that do not exist are no case.
    """
    keys = ["source_id", "field_path", "anchor_id"]
    a = anchors.select(*keys, "quote", F.explode("passage_ids").alias("id")).where("trim(quote) <> ''").distinct()
    met = [a.join(p, ["source_id", "id"]) for p in _without_copies(passages)]
    pairs = met[0].unionByName(met[1]).select(*keys, _stored(F.col("quote"), F.col("text")).alias("stored"), "quote", "text")
    pairs = pairs.select(*keys, "stored", "quote", F.when(~F.col("stored"), F.col("text")).alias("text"))

    def factory():
        def chunk(cols):
            *key, stored, quotes, texts = cols
            looks = [t is not None and same_looking(q, [t])[0] for q, t in zip(quotes, texts)]
            return (*key, stored, looks)

        return chunk

    schema = ", ".join(f"{k} string" for k in keys) + ", stored boolean, looks boolean"
    seen = arrow_map(pairs, [*keys, "stored", "quote", "text"], schema, factory)
    return seen.groupBy(*keys).agg(F.max("stored").alias("stored"), F.max("looks").alias("looks")).where("looks and not stored").select(*keys)
