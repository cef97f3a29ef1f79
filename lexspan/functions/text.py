"""Scalar text functions, all as column expressions inside whole-stage code generation.

White space means Unicode white space, letters are Unicode letters, and lengths and offsets count
code points. Null in, null out, unless a default is named.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces that forbid a line break.
NO_BREAK = "[\\u00A0\\u2007\\u202F]"
#: Named entities that text of web pages uses, with what they stand for.
ENTITIES = {"amp": "&", "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—", "hellip": "…", "euro": "€"}
#: Tags whose end is the end of a block.
BLOCK_TAGS = "p|div|h[1-6]|li|tr|table|section|article|header|footer|blockquote"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize_newlines(c: Column | str) -> Column:
    """Line feeds only, no NUL, plain spaces, no blanks before a line's end, at most two empty lines."""
    c = F.regexp_replace(col(c), "\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "\\x00", ""), NO_BREAK, " ")
    return trim(F.regexp_replace(F.regexp_replace(c, "[ \t]+\n", "\n"), "\n{4,}", "\n\n\n"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: within lambdas the engine shares no subexpressions, and deep ones are not copied."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tail(parts: Column) -> Column:
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def decode_entities(c: Column | str) -> Column:
    """Named, decimal and hexadecimal entities, in one pass: what an entity stands for is not read again; unknown ones stay as they are.

    The text is cut at its ampersands; a part that begins with a known name or number and a semicolon gives its character.
    """
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(part: Column) -> Column:
        def decoded(name: Column) -> Column:
            low = F.lower(name)
            digits = F.when(F.startswith(low, F.lit("#x")), F.conv(F.substring(low, 3, 6), 16, 10)).when(F.startswith(low, F.lit("#")), F.substring(low, 2, 7))
            number = digits.cast("int")
            good = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
            char = F.when(good, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.try_element_at(names, low))
            return F.coalesce(F.concat(F.when(name != "", char), F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

        return bound(F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});", 1), decoded)

    return bound(F.split(col(c), "&"), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(_tail(parts), one), "")))


def strip_tags(c: Column | str) -> Column:
    """Tags out, from a '<' to the next '>', which must not follow at once.

    The text is cut at its '>'; of each part but the last, what follows the first '<' goes. That is one pass, also over tags without an end.
    """

    def kept(part: Column) -> Column:
        at = F.instr(part, "<")
        return F.when((at > 0) & (at < F.length(part)), F.substr(part, F.lit(1), at - 1)).otherwise(F.concat(part, F.lit(">")))

    return bound(F.split(col(c), ">"), lambda parts: F.concat(F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), kept), ""), F.element_at(parts, -1)))


def without_raw(c: Column | str) -> Column:
    """Scripts and styles out. The text is cut at their beginnings; each part loses what it holds up to its end, if it has one."""
    c = col(c)
    for name in ("script", "style"):
        after = _after_end(name)
        c = bound(F.split(c, rf"(?i)<{name}(?=[\s>/])"), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(_tail(parts), after), "")))  # noqa: B023
    return c


def _after_end(name: str) -> Callable[[Column], Column]:
    def rest(part: Column) -> Column:
        return bound(F.split(part, rf"(?i)</{name}\s*>", 2), lambda ends: F.when(F.size(ends) > 1, F.element_at(ends, 2)).otherwise(F.concat(F.lit(f"<{name}"), part)))

    return rest


def html_to_text(c: Column | str) -> Column:
    """Visible text of a page: scripts and styles go first, block ends become empty lines, list items get bullets."""
    c = without_raw(c)
    c = F.regexp_replace(c, rf"(?i)</(?:{BLOCK_TAGS})\s*>", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"(?i)<li\b[^>]*+>", "• ")
    return normalize_newlines(decode_entities(strip_tags(c)))


def escape_html(c: Column | str) -> Column:
    c = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    for ch, to in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(ch), F.lit(to))
    return c


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole, halves up, 0 for an empty whole: the same on every engine."""
    scale = 10**digits
    return F.when(whole > 0, F.floor(part / whole * scale + F.lit(0.5)) / F.lit(float(scale))).otherwise(F.lit(0.0))


def uppercase_ratio(c: Column | str) -> Column:
    """Capital letters among letters, three digits."""
    c = col(c)
    return share(F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(c, r"[^\p{L}]", "")))


def paragraph_number(c: Column | str) -> Column:
    """The number a paragraph begins with, as [n], (n), n. or n), of up to four digits; else empty."""
    c = col(c)
    found = [F.regexp_extract(c, p, 1) for p in (r"^\s*\[(\d{1,4})\]", r"^\s*\((\d{1,4})\)", r"^\s*(\d{1,4})[.)](?:\s|$)")]
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))


def is_list_item(c: Column | str) -> Column:
    return F.regexp_like(col(c), F.lit(r"^\s*(?:[•‣▪–-]\s|\(?\d{1,4}[.)]\s|\(?[a-zα-ω][)]\s)"))


def is_heading(c: Column | str, words: Sequence[str], longest: int = 120, ratio: float = 0.6) -> Column:
    """Short, and mostly capitals or begun by a heading word of the caller's list."""
    c = col(c)
    begun = F.lit(False)
    for w in words:
        begun = begun | F.startswith(F.lower(trim(c)), F.lit(w.lower()))
    return (F.length(c) <= longest) & ((uppercase_ratio(c) >= ratio) | begun)


def script_hint(c: Column | str) -> Column:
    """'el' for text with any Greek letter, else 'en'."""
    return F.when(F.regexp_like(col(c), F.lit(r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]")), F.lit("el")).otherwise(F.lit("en"))


def content_id(c: Column | str, prefix: str = "doc_", length: int = 24) -> Column:
    """An identifier that follows from the text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(col(c).cast("binary"), 256), 1, length))


def line_at(c: Column | str, offset: Column) -> Column:
    """The line, from 1, in which a 0-based offset lies."""
    head = F.substr(col(c), F.lit(1), offset.cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def clamp01(c: Column | str, fallback: float) -> Column:
    """Within [0, 1]; null and NaN give the fallback."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None).cast("double")), F.lit(fallback))))


def one_of(c: Column | str, allowed: Sequence[str], fallback: str) -> Column:
    c = col(c)
    return F.when(c.isin(*allowed), c).otherwise(F.lit(fallback))


def field_path(c: Column | str) -> Column:
    """A path without indexes and surplus points: 'a[3]..b.' is 'a.b'."""
    c = F.regexp_replace(F.regexp_replace(col(c), r"\[\d*\]", ""), r"\.{2,}", ".")
    return F.regexp_replace(c, r"^\.|\.$", "")


def slug(c: Column | str, joiner: str = "-", longest: int = 80) -> Column:
    """Lower case, other characters than ASCII letters and digits as one joiner, none at the ends."""
    s = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", joiner)
    s = F.regexp_replace(F.substring(F.regexp_replace(s, f"^{joiner}|{joiner}$", ""), 1, longest), f"{joiner}$", "")
    return s


def without_clauses(c: Column | str, pattern: str) -> Column:
    """The clauses (between full stops or semicolons) that don't match, joined again."""
    clauses = F.transform(F.split(col(c), r"[.;]"), lambda x: F.trim(x))
    kept = F.filter(clauses, lambda x: (x != "") & ~F.regexp_like(x, F.lit(pattern)))
    return F.array_join(kept, ". ")


def clock(seconds: Column) -> Column:
    """mm:ss of a number of seconds, negative ones as 00:00."""
    s = F.greatest(seconds.cast("int"), F.lit(0))
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), (s % 60).cast("int"))


def percent(c: Column) -> Column:
    return F.floor(c * 100 + F.lit(0.5)).cast("int")


def bucket(c: Column, bounds: Sequence[tuple[float, str]], below: str) -> Column:
    """The name of the first bound reached, bounds falling."""
    out = F.lit(below)
    for low, name in reversed(bounds):
        out = F.when(c >= low, F.lit(name)).otherwise(out)
    return out


def omitted(c: Column | str) -> Column:
    """What stands for a long text that isn't carried along."""
    return F.when(col(c).isNotNull(), F.concat(F.lit("[omitted: "), F.length(col(c)).cast("string"), F.lit(" characters]")))


def folded(c: Column) -> Column:
    """Without case: lower letters, the three sigmas as one and the four i with and without a dot as one, on any engine alike."""
    return F.lower(F.translate(c, "ΣςİIı", "σσiii"))


def distinct_folded(items: Column) -> Column:
    """Of an array of strings the trimmed, non-empty ones, each spelling's first case-folded occurrence, in order."""
    cleaned = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

    def once(cleaned: Column) -> Column:
        keys = F.transform(cleaned, folded)
        return F.filter(cleaned, lambda x, i: F.array_position(keys, folded(x)) == i + 1)

    return bound(cleaned, once)


def flattened(items: Column, members: Sequence[str]) -> Column:
    """The text of an array of structures: of each the first of ``members`` that is not blank; blanks are left out."""
    first = lambda x: F.coalesce(*[F.nullif(F.trim(x[m].cast("string")), F.lit("")) for m in members])
    return F.array_join(F.filter(F.transform(items, first), lambda x: x.isNotNull()), " ")


def matches_all(c: Column | str, patterns: Sequence[str]) -> Column:
    """Whether every pattern is found; null counts as no text."""
    out = F.lit(True)
    for p in patterns:
        out = out & F.coalesce(F.regexp_like(col(c), F.lit(p)), F.lit(False))
    return out


def at_least(c: Column, floor: float) -> Column:
    """A confidence raised to a floor."""
    return F.greatest(F.lit(floor), c)


def ordinal_after(c: Column | str, words: Sequence[str]) -> Column:
    """The first number of up to three digits that follows one of the words; null if there is none."""
    found = F.regexp_extract(col(c), "(?i)(?:" + "|".join(words) + r")\D{0,3}(\d{1,3})", 1)
    return F.when(found != "", found.cast("int"))


def mapped(c: Column | str, names: dict[str, str], default: str = "") -> Column:
    """The name of a value, or the default."""
    out = F.lit(default)
    for value, name in names.items():
        out = F.when(col(c) == value, F.lit(name)).otherwise(out)
    return out


def first_match(c: Column | str, patterns: Sequence[str]) -> Column:
    """The first group of the first pattern that is found, null if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(col(c), p, 1), F.lit("")) for p in patterns])


def labelled(parts: Sequence[tuple[str, Column]], joiner: str = "; ") -> Column:
    """'label: value' of the parts that have a value, joined."""
    items = F.array(*[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{name}: "), v)) for name, v in parts])
    return F.array_join(F.array_compact(items), joiner)


def plain_value(c: Column, kind: str) -> Column:
    """How a value is shown: a dash for none, Yes and No, arrays joined, structures as JSON."""
    if kind == "boolean":
        shown = F.when(c, "Yes").otherwise("No")
    elif kind == "array":
        shown = F.array_join(c, ", ")
    elif kind == "struct":
        shown = F.to_json(c)
    else:
        shown = c.cast("string")
    return F.when(c.isNull(), F.lit("–")).otherwise(shown)


def without_prefix(items: Column, prefix: str) -> Column:
    return F.filter(items, lambda x: ~F.startswith(x, F.lit(prefix)))


def united(a: Column, b: Column, most: int) -> Column:
    """Both arrays' members once each, in order, up to ``most``."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)), 1, most)


def within(items: Column, allowed: Column, most: int) -> Column:
    """The items that are allowed, in their order and with their repeats, the first ``most``."""
    return F.slice(F.filter(items, lambda x: F.array_contains(allowed, x)), 1, most)
