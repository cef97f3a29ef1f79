"""Problem 4: find text that was decoded with the wrong character encoding, and restore it.

A smoothed character model is trained on the clean lines of all records: seed texts choose those that are
likely, the model is trained on these, and on those among them that it finds likely itself. Only counts of
character pairs and of scores reach the driver. A line is scored
as it stands; lines whose every character pair is likely can gain nothing and are done. For the others each
encode-decode chain (the encoding it was read in, undone, then the one it was written in, twice
over for doubly read UTF-8) gives a candidate; the likeliest is accepted if it beats the line by
more than a margin validated on clean lines, each held out once, the line counting in look-alike-free form
so that disguised letters are no evidence. Text lost for good (replacement characters, words of
question marks) is found by its marks.

Defined results: null, empty and pure ASCII texts without such marks are clean; the charset label
is never looked at; a partly lost line is restored as far as its bytes allow. Repeated rows get the same verdict.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
import zlib
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .arrowmap import added, arrow_map, arrow_tally, spread
from .canonical import in_context
from .charmodel import Alphabet, CharModel, code_points, per_line
from .seeds import SEEDS

#: Least length of lines that train the model, and their least log likelihood by character in the model of the seeds.
LEAST_LINE, LEAST_LIKELY = 12, -5.2
#: Pairs of characters that all counted ones stand for; the smoothing and the limits in nats below are meant for about as many.
SCALE = 1_500_000
#: Parts of the clean lines that are held out in turn.
FOLDS = 9
#: What pairs of a line lack below TYPICAL, counted where they are below UNLIKELY, is all that a chain can gain.
UNLIKELY, TYPICAL = -8.0, -2.5
#: A line that lacks less than this, in nats, is done.
SUSPECT = 16.0
#: Least margin in nats, and the factor on the largest gain seen on a clean line held out.
LEAST_MARGIN, MARGIN_FACTOR = 10.0, 1.25
#: The least margin of lines that are UTF-8 throughout, as right text hardly ever is.
LEAST_UTF8 = 6.0
#: Margins that the lines of a garbled record gain together at least: single rare letters may gain one or two.
SURE = 3.0

#: Encodings a text may have been read in, and those it may have been written in.
READ_AS = ("cp1252", "cp1253", "cp1251", "cp1254", "cp437", "cp737", "cp850", "cp866", "iso8859_7", "iso8859_5", "iso8859_2", "cp1250", "koi8_r", "mac_roman", "mac_greek", "cp869", "cp1256", "iso8859_9", "latin_1", "cp874")
WRITTEN_IN = ("utf_8", "cp1253", "cp1251", "cp1254", "cp1250", "iso8859_7", "cp737", "koi8_r", "cp866", "cp1252", "iso8859_5", "iso8859_2", "cp1256", "cp874", "gb18030", "mac_greek", "cp869", "cp857", "iso8859_16", "iso8859_9", "cp850", "mac_cyrillic", "armscii8", "cp437")


def _byte_table(name: str) -> tuple[dict[str, int], str] | None:
    """Characters of a one-byte encoding; undefined bytes pass as control characters, as browsers pass them."""
    try:
        if len("é".encode(name, "replace")) != 1:
            return None
    except LookupError:
        return None
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    if any(len(c) != 1 for c in chars):
        return None
    return {c: b for b, c in enumerate(chars)}, "".join(chars)


_TABLES = {name: t for name in {*READ_AS, *WRITTEN_IN} if name not in ("utf_8", "gb18030", "big5", "shift_jis", "armscii8") and (t := _byte_table(name))}
#: Doubtful bytes of a C1 control stand for themselves whatever the encoding was.
for _enc, _ in _TABLES.values():
    for _b in range(0x80, 0xA0):
        _enc.setdefault(chr(_b), _b)


def _unread(text: str, name: str) -> bytes | None:
    """The bytes that read as ``text`` in ``name``; None if there are none."""
    if name in _TABLES:
        try:
            return bytes(map(_TABLES[name][0].__getitem__, text))
        except KeyError:
            return None
    try:
        return text.encode(name)
    except UnicodeError:
        return None


def _reread(data: bytes, name: str) -> str | None:
    if name in _TABLES:
        return codecs.charmap_decode(data, "strict", _TABLES[name][1])[0]
    if name == "utf_8":
        try:
            return data.decode("utf_8")
        except UnicodeDecodeError:
            text = data.decode("utf_8", "replace")
            gone = text.count("�")  # a few damaged sequences among many right ones
            return text if 3 * gone <= sum(c > "\x7f" for c in text) - gone else None
    try:
        return data.decode(name)
    except (UnicodeDecodeError, LookupError):
        return None


_LOST = re.compile(r"�|[\x80-\x84\x86-\x9f]")
#: Words that became question marks: two side by side, or one long one; never a date, a field or an emphasis.
_QUESTIONS = re.compile(r"(?<![/?\w.])\?{2,}[,.:»\")]?(?: [«(\"]?\?+[,.:»\")]?)+(?![/?\w])|(?<![/?.])\?{5,}(?![/?])")
_GLUED = re.compile(r"(?<=[a-zçğışöüéèâîșțăäß])\?(?=[a-zçğışöüéèâîșțăäß])")
#: Marks of UTF-8 read as a one-byte encoding, typographic characters above all.
_EXOTIC = re.compile(r"[     ​‌‍‎‏⁠﻿­　]")


def lost(text: str) -> bool:
    """Marks of characters that can't be restored."""
    return _LOST.search(text) is not None or "??" in text and _QUESTIONS.search(text) is not None


def _plain(line: str) -> str:
    """The line as it would look without disguises: what its likelihood is held against."""
    return in_context(line)


_HAN = re.compile("[\u3400-\u9fff]")


#: What stands beside ideographs in right Chinese text.
_CHINESE = re.compile("[\u3400-\u9fff\u3000-\u3011\uff01-\uff1f“”‘’—…·€\x00-\x7f]*")
_MIXED = re.compile("[A-Za-z][\u0370-\u03ff\u0400-\u04ff]|[\u0370-\u03ff\u0400-\u04ff][A-Za-z]|[\u0370-\u03ff][\u0400-\u04ff]")


def _in_words(before: str, after: str) -> bool:
    """Whether one-byte text may have become ``after``: ideographs come in numbers and among their own
    marks, no word mixes scripts that didn't before, and two changed characters at least stand next
    to a letter or another change, a lone symbol being no garbled word."""
    if han := len(_HAN.findall(after)):
        return han >= 4 and _CHINESE.fullmatch(after) is not None
    if len(before) != len(after):
        return True
    if len(_MIXED.findall(after)) > len(_MIXED.findall(before)):
        return False
    at = {i for i, (a, b) in enumerate(zip(before, after)) if a != b}
    return sum(i - 1 in at or i + 1 in at or before[i - 1 : i].isalpha() or before[i + 1 : i + 2].isalpha() for i in at) >= 2


def _read_of(low: int, high: int) -> np.ndarray:
    """Whether a code point is what a byte from ``low`` to ``high`` is read as."""
    found = np.zeros(0x3000, bool)
    found[[c for read in ("cp1252", "latin_1", "cp1253", "cp1251", "cp1254") for b in range(low, high) if 127 < (c := ord(_TABLES[read][1][b])) < 0x2FFF]] = True
    return found


#: Letters that the leading bytes of two-byte UTF-8 sequences are read as (scripts with vowel signs left out), and symbols that those after them are.
_LEADS = _read_of(0xC2, 0xE0) & (np.arange(0x3000) < 0x530)
_TAILS = _read_of(0x80, 0xC0) & ~np.array([chr(c).isalpha() for c in range(0x3000)])
#: The same of sequences of three bytes, the last of which may be read as a letter, too.
_LEADS3, _LAST = _read_of(0xE0, 0xF0) & (np.arange(0x3000) < 0x530), _read_of(0x80, 0xC0)


class Repairer:
    def __init__(self, model: CharModel, margin: float, utf8_margin: float | None = None):
        self.model, self.margin, self.utf8_margin = model, margin, margin if utf8_margin is None else utf8_margin
        self.seen: dict[str, tuple[float, str] | None] = {}

    def _sums(self, lines: list[str], lacking: bool) -> np.ndarray:
        """Of each line its log likelihood, or how much its unlikely pairs lack; one array for all."""
        joined = "\n" + "\n".join(lines) + "\n"
        lp = self.model.bigrams(joined)
        if lacking:
            # the start of a word says little in a mixture of languages, nor does what stands beside an ideograph
            cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            high, han = cps > 0x7F, (cps >= 0x3000) & (cps < 0xA000)
            # what must be a sequence of UTF-8, a leading byte before a symbol, counts at a word's start, too
            lead = np.append(_LEADS[np.minimum(cps[:-1], 0x2FFF)] & _TAILS[np.minimum(cps[1:], 0x2FFF)], False)
            lp = np.where((lp < UNLIKELY) & (high[1:] | high[:-1]) & ((cps[:-1] > 32) | lead[1:]) & ~(han[1:] | han[:-1]), TYPICAL - lp, 0.0)
        return np.add.reduceat(lp, np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])[:-1])), dtype=np.float64)

    def suspects(self, texts: list[str | None]) -> list[list[int]]:
        """Of each text, the numbers of lines that lack too much, as they stand and without disguises."""
        out: list[list[int]] = [[] for _ in texts]
        lines, owner = [], []
        for i, text in enumerate(texts):
            if not text or text.isascii():
                continue
            for k, line in enumerate(text.split("\n")):
                if line and not line.isascii() and line.count("�") * 5 < len(line):  # else there is nothing left to restore
                    lines.append(line)
                    owner.append((i, k))
        if lines:
            first = np.flatnonzero(self._sums(lines, True) > SUSPECT).tolist()
            if first:
                again = self._sums([_plain(lines[j]) for j in first], True)
                for j, lack in zip(first, again):
                    if lack > SUSPECT:
                        out[owner[j][0]].append(owner[j][1])
        return out

    def best(self, line: str) -> tuple[float, str, str] | None:
        """(gain, chain, text) of the likeliest candidate; gains are in nats over the line as it looks, in either case."""
        plain = _plain(line)
        flat = _EXOTIC.sub(lambda m: " " if m[0].isspace() and m[0] != "\ufeff" else "", line)
        have = self._sums([plain, plain.lower(), plain.capitalize()], False).max()
        found, tried = None, {line, flat, ""}
        todo = [(x, "") for x in dict.fromkeys((line, flat))]
        for depth in range(3):
            candidates: list[str] = []
            chains: list[str] = []
            for text, chain in todo:
                for read in READ_AS:
                    data = _unread(text, read)
                    if data is None or data.isascii():
                        continue
                    for written in ("utf_8",) if depth else WRITTEN_IN:
                        if written == read:
                            continue
                        candidate = _reread(data, written)
                        if candidate is None or candidate in tried or "\n" in candidate:
                            continue
                        tried.add(candidate)
                        candidates.append(candidate)
                        chains.append(f"{chain}{read}>{written} ")
            if not candidates:
                break
            sums = self._sums(candidates, False)
            for i, (c, n) in enumerate(zip(candidates, chains)):
                if sums[i] > have and "utf_8" not in n and not _in_words(flat, c):
                    sums[i] = -1e9
            at = int(sums.argmax())
            if found is None or sums[at] - have > found[0]:
                found = (float(sums[at] - have), chains[at], candidates[at])
            todo = [(c, n) for c, n in zip(candidates, chains) if n.endswith("utf_8 ")]
        return found

    def line(self, line: str) -> tuple[float, str, bool] | None:
        """(gain, restored line, whether its bytes are UTF-8 throughout), or None if the line is to stay."""
        if line in self.seen:
            return self.seen[line]
        found = self.best(line)
        utf8 = bool(found) and found[1].endswith("utf_8 ")
        fixed = (found[0], found[2], utf8) if found and found[0] > (self.utf8_margin if utf8 else self.margin) else self._inside(line)
        if len(self.seen) > 20_000:
            self.seen.clear()
        self.seen[line] = fixed
        return fixed

    def _inside(self, line: str) -> tuple[float, str, bool] | None:
        """A garbled stretch in a line that no chain takes as a whole."""
        parts = re.split(r"((?:[^\x00-\x7f]|(?<=[^\x00-\x7f])[ .,:;()'\"-](?=[^\x00-\x7f]))+)", line)
        gain = 0.0
        for i in range(1, len(parts), 2) if len(parts) >= 4 else ():
            if len(parts[i]) > 3:
                found = self.best(parts[i])
                if found and found[0] > self.margin * 1.5:
                    parts[i], gain = found[2], gain + found[0]
        return (gain, "".join(parts), False) if gain else None

    def texts(self, texts: list[str | None]) -> list[tuple[bool, bool, str | None]]:
        """(garbled, restored in full, text) of each text.

        A text is garbled if its lines that gain a margin gain SURE margins together, or one of them is UTF-8 throughout, which
        right text is not by chance; then every line that gains one is restored.
        """
        out = []
        for text, lines in zip(texts, self.suspects(texts)):
            is_lost = bool(text) and lost(text)
            fixed = None
            if lines:
                parts = text.split("\n")
                found = {k: f for k in lines if (f := self.line(parts[k]))}
                if found and (is_lost or sum(gain for gain, _, _ in found.values()) > SURE * self.margin or any(sure for _, _, sure in found.values())):
                    for k, (_, new, _) in found.items():
                        parts[k] = new
                    fixed = "\n".join(parts)
            result = fixed or text
            out.append((bool(fixed) or is_lost, bool(fixed) and not lost(result), result))
        return out


#: Letters that right text of the Latin and Greek languages may have beside those of the seeds.
_LETTERS = "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰ çğıöşüâîû àâæçéèêëîïôœùûüÿ äöüß ăâîșț ѝё"
#: Marks that right text of any language may have beside the letters of the seeds.
_TYPOGRAPHIC = "€£§°·–—…“”«»„‘’№½²³•©™、。，！？；：（）《》、।؟،؛՛՞՜։"


#: Characters of which lines may consist to train the model, ideographs besides.
_KNOWN = "".join(SEEDS.values()) + _LETTERS + "".join(map(chr, (*range(0x430, 0x450), *range(0x531, 0x588), *range(0x620, 0x653), *range(0x900, 0x970), *range(0xE00, 0xE5C))))
_KNOWN = {*_KNOWN, *_KNOWN.upper(), *_KNOWN.lower(), *map(chr, range(32, 127)), *_TYPOGRAPHIC}
_KNOWN_CP = np.zeros(0x10000 + 1, bool)
_KNOWN_CP[[*map(ord, _KNOWN), 0x0A, *range(0x4E00, 0xA000)]] = True


def _bare(char: str) -> str:
    return re.sub("[\u0300-\u0304\u0306-\u036f]", "", unicodedata.normalize("NFD", char.upper()))


_ALPHABET = Alphabet({x for c in _KNOWN for x in (c, *c.upper(), *_bare(c))})
_CELLS = _ALPHABET.size**2


@lru_cache(1)
def _seed_model() -> CharModel:
    return CharModel.train(list(SEEDS.values()))


def _model(pairs: np.ndarray) -> CharModel:
    """The model of counted lines, a quarter of them in capitals and another without accents, too, as headings are written, and of the seeds.

    Counts of more than SCALE pairs are brought to that many, in proportion: what a pair not seen lacks would grow with the table, else.
    """
    pairs = pairs * min(1.0, SCALE / max(1, pairs.sum()))
    headings = _ALPHABET.mapped(pairs, str.upper) + _ALPHABET.mapped(pairs, _bare)
    return CharModel.of(_ALPHABET, _ALPHABET.count(list(SEEDS.values())) + pairs + headings / 4)


def _is_utf8(line: str) -> bool:
    """Whether a line of known characters is UTF-8 throughout, read in another encoding."""
    for read in ("cp1252", "cp1253", "cp1251", "cp1254"):
        try:
            line.encode(read).decode("utf_8")
            return True
        except UnicodeError:
            pass
    return False


def clean_lines(texts: list[str | None]) -> list[str]:
    """The distinct lines of these texts that may train the model; texts with lost characters have none."""
    lines = list(dict.fromkeys(x for t in texts if t and not lost(t) for x in t.split("\n") if len(x) >= LEAST_LINE))
    if not lines:
        return []
    cps = code_points(lines)
    low = np.minimum(cps, 0x2FFF)
    # characters that look like a sequence of UTF-8 read wrongly; with many lines its pairs would become likely
    tails = _TAILS[low[1:]]
    traced = _LEADS[low[:-1]] & tails
    traced[:-1] |= _LEADS3[low[:-2]] & tails[:-1] & _LAST[low[2:]]
    good = per_line(_KNOWN_CP[np.minimum(cps[1:], 0x10000)] & ~traced, lines, np.logical_and, bool)
    likely = good & (_seed_model().totals(lines) > LEAST_LIKELY * np.array([len(x) + 1 for x in lines]))
    return [x for i in np.flatnonzero(likely).tolist() if (x := lines[i]).isascii() or not _is_utf8(x) and _plain(x) == x]


def _binned(model: CharModel, lines: list[str]) -> np.ndarray:
    """Log likelihoods by character in thousandths."""
    return np.floor(1000 * model.totals(lines) / np.array([len(x) + 1 for x in lines])).astype(np.int64)


def _selected(cols: list[list], chosen: tuple[CharModel, int] | None) -> tuple[list[int], list[str]]:
    """Folds and texts of the lines that a model makes as likely as given, at first of all."""
    folds, lines = cols
    if chosen and lines:
        at = np.flatnonzero(_binned(chosen[0], lines) >= chosen[1]).tolist()
        folds, lines = [folds[i] for i in at], [lines[i] for i in at]
    return folds, lines


def _pairs(chosen: tuple[CharModel, int] | None):
    """Counts pairs of selected lines by fold."""

    def chunk(cols):
        folds, lines = _selected(cols, chosen)
        parts = []
        for fold in sorted(set(folds)):
            found = _ALPHABET.count([x for f, x in zip(folds, lines) if f == fold])
            at = np.flatnonzero(found)
            parts.append((at + fold * _CELLS, found[at]))
        return parts[0] if len(parts) == 1 else added(parts)

    return chunk


def _scores(chosen: tuple[CharModel, int] | None, model: CharModel):
    """Counts selected lines by their log likelihood."""

    def chunk(cols):
        lines = _selected(cols, chosen)[1]
        return np.unique(_binned(model, lines) if lines else np.empty(0, np.int64), return_counts=True)

    return chunk


def _gains(chosen: tuple[CharModel, int] | None, cells: np.ndarray, folds: np.ndarray):
    """Counts selected lines by what a chain gains on them, in thousandths, twice that and one for UTF-8, by the model of all other folds."""
    trials: dict[int, Repairer] = {}

    def trial(fold: int) -> Repairer:
        if fold not in trials:
            pairs = np.zeros(_CELLS, np.int64)
            pairs[cells] = folds.sum(0) - folds[fold]
            trials[fold] = Repairer(_model(pairs), 0.0)
        return trials[fold]

    def chunk(cols):
        own, lines = _selected(cols, chosen)
        gains = []
        for fold in sorted(set(own)):
            held = [x for f, x in zip(own, lines) if f == fold]
            for x, suspect in zip(held, trial(fold).suspects(held)):
                if suspect and (found := trial(fold).best(x)) and found[0] > 0:
                    gains.append(2 * math.ceil(1000 * found[0]) + found[1].endswith("utf_8 "))
        return np.unique(np.array(gains, np.int64), return_counts=True)

    return chunk


def _median(values: np.ndarray, counts: np.ndarray) -> int:
    order = np.argsort(values, kind="stable")
    return int(values[order][np.searchsorted(np.cumsum(counts[order]), (counts.sum() + 1) // 2)])


def _fitted(tally) -> tuple[CharModel, float, float]:
    """The model and its margins (any chain, UTF-8 chains) from all clean lines; ``tally`` counts what one of the functions above finds in them.

    Every line is held out once, in one of FOLDS folds. A line that no pair makes suspect is never repaired, whatever a
    margin is, so only the others are tried; what gains SURE least margins is garbled text, which says nothing of right text.
    """

    def counted(chosen):
        folds = np.zeros((FOLDS, _CELLS), np.int64)
        items, n = tally(_pairs, chosen)
        folds.ravel()[items] = n
        return folds

    chosen = None
    folds = counted(chosen)
    # twice: what is unlikely among the selected lines goes, too
    for _ in range(2):
        model = _model(folds.sum(0))
        scores, n = tally(_scores, chosen, model)
        if n.sum() < 50:
            break
        median = _median(scores, n)
        chosen = model, median - 6 * max(150, _median(np.abs(scores - median), n))
        folds = counted(chosen)
    pairs = folds.sum(0)
    cells = np.flatnonzero(pairs)
    found = tally(_gains, chosen, cells, folds[:, cells])[0]
    found = found[found <= 2000 * SURE * LEAST_MARGIN + 1]
    gain, utf8_gain = (max(x.tolist(), default=0) // 2 / 1000 for x in (found, found[found % 2 == 1]))
    return _model(pairs), max(LEAST_MARGIN, MARGIN_FACTOR * gain), max(LEAST_UTF8, MARGIN_FACTOR * utf8_gain)


def train(records: list[str]) -> tuple[CharModel, float, float]:
    """The model and its margins from a list of texts, garbled ones among them."""
    lines = clean_lines(records)
    folds = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FOLDS for x in lines]
    return _fitted(lambda make, *args: make(*args)([folds, lines]))


def fit(tables: list[tuple[DataFrame, str]]):
    """A broadcast of model and margins (a table of at most ~750 x 750 floats) from all rows of (df, text column) each.

    Clean lines, each once however often it occurs, are written once by :func:`cut` and read by each count. Partitions hold
    one fold each, so that a task sends the pairs of one.
    """
    texts = reduce(DataFrame.unionAll, [df.select(F.col(col).alias("text")) for df, col in tables])
    context, n = texts.sparkSession.sparkContext, FOLDS * -(-texts.rdd.getNumPartitions() // FOLDS)
    lines = arrow_map(spread(texts), ["text"], "line string", lambda: lambda cols: (clean_lines(cols[0]),))
    # the hash that deals rows to partitions, their number being a multiple of FOLDS
    lines = cut(lines.repartition(n, "line").distinct().select(F.pmod(F.hash("line"), F.lit(FOLDS)).alias("fold"), "line"))

    def tally(make, *args):
        shared = context.broadcast(args)
        found = arrow_tally(lines, ["fold", "line"], lambda: make(*shared.value))
        shared.unpersist()
        return found

    return context.broadcast(_fitted(tally))


def repair(df: DataFrame, keys: list[str], text_col: str, fitted) -> DataFrame:
    """(keys, garbled, restored, repaired) of every row; one pass without a shuffle."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", garbled boolean, restored boolean, repaired string"

    def factory():
        repairer = Repairer(*fitted.value)

        def chunk(cols):
            out = repairer.texts(cols[-1])
            return (*cols[:-1], *zip(*out))

        return chunk

    return arrow_map(df, [*keys, text_col], schema, factory)
