"""Problem 1: the language of each document and of each block, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound into one vector by
multiplying its letters' vectors, the first permuted twice and the second once. The vectors of a
text's trigrams, bundled by addition, are its profile; the profiles of known text, weighted by the
logarithm of each trigram's count and without what all have in common, are the prototypes. A block
is compared with the prototypes by cosine.

The cosine's denominator follows from the counts of the text's trigrams, their vectors being as good as orthogonal.
Because a profile is a sum, its product with a prototype is the sum of its trigrams' products with
it. Those are computed once for each distinct trigram (ahead for all trigrams of the training
texts, on first sight for others), so that a text costs a look-up a letter whatever the dimension.
A language has several prototypes: its own letters, without accents, in Latin letters, and as it
looks when read in a usual wrong encoding; all stand for the one language.

Prototypes are trained on seed texts and on blocks of a bounded sample of records whose hint and
seed verdict agree.

Defined results: null and blank texts, and texts without letters whose title doesn't tell either, have no language and no rows; a block without enough letters
or without a clear verdict goes with the document; confidence is the softmax of the cosines and lies in
(0, 1]. Hints are read as codes, three-letter codes, names or native names, with any case and region.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import arrow_map, bounded_sample
from .canonical import in_context
from .seeds import SEEDS

DIMENSION, SEED = 2048, 20240229
#: Records sampled for training, characters kept of each language, and distinct trigrams tabulated ahead.
TRAIN_RECORDS, TRAIN_CHARS, MAX_TRIGRAMS = 1500, 400_000, 120_000
#: Lead by which the seeds must prefer a language for a block to train it: where the hint says the same, where it does not.
TRAIN_LEADS = (0.04, 0.12)
#: A block differs from its document if its language's cosine leads by so much (chance moves a cosine by 1 / sqrt(DIMENSION), 0.022), and it has so many letters.
BLOCK_MARGIN, BLOCK_LETTERS = 0.10, 5
#: From this lead on a block's letters count in full towards the main language.
CLEAR = 0.05
#: ASCII letters and digits in a row that may still be a word.
LONGEST_WORD = 40
#: Sharpness of the confidence.
TEMPERATURE = 60.0

#: Names of the languages of the corpus: codes, three-letter codes, English and native names.
NAMES = {
    "el": "el ell gre greek ελληνικα gr",
    "en": "en eng english αγγλικα",
    "tr": "tr tur turkish turkce τουρκικα",
    "ru": "ru rus russian русскии",
    "bg": "bg bul bulgarian български",
    "fr": "fr fra fre french francais",
    "de": "de deu ger german deutsch",
    "ro": "ro ron rum romanian romana",
    "ar": "ar ara arabic العربية",
    "zh": "zh zho chi chinese 中文 汉语 漢語",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "th": "th tha thai ไทย ภาษาไทย",
    "hy": "hy hye arm armenian հայերեն",
}
_NAME_OF = {name: code for code, names in NAMES.items() for name in names.split()}

#: The script each language is usually written in.
_OWN_SCRIPT = {"el": "Ͱ-Ͽἀ-῿", "ru": "Ѐ-ӿ", "bg": "Ѐ-ӿ", "ar": "؀-ۿ", "zh": "㐀-鿿", "hi": "ऀ-ॿ", "th": "฀-๿", "hy": "԰-֏"}
_OWN = {code: re.compile(f"[{script}]") for code, script in _OWN_SCRIPT.items() if code not in ("ru", "bg")}

#: Latin spellings of letters of other alphabets.
LATIN_OF = {
    "el": dict(zip("αβγδεζηθικλμνξοπρστυφχψως", "a v g d e z i th i k l m n x o p r s t y f ch ps o s".split())),
    "ru": dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya yo".split(" "))),
    "bg": dict(zip("абвгдежзийклмнопрстуфхцчшщъьюя", "a b v g d e zh z i y k l m n o p r s t u f h ts ch sh sht a y yu ya".split())),
    "hy": dict(zip("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆև", "a b g d e z e y t zh i l kh ts k h dz gh ch m y n sh vo ch p j r s v t r ts w p k o f ev".split())),
}
#: Wrong readings of right text: written in, read in.
MISREAD = {
    "el": (("cp1253", "cp1252"), ("cp1253", "cp1251"), ("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "cp1253"), ("cp737", "cp1253"), ("cp1253", "cp437"), ("cp1253", "cp737")),
    "ru": (("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("utf_8", "cp1252"), ("utf_8", "latin_1"), ("cp1251", "cp1253"), ("utf_8", "cp1251")),
    "bg": (("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("utf_8", "cp1252"), ("utf_8", "latin_1"), ("cp1251", "cp1253"), ("utf_8", "cp1251")),
    "tr": (("utf_8", "cp1252"), ("cp1254", "cp1253")),
}


def normalize_hint(hint: str | None) -> str | None:
    """The language code a hint means, '?' for one that means no language of the corpus, None if there is none."""
    if hint is None or not hint.strip():
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", hint.strip().lower().replace("ı", "i")) if not unicodedata.combining(c))
    plain = re.split(r"[\s_\-(,;/@.]", plain, maxsplit=1)[0] if plain not in _NAME_OF else plain
    return _NAME_OF.get(plain, "?")


# letters ------------------------------------------------------------------------------------------

_LATIN = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿğıșşțţăœšžœƒ"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёєіїјљњћќўџґђѓѕ"


def _letters() -> tuple[np.ndarray, np.ndarray, int]:
    """Class of each code point (0: passed over, 1: no letter) and script of each class."""
    classes: dict[str, int] = {}
    script = [0, 0]

    def add(key: str, group: int) -> int:
        if key not in classes:
            classes[key] = len(classes) + 2
            script.append(group)
        return classes[key]

    lut = np.ones(0x10001, np.uint8)
    for text, group in ((_LATIN, 1), (_GREEK, 2), (_CYRILLIC, 3)):
        for ch in text:
            lut[ord(ch)] = add(ch, group)
    for cp in range(0x80, 0xC0):
        lut[cp] = add(f"sign{cp % 12}", 1)
    for ch in "‚ƒ„…†‡ˆ‰‹Œ‘’“”•–—˜™›":
        lut[ord(ch)] = add(f"mark{ord(ch) % 6}", 1)
    for cp in range(0x2500, 0x25A0):
        lut[cp] = add(f"box{cp % 8}", 2)
    for name, low, high in (("hy", 0x531, 0x588), ("ar", 0x620, 0x6FF), ("hi", 0x900, 0x970), ("th", 0xE00, 0xE5C), ("zh", 0x3400, 0xA000)):
        for cp in range(low, high):
            if unicodedata.category(chr(cp))[0] in "LM":
                lut[cp] = add(f"{name}{cp % 6}", 4)
    lut[ord("­")] = lut[0xA0] = 1
    for cp in range(0x10000):
        ch = chr(cp)
        if lut[cp] != 1 or 0xD800 <= cp < 0xE000:
            continue
        if unicodedata.category(ch) in ("Mn", "Cf"):
            lut[cp] = 0
            continue
        wide = unicodedata.normalize("NFKD", ch) if 0xFF00 <= cp < 0xFFF0 or 0x370 <= cp < 0x530 or 0x1F00 <= cp < 0x2000 or 0xFB00 <= cp < 0xFB07 else ch
        low = wide[:1].lower()[:1]
        if low == "ς":
            low = "σ"
        if low != ch and low and ord(low) < 0x10000 and lut[ord(low)] > 1:
            lut[cp] = lut[ord(low)]
    lut[ord("­")] = 0
    lut[ord("̇")] = 0
    lut[0xA0] = 1
    lut[ord("ς")] = lut[ord("σ")]
    lut[ord("й")] = lut[ord("Й")] = classes["й"]
    lut[ord("ё")] = lut[ord("Ё")] = classes["ё"]
    lut[ord("’")] = lut[ord("‘")] = lut[ord("“")] = lut[ord("”")] = lut[ord("„")] = lut[ord("…")] = lut[ord("–")] = lut[ord("—")] = lut[ord("•")] = lut[ord("«")] = lut[ord("»")] = 1
    return lut, np.array(script, np.uint8), len(script)


LUT, SCRIPT, CLASSES = _letters()
#: What the canonical form may change for a reader of letters: scripts that meet, characters that do not show, wide forms.
_MIXED = re.compile("[A-Za-z][Ͱ-ϿЀ-ԯ]|[Ͱ-ϿЀ-ԯ][A-Za-z]|[\u00ad\u200b-\u200f\u2060\ufeff\uff01-\uff5e]")


def _no_codes(cps: np.ndarray, ids: np.ndarray) -> None:
    """Unbroken runs of ASCII letters and digits that no word is long enough for are codes, not text."""
    low = cps | 32
    run = np.concatenate(([False], ((cps >= 48) & (cps <= 57)) | ((low >= 97) & (low <= 122)), [False]))
    edges = np.flatnonzero(run[1:] != run[:-1])
    begins, ends = edges[::2], edges[1::2]
    long = ends - begins > LONGEST_WORD
    for a, b in zip(begins[long], ends[long]):
        ids[a:b] = 1


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter trigrams of all texts, and of each the number of its text."""
    joined = "\n".join([*texts, ""])
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = LUT[np.minimum(cps, 0x10000)]
    _no_codes(cps, ids)
    owner = np.cumsum(cps == 10)
    if "\n" in "".join(texts):
        raise ValueError("texts must hold no line feed")
    keep = ids > 0
    keep[1:] &= ~((ids[1:] == 1) & (ids[:-1] == 1) & (cps[1:] != 10))
    ids, owner, ends = ids[keep].astype(np.int32), owner[keep], (cps == 10)[keep]
    codes = (ids[:-2] * CLASSES + ids[1:-1]) * CLASSES + ids[2:]
    # the middle letter's text; a middle that is no letter says nothing, nor does a reach beyond the text
    good = (ids[1:-1] > 1) & ~(ends[:-2] & (ids[:-2] != 1))
    return codes[good], owner[1:-1][good]


class Profiles:
    """Prototypes and the product of each known trigram with each of them."""

    def __init__(self, prototypes: np.ndarray, codes: list[str], seed_codes: np.ndarray):
        self.prototypes = prototypes.astype(np.float32)  # unit length, one row each
        self.codes = codes
        self.langs = list(NAMES)
        self.column = np.array([self.langs.index(c) for c in codes])
        self.known = np.sort(seed_codes)
        self.table = self._products(self.known)

    @staticmethod
    def vectors(codes: np.ndarray) -> np.ndarray:
        """The bound vectors of trigrams."""
        letters = _letter_vectors()
        a, b, c = codes // (CLASSES * CLASSES), codes // CLASSES % CLASSES, codes % CLASSES
        return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]

    def _products(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(self.codes)), np.float32)
        for at in range(0, len(codes), 4096):
            out[at : at + 4096] = self.vectors(codes[at : at + 4096]).astype(np.float32) @ self.prototypes.T
        return out

    @staticmethod
    def lengths(codes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Length of each text's profile: bound vectors of different trigrams are as good as orthogonal, so their squared counts add up.

        What they share by chance is a share of the square with a standard deviation of at most sqrt(2 / DIMENSION), 3 percent.
        """
        both = np.sort(owner.astype(np.int64) * CLASSES**3 + codes)
        starts = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, int)
        counts = np.diff(np.append(starts, len(both)))
        square = np.bincount(both[starts] // CLASSES**3, counts.astype(float) ** 2, texts)
        return np.sqrt(DIMENSION * np.maximum(square, 1)).astype(np.float32)

    def ready(self) -> Profiles:
        """Set up the direct look-up, once a worker."""
        self.lookup = np.full(CLASSES**3, -1, np.int32)
        self.lookup[self.known] = np.arange(len(self.known))
        self.rows = self.table
        return self

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) cosine with the best prototype of each language, and the number of trigrams."""
        codes, owner = trigrams(texts)
        at = self.lookup[codes]
        if (unseen := np.unique(codes[at < 0])).size:
            if len(self.rows) + len(unseen) > 4 * MAX_TRIGRAMS:  # forget what was seen in passing
                self.lookup[:] = -1
                self.lookup[self.known] = np.arange(len(self.known))
                self.rows = self.table
                unseen = np.unique(codes[self.lookup[codes] < 0])
            self.lookup[unseen] = len(self.rows) + np.arange(len(unseen))
            self.rows = np.concatenate([self.rows, self._products(unseen)])
            at = self.lookup[codes]
        n = np.bincount(owner, minlength=len(texts)).astype(np.float32)
        sums = np.zeros((len(texts), self.rows.shape[1]), np.float32)
        if len(at):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sums[owner[starts]] = np.add.reduceat(self.rows[at], starts, axis=0)
        cosine = sums / self.lengths(codes, owner, len(texts))[:, None]
        best = np.full((len(texts), len(self.langs)), -np.inf, np.float32)
        for j, k in enumerate(self.column):
            np.maximum(best[:, k], cosine[:, j], out=best[:, k])
        return best, n


_VECTORS: list[np.ndarray] = []


def _letter_vectors() -> np.ndarray:
    if not _VECTORS:
        _VECTORS.append(np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSION)))
    return _VECTORS[0]


_MARKS = re.compile("[\u0300-\u036f]+")


def _bare(text: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFD", text.replace("ı", "i").replace("İ", "I"))).replace("ß", "ss")


def _variants(code: str, text: str) -> list[str]:
    """The text as it may look beside its usual form."""
    out = [text]
    if code in ("tr", "fr", "de", "ro"):
        out.append(_bare(text))
    if code in LATIN_OF:
        low = _bare(text.lower()).translate({ord("ё"): "е"}) if code != "el" else _bare(text.lower())
        out.append(low.translate(str.maketrans(LATIN_OF[code])))
        if code == "el":
            other = LATIN_OF["el"] | {"β": "b", "η": "h", "υ": "u", "χ": "x", "ξ": "ks", "ω": "w", "θ": "8"}
            out.append(low.translate(str.maketrans(other)))
            out.append(low.replace("ου", "ou").replace("αυ", "av").replace("ευ", "ev").replace("μπ", "b").replace("ντ", "d").translate(str.maketrans(LATIN_OF["el"])))
    for written, read in MISREAD.get(code, ()):
        data = text.encode(written, "ignore")
        out.append(data.decode(read, "ignore").replace("\n", " "))
    return out


def _train(texts: dict[str, list[str]]) -> Profiles:
    """Prototypes from texts of each language."""
    names, counted = [], []
    for code in NAMES:
        joined = " ".join(SEEDS[code].split()) + " " + " ".join(x.replace("\n", " ") for x in texts.get(code, ()))
        for variant in _variants(code, joined):
            codes, _ = trigrams([variant.replace("\n", " ")])
            if len(codes):
                names.append(code)
                counted.append(np.unique(codes, return_counts=True))
    known = np.unique(np.concatenate([c for c, _ in counted]))
    weights = np.zeros((len(names), len(known)), np.float32)
    for i, (codes, counts) in enumerate(counted):
        weights[i, np.searchsorted(known, codes)] = np.log1p(counts * (20_000 / counts.sum()))
    # what the prototypes of other languages share says nothing; a language's own variants don't count against it
    by_lang = np.stack([weights[[i for i, x in enumerate(names) if x == code]].max(0) for code in NAMES])
    rest = (by_lang.sum(0) - np.stack([by_lang[list(NAMES).index(x)] for x in names])) / (len(NAMES) - 1)
    weights = weights - rest * 1.5
    if len(known) > MAX_TRIGRAMS:
        keep = np.sort(np.argsort(-np.abs(weights).max(0), kind="stable")[:MAX_TRIGRAMS])
        known, weights = known[keep], weights[:, keep]
    prototypes = np.zeros((len(names), DIMENSION), np.float32)
    for at in range(0, len(known), 4096):
        prototypes += weights[:, at : at + 4096] @ Profiles.vectors(known[at : at + 4096]).astype(np.float32)
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Profiles(prototypes, names, known)


def train(records: list[tuple[str, str | None]]) -> Profiles:
    """Prototypes from (text, hint) pairs, hints being partly wrong: a block counts if the seeds agree with its record's hint or leave no doubt."""
    model = _train({})
    for _ in range(2):
        model.ready()
        chosen: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for text, hint in records:
            blocks = [b.replace("\n", " ") for b in text.split("\n\n") if len(b) >= 30]
            if not blocks:
                continue
            score, n = model.scores(blocks)
            hint = normalize_hint(hint)
            order = np.argsort(-score, axis=1)
            for b, s, o, k in zip(blocks, score, order, n):
                lang = model.langs[o[0]]
                gap = float(s[o[0]] - s[o[1]])
                if k >= 20 and gap > TRAIN_LEADS[lang != hint] and size.get(lang, 0) < TRAIN_CHARS:
                    chosen.setdefault(lang, []).append(b)
                    size[lang] = size.get(lang, 0) + len(b)
        model = _train(chosen)
    return model


_TO_BYTE = {ord(bytes([b]).decode("cp1252", "ignore") or "\x80"): chr(b) for b in range(0x80, 0xA0)}
_BYTE = "[\u0080-\u00bf" + "".join(chr(c) for c in _TO_BYTE) + "]"
_TWICE = re.compile(f"\u00c3{_BYTE}\u00c2{_BYTE}")


def _seen(block: str) -> str:
    """The block as it is profiled: UTF-8 read in Latin-1 or its Windows form again and again is read back while that is possible, look-alikes go to the script of their word."""
    while _TWICE.search(block):
        try:
            block = block.translate(_TO_BYTE).encode("latin_1").decode("utf_8")
        except UnicodeError:
            break
    return " ".join((in_context(block) if _MIXED.search(block) else block).split("\n"))


def blocks_of(text: str) -> list[str]:
    return text.split("\n\n")


_LOST = re.compile("�|\\?{2,}")


def _lost(text: str) -> int:
    """Characters that became replacement or question marks."""
    return sum(len(m) for m in _LOST.findall(text)) if "�" in text or "??" in text else 0


def _of_script(text: str | None) -> str | None:
    """The language of a text in a script that only one language of the corpus has."""
    counts = {c: len(p.findall(text)) for c, p in _OWN.items()} if text else {}
    best = max(counts, key=counts.get, default=None)
    return best if best and counts[best] >= BLOCK_LETTERS else None


def judge(model: Profiles, texts: list[str | None], titles: list[str | None] | None = None) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
    """Of each text its main language, confidence, and the (number, language, confidence) of its blocks in another.

    A block with more lost characters than letters has no verdict. A text without any verdict has the language of
    its title if that is in a script of one language, at confidence 0.5, else none.
    """
    flat, owner = [], []
    for i, text in enumerate(texts):
        if text and not text.isspace():
            for no, block in enumerate(blocks_of(text), 1):
                flat.append(_seen(block))
                owner.append((i, no))
    out: list = [(None, 0.0, []) for _ in texts]
    if not flat:
        return out
    score, n = model.scores(flat)
    langs = model.langs
    at = 0
    while at < len(flat):
        i = owner[at][0]
        to = at
        while to < len(flat) and owner[to][0] == i:
            to += 1
        s, k = score[at:to], n[at:to].copy()
        k[[_lost(flat[b]) > n[b] for b in range(at, to)]] = 0
        if not k.sum() and titles is not None and (told := _of_script(titles[i])):
            out[i] = (told, 0.5, [])
        elif k.sum():
            first = s.argmax(1)
            weight = np.zeros(len(langs))
            np.add.at(weight, first, k * np.clip(s[np.arange(len(s)), first] - np.partition(s, -2, axis=1)[:, -2], 0.01, CLEAR))
            main = int(weight.argmax())
            mean = (s * k[:, None]).sum(0) / k.sum()
            confidence = np.exp(TEMPERATURE * (s - s.max(1, keepdims=True)))
            confidence /= confidence.sum(1, keepdims=True)
            others = [
                (owner[at + b][1], langs[first[b]], float(confidence[b, first[b]]))
                for b in range(to - at)
                if first[b] != main and k[b] >= BLOCK_LETTERS and s[b, first[b]] - s[b, main] > BLOCK_MARGIN
            ]
            whole = np.exp(TEMPERATURE * (mean - mean.max()))
            out[i] = (langs[main], float(whole[main] / whole.sum()), others)
        at = to
    return out


def fit(judgments: DataFrame, text_col: str = "clean_text", hint_col: str = "language_hint"):
    """A broadcast of the prototypes and the trigram table (at most MAX_TRIGRAMS rows), trained on a bounded sample."""
    rows = bounded_sample(judgments, [text_col, hint_col], TRAIN_RECORDS)
    return judgments.sparkSession.sparkContext.broadcast(train(rows))


def languages(judgments: DataFrame, fitted, key_col: str = "source_id", text_col: str = "clean_text", hint_col: str = "language_hint", title_col: str | None = None) -> DataFrame:
    """(key, block_no, lang, confidence, hint_ok): row 0 for each text, and one for each block in another language.

    One pass over three columns without a shuffle.
    """
    kind = judgments.schema[key_col].dataType.simpleString()

    def factory():
        model = fitted.value.ready()

        def chunk(cols):
            keys, texts, hints, *titles = cols
            out = []
            for key, hint, (main, confidence, others) in zip(keys, hints, judge(model, texts, *titles)):
                if main is not None:
                    out.append((key, 0, main, confidence, normalize_hint(hint) == main))
                    out += [(key, no, lang, c, True) for no, lang, c in others]
            return list(zip(*out)) if out else [[]] * 5

        return chunk

    columns = [key_col, text_col, hint_col, *([title_col] if title_col else [])]
    return arrow_map(judgments, columns, f"{key_col} {kind}, block_no int, lang string, confidence double, hint_ok boolean", factory)
