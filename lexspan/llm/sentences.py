"""Problem 2: sentence boundaries in any language or script.

Candidates are the places where a sentence may end: after a run of terminators with its closing
marks, at a line break, and at spaces in scripts that separate sentences by spaces. A maximum-entropy model decides
every candidate, of whatever kind, by the neighbouring tokens (abbreviation, initial, number, length, inner periods, script,
how often a token ends and begins passages), case, digits and marks around it, and the layout (list marks, turns of speech,
headings, whether lines are filled or ended on purpose). It is trained on the reliable candidates of a bounded sample:
those whose surroundings leave no doubt (a passage's end, a break before a list mark, a terminator before a
small letter, a comma or after a title, a line that leaves room for the next word). All others, and all kinds in new surroundings,
are the model's to generalize to.

What is no candidate is settled before: speech in quotation marks or brackets inside a sentence is closed to boundaries, and a
leading number, bullet or speaker's letter alone is no sentence.

Features see bounded surroundings: 40 characters for a token (a longer one is a word), 60 for the script of what a semicolon
ends, 4 on either side of a space.

Positions are code points from 0, ends exclusive. Defined results: null and blank texts have no
sentences; text without sentence structure is one; every character but white space belongs to
exactly one sentence, and no sentence starts or ends with white space. Repeated rows repeat theirs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, namedtuple
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .arrowmap import arrow_map, bounded_sample
from .canonical import in_context

#: Passages sampled for training.
TRAIN_PASSAGES = 6000
ROUNDS, RATE, DECAY = 400, 0.5, 1e-4

#: Abbreviations that stand before what they belong to.
BEFORE = set(
    "mr mrs ms dr prof st sr jr hon messrs rev gen col no nos art arts s ss sec para paras p pp cf vs v viz approx ch cl fig vol ed al appl cap exh "
    "κ κα κος δρ κκ αρ αριθ πολ ποιν υπόθ υπ βλ άρθ παρ σελ κεφ τεκμ έφ πρβλ αγ "
    "av sn doç dr md böl bkz s no vd fk "
    "herr hr fr nr art abs vgl bzw z bd rn rdnr "
    "m mme mlle me mm art al ch n v p "
    "dl dna d-l d-na nr art alin lit "
    "г гр ул см ст ч п пп док чл ал т вж г-н г-жа д-р проф "
    "ypoth pol ar vl arth kef tekm sel par k "
    "jan feb mar apr jun jul aug sept sep oct nov dec ιαν φεβ μαρ απρ ιουν ιουλ αυγ σεπ οκτ νοε δεκ".split()
)
#: Abbreviations that may end a sentence or go on in it.
EITHER = set("etc ltd co inc plc corp u.k u.s a.m p.m p.a seq sq al κ.λπ κλπ κ.ά κ.α π.μ μ.μ ο.ε α.ε λτδ δηλ τ.μ ημ χλμ εκ ολομ vb vs şti a.ş tic т.д т.п т.е тыс руб д г usw u.a d.h z.b i.d.f etc cie s.a d.l ș.a h i.e e.g".split())
#: Of these, those that close an enumeration: before a capital the sentence is over.
CLOSING = set("etc κ.λπ κλπ κ.ά κ.α vb vs usw u.a т.д т.п seq".split())
_COMPANY = {"ltd", "co", "inc", "şti", "plc", "gmbh", "tic", "san"}

#: Characters on either side of a space that stand for a token, where words are not parted.
EDGE = 4

_OPEN, _CLOSE = "«“„‘「『（([【\"", "»”」』）)]】\""
_PAIR = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】"}
_TERM = re.compile(r"(?:[.!?…‼⁇⁈⁉։؟।॥。！？｡．;;]+(?:\s?[!?…])*)(?:[\"'»”’」』）)\]】]*)")
_LEADERS = re.compile(r"\.{4,}|(?:\. ){3,}")
_MARK = re.compile(r"(?:[•‣◦▪●·*∙]|[-‐‑–—](?=\s)|[(\[（]?(?:\d{1,4}|[^\W\d_]{1,2}|[ivxIVX]{1,5})[)\]）]|\d{1,4}\.(?=\s)|[^\W\d_]\.(?=\s))\s*")
_BULLET = re.compile(r"(?:[•‣◦▪●·*∙]|[-‐‑–—](?=\s)|[(\[（](?:\d{1,4}|[^\W\d_]{1,2}|[ivx]{1,5})[)\]）]|(?:\d{1,4}|[^\W\d_])[)）])\s*\S")
_NUMBERED = re.compile(r"\d{1,4}\.\s+[\"«“„(]?[^\W\d_]")
_SPEAKER = re.compile(r"[QAESCΕΑΌΚВОПSCFRQАЕＱＡ]\s?[.:]\s*\S|[^\W\d_]{1,2}\s?[.]\s+[\"«“„]?[^\W\d_]")
_TOKEN_BEFORE = re.compile(r"[^\s\"'«»“”„()\[\]（），,;:。！？]+$")
_SPACELESS = re.compile("[฀-๿຀-໿က-႟ក-៿]")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]")


@lru_cache(100_000)
def _norm(token: str) -> str:
    token = _INVISIBLE.sub("", token)
    if not token.isascii():
        token = unicodedata.normalize("NFC", in_context(unicodedata.normalize("NFKC", token)))
    return token.strip(".…!?;").lower().replace("i̇", "i")


@lru_cache(4096)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "? ").split(" ")[0] if ch else ""


def _first_solid(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at].isspace():
        at += 1
    return at


def _letter_at(text: str, at: int) -> int:
    """The place of the first character from ``at`` that shows."""
    while at < len(text) and unicodedata.category(text[at]) == "Cf":
        at += 1
    return at


def _next_token(text: str, at: int) -> str:
    m = re.compile(r"[\"'«“„(\[（「]*([^\s,;:.!?»”)\]。，]+\.?)").match(text, at)
    return m[1] if m else ""


class Candidate:
    __slots__ = ("at", "end", "go", "kind", "prev", "next", "gap")

    def __init__(self, at: int, end: int, go: int, kind: str, prev: str, nxt: str, gap: str):
        # terminators begin at ``at``, the sentence would end at ``end`` and the next begin at ``go``
        self.at, self.end, self.go, self.kind, self.prev, self.next, self.gap = at, end, go, kind, prev, nxt, gap


def candidates(text: str) -> list[Candidate]:
    out: list[Candidate] = []
    n, led = len(text), 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        if a < led:
            continue
        if leaders := _LEADERS.match(text, a):
            led = leaders.end()
            continue
        if a and text[a - 1] == "." and text[a] == ".":
            continue
        mark = m[0][0]
        # closing marks that were not opened before belong to what follows: a lone ASCII quote after a space is not taken by the pattern
        go = _first_solid(text, b)
        gap = text[b:go]
        prev = _TOKEN_BEFORE.search(text, max(0, a - 40), a)
        prev = prev[0] if prev else ""
        if not gap and go < n:
            solid = _letter_at(text, go)
            c, before = text[solid : solid + 1], prev[-1:] or text[a - 1 : a]
            if mark in "。！？｡।॥։؟":
                pass
            elif not (c.isupper() and (before.islower() or before.isdigit() and _script(c) != "LATIN" or b > a + 1) and (text[solid + 1 : solid + 2].islower() or text[solid + 1 : solid + 2].isspace())):
                continue
        out.append(Candidate(a, b, go, mark, prev, _next_token(text, go), gap))
    taken = {c.go for c in out}
    for m in re.finditer(r"[^\S\n]*\n\s*", text):
        a, b = m.span()
        go = _first_solid(text, b)
        if go not in taken and 0 < a and go < n:
            prev = _TOKEN_BEFORE.search(text, max(0, a - 40), a)
            out.append(Candidate(a, a, go, "\n", prev[0] if prev else "", _next_token(text, go), text[a:go]))
    if _SPACELESS.search(text):
        for m in re.finditer(r"(?<=[฀-๿຀-໿])[^\S\n]+(?=[฀-๿຀-໿])", text):
            out.append(Candidate(m.start(), m.start(), m.end(), "_", text[max(0, m.start() - EDGE) : m.start()], text[m.end() : m.end() + EDGE], m[0]))
    out.sort(key=lambda c: (c.at, c.end))
    return out


_INLINE_MARK = re.compile(r"[(\[（](?:\d{1,3}|[^\W\d_]{1,2}|[ivx]{1,4})[)\]）]\s+(?=\S)")


def _case(text: str, at: int) -> str:
    if m := _INLINE_MARK.match(text, at):
        at = m.end()
    while at < len(text) and (text[at] in "\"'«“„‘(（[「『" or text[at].isspace() or unicodedata.category(text[at]) in ("Cf", "Mn")):
        at += 1
    if at >= len(text):
        return "end"
    c = text[at]
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "upper" if c.isupper() or c.istitle() else "lower" if c.islower() else "plain"
    return "list" if c in "•‣◦▪●∙-–—‐" else "mark"


#: What a candidate looks like to the model; all fields are small sets of values.
Look = namedtuple("Look", "kind case next line lead turn layout head ended greek lex following unit length script ends begins mark size inner")
_KINDS = {"\n": "break", "_": "space", ";": "semicolon", ";": "semicolon", "!": "call", "?": "call", "…": "dots"} | dict.fromkeys("。！？｡।॥։؟⁇⁈⁉‼", "full")


class Model:
    """Weights of features, and how often tokens end and begin passages in the sample."""

    def __init__(self, weights: dict[str, float], ends: dict[str, float], begins: dict[str, float]):
        self.weights, self.ends, self.begins = weights, ends, begins
        self.known: dict[Look, float] = {}

    def look(self, text: str, c: Candidate, start: int, layout: int, breaks: list[int]) -> Look:
        """The features of a candidate in a sentence from ``start``; ``layout`` tells what the text's line breaks mean."""
        kind = _KINDS.get(c.kind, "dots" if text.startswith("...", c.at) else "stop")
        line = "\n" in c.gap
        prev, following = (c.prev, c.next) if kind == "space" else (_norm(c.prev), _norm(c.next))
        lead = ""
        if line:
            lead = "bullet" if _BULLET.match(text, c.go) or _NUMBERED.match(text, c.go) else "speaker" if _SPEAKER.match(text, c.go) else ""
        head = ended = mark = ""
        if kind == "break":
            k = bisect_left(breaks, c.at)
            if (not k or breaks[k - 1] < start) and c.at - start <= 100:
                title = _plain_mark(text[start : c.at].strip())
                if _heading(title):
                    head = "capitals" if title.isupper() else "open" if title.endswith(_FUNCTION) else "short" if len(title) <= 12 else "title"
            before = c.at
            while before > start and text[before - 1].isspace():
                before -= 1
            ended = "ended" if before > start and text[before - 1] in ";·;" else ""
            mark = "list" if _MARK.match(text, start, c.at) and _BULLET.match(text, start) else ""
        return Look(
            kind,
            _case(text, c.go),
            "inside" if text[c.go] in ",;:·،，)]）»”」" or kind == "break" and text[c.go] == "." else "",
            "line" if line else "space" if c.gap else "none",
            lead,
            "turn" if line and _SPEAKER.match(text, start) else "",
            layout if line else 0,
            head,
            ended,
            kind == "semicolon" and _greek_question(text, c.at),
            _lexical(prev),
            "before" if following in BEFORE and c.next.endswith(".") else "initial" if len(following) == 1 and c.next.endswith(".") else "company" if following in _COMPANY and c.next.endswith(".") else "word",
            kind == "stop" and _ends_unit(text, c),
            min(len(prev), 6),
            _script(prev[-1:]),
            _bucket(self.ends.get(prev)),
            _bucket(self.begins.get(following)),
            mark,
            "short" if c.at - start < 8 else "long",
            "." in prev,
        )

    @staticmethod
    def features(look: Look) -> list[str]:
        kind, case = look.kind, look.case
        place = f"{kind},{case},{look.next},{look.line},{look.lead}"
        return [
            "bias",
            f"kind={kind}",
            f"case={kind},{case}",
            f"next={kind},{look.next}",
            f"place={place}",
            f"layout={kind},{look.layout},{case}",
            f"turn={kind},{look.lead},{look.turn},{look.layout}",
            f"head={kind},{look.head},{case}",
            f"head={kind},{look.head},{look.begins}",
            f"begins={kind},{case},{look.layout},{look.mark},{look.begins}",
            f"ended={kind},{look.ended},{case}",
            f"greek={kind},{look.greek}",
            f"greek={kind},{look.greek},{case},{look.line}",
            f"lex={kind},{look.lex}",
            f"lex={kind},{look.lex},{case}",
            f"lex={kind},{look.lex},{look.unit},{case}",
            f"pair={kind},{look.lex},{look.following},{case}",
            f"length={kind},{look.length}",
            f"script={kind},{look.script}",
            f"ends={kind},{look.ends}",
            f"begins={kind},{look.begins}",
            f"both={kind},{look.ends},{look.begins}",
            f"size={kind},{look.size}",
            f"inner={kind},{look.inner},{case}",
            f"all={place},{look.turn},{look.layout},{look.head},{look.ended},{look.greek},{look.lex},{look.following},{look.unit}",
        ]

    def probability(self, look: Look) -> float:
        if (p := self.known.get(look)) is None:
            if not self.weights:  # too little text to train on: a full mark, or a plain word before a capital
                p = 0.9 if look.kind == "full" or look.case == "upper" and look.lex in ("word", "number") and look.kind != "semicolon" or look.lead == "bullet" else 0.1
            else:
                z = sum(self.weights.get(f, 0.0) for f in self.features(look))
                p = 1 / (1 + math.exp(-z)) if z > -30 else 0.0
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[look] = p
        return p


def _bucket(rate: float | None) -> str:
    return "?" if rate is None else str(0 if rate == 0 else 1 + int(min(0.999, rate) * 5))


def _lexical(prev: str) -> str:
    if prev in CLOSING:
        return "closing"
    if prev in _COMPANY:
        return "company"
    if prev in BEFORE or prev.rpartition("/")[2] in BEFORE:
        return "before"
    if prev in EITHER:
        return "either"
    if len(prev) == 1 and prev.isalpha() and _script(prev) not in ("CJK", "ARABIC", "THAI"):
        return "initial"
    if prev.replace(".", "").replace("/", "").replace(",", "").isdigit():
        return "number"
    return "inner" if "." in prev else "word" if prev else "none"


def _reliable(look: Look) -> bool | None:
    """What the surroundings of a candidate leave no doubt about; None where they do."""
    case, often, never = look.case, look.begins in "3456", look.begins == "0"
    if look.kind == "space":
        if look.size == "short":
            return False
        return True if look.begins in "123456" or look.ends in "123456" else None
    if look.kind == "break":
        if look.lead == "bullet" or look.lead == "speaker" and (look.turn or look.layout):
            return True
        if case == "lower" or look.next:
            return False
        if look.ended:
            return True
        if look.head and case in ("upper", "plain", "mark", "digit") and (case != "plain" or look.head == "short"):
            return True if often or look.head == "capitals" or case in ("mark", "digit") else False if never and look.head == "open" else None
        if look.layout == 2 and case in ("upper", "plain"):
            return True
        if case == "upper" and (look.layout or look.mark):
            return True if often else False if never else None
        return False
    if look.kind == "semicolon":
        if look.line == "line" and (look.lead or case == "upper"):
            return True
        return bool(look.greek) and case != "lower" and not look.next
    if look.next or case == "lower" and look.lead != "bullet":
        return False
    if look.kind == "full":
        return True
    if look.lead:
        return look.lex != "before" or look.lead == "bullet"
    if look.kind in ("call", "dots"):
        return case != "digit" or look.kind == "call"
    if case == "digit" and look.lex in ("before", "either", "closing", "company"):
        return False
    if look.lex in ("before", "initial") and not look.unit:
        return False
    if look.lex == "closing" and case in ("upper", "mark", "end"):
        return True
    if look.lex == "company" and look.following == "company":
        return False
    if look.lex == "number" and case == "upper" and look.following == "before" or case == "end":
        return True
    if look.length >= 4 and look.lex == "word" and look.ends in "123456" and (case in ("mark", "plain") or case == "upper" and look.begins in "3456"):
        return True
    if case == "plain" and look.lex in ("word", "number"):
        return True
    return None


#: Passages written for this project, of surroundings that a small sample may lack; their reliable candidates train, too.
SEED_PASSAGES = (
    "(a) the first thing;\n(b) the second thing;\n(c) the third thing.",
    "1. Ο πρώτος λόγος·\n2. Ο δεύτερος λόγος·\n3. Ο τρίτος λόγος.",
    "Q. Where were you?\nA. At home.\nQ. Alone?\nA. Yes.",
    "Ε. Πού ήσασταν;\nΑ. Στο σπίτι.\nΕ. Μόνος;\nΑ. Ναι.",
    "The road was wet; the lamp was broken; nobody came. Then it rained!",
    "Ήταν βρεγμένος ο δρόμος; Κανείς δεν ήρθε. Γιατί άραγε; Έβρεχε.",
    "The first page is missing… Nobody knows why. Does it matter? It does.",
    "桥很旧。没有人修理！为什么？没有钱。",
    "पुल पुराना था। किसी ने उसे ठीक नहीं किया। क्यों?",
    "الجسر قديم. لماذا لم يصلحه أحد؟ لا يوجد مال.",
    "Կամուրջը հին էր։ Ոչ ոք չնորոգեց այն։",
    "FACTS\nThe bridge was old.\nNobody repaired it.",
    "- the first item\n- the second item\n- the third item",
    "• το πρώτο\n• το δεύτερο",
    "The witness was called by the plaintiff and\nspoke of the bridge, which had been old for\nyears.",
)


def train(passages: list[str]) -> Model:
    passages = [p for p in dict.fromkeys([*passages, *SEED_PASSAGES]) if p and p.strip()]
    total, last, first = Counter(), Counter(), Counter()
    for text in passages:
        tokens = [x for x in text.split()]
        norm = [_norm(x.strip("\"'«»“”„()[],:;")) for x in tokens]
        total.update(norm)
        if norm and tokens[-1].rstrip("\"'»”)]")[-1:] in ".!?…;։।。":
            last[norm[-1]] += 1
        start = next((i for i, x in enumerate(tokens) if not _MARK.fullmatch(x + " ")), 0)
        if norm:
            first[norm[start]] += 1
        for i in range(1, len(tokens)):
            before = tokens[i - 1]
            if tokens[i][:1].isupper() and (before[-1:] in "!?…" or before[-1:] == "." and len(norm[i - 1]) > 4 and "." not in norm[i - 1] and norm[i - 1] not in BEFORE):
                first[norm[i]] += 1
    upper = Counter()
    for text in passages:
        upper.update(_norm(x.strip("\"'«»“”„()[],:;")) for x in text.split() if x.lstrip("\"'«“„([")[:1].isupper())
    ends = {t: last[t] / n for t, n in total.items() if n >= 3}
    begins = {t: first[t] / max(1, upper[t]) for t, n in total.items() if n >= 3 and upper[t]}
    for text in passages:  # edges of what spaces part, in scripts without spaces between words
        if _SPACELESS.search(text):
            parts = text.split()
            for table, edges, edge in ((begins, [x[:EDGE] for x in parts], parts[0][:EDGE]), (ends, [x[-EDGE:] for x in parts], parts[-1][-EDGE:])):
                for x in edges:
                    table.setdefault(x, 0.0)
                table[edge] = 1.0
    model = Model({}, ends, begins)
    rows, labels = [], []
    for text in passages:
        layout = _itemised(text) if "\n" in text else 0
        breaks = [m.start() for m in re.finditer("\n", text)]
        start = _first_solid(text, 0)
        for c in candidates(text):
            if c.end <= start or _only_mark(text, start, c):
                continue
            look = model.look(text, c, start, layout, breaks) if c.go < len(text) else None
            label = _reliable(look) if look else None
            if label is not None:
                rows.append(look)
                labels.append(label)
                if look.greek and look.line != "line":  # in Latin letters the same place is none, however rare there
                    rows.append(look._replace(greek=False))
                    labels.append(False)
            if label:
                start = c.go
    counts = Counter(zip(rows, labels))
    features = [model.features(look) for look, _ in counts]
    index = {f: i for i, f in enumerate(sorted({f for r in features for f in r}))}
    if not index or len(set(labels)) < 2:
        return model
    x = np.array([[index[f] for f in r] for r in features])
    y, weight = np.array([label for _, label in counts], float), np.array(list(counts.values()), float)
    weight /= weight.sum()
    w, g2 = np.zeros(len(index)), np.full(len(index), 1e-6)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat((p - y) * weight, x.shape[1]), len(w)) + DECAY * w / len(w)
        g2 += g * g
        w -= RATE * g / np.sqrt(g2)
    model.weights = {f: float(w[i]) for f, i in index.items()}
    model.known.clear()
    return model


def _only_mark(text: str, start: int, c: Candidate) -> bool:
    """Whether nothing but a leading number, bullet or letter stands before the candidate."""
    if c.at - start > 20:
        return False
    sofar = text[start : c.at].strip()
    return not sofar or _MARK.fullmatch(text[start : c.end].strip() + " ") is not None and c.kind not in "\n_" or c.kind == "." and len(sofar) <= 4 and sofar.strip("([（").isdigit()


def _spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, bracket) of matched quotations and brackets, outermost first; those without a partner are left out."""
    out, stack = [], []
    for m in re.finditer(r"[«»“”„「」『』（）()\[\]【】\"]", text):
        ch, i = m[0], m.start()
        if ch == '"':
            opener = next((s for s in reversed(stack) if s[0] == '"'), None)
            if opener and not (i + 1 < len(text) and text[i + 1].isalnum() and (i == 0 or text[i - 1].isspace())):
                while stack and stack.pop() is not opener:
                    pass
                out.append((opener[1], i + 1, False))
            else:
                stack.append(('"', i))
        elif ch in "»”」』）)]】" or ch == "“" and any(s[0] == "„" for s in stack):
            for k in range(len(stack) - 1, -1, -1):
                if ch in _PAIR.get(stack[k][0], ""):
                    out.append((stack[k][1], i + 1, ch in "）)]】"))
                    del stack[k:]
                    break
        else:
            stack.append((ch, i))
    return sorted(out)


def _itemised(text: str) -> int:
    """Whether each line stands for itself: 0 no, 1 perhaps, 2 surely.

    A small letter begins a line only where text was wrapped. Wrapped lines are filled: the next line's first
    word would not have fitted; lines that leave more room were ended on purpose.
    """
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) > 2 and _heading(lines[0]) and 2 * len(lines[0]) < max(map(len, lines)):
        lines = lines[1:]
    if len(lines) < 2 or any(x[:1].islower() for x in lines[1:]):
        return 0
    width = max(map(len, lines))
    filled = all(len(a) + 1 + len(b.split()[0]) > width for a, b in zip(lines, lines[1:]))
    return 1 if filled else 2


def _heading(line: str) -> bool:
    """A line that stands as a title: short, no closing mark, no inner clause."""
    words = line.split()
    return 0 < len(words) <= 7 and len(line) <= 60 and not re.search(r"[.,:!?;…。，！？]$", line) and (line.isupper() or not re.search(r"[,.;:]", line)) and not line[:1].islower()


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    if text is None or not text.strip():
        return []
    n = len(text)
    begin = _first_solid(text, 0)
    itemised = _itemised(text) if "\n" in text else 0
    spans = _spans(text)
    cands = candidates(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    # a quotation or bracket inside a sentence: everything between its marks is closed to boundaries
    shut: list[tuple[int, int]] = []
    ends_at: set[int] = set()
    for a, b, bracket in spans:
        inner = text[a + 1 : b - 1]
        if not re.search(r"[.!?…;;։؟।。！？\n]", inner):
            continue
        before = _bare_start(text, a, breaks)
        after = _first_solid(text, b)
        tail = text[after : after + 1]
        complete = re.search(r"[.!?…;;։؟।。！？][\"'»”’)\]」）]*$", text[a : b - 1].rstrip()) is not None
        if bracket:
            alone = before and complete and (not tail or not (tail.islower() or tail.isdigit() or tail in ",;:·،，") or "\n" in text[b:after])
        else:
            goes_on = bool(tail) and (tail in ",;:·،，—–-" or tail.islower() or tail.isdigit() and not complete or (not tail.isupper() and tail.isalpha() and "\n" not in text[b:after] and complete) or tail in ".!?…" )
            alone = before and (not goes_on or not tail)
        if not alone:
            shut.append((a, b))
            if complete and not bracket and tail and (tail.isupper() or text[after] in "«“„\"(") and not (tail in ",;:"):
                ends_at.add(b)
        elif not complete and tail in ".!?…":
            shut.append((a, b))
    outer: list[tuple[int, int]] = []  # the outermost of the closed stretches, in order
    for a, b in sorted(shut, key=lambda x: (x[0], -x[1])):
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    out: list[tuple[int, int]] = []
    start, at = begin, 0
    for c in cands:
        if c.end <= start or c.go >= n:
            continue
        while at < len(outer) and outer[at][1] <= c.at:
            at += 1
        if at < len(outer) and outer[at][0] < c.at and (c.end < outer[at][1] or c.kind == "\n" or outer[at][1] not in ends_at):
            continue
        if not _only_mark(text, start, c) and model.probability(model.look(text, c, start, itemised, breaks)) > 0.5:
            out.append((start, c.end))
            start = c.go
    out.append((start, n))
    return [(a, b) for a, b in (_trim(text, a, b) for a, b in out) if a < b]


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


_BLANK = " \t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u3000\u200b\u200c\u200d\ufeff"
_CLOSED = "\"'»”’)]」）"


def _bare_start(text: str, at: int, breaks: list[int]) -> bool:
    """Whether a sentence may begin at ``at``: nothing before it but a mark, a line break or a closed sentence."""
    k = bisect_left(breaks, at)
    line = breaks[k - 1] + 1 if k else 0
    end = at
    while end > line and text[end - 1] in _BLANK:
        end -= 1
    if not text[line:end][:20].strip() and not text[line:end].strip() or end - line <= 20 and _MARK.fullmatch(text[line:end].strip() + " "):
        return True
    while end > line and text[end - 1] in _CLOSED:
        end -= 1
    return end > line and text[end - 1] in ".!?…;;։؟।。！？" and not (text[end - 1] == ";" and end - line > 1 and text[end - 2].isascii() and text[end - 2].isalpha())


#: Words after which a line can't be a heading's end.
_FUNCTION = (" of", " the", " and", " to", " in", " on", " for", " with", " by", " at", " της", " του", " των", " την", " το", " τον", " στην", " στο", " και", " για", " με", " από", " ve", " ile", " için", " de", " la", " le", " et", " der", " die", " das", " und", " и", " в", " на")


def _plain_mark(line: str) -> str:
    m = _MARK.match(line)
    return line[m.end() :] if m and m.end() < len(line) else line


def _ends_unit(text: str, c: Candidate) -> bool:
    """A single letter after a numeral or 'No' closes a designation rather than shortening a name."""
    return re.search(r"(?:\d|exhibit|section|annex|τεκμήριο|άρθρο)\s?\S$", text[max(0, c.at - 14) : c.at]) is not None


def _greek_question(text: str, at: int) -> bool:
    """The semicolon is a question mark after Greek: the nearest letters before it decide."""
    seen = greek = 0
    for i in range(at - 1, max(-1, at - 60), -1):
        ch = text[i]
        if ch == "\n" and seen:
            break
        if ch.isalpha():
            seen += 1
            greek += _script(ch) == "GREEK"
    return seen > 0 and greek * 2 > seen


def fit(passages: DataFrame, text_col: str = "text"):
    """A broadcast of the model (a few hundred weights and the token rates of the sample)."""
    rows = bounded_sample(passages, [text_col], TRAIN_PASSAGES)
    return passages.sparkSession.sparkContext.broadcast(train([text for (text,) in rows]))


def sentences(passages: DataFrame, fitted, keys: tuple[str, ...] = ("source_id", "ordinal"), text_col: str = "text") -> DataFrame:
    """(keys, start_pos, end_pos) of each sentence, in one pass without a shuffle."""
    schema = ", ".join(f"{k} {passages.schema[k].dataType.simpleString()}" for k in keys) + ", start_pos int, end_pos int"

    def factory():
        model = fitted.value

        def chunk(cols):
            out = [(*key, a, b) for *key, text in zip(*cols) for a, b in split(text, model)]
            return list(zip(*out)) if out else [[]] * (len(keys) + 2)

        return chunk

    return arrow_map(passages, [*keys, text_col], schema, factory)
