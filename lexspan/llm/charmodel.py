"""A smoothed character bigram model over code-point classes, scored with numpy.

Characters seen in training have ids of their own; all others share one id for each block and kind,
so that no text is outside the model. P(b|a) is interpolated with P(b), and P(b) with a uniform
share. A whole chunk of texts is scored as one array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import numpy as np

#: Characters that get ids of their own; weight of the unigram in a bigram's distribution.
MAX_CHARS, BACKOFF = 640, 4.0


def _kind(cp: int) -> str:
    """The class of a character without an id."""
    if cp > 0xFFFF:
        return "astral"
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cp == 0xFFFD:
        return "lost"
    if 0x80 <= cp < 0xA0:
        return "c1"
    if cat[0] == "C":
        return "control"
    if cp < 0x80:
        return "ascii" + cat
    if 0x3400 <= cp < 0xA000:
        return "han"
    block = cp >> 7 if cp < 0x700 else (cp >> 8 if cp >= 0x2000 else 0x700 + (cp >> 8))
    return f"{cat[0]}{block}"


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, int]:
    """The class of every character that has no id of its own, and the number of classes."""
    kinds: dict[str, int] = {}
    lut = np.zeros(0x10000 + 1, np.uint16)
    for cp in range(0x10000):
        lut[cp] = kinds.setdefault(_kind(cp), len(kinds))
    lut[0x10000] = kinds.setdefault("astral", len(kinds))
    return lut, len(kinds)


def code_points(lines: Sequence[str]) -> np.ndarray:
    """Code points of lines between line feeds."""
    return np.frombuffer(("\n" + "\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)


def per_line(values: np.ndarray, lines: Sequence[str], how: np.ufunc = np.add, dtype: type = np.float64) -> np.ndarray:
    """What ``how`` makes of the values of each line's pairs of neighbours, its line feeds among them."""
    return how.reduceat(values, np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])[:-1])), dtype=dtype)


class Alphabet:
    """Characters whose pairs are counted: counts of lines add up, wherever the lines are. Ideographs count as one character, others as lost."""

    def __init__(self, chars: Iterable[str]):
        self.cps = np.array(sorted({0x0A, 0x4E00, 0xFFFD, *(c for c in map(ord, chars) if c < 0x10000 and not 0x3400 <= c < 0xA000)}), np.uint32)
        self.size = len(self.cps)
        self.lut = np.full(0x10000 + 1, np.searchsorted(self.cps, 0xFFFD), np.int32)
        self.lut[0x3400:0xA000] = np.searchsorted(self.cps, 0x4E00)
        self.lut[self.cps] = np.arange(self.size)

    def count(self, lines: Sequence[str]) -> np.ndarray:
        ids = self.lut[np.minimum(code_points(lines), 0x10000)]
        return np.bincount(ids[:-1] * self.size + ids[1:], minlength=self.size**2)

    def mapped(self, pairs: np.ndarray, written: Callable[[str], str]) -> np.ndarray:
        """The pairs of the same lines with every character written otherwise."""
        pairs = pairs.reshape(self.size, self.size)
        forms = [[self.lut[min(ord(x), 0x10000)] for x in written(c) or c] for c in map(chr, self.cps.tolist())]
        first, last = np.array([f[0] for f in forms]), np.array([f[-1] for f in forms])
        out = np.bincount((last[:, None] * self.size + first[None, :]).ravel(), pairs.ravel(), self.size**2)
        for form, n in zip(forms, pairs.sum(0)):
            for a, b in zip(form, form[1:]):
                out[a * self.size + b] += n
        return out


class CharModel:
    def __init__(self, lut: np.ndarray, table: np.ndarray, size: int):
        self.lut, self.table, self.size = lut, table, size

    @classmethod
    def train(cls, texts: Sequence[str]) -> CharModel:
        alphabet = Alphabet(set().union(*texts))
        return cls.of(alphabet, alphabet.count(texts))

    @classmethod
    def of(cls, alphabet: Alphabet, pairs: np.ndarray) -> CharModel:
        """The model of counted pairs."""
        cps, pairs = alphabet.cps, pairs.reshape(alphabet.size, alphabet.size)
        counts = pairs.sum(0)
        order = np.argsort(-counts, kind="stable")
        keep = cps[order[counts[order] > 0]][:MAX_CHARS]
        keep = keep[(keep != 0xFFFD) & ((keep < 0x3400) | (keep >= 0xA000))]  # ideographs stay one class
        lut, own = _kinds()
        lut = lut.copy()
        lut[keep] = own + np.arange(len(keep))
        k = own + len(keep)
        # characters of a class share its probability; a class seldom seen counts for many characters
        members = np.bincount(lut, minlength=k).astype(np.float64)
        ids = lut[np.minimum(cps, 0x10000)].astype(np.int64)
        uni = np.bincount(ids, counts, k) + 0.02
        p1 = uni / uni.sum()
        pairs = np.bincount((ids[:, None] * k + ids[None, :]).ravel(), pairs.ravel(), k * k).reshape(k, k)
        p2 = (pairs + BACKOFF * p1) / (pairs.sum(1, keepdims=True) + BACKOFF)
        p2 /= np.clip(members, 1, 200)[None, :]
        return cls(lut, np.log(p2).astype(np.float32).ravel(), k)

    def bigrams(self, text: str) -> np.ndarray:
        """log P(b|a) of each neighbouring pair; one fewer than characters."""
        return self.pairs(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))

    def pairs(self, cps: np.ndarray) -> np.ndarray:
        ids = self.lut[np.minimum(cps, 0x10000)].astype(np.int32)
        return self.table[ids[:-1] * self.size + ids[1:]]

    def total(self, text: str) -> float:
        """Log likelihood of a text between line feeds."""
        return float(self.bigrams(f"\n{text}\n").sum())

    def totals(self, lines: Sequence[str]) -> np.ndarray:
        """The same of each line; one array for all."""
        return per_line(self.pairs(code_points(lines)), lines)
