"""Problem 7: encode every text with a public byte-level BPE vocabulary.

Each pre-token is merged with a priority queue of merge ranks over a doubly linked list of
symbols. An entry names the two symbols it saw; if either has changed since, the entry is stale
and is skipped. That is O(n log n) in the pre-token, so one unbroken run of a million letters
costs no more than its share. Results of pre-tokens are kept in a bounded cache.

Defined results: a null text and an empty text both give an empty list of ids. Strings that look
like special tokens are ordinary text. ``decode`` concatenates vocabulary strings and is the
exact inverse for every text.
"""

from __future__ import annotations

import base64
import os
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .arrowmap import arrow_map

#: Pre-token pattern that belongs to the rank files.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where vocabulary files lie unless a call says otherwise.
VOCAB_DIR = os.environ.get("LEXSPAN_TOKENIZERS", "/opt/tokenizers")
#: Longest pre-token that is kept in the cache, and how many are.
CACHE_LEN, CACHE_SIZE = 48, 200_000


def vocab_path(name: str, directory: str | None = None) -> str:
    return os.path.join(directory or VOCAB_DIR, f"{name}.tiktoken")


def ship(df: DataFrame, name: str, directory: str | None) -> str:
    """Give every executor the vocabulary file of the driver's folder; the path for :func:`shipped`."""
    path = vocab_path(name, directory)
    df.sparkSession.sparkContext.addFile(path)
    return path


def shipped(path: str) -> str:
    """Where the file lies on this machine: as shipped, else under its own path."""
    here = SparkFiles.get(os.path.basename(path))
    return here if os.path.exists(here) else path


class BytePairEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.strings = {r: s for s, r in self.rank.items()}
        self.split = regex.compile(PRE_TOKEN).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        rank = self.rank
        if (whole := rank.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        sym: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, i + 1, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, j, a, b = heappop(queue)
            if sym[i] is not a or right[i] != j or sym[j] is not b:
                continue  # stale: one of the two symbols has been merged since
            sym[i], sym[j] = joined, _gone = a + b, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get(joined + sym[k])) is not None:
                    heappush(queue, (r, i, k, joined, sym[k]))
            if (h := left[i]) >= 0 and (r := rank.get(sym[h] + joined)) is not None:
                heappush(queue, (r, h, i, sym[h], joined))
        return tuple(rank[s] for s in sym if s is not None)

    def encode_into(self, text: str | None, out: array) -> int:
        """Append the ids of ``text`` to ``out``; how many there were."""
        if not text:
            return 0
        before, cache = len(out), self.cache
        for token in self.split(text):
            ids = cache.get(token)
            if ids is None:
                ids = self.merge(token.encode("utf-8"))
                if len(token) <= CACHE_LEN:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[token] = ids
            out.extend(ids)
        return len(out) - before

    def encode(self, text: str | None) -> list[int]:
        self.encode_into(text, out := array("i"))
        return out.tolist()

    def count(self, text: str | None) -> int:
        return self.encode_into(text, array("i"))

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8")


def encode_texts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", directory: str | None = None) -> DataFrame:
    """(id, ids array<int>) of each row; rows with null ids are kept. No shuffle: one pass over two columns."""
    path = ship(documents, tokenizer, directory)
    kind = documents.schema[id_col].dataType.simpleString()

    def factory():
        bpe = BytePairEncoder(shipped(path))

        def chunk(cols):
            ids, texts = cols
            flat, offsets = array("i"), np.zeros(len(texts) + 1, np.int32)
            for i, text in enumerate(texts):
                offsets[i + 1] = offsets[i] + bpe.encode_into(text, flat)
            values = pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))
            return ids, pa.ListArray.from_arrays(pa.array(offsets), values)

        return chunk

    return arrow_map(documents, [id_col, text_col], f"{id_col} {kind}, ids array<int>", factory)


def count_tokens(documents: DataFrame, columns: list[str], tokenizer: str = "byte_bpe_50k", text_col: str = "text", directory: str | None = None) -> DataFrame:
    """``columns`` and ``n_tokens`` of each row; the ids themselves never leave the worker."""
    path = ship(documents, tokenizer, directory)
    schema = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens int"

    def factory():
        bpe = BytePairEncoder(shipped(path))
        return lambda cols: (*cols[:-1], [bpe.count(t) for t in cols[-1]])

    return arrow_map(documents, [*columns, text_col], schema, factory)


def decode_ids(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", directory: str | None = None) -> DataFrame:
    """(id, text) from (id, ids): the exact inverse of :func:`encode_texts`, null texts coming back empty."""
    path = ship(encoded, tokenizer, directory)
    kind = encoded.schema[id_col].dataType.simpleString()

    def factory():
        bpe = BytePairEncoder(shipped(path))
        return lambda cols: (cols[0], [bpe.decode(x or ()) for x in cols[1]])

    return arrow_map(encoded, [id_col, "ids"], f"{id_col} {kind}, text string", factory)
