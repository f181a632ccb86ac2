"""Encoding of texts with a public byte-level BPE vocabulary, in linear time.

A piece of text is encoded by longest vocabulary matches (found for all
positions in one pass of an Aho-Corasick automaton). A match is accepted only
if its pair with the token before it is compatible, that is, if merging would
keep exactly this border; otherwise the next shorter token is tried, and with
none left the encoder steps back over the last token. Places that were given
up are remembered, so no place is tried twice. The result equals that of
applying the merges in order.

Decoding concatenates slices of one byte string through an offset table.

Defined results: null and empty texts give the empty list; text of special
tokens is ordinary text; repeated texts give the same ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator here.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the published pattern that cuts text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of at most this many bytes are remembered, at most KEPT of them by a worker; longer ones are encoded each time.
REMEMBERED, KEPT = 40, 400_000


class Bpe:
    """Tables of one vocabulary: token bytes by id, the split of each merged token, and the pairs that merge."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ids = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.n = max(ranks.values()) + 1
        self.text = [""] * self.n
        for t, i in self.ids.items():
            self.text[i] = t
        self.size = [len(t) for t in self.text]
        self.find = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * self.n
        for i, t in enumerate(self.text):
            for k in range(len(t) - 1, 0, -1):
                if (p := self.ids.get(t[:k])) is not None:
                    self.shorter[i] = p
                    break
        self.pairs: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(self.n)), list(range(self.n))
        for i in range(self.n):
            t, a = self.text[i], self.shorter[i]
            while a >= 0:
                b = self.ids.get(t[self.size[a] :])
                if b is not None and a < i and b < i and self.compatible(a, b):
                    self.pairs[a, b] = i
                    self.left[i], self.right[i] = a, b
                    break
                a = self.shorter[a]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.bytes = "".join(self.text).encode("latin-1")
        self.offsets = np.concatenate(([0], np.cumsum(self.size)))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between the tokens a and b.

        Going back through the merges that made a and b, latest first, a pair
        across the border must not be one that merges earlier than the merge
        undone last.
        """
        most = 1 << 60
        pairs, left, right = self.pairs, self.left, self.right
        while True:
            if pairs.get((a, b), most) < most:
                return False
            undo_left = a > b
            for _ in range(2):
                if undo_left and right[a] != a:
                    most, a = a, right[a]
                    break
                if not undo_left and left[b] != b:
                    most, b = b + 1, left[b]
                    break
                undo_left = not undo_left
            else:
                return True

    def piece(self, t: str) -> tuple[int, ...]:
        """Ids of one piece, given as one character for each byte."""
        whole = self.ids.get(t)
        if whole is not None and (whole < 256 or self.left[whole] != whole):
            return (whole,)
        longest = [-1] * (len(t) + 1)
        size, shorter, compatible = self.size, self.shorter, self.compatible
        for end, i in self.automaton.iter(t):
            at = end + 1 - size[i]
            if longest[at] < 0 or size[longest[at]] < size[i]:
                longest[at] = i
        open_, out, at, token = bytearray(b"\1") * (len(t) + 1), [], 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if open_[end] and (last < 0 or compatible(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = shorter[token]
            else:
                open_[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                token = out.pop()
                at -= size[token]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for null and empty texts."""
        if not text:
            return []
        cache = self.cache
        out: list[tuple[int, ...]] = []
        for p in self.find(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace").decode("latin-1"))
                if len(p) <= REMEMBERED:
                    if len(cache) >= KEPT:
                        cache.clear()
                    cache[p] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        o, b = self.offsets, self.bytes
        return b"".join(b[o[i] : o[i + 1]] for i in ids)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def vocabulary(folder: str = FOLDER, name: str = VOCABULARY) -> Bpe:
    """The tables of a vocabulary, made once in each worker."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(df, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY):
    """(key, ids array<int>) of every row; a map over Arrow batches without a shuffle."""
    import pyarrow as pa

    field = df.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for b in batches:
            lists = [v.encode(t) for t in b.column(1).to_pylist()]
            offsets = pa.array([0, *accumulate(map(len, lists))], pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(chain.from_iterable(lists), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, ids array<int>")


def decode_documents(df, ids: str = "ids", folder: str = FOLDER, name: str = VOCABULARY):
    """Adds the column ``text`` decoded from ``ids``; null ids give null."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        v = vocabulary(folder, name)
        return s.map(lambda x: None if x is None else v.decode(x))

    return df.withColumn("text", run(F.col(ids)))
