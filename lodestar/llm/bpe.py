"""Byte-level BPE by segment trees (operator 10).

A word's adjacent pairs are the leaves of a segment tree whose inner nodes keep the least
(rank, position) below them. The root is therefore the leftmost pair of lowest rank; merging it
changes three leaves, each an update along one path to the root, so a word of n bytes takes
O(n log n) however long it is. A text is cut where the tokenizer's pattern must cut (before each
run of non-space characters, its space included), and the ids of such pieces are kept in a
bounded cache of the worker, since texts repeat their words.

Defined cases: null text is the empty text, with no ids; special tokens spelled out in a text
become their id, as in the library; texts may be of any length; repeated rows are encoded each; of equal pairs the leftmost merges first; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Remembered, map_arrow, tune

#: Entries of one generation of the worker's cache of pieces.
CACHE = 250_000
#: Bytes of ids after which rows are handed on.
EMIT = 2 << 20
#: Fixed values of the byte-level pre-tokenizer: its pattern, and white space as it knows it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters on which Python's patterns and the tokenizer's may differ, or that are seldom: texts with them are cut in two steps.
ODD = re.compile("[\x1c-\x1f\u0180-\u200f\u2028-\u202f\u205f-\u209f\u20c0-\U0010ffff]")
#: Letters and digits among all other characters, and the tokenizer's pattern over them.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge ``ids`` until no adjacent pair has a rank; ``ranks`` maps a pair to (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return ids
    ids, none = list(ids), 1 << 62
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    keys = [none] * (2 * width)
    for i in range(n - 1):
        if found := ranks.get((ids[i], ids[i + 1])):
            keys[width + i] = found[0] * n + i
    for k in range(width - 1, 0, -1):
        a, b = keys[2 * k], keys[2 * k + 1]
        keys[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = width + i
        keys[k] = key
        while k > 1:
            other = keys[k ^ 1]
            k >>= 1
            key = key if key < other else other
            if keys[k] == key:
                return
            keys[k] = key

    while keys[1] != none:
        i = keys[1] % n
        j = after[i]
        ids[i] = ranks[ids[i], ids[j]][1]
        ids[j] = -1
        after[i] = k = after[j]
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
        found = ranks.get((ids[i], ids[k])) if k < n else None
        put(i, found[0] * n + i if found else none)
        if (h := before[i]) >= 0:
            found = ranks.get((ids[h], ids[i]))
            put(h, found[0] * n + h if found else none)
    return [x for x in ids if x >= 0]


class ByteBpe:
    """Encoder and decoder of one vocabulary file; ``pieces`` remembers the packed ids of pieces and of the words they are made of."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[x] for x in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.words = regex.compile(PATTERN)

        self.pieces = Remembered(self._piece, CACHE)

    def _piece(self, piece: str) -> bytes:
        words = self.words.findall(piece)
        if len(words) > 1:
            return b"".join([self.pieces[w] for w in words])
        return array("I", merge([self.first[b] for b in piece.encode()], self.ranks)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut and self.cut.search(text):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, (PIECES if ODD.search(text) else WORDS).findall(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer for each worker process."""
    return ByteBpe(path)


def bpe(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text; with ``with_ids`` also the ids, little-endian unsigned 32-bit."""
    tune(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select("doc_id", "text")
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    names = [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in it:
            rows: list[tuple] = []
            begin = size = 0
            for i, text in enumerate(batch.column(1)):  # one text at a time: a batch may hold very long ones
                ids = tok.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tok.decode(ids).encode()).hexdigest(), ids if with_ids else b""))
                size += len(ids)
                if size >= EMIT or i == batch.num_rows - 1:
                    counts, sums, texts, coded = zip(*rows, strict=True)
                    columns = [batch.column(0).slice(begin, len(rows)), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array(coded, pa.binary())] if with_ids else []), names=names)
                    rows, begin, size = [], i + 1, 0
        tok.pieces.forget()

    return map_arrow(docs, run, T.StructType(fields))
