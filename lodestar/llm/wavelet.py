"""Token-id files as wavelet matrices (operator 9).

Each file holds a run of documents in ascending ``doc_id``. Its ids form a wavelet matrix: for
every bit of an id, from the highest, one plane of bits in the order left by stably moving the
zeros of the planes above in front of the ones. A plane is kept as 64-bit words, with a directory of the
ones before each group of ``GROUP`` words, so rank takes one look-up and a few bit counts, from which follow
access, counting, select and the places of an id: all on the bytes of the file, without unpacking it. Files are binary records of a
Parquet table in the shared folder, so that Spark's writers commit and compress them and any of its stores can hold them.

Format, little endian, each part padded to 8 bytes: ``LSWM``, u8 bits, u8 null flags (1: some doc_id is null), u64 documents, u64 ids,
documents x i64 doc_id, documents x u8 null flag if flagged, documents x u32 number of ids, then for each plane u64 zeros, its words (u64, one more than needed)
and its directory (u32, groups and one more).

Defined cases: null text is empty (its document holds the end id alone); doc_id is read as a long; rows of equal doc_id are
ordered by the text's hash, then text; a null doc_id comes first; texts may be of any length; other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Remembered, map_arrow, tune, written

#: Ids of one file, at least one document; small enough for a cache of the CPU.
FILE_IDS = 1 << 18
#: Entries of one generation of the worker's cache of pieces.
CACHE = 300_000
#: Texts with these are encoded by the library in one go: special tokens, letters beyond the Latin blocks, and characters on which
#: Python and the tokenizer differ about white space or lower case.
ODD = re.compile("[\x1c-\x1f\u0130\u0180-\u200f\u2028-\u202f\u205f-\u209f\u20c0-\U0010ffff]|<\\|")
#: Letters and digits among the characters of all other texts, in lower case; the pattern is the pre-tokenizer's over them.
LETTERS, DIGITS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
#: Words of 64 bits for one entry of a plane's directory.
GROUP = 8
_HEAD = struct.Struct("<4sBBxxQQ")


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], before: list[np.ndarray] | None = None, group: int = GROUP):
        """planes: 64-bit words of each level, highest bit first; zeros: their numbers of zero bits; before: their directories, by ``group`` words."""
        self.n, self.planes, self.zeros, self.group = n, planes, zeros, group
        self.before = before if before is not None else [directory(p, group) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int, group: int = GROUP) -> WaveletMatrix:
        planes, zeros = [], []
        ids, spare = ids.copy(), np.empty_like(ids)
        for k in range(bits - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << k)).astype(bool)
            words = np.zeros(width(len(ids)), "<u8")
            words.view(np.uint8)[: (len(ids) + 7) // 8] = np.packbits(ones, bitorder="little")
            planes.append(words)
            zeros.append(len(ids) - int(np.count_nonzero(ones)))
            ids.compress(~ones, out=spare[: zeros[-1]])
            ids.compress(ones, out=spare[zeros[-1] :])
            ids, spare = spare, ids
        return cls(len(ids), planes, zeros, group=group)

    def decode(self, dtype: type = np.uint16) -> np.ndarray:
        """All ids in order, undoing the planes from the lowest bit."""
        ids, spare = np.zeros(self.n, dtype), np.empty(self.n, dtype)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            ones = np.unpackbits(plane.view(np.uint8), count=self.n, bitorder="little").view(bool)
            ids[zeros:] |= dtype(1 << k)
            spare[np.flatnonzero(~ones)] = ids[:zeros]
            spare[np.flatnonzero(ones)] = ids[zeros:]
            ids, spare = spare, ids
        return ids

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before the positions ``at``."""
        words, word = self.planes[level], at >> 6
        inside = word % self.group
        out = self.before[level][word // self.group].astype(np.int64)
        for k in range(self.group - 1):
            out += np.where(inside > k, np.bitwise_count(words[word - inside + np.minimum(k, inside)]), 0)
        return out + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the positions ``at``."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, zeros + ones, at - ones)
            out = out << 1 | one
        return out

    def _narrow(self, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for level, zeros in enumerate(self.zeros):
            one = (symbol >> (len(self.zeros) - 1 - level) & 1).astype(bool)
            b, e = self._ones(level, begin), self._ones(level, end)
            begin, end = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, end - e)
        return begin, end

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        symbol, at = np.broadcast_arrays(np.asarray(symbol, np.int64), np.asarray(at, np.int64))
        begin, end = self._narrow(symbol, np.zeros_like(at), at)
        return end - begin

    def count(self, symbol: int) -> int:
        return int(self.rank(np.array([symbol]), np.array([self.n]))[0])

    def select(self, symbol: int, nth: int) -> int:
        """The position of the nth (from 0) occurrence, found by bisecting on rank; -1 if there are fewer."""
        if nth < 0 or nth >= self.count(symbol):
            return -1
        low, high = 0, self.n - 1
        while low < high:
            middle = (low + high) // 2
            if self.rank(np.array([symbol]), np.array([middle + 1]))[0] > nth:
                high = middle
            else:
                low = middle + 1
        return low


    def places(self, symbol: int) -> list[int]:
        """All positions of ``symbol``."""
        return [self.select(symbol, k) for k in range(self.count(symbol))]


def width(n: int) -> int:
    """Words of a plane of n bits: whole groups, and a place after the last bit."""
    return ((n >> 6) // GROUP + 1) * GROUP


def directory(words: np.ndarray, group: int = GROUP) -> np.ndarray:
    """Ones before each group of a plane's words."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, group).sum(axis=1))]).astype("<u4")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    matrix = WaveletMatrix.build(ids, bits)
    flagged = any(d is None for d in doc_ids)
    out = [_HEAD.pack(b"LSWM", bits, flagged, len(doc_ids), len(ids)), np.array([d or 0 for d in doc_ids], "<i8").tobytes()]
    if flagged:
        out.append(bytes(d is None for d in doc_ids))
    out.append(np.array(lengths, "<u4").tobytes())
    for plane, zeros, before in zip(matrix.planes, matrix.zeros, matrix.before, strict=True):
        out += [struct.pack("<Q", zeros), plane.tobytes(), before.tobytes()]
    return b"".join(map(padded, out))


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents' ids, their numbers of token ids, and the matrix of all token ids, on the bytes of the file."""
    magic, bits, flagged, docs, n = _HEAD.unpack_from(data)
    if magic != b"LSWM":
        raise ValueError("not a wavelet matrix file")
    at = _HEAD.size

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += -(-out.nbytes // 8) * 8
        return out

    doc_ids: list[int | None] = part("<i8", docs).tolist()
    if flagged:
        doc_ids = [None if x else d for d, x in zip(doc_ids, part("u1", docs).tolist(), strict=True)]
    lengths = part("<u4", docs).astype(np.int64)
    zeros, planes, before = [], [], []
    for _ in range(bits):
        zeros.append(int(part("<u8", 1)[0]))
        planes.append(part("<u8", width(n)))
        before.append(part("<u4", width(n) // GROUP + 1))
    return doc_ids, lengths, WaveletMatrix(n, planes, zeros, before)


class WordEncoder:
    """The library's encoder behind a cache from a piece (what the tokenizer's pattern cuts out) to its packed ids.

    White space is dropped and no piece spans it, so the ids of a text are those of its pieces in turn. On Latin letters the
    normalisation is lower-casing alone; the text is cut by the same pattern and each new piece goes to the
    library's model. Any other text goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (size - 1).bit_length())
        self.dtype, self.code = (np.uint16, "H") if self.bits <= 16 else (np.uint32, "I")
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = [letters[b] for b in range(256)]
        self.model = self.tok.model
        self.pieces = Remembered(self._piece, CACHE)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        # printable ASCII letters stand for their own bytes
        spelt = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        return self.pack([t.id for t in self.model.tokenize(spelt)])

    def encode(self, text: str, plain: bool = False) -> bytes:
        """The packed ids; ``plain`` says that the text is known to hold nothing odd."""
        if not plain and ODD.search(text):
            return self.pack(self.tok.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))


def all_plain(column: pa.Array) -> bool:
    """Whether no text of a batch can hold anything odd, seen from its bytes at once: no control or special characters, nothing from U+0180 on, no dotted I."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width, len(column) + 1, column.offset * np.dtype(width).itemsize) if len(column) else [0, 0]
    data = column.buffers()[2]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(b) == 0:
        return True
    if ((b - np.uint8(0x1C)) < 4).any() or (b >= 0xC6).any():
        return False
    return not (((b[:-1] == 0xC4) & (b[1:] == 0xB0)).any() or ((b[:-1] == 0x3C) & (b[1:] == 0x7C)).any())


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)


def write_files(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """The table of files (part, first, n_ids, data): by ascending doc_id over parts, and within a part by ``first``, the ids before the file in its part."""
    tune(docs.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    key = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_tie", key).repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, first = encoder(path), TaskContext.get().partitionId(), 0
        end = enc.pack([end_id])
        held_docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), enc.dtype)
            data = to_file(held_docs, [len(x) // enc.dtype().itemsize for x in held], ids, enc.bits)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([part, first, len(ids), data], schema, strict=True)], schema=schema)

        for batch in it:
            plain = all_plain(batch.column(1))
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held_docs.append(doc)
                held.append(enc.encode(text or "", plain) + end)
                size += len(held[-1]) // enc.dtype().itemsize
                if size >= FILE_IDS:
                    yield flush()
                    first += size
                    held_docs, held, size = [], [], 0
        if held:
            yield flush()

    return written(map_arrow(ordered, run, "part int, first long, n_ids long, data binary"), "wavelet")


def read_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    tune(files.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, first, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                doc_ids, lengths, matrix = from_file(data)
                ids = matrix.decode(np.uint16 if len(matrix.planes) <= 16 else np.uint32).astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(crcs), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(begins + first), pa.array(lengths), pa.array(crcs, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = map_arrow(files.select("part", "first", "data"), run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row per part, and parts are as many as shuffle partitions: a proven bound for the broadcast
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def wavelet(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_files(write_files(docs, path))
