"""Benchmark decontamination by FM-indexes (operator 6).

Each shard of training documents (one Arrow batch) is indexed: the sequence of its words, as
symbols of the benchmark's vocabulary, gets a suffix array, its Burrows-Wheeler transform goes
into a wavelet matrix, and every ``SAMPLE``-th text position is kept. All test windows are then
searched backwards at once; each surviving interval is located by walking to sampled positions,
and the spans found are merged per document. A word outside the benchmark's vocabulary can be
part of no window, so it only parts the sequence, and stretches shorter than the shortest window
are left out of the index.

The benchmark is read a partition at a time, in blocks of ``BLOCK_BYTES`` bytes of words and at least one item, each broadcast on its own;
the documents pass once for each block, and the spans of all blocks are merged, so the benchmark may be of any size.

Defined cases: null text has no words; a null item_id is never listed, though its windows hit;
items without words match nothing; repeated items count once; repeated documents are judged each; texts may be of any length;
windows that overlap or tie are all found; other columns, whatever their names, are kept by the filter and ignored by the query;
empty tables give an empty result, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, map_arrow, packed, tune, unpacked, written
from .wavelet import WaveletMatrix

WINDOW = 10
SAMPLE = 8
#: Bytes of words of the benchmark in one broadcast block: some 70 MB on the driver while it is built, 15 MB broadcast.
BLOCK_BYTES = 1_000_000

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A-Z and turns every other byte outside words into a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Windows:
    """Test windows of one block: a vocabulary, the windows as rows of symbols padded with 0 in front, and each one's items."""

    def __init__(self) -> None:
        self.vocab: dict[bytes, int] = {}
        self.found: dict[tuple[int, ...], set] = {}
        self.n_bytes = 0

    def add(self, item: object, words: list[bytes], width: int) -> None:
        ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
        self.n_bytes += sum(map(len, words)) + len(words)
        for i in range(max(1, len(ids) - width + 1) if ids else 0):
            self.found.setdefault(tuple(ids[i : i + width]), set()).add(item)

    def close(self) -> Windows:
        self.keys = list(self.found)
        self.items = [sorted((str(x) for x in self.found[k] if x is not None)) for k in self.keys]
        self.lengths = np.array([len(k) for k in self.keys], np.int64)
        self.width = int(self.lengths.max()) if self.keys else 0
        self.rows = np.zeros((len(self.keys), self.width), np.int64)
        for i, k in enumerate(self.keys):
            self.rows[i, self.width - len(k) :] = k
        del self.found, self.keys
        return self


def blocks(benchmark: DataFrame, width: int) -> Iterator[Windows]:
    """Read the benchmark a partition at a time; yield blocks of bounded size."""
    block = Windows()
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        block.add(row.item_id, words_of(bytes(row.text) if row.text is not None else None), width)
        if block.n_bytes >= BLOCK_BYTES:
            yield block.close()
            block = Windows()
    if block.n_bytes:
        yield block.close()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling, starting from as many symbols as fit in a 64-bit key."""
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length()) if n else 1
    h = max(1, min(62 // bits, 8))
    key = np.zeros(n, np.int64)
    for k in range(h):
        key <<= bits
        key[: max(0, n - k)] |= seq[k:]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: max(0, n - h)] += rank[h:] + 1
        h *= 2


class FmIndex:
    def __init__(self, seq: np.ndarray, sigma: int):
        """seq: symbols 1..sigma, 0 between stretches; a unique terminator is appended at rank 0."""
        text = np.concatenate([seq + 1, [0]]) if len(seq) else np.array([0])
        self.n = len(text)
        order = suffix_array(text)
        last = text[order - 1]
        self.matrix = WaveletMatrix.build(last.astype(np.uint32), max(1, int(sigma + 1).bit_length()), group=1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 2))])
        sampled = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the index that starts with each row's last ``lengths`` symbols; empty if it doesn't occur."""
        begin, end = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        live = np.arange(len(rows))
        for step in range(1, rows.shape[1] + 1):
            live = live[(lengths[live] >= step) & (end[live] > begin[live])]
            if not len(live):
                break
            symbol = rows[live, rows.shape[1] - step] + 1
            base = self.before[symbol]
            begin[live], end[live] = base + self.matrix.rank(symbol, begin[live]), base + self.matrix.rank(symbol, end[live])
        return begin, np.maximum(begin, end)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of index rows, by stepping back to the nearest sampled position."""
        at, out, steps = at.copy(), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            here = at[live]
            done = self.marks[here + 1] > self.marks[here]
            out[live[done]] = self.samples[self.marks[here[done]]] + steps[live[done]]
            live, here = live[~done], here[~done]
            symbol = self.matrix.access(here)
            at[live] = self.before[symbol] + self.matrix.rank(symbol, here)
            steps[live] += 1
        return out


def scan(texts: list[bytes | None], block: Windows) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """For each text its number of words, its hit spans (begin, end, begin, end ...; in words, merged) and the items that occur."""
    get = block.vocab.get
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # one separator after each text
    seq = np.zeros(int(starts[-1]), np.int64)
    for words, begin in zip(split, starts.tolist(), strict=False):
        seq[begin : begin + len(words)] = [get(w, 0) for w in words]
    spans: list[list[int]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if len(block.rows) and len(seq):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], seq > 0, [0]])))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= block.lengths.min()]
        # the kept stretches, each with the 0 that follows it
        sizes = runs[:, 1] - runs[:, 0] + 1
        if len(runs):
            offset = np.concatenate([[0], np.cumsum(sizes)])
            place = np.arange(offset[-1]) - np.repeat(offset[:-1] - runs[:, 0], sizes)
            index = FmIndex(np.where(place < len(seq), seq[np.minimum(place, len(seq) - 1)], 0), len(block.vocab))
            begin, end = index.search(block.rows, block.lengths)
            hits = end - begin
            which = np.repeat(np.arange(len(hits)), hits)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits - begin, hits)
            at = place[index.locate(rows)]
            change = np.zeros(len(seq) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + block.lengths[which], -1)
            marked = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]]))).reshape(-1, 2)
            for doc, (a, b) in zip((np.searchsorted(starts, marked[:, 0], "right") - 1).tolist(), marked.tolist(), strict=True):
                spans[doc] += [a - int(starts[doc]), b - int(starts[doc])]
            pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, which]), axis=1)
            for doc, w in pairs.T.tolist():
                items[doc] += block.items[w]
    return lengths.tolist(), spans, [sorted(set(x)) for x in items]


def merged(spans: list[int]) -> list[int]:
    """Union of spans given as begin, end, begin, end ..."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with ``_words``, ``_spans`` and ``_items``; rows and columns otherwise as they came."""
    spark = docs.sparkSession
    tune(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField("_words", T.LongType()), T.StructField("_spans", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))])
    names, at, out = schema.names, docs.columns.index("text"), None
    for block in _or_empty(blocks(benchmark, width)):
        shared, later = spark.sparkContext.broadcast(block), out is not None

        def run(it: Iterator[pa.RecordBatch], shared=shared, later=later) -> Iterator[pa.RecordBatch]:
            for batch in it:
                n, spans, items = scan(as_bytes(batch.column(at)), shared.value)
                if later:
                    spans = [merged(a + b) for a, b in zip(batch.column(len(names) - 2).to_pylist(), spans, strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(batch.column(len(names) - 1).to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 3], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=names)

        out = map_arrow((docs if out is None else written(out, "hits")), run, schema)
    return out


def _or_empty(found: Iterator[Windows]) -> Iterator[Windows]:
    first = next(found, None)
    yield first or Windows().close()
    yield from found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = with_hits(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("g")), lambda a, x: F.struct((a.s + a.g * x).alias("s"), (-a.g).alias("g")), lambda a: a.s)
    return found.select("doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def decontaminate_filter(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit words cut out of their texts; a document that is left with no words goes."""
    needed = ["text"]
    plain = packed(docs, needed)
    found = with_hits(plain, benchmark)
    at, schema = plain.columns.index("text"), plain.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, spans = as_bytes(batch.column(at)), batch.column(len(schema) + 1).to_pylist()
            left = [without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            keep = pa.array([not s or bool(words_of(t)) for t, s in zip(left, spans, strict=True)])
            columns = list(batch.columns[: len(schema)])
            columns[at] = pa.array(left, pa.binary()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(keep)

    return unpacked(map_arrow(found, run, schema), docs.columns, needed)


def without(text: bytes, spans: list[int]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between the words of one span."""
    folded = text.translate(FOLD)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(folded, np.uint8) != 0x20, [0]]))).reshape(-1, 2)
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : edges[a, 0]])
        last = int(edges[b - 1, 1])
    return b"".join([*out, text[last:]])



_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(len(w), {WINDOW}) as k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select r, k, w, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
h as (select r, dw.k, i, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from (select distinct r, i, k from h)) group by r),
t as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n on d.r = n.r left join t on d.r = t.r
"""
