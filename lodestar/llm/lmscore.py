"""Cross-entropy difference scores (operator 3).

Two bigram models, one of the target documents and one of all documents, share one vocabulary:
every word of the corpus, and one more symbol for words it doesn't have (an interpolation of bigram
and unigram relative frequencies). All counts are exact, keyed by the words themselves, and grow with
the corpus; none of them comes to the driver or is broadcast. The score of a document is its mean, over
its tokens, of the difference of the losses in bits under target and background: low means like the target.

Documents are read once, in chunks of about ``CHUNK_TOKENS`` tokens. A chunk keeps its documents as numbers of
its own words; its distinct words and bigrams with their target and background counts go to
buckets by a hash, packed as one row for each chunk and bucket. The number of buckets grows with the text, so a
bucket stays small; in it equal keys (as text, not as hashes) are summed, and what other chunks add goes back,
in the order in which the keys came. What comes to the driver are four numbers: bytes of text, tokens of the
target and of all documents, and distinct words.

Defined cases: null text has no words, and a document without words has null entropies; repeated
rows count and are scored each; a document longer than a chunk is a chunk of its own; other columns, whatever their names, are ignored;
an empty target leaves its model uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, map_arrow, release, tune, written
from .decontam import words_of

#: Words that the models tell apart: None, as all of them.
VOCABULARY = None
MIX = 0.7
SMOOTHING = 0.5
#: Tokens after which a chunk is closed; a longer document is a chunk of its own.
CHUNK_TOKENS = 3_000_000
#: Most target documents that are broadcast: some 20 MB where doc_id is a long.
BROADCAST_IDS = 500_000
#: Bytes of text for one bucket, of whose keys some 100,000 to 500,000 are different.
BUCKET_BYTES = 4_000_000
#: Rows: a document, the hashes of a chunk's words, keys of a chunk in a bucket, a bucket's sums.
DOCUMENT, HASHES, KEYS, SUMS = range(4)


def cells(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The number of each pair of symbols, a different one for each."""
    return before.astype(np.int64) << 32 | word.astype(np.int64)


def zipped(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def zipped_symbols(a: np.ndarray) -> bytes:
    """The bytes of int32 numbers, plane by plane."""
    return zipped(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T))


def unzipped_symbols(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(unzipped(data, 4 * n, np.uint8).reshape(4, n).T).view(np.int32).reshape(-1)


def unzipped(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


class Counts:
    """Counts of the words and bigrams of a chunk, from its documents as numbers of words from 1; 0 stands before a document.

    ``t`` and ``b`` have a place for each word, 0 included, then each bigram; ``t_last`` and ``b_last`` count documents by their last word, which is no history.
    ``order`` are the places by bucket, ``ends`` where buckets begin and end in it."""

    def __init__(self, seqs: list[np.ndarray], hits: np.ndarray, hashes: np.ndarray, buckets: int):
        lengths = np.array([len(s) for s in seqs], np.int64)
        some, self.known = lengths > 0, len(hashes)
        self.word = np.concatenate(seqs)
        self.before = np.concatenate([np.zeros(1, np.int32), self.word[:-1]])
        self.before[(np.cumsum(lengths) - lengths)[some]] = 0
        self.pair, at = np.unique(cells(self.before, self.word), return_inverse=True)
        self.at = at.reshape(-1).astype(np.int32)
        last, of_target = self.word[np.cumsum(lengths)[some] - 1], np.repeat(hits, lengths)
        self.b, self.b_last = self._count(self.word, self.at, last)
        self.t, self.t_last = self._count(self.word[of_target], self.at[of_target], last[hits[some]])
        h = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        x = np.concatenate([h + np.uint64(1), h[self.pair >> 32] * np.uint64(5) + h[self.pair & 0xFFFFFFFF]]) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        self.order = np.argsort(bucket, kind="stable")
        self.ends = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def _count(self, word: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.bincount(word, minlength=self.known)
        words[0] = len(last)  # documents, which is how often 0 is a history
        return np.concatenate([words, np.bincount(at, minlength=len(self.pair))]), np.bincount(last, minlength=self.known)


class Chunk:
    """Documents as numbers of words, in the order in which the chunk meets them."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.vocab: dict[bytes, int] = {}
        self.seqs: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.hits: list[bool] = []
        self.n_tokens = 0

    def add(self, doc_id: pa.Array, hit: bool, text: bytes | None) -> None:
        vocab = self.vocab
        words = words_of(text)
        seq = np.fromiter((vocab.setdefault(w, len(vocab) + 1) for w in words), np.int32, len(words))
        self.ids.append(doc_id)
        self.hits.append(hit)
        self.seqs.append(seq)
        self.n_tokens += len(seq)

    def rows(self, schema: pa.Schema, buckets: int) -> Iterator[pa.RecordBatch]:
        """The chunk as rows to deal out by bucket."""
        for i in range(0, len(self.seqs), 1000):
            part = self.seqs[i : i + 1000]
            places = [(self.number + i + k) % buckets for k in range(len(part))]
            yield filled(schema, len(part), chunk=[self.number] * len(part), kind=[DOCUMENT] * len(part), bucket=places, doc_id=pa.concat_arrays(self.ids[i : i + 1000]), hit=self.hits[i : i + 1000], n=[len(s) for s in part], data=[zipped_symbols(s) for s in part])
        if not self.n_tokens:
            return
        hashes = np.array([0, *map(zlib.crc32, self.vocab)], np.uint32)
        counts = Counts(self.seqs, np.array(self.hits, bool), hashes, buckets)
        yield filled(schema, 1, chunk=[self.number], kind=[HASHES], bucket=[self.number % buckets], n=[len(hashes)], data=[zipped(hashes)])
        names, known, space = pa.array([b"", *self.vocab], pa.binary()), counts.known, pa.scalar(b" ", pa.binary())
        join = lambda a, b: pc.binary_join_element_wise(names.take(pa.array(a)), names.take(pa.array(b)), space).to_pylist()
        for k in range(buckets):
            places = counts.order[counts.ends[k] : counts.ends[k + 1]]
            if not len(places):
                continue
            word, pair = places[places < known], counts.pair[places[places >= known] - known]
            keys = [*names.take(pa.array(word)).to_pylist(), *join(pair >> 32, pair & 0xFFFFFFFF)]
            text = b"\n".join(keys)
            yield filled(schema, 1, chunk=[self.number], kind=[KEYS], bucket=[k], n=[len(keys)], words=[len(word)], size=[len(text)], data=[pa.Codec("zstd", compression_level=6).compress(text, asbytes=True)], t=[zipped(counts.t[places])], b=[zipped(counts.b[places])], t_last=[zipped(counts.t_last[word])], b_last=[zipped(counts.b_last[word])])


def filled(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    """``rows`` rows; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def chunks(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Documents and keys of all chunks. A target of at most BROADCAST_IDS documents is broadcast, so that texts stay where they are; a larger one is joined by sorting.

    Rows are sorted within their partition and chunks numbered in it, so a task that runs again makes the same chunks."""
    listed = written(target.select("doc_id").filter("doc_id is not null").distinct().withColumn("hit", F.lit(True)), "lm-target")
    way = "broadcast" if listed.count() <= BROADCAST_IDS else "merge"
    marked = docs.select("doc_id", "text").join(listed.hint(way), "doc_id", "left").select("doc_id", "text", F.coalesce("hit", F.lit(False)).alias("hit"))
    kinds = {"chunk": T.LongType(), "kind": T.IntegerType(), "bucket": T.IntegerType(), "doc_id": docs.schema["doc_id"].dataType, "hit": T.BooleanType(), "n": T.LongType(), "words": T.LongType(), "size": T.LongType(), "data": T.BinaryType(), **{c: T.BinaryType() for c in ("t", "b", "t_last", "b_last")}}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk, out = Chunk(number), None
        for batch in it:
            ids = batch.column(0)
            out = out or pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", ids.type), ("hit", pa.bool_()), ("n", pa.int64()), ("words", pa.int64()), ("size", pa.int64()), ("data", pa.binary()), *((c, pa.binary()) for c in ("t", "b", "t_last", "b_last"))])
            for i, (text, hit) in enumerate(zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                chunk.add(ids.slice(i, 1), hit, text)
                if chunk.n_tokens >= CHUNK_TOKENS:
                    yield from chunk.rows(out, buckets)
                    number += 1
                    chunk = Chunk(number)
        if chunk.seqs:
            yield from chunk.rows(out, buckets)

    return map_arrow(marked.sortWithinPartitions("doc_id", "text"), run, T.StructType([T.StructField(c, k) for c, k in kinds.items()]))


def summed(rows: pa.Table) -> pa.Table:
    """One bucket: documents and hashes pass, keys get what other chunks have of them, and the bucket's sums are added."""
    kinds = rows.column("kind").to_numpy()
    passing, own = rows.filter(pa.array(kinds != KEYS)), rows.filter(pa.array(kinds == KEYS))
    if not own.num_rows:
        return passing
    sizes, words = own.column("n").to_numpy(), own.column("words").to_numpy()
    parts = [pa.array(pa.decompress(d, k, codec="zstd", asbytes=True).split(b"\n"), pa.binary()) for d, k in zip(own.column("data").to_pylist(), own.column("size").to_pylist(), strict=True)]
    every = pa.concat_arrays(parts)
    code = every.dictionary_encode().indices.to_numpy()
    single = np.concatenate([np.arange(n) < w for n, w in zip(sizes, words, strict=True)])
    back, totals = {}, []
    true_word = single & (pc.binary_length(every).to_numpy() > 0)  # the empty key is what stands before a document
    for c, of, lengths in (("t", code, sizes), ("b", code, sizes), ("t_last", code[single], words), ("b_last", code[single], words)):
        mine = np.concatenate([unzipped(d, int(n), np.int64) for d, n in zip(own.column(c).to_pylist(), lengths, strict=True)])
        sums = np.zeros(int(code.max()) + 1, np.int64)
        np.add.at(sums, of, mine)
        back[c] = [zipped(x) for x in np.split(sums[of] - mine, np.cumsum(lengths)[:-1])]
        if lengths is sizes:
            totals.append(int(mine[true_word].sum()))
    chunk, bucket = own.column("chunk").to_pylist(), own.column("bucket").to_pylist()
    keys = filled(rows.schema, own.num_rows, chunk=chunk, kind=[KEYS] * own.num_rows, bucket=bucket, n=sizes, words=words, **back)
    sums = filled(rows.schema, 1, chunk=[-1], kind=[SUMS], bucket=bucket[:1], n=[len(np.unique(code[true_word]))], words=[totals[0]], size=[totals[1]])
    out = pa.concat_tables([passing, pa.Table.from_batches([keys, sums])])
    release()
    return out


def losses(before: np.ndarray, word: np.ndarray, pair: np.ndarray, tokens: int, size: int) -> np.ndarray:
    """Bits of each token under one model, from the counts of its history, its word and its bigram."""
    unigram = (word + SMOOTHING) / (tokens + SMOOTHING * (size + 1))
    mix = np.where(before > 0, MIX, 0.0)
    return -np.log2(mix * (pair / np.maximum(before, 1)) + (1 - mix) * unigram)


def lm_scores(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_bits, background_bits and their difference, per token; ``target`` lists the doc_id of target documents."""
    tune(docs.sparkSession)
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    dealt = chunks(docs, target, buckets)
    rows = written(dealt.groupBy("bucket").applyInArrow(summed, dealt.schema), "lm-counts")
    n = rows.filter(F.col("kind") == SUMS).agg(F.sum("words"), F.sum("size"), F.sum("n")).first()  # three numbers
    totals, size = (n[0] or 0, n[1] or 0), n[2] or 0
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_bits", "background_bits", "difference"))]

    def score(rows: pa.Table) -> pa.Table:
        kinds = rows.column("kind").to_numpy()
        docs, hashes, keys = (rows.filter(pa.array(kinds == k)) for k in (DOCUMENT, HASHES, KEYS))
        lengths = docs.column("n").to_numpy()
        bits = np.zeros((2, int(lengths.sum())))
        if bits.size:
            seqs = [unzipped_symbols(d, int(k)) for d, k in zip(docs.column("data").to_pylist(), lengths, strict=True)]
            own = Counts(seqs, np.array(docs.column("hit").to_pylist(), bool), unzipped(hashes.column("data")[0].as_py(), hashes.column("n")[0].as_py(), np.uint32), buckets)
            for bucket, n_keys, n_words, *more in zip(*(keys.column(c).to_pylist() for c in ("bucket", "n", "words", "t", "b", "t_last", "b_last")), strict=True):
                places = own.order[own.ends[bucket] : own.ends[bucket + 1]]
                for mine, data, n in zip((own.t, own.b, own.t_last, own.b_last), more, (n_keys, n_keys, n_words, n_words), strict=True):
                    mine[places[:n]] += unzipped(data, n, np.int64)
            for k, (found, last) in enumerate(((own.t, own.t_last), (own.b, own.b_last))):
                bits[k] = losses(found[own.before] - last[own.before], found[own.word], found[own.known + own.at], totals[k], size)
        some = lengths > 0
        starts = (np.cumsum(lengths) - lengths)[some]
        means = [np.add.reduceat(x, starts) / lengths[some] if len(starts) else np.zeros(0) for x in (*bits, bits[0] - bits[1])]
        columns = []
        for x in means:
            full = np.zeros(len(lengths))
            full[some] = x
            columns.append(pa.array(full, mask=~some))
        out = pa.Table.from_arrays([docs.column("doc_id"), docs.column("n"), *columns], names=[f.name for f in fields])
        release()
        return out

    return rows.filter(F.col("kind") != SUMS).groupBy("chunk").applyInArrow(score, T.StructType(fields))
