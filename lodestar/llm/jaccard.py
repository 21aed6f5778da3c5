"""N-gram Jaccard join by signature trees (operator 5).

Documents are sets of word shingles, hashed to 64 bits. Two link when their Jaccard similarity
is at least ``percent`` per cent, decided in whole numbers on the full sets; classes are the
connected components of the links. Words per shingle and ``percent`` are parameters.

1. Documents of equal sets become one *node*. Sets are told apart by 128 bits of hash: where two sets
   have the same first 64 bits, which name the node, both get a name made from all 128.
2. Blocking without loss: all shingles stand in one order, and the block keys of a set of n shingles are the first of them, a few more than
   the n (100 - percent) / 100 that a linked set may lack; so sets that link share at least those few. Any order is right; a good one has rare shingles
   first, so that passages which many documents share bring none together: the number of times that a shingle occurs in SAMPLE documents says what is
   common. Nodes that share too few blocks to link are left out before anything is compared.
3. In each block all nodes are linked to its least one, as candidates, and those that meet in enough blocks are verified; these stars give first classes.
   Within a class nothing more needs comparing.
4. Nodes that meet other classes in too few blocks to link are left out, in some rounds. In what is left, pairs that share enough narrow blocks, and nodes whose
   wide blocks alone would be enough, are put together; each such *group* is searched by *signature
   trees*: nodes of the tree hold the OR of their members' token bitmaps, their range of sizes, and their class if it is one; two trees
   are traversed at once, and a pair of tree nodes is pruned when it has one class, when the ranges of sizes are too far apart or when the
   greatest overlap that the bitmaps allow is too small. Pairs of leaves that remain are verified on the full sets, those of the
   greatest overlap first, and only while their classes are apart: what comes out is a forest over the classes, not all pairs.
   A node stands in one group, so its text is sent once, not for each of its blocks; wide blocks that would make a group of more than GROUP nodes
   stay apart. A large group is split into cells: its largest class and the others are cut into chunks, and pairs of chunks meet, each pair in one cell.
5. The verified links of both steps give the classes.

Block keys and links are those of 64-bit shingle hashes. Nothing is capped, and texts are whole.

Defined cases: a document without text or words is a class of its own; a null doc_id takes part, and is
never the least; a class of null doc_ids alone has a null component_id; repeated rows are copies; other columns, whatever their names,
are ignored or, by ``one_of_each``, kept; ties for the least doc_id go to the least hash of the text; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, free_shuffles, map_arrow, packed, tune, unpacked, written
from .graph import components

SHINGLE = 3
PERCENT = 90
#: Documents, and characters of each, that tell which shingles are common, and the most common shingles that are remembered. They set the order of keys alone.
SAMPLE = 4000
SAMPLE_CHARS = 20_000
COMMON = 1 << 18
#: Keys beyond those that a linked set may lack: so many, and one for each so many shingles.
SPARE = 3
SPARE_SHARE = 20
#: Rounds in which nodes that share too few blocks to link are left out; any number loses no link.
ROUNDS = 2
#: Most nodes of a block whose pairs are counted.
WIDE = 50
#: Most nodes that are put together.
GROUP = 20_000
#: Members of one chunk of a large group, at least and at most, and the bytes of their sets.
CHUNK = (512, 4096)
CHUNK_BYTES = 16 << 20
#: Cells that a member of a large group is dealt to, about, unless the bounds of a chunk ask for more: its text is written once for each.
COPIES = 8
#: Links of one hub that one task verifies.
HUB = 200
#: Bits of a token bitmap for each shingle of a set of middle size, and of all bitmaps of a cell; members of a leaf of a signature tree.
BITS = 16
CELL_BITS = 1 << 28
LEAF = 8
CACHE = 400_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingle_set(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles of one text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    out = mix(h[: len(h) - k + 1] + _U(k))
    for i in range(1, k):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), n - 1)] == b).sum())
    return 100 * both >= percent * (n + m - both)


class Classes:
    """The order of shingles, and the numbers of block keys of a set and of those that a linked set shares."""

    def __init__(self, percent: int = PERCENT, common: np.ndarray | None = None):
        self.percent, self.spare = percent, SPARE
        # the smallest set that can link to a different one
        self.least = -(-percent // (100 - percent))
        # how common a shingle is, by some of its bits: what falls together with a common one counts as common, for all sets alike
        self.level = np.zeros(1 << 22, np.uint8)
        if common is not None:
            np.maximum.at(self.level, self.place(common[0]), common[1].astype(np.uint8))

    def place(self, shingles: np.ndarray) -> np.ndarray:
        return (shingles & _U(len(self.level) - 1)).astype(np.int64)

    def extra(self, n: int) -> int:
        return max(1, self.spare + n // SPARE_SHARE)

    def keys(self, n: int) -> int:
        """The number of keys of a set of n shingles: all but the first of ``extra`` of the shared ones may stand behind what a linked set lacks."""
        return min(n, n - -(-self.percent * n // 100) + self.extra(n)) if n >= self.least else 0

    def shared(self, n: int) -> int:
        """The least number of keys that a set shares with any that links to it: of two sets, all shared shingles among the keys of that whose
        last key comes first are keys of both, and a partner has percent of n shingles or more."""
        return min(-(-self.percent * n // 100), self.extra(-(-self.percent * n // 100)))

    def first(self, s: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` shingles of a set in the order: by level, then by a mixing, in which no two are equal."""
        level = self.level[self.place(s)]
        rare = s[level == 0]
        if len(rare) >= count:
            return rare[np.argpartition(mix(rare), count - 1)[:count]]
        return s[np.lexsort((mix(s), level))[:count]]


def block_keys(sets: list[np.ndarray], classes: Classes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The block keys of each set, and a mark for each key: twice the least number of keys that a linked set shares."""
    counts = [classes.keys(len(s)) for s in sets]
    keys = [classes.first(s, k) if k else np.zeros(0, np.uint64) for s, k in zip(sets, counts, strict=True)]
    return keys, [np.full(k, 2 * classes.shared(len(s)), np.int32) for s, k in zip(sets, counts, strict=True)]


def common_shingles(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several of some SAMPLE documents, at most COMMON, and the binary digits of their numbers. Only the order of keys hangs on it."""
    rows = docs.count()
    share = min(1 << 30, (SAMPLE << 30) // max(1, rows))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, sets = WordHashes(), set(), []
        for batch in it:
            for text in as_bytes(batch.column(0)):
                s = shingle_set(text, hashes, size)
                # copies of one set tell nothing on what is common
                if node_of(s) not in seen:
                    seen.add(node_of(s))
                    sets.append(s)
        shingles, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        top = np.argsort(-count, kind="stable")[:COMMON]
        top = top[count[top] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(shingles[top].view(np.int64)), pa.array(np.ceil(np.log2(count[top] + 1)).astype(np.int32))], names=["shingle", "level"])

    found = map_arrow(drawn.repartition(1), run, "shingle long, level int").toArrow()
    return found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()


def shingled(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, node, proof, did, th, keys, mark) per document: size and two hashes of its set, what finds its row again, and its block keys.

    A node's keys stand once for each task that saw it, so copies add few."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("did"), F.xxhash64("text").alias("th"), "text")
    common = common_shingles(docs, size)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes, seen = WordHashes(), Classes(percent, common), set()
        for batch in it:
            sets = [shingle_set(t, hashes, size) for t in as_bytes(batch.column(3))]
            nodes = [node_of(s) for s in sets]
            fresh = []
            for i, node in enumerate(nodes):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            if len(seen) > CACHE:
                seen.clear()
            keys: list[np.ndarray | None] = [None] * len(sets)
            for i, k in zip(fresh, block_keys([sets[i] for i in fresh], classes)[0], strict=True):
                keys[i] = k.view(np.int64)
            marks = [2 * classes.shared(len(s)) for s in sets]
            names, proofs = (pa.array(x, pa.int64()) for x in zip(*nodes, strict=True)) if nodes else (pa.array([], pa.int64()),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), names, proofs, batch.column(1), batch.column(2), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.int32())], names=["doc_id", "n", "node", "proof", "did", "th", "keys", "mark"])

    return map_arrow(rows, run, "doc_id long, n long, node long, proof long, did long, th long, keys array<long>, mark int")


def node_of(s: np.ndarray) -> tuple[int, int]:
    """Both halves of the hash of a set, as signed longs."""
    if not len(s):
        return 0, 0
    both = xxhash.xxh3_128_intdigest(s.tobytes())
    low, high = np.array([both & 0xFFFFFFFFFFFFFFFF, both >> 64], np.uint64).view(np.int64).tolist()
    return low, high


def told_apart(documents: DataFrame) -> DataFrame:
    """``documents`` whose nodes are one set each: sets that share the first half of their hash are named by both halves."""
    shared = documents.groupBy("node").agg(F.min("proof").alias("low"), F.max("proof").alias("high")).filter("low != high").select("node", F.lit(True).alias("again"))
    if shared.isEmpty():
        return documents
    named = F.when(F.col("again"), F.xxhash64("node", "proof")).otherwise(F.col("node"))
    return written(documents.join(shared, "node", "left").withColumn("node", named).drop("again"), "jaccard-apart")


def shared_blocks(documents: DataFrame) -> DataFrame:
    """(key, node) of the blocks of several nodes, without the nodes that stand in fewer of them than they share with any that links to them. Streams over sorted rows; no block is gathered."""
    keyed = documents.filter("keys is not null").select(F.explode("keys").alias("key"), "node")
    rows = keyed.repartition("key").sortWithinPartitions("key", "node")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for the next batch, which tells whether its block has more nodes
        kept, out = (np.zeros(0, np.int64),) * 2, False
        for batch in it:
            key, node = (np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept))
            if not len(key):
                continue
            again = np.concatenate([[False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])
            key, node = key[~again], node[~again]
            same = key[1:] == key[:-1]
            several = np.concatenate([[out], same]) | np.concatenate([same, [False]])
            kept, out = (key[-1:], node[-1:]), bool(several[-1])
            if several[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][several[:-1]]) for x in (key, node)], names=["key", "node"])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["key", "node"])

    several = written(map_arrow(rows, run, "key long, node long"), "jaccard-several")
    enough = several.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(marks_of(documents), "node").filter(F.col("n") >= F.shiftright("mark", 1))
    return several.join(enough.select("node", "mark"), "node").select("key", "node", "mark")


def marks_of(documents: DataFrame) -> DataFrame:
    """(node, mark) per node."""
    return documents.groupBy("node").agg(F.max("mark").alias("mark"))


def stars_of(blocks: DataFrame) -> DataFrame:
    """(hub, node): each node with the least one of its block, where they are met so in as many blocks as sets that link share. The trees find what this leaves out."""
    hubs = blocks.groupBy("key").agg(F.min(F.struct("node", "mark")).alias("hub"))
    met = blocks.join(hubs, "key").filter("node != hub.node").groupBy(F.col("hub.node").alias("hub"), "node").agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest("mark", "hub.mark")).alias("mark"))
    return met.filter(F.col("n") >= F.shiftright("mark", 1)).select("hub", "node")


def texts_of(docs: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one document's text for each of ``nodes``."""
    # one row per node comes first: copies are combined before anything is shuffled by node
    wanted = documents.groupBy("node").agg(F.min(F.struct("did", "th")).alias("at")).join(nodes, "node", "left_semi").select("node", "at.did", "at.th")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("did"), F.xxhash64("text").alias("th"), "text")
    return rows.join(wanted, ["did", "th"]).dropDuplicates(["node"]).select("node", "text")


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (hub, node) whose sets link. A hub's set is made once for each task; hubs of many pairs are spread over tasks."""
    spread = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts"))
    members = pairs.join(spread, "hub").select("hub", F.pmod(F.hash("node"), F.col("salts")).alias("salt"), "node")
    heads = spread.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).withColumn("node", F.col("hub"))
    rows = members.unionByName(heads).join(texts, "node").select("hub", "salt", (F.col("node") != F.col("hub")).alias("member"), "node", "text")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hub, base = WordHashes(), None, None
        for batch in it:
            out = []
            for h, member, node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), as_bytes(batch.column(4)), strict=True):
                if not member:
                    hub, base = h, shingle_set(text, hashes, size)
                elif hub == h and links(base, shingle_set(text, hashes, size), percent):
                    out.append((h, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["hub", "node"])

    return map_arrow(dealt, run, "hub long, node long")


def bitmaps(sets: list[np.ndarray], words: int) -> np.ndarray:
    """The token bitmaps of sets, a row of ``words`` 64-bit words each."""
    out = np.zeros(len(sets) * words, np.uint64)
    at = (np.concatenate(sets) >> _U(7)) % _U(words * 64)
    row = np.repeat(np.arange(len(sets), dtype=np.int64) * words, [len(s) for s in sets])
    np.bitwise_or.at(out, row + (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return out.reshape(len(sets), words)


class SignatureTree:
    """A binary tree over members sorted by class and size; arrays per level, leaves of LEAF members first."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, classes: np.ndarray):
        order = np.lexsort((sizes, classes))
        self.order, bits, sizes, classes = order, bits[order], sizes[order], classes[order]
        starts = np.arange(0, len(order), LEAF)
        # tokens beyond the first of their bit: the overlap of two sets is at most that of their bits and these
        extra = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.members = (bits, sizes, sizes, extra, classes, classes)
        level = (np.bitwise_or.reduceat(bits, starts), np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts), np.maximum.reduceat(extra, starts), np.minimum.reduceat(classes, starts), np.maximum.reduceat(classes, starts))
        self.levels = [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), 2)
            level = tuple(f.reduceat(x, at) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), level, strict=True))
            self.levels.append(level)


def dual(left: SignatureTree, right: SignatureTree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a member of each tree, by their places in the given order, that no bound excludes, and their greatest overlaps.

    Both trees are descended at once. A tree with itself gives each pair once."""
    same = left is right
    a = b = np.zeros(1, np.int64)
    for depth in range(max(len(left.levels), len(right.levels)) - 1, -1, -1):
        x, y = (t.levels[min(depth, len(t.levels) - 1)] for t in (left, right))
        keep = np.concatenate([possible(x, y, i, j, percent)[0] for i, j in _slices(a, b, x)]) if len(a) else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        for mine in (True, False):
            tree = left if mine else right
            if 0 < depth < len(tree.levels):
                width = len(tree.levels[depth - 1][1])
                grown = 2 * (a if mine else b)
                other = np.tile(b if mine else a, 2)
                grown = np.concatenate([grown, grown + 1])
                inside = grown < width
                a, b = (grown[inside], other[inside]) if mine else (other[inside], grown[inside])
        if same:
            a, b = a[a <= b], b[a <= b]
    found: list[tuple[np.ndarray, ...]] = []
    steps = np.arange(LEAF)
    for x, y in _slices(a, b, left.members, LEAF * LEAF):
        i = np.repeat(x * LEAF, LEAF * LEAF) + np.tile(np.repeat(steps, LEAF), len(x))
        j = np.repeat(y * LEAF, LEAF * LEAF) + np.tile(steps, LEAF * len(y))
        inside = (i < len(left.order)) & (j < len(right.order)) & ((not same) | (i < j))
        i, j = i[inside], j[inside]
        keep, common = possible(left.members, right.members, i, j, percent)
        found.append((left.order[i[keep]], right.order[j[keep]], common[keep]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([*(f[k] for f in found), none]) for k in range(3))


def _slices(a: np.ndarray, b: np.ndarray, level: tuple, times: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of which the bitmaps take some 16 MB."""
    size = max(1, (2 << 20) // (level[0].shape[1] * times))
    for i in range(0, len(a), size):
        yield a[i : i + size], b[i : i + size]


def possible(left: tuple, right: tuple, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pair of members of different classes under the two tree nodes may link, and their greatest overlap."""
    (bits, low, high, extra, least, most), (bits2, low2, high2, extra2, least2, most2) = left, right
    one_class = (least[a] == most[a]) & (least2[b] == most2[b]) & (least[a] == least2[b])
    near = (100 * high[a] >= percent * low2[b]) & (100 * high2[b] >= percent * low[a])
    common = np.bitwise_count(bits[a] & bits2[b]).sum(axis=1).astype(np.int64) + np.minimum(extra[a], extra2[b])
    common = np.minimum(common, np.minimum(high[a], high2[b]))
    return ~one_class & near & (100 * common >= percent * (low[a] + low2[b] - common)), common


class Cell:
    """Members of one cell of a group: names, classes, sides and sets."""

    def __init__(self, node: np.ndarray, component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int):
        self.node, self.component, self.side, self.sets, self.percent = node, component, side, sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.words = max(1, min(int(np.median(self.sizes)) * BITS, CELL_BITS // len(sets)) >> 6)

    def tree(self, at: np.ndarray) -> SignatureTree:
        return SignatureTree(bitmaps([self.sets[i] for i in at], self.words), self.sizes[at], self.component[at])

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of members that may link, those of different sides if there are two, and their greatest overlaps."""
        sides = [np.flatnonzero(self.side == k) for k in (0, 1)]
        if len(sides[0]) and len(sides[1]):
            a, b, common = dual(self.tree(sides[0]), self.tree(sides[1]), self.percent)
            return sides[0][a], sides[1][b], common
        tree = self.tree(np.arange(len(self.node)))
        return dual(tree, tree, self.percent)

    def forest(self) -> tuple[list[int], list[int]]:
        """Links that join all classes of the cell which any link joins, from the greatest overlap down."""
        a, b, common = self.candidates()
        classes, number = np.unique(self.component, return_inverse=True)
        up = list(range(len(classes)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        left, right = [], []
        order = np.argsort(-common / (self.sizes[a] + self.sizes[b]), kind="stable")
        for i, j, x, y in zip(a[order].tolist(), b[order].tolist(), number[a[order]].tolist(), number[b[order]].tolist(), strict=True):
            if (x := find(x)) != (y := find(y)) and links(self.sets[i], self.sets[j], self.percent):
                up[x] = y
                left.append(i)
                right.append(j)
        return left, right


def several_classes(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (key, node, component, mark) in blocks of several classes, without the nodes that share too few blocks to link.

    Sets that link share at least half as many blocks as the mark of either says, and while they are of two classes all these blocks hold several; so a node in fewer goes, and each round can only lose nodes without a link."""
    last = None
    for k in range(ROUNDS + 1):
        mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
        found = written(members.join(mixed, "key"), f"jaccard-mixed-{k}")
        if last is not None:
            discard(last)
        last = found
        enough = found.groupBy("node", "mark").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.shiftright("mark", 1)).select("node", "mark")
        members = found.join(enough, ["node", "mark"], "left_semi")
    return found


def near(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What joins the nodes of ``held`` (key, node, component, mark) that may link: pairs (a, b), and the rows (key, node) of wide blocks that are needed besides.

    In blocks of at most WIDE nodes the blocks of each pair are counted. A node needs so many with a partner that these and its own wide blocks make up what
    sets that link share. Only where the wide ones alone can, they stand themselves: of those that sets that link share, the narrowest is one of a node's
    narrowest, so as many of its widest as it shares with a partner, less one, aren't needed."""
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    rows = written(held.join(sizes, "key"), "jaccard-sized")
    wide = F.col("size") > WIDE
    lack = rows.groupBy("node").agg((F.shiftright(F.max("mark"), 1) - F.sum(wide.cast("int"))).alias("lack"))
    listed = rows.filter(~wide).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "component"))).alias("m"))
    met = listed.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, WIDE), lambda y: y.component != x.component), lambda y: F.struct(x.node.alias("a"), y.node.alias("b")))))).alias("p"))
    pairs = met.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k: lack.select(F.col("node").alias(k), F.col("lack").alias(f"lack_{k}"))
    enough = pairs.join(of("a"), "a").join(of("b"), "b").filter((F.col("n") >= F.col("lack_a")) & (F.col("n") >= F.col("lack_b"))).select("a", "b")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), F.desc("key")))
    needed = rows.filter(wide).withColumn("place", place).filter(F.col("place") >= F.shiftright("mark", 1)).select("key", "node")
    return written(enough, "jaccard-near"), written(needed, "jaccard-wide")


def groups(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """(group, node, component) of the members of blocks that hold several classes; nodes that may link are in one group, up to GROUP nodes. Beyond,
    pairs of narrow blocks make one group, and each wide block is its own."""
    classed = blocks.join(classes.select("node", "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), "mark")
    held = several_classes(classed)
    pairs, wide = near(held)
    hubs = wide.groupBy("key").agg(F.min("node").alias("hub"))
    stars = wide.join(hubs, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")).filter("a != b")
    joined = components(pairs.unionByName(stars), "jaccard-groups").withColumnRenamed("component", "group")
    large = written(joined.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("group"), "jaccard-large")
    members = held.groupBy("node").agg(F.min("component").alias("component"))
    if large.isEmpty():
        return members.join(joined, "node").select("group", "node", "component")
    alone = written(joined.join(large, "group", "left_semi").select("node"), "jaccard-alone")
    apart = components(pairs.join(alone.withColumnRenamed("node", "a"), "a", "left_semi"), "jaccard-apart").withColumnRenamed("component", "group")
    placed = joined.join(large, "group", "left_anti").select("group", "node").unionByName(apart.select("group", "node")).unionByName(wide.join(alone, "node", "left_semi").select(F.col("key").alias("group"), "node"))
    return members.join(placed.distinct(), "node").select("group", "node", "component")


def tree_links(docs: DataFrame, blocks: DataFrame, classes: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (hub, node) that join the classes in blocks of several classes, by signature trees."""
    spark, (least, most) = blocks.sparkSession, CHUNK
    sizes = documents.groupBy("node").agg(F.first("n").alias("n"))
    rows = written(groups(blocks, classes).join(sizes, "node"), "jaccard-groups")
    free_shuffles(spark)
    texts = written(texts_of(docs, documents, rows.select("node").distinct()), "jaccard-texts")
    free_shuffles(spark)
    # a chunk is half of what a task would get if rows were dealt evenly, within bounds
    even = rows.count() // (2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    per_class = rows.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles"))
    stats = per_class.groupBy("group").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "component")).alias("top"))
    chunk = F.greatest(F.lit(1), F.least(F.greatest(F.lit(max(least, min(most, even))), F.least(F.lit(most), F.ceil(F.col("n") / COPIES))), F.expr(f"{CHUNK_BYTES >> 3} * n div shingles")))
    cells = lambda n: F.greatest(F.lit(1), F.ceil(n / F.col("chunk"))).cast("int")
    cut = stats.withColumn("chunk", chunk).select("group", (F.col("n") <= F.col("chunk")).alias("one"), F.col("top.component").alias("largest"), cells(F.col("top.n")).alias("a"), cells(F.col("n") - F.col("top.n")).alias("b"))
    first = F.col("component") == F.col("largest")
    placed = rows.join(cut, "group").withColumn("own", F.pmod(F.hash("node"), F.when(first, F.col("a")).otherwise(F.col("b"))))
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    zero, own = F.lit(0), F.col("own")
    where = (
        F.when(F.col("one"), F.array(cell(0, zero, zero, zero)))
        .when(first, F.transform(upto(F.col("b")), lambda j: cell(1, own, j, zero)))
        .otherwise(F.concat(F.transform(upto(F.col("a")), lambda i: cell(1, i, own, F.lit(1))), F.transform(upto(F.col("b")), lambda k: cell(2, F.least(own, k), F.greatest(own, k), (own > k).cast("int")))))
    )
    dealt = placed.withColumn("cell", F.explode(where)).select("group", "cell.*", "node", "component")
    full = dealt.join(texts, "node").select("group", "kind", "i", "j", "side", "node", "component", "text").repartition("group", "kind", "i", "j").sortWithinPartitions("group", "kind", "i", "j")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[tuple] = []
        last = None
        for batch in it:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for *here, side, node, component, text in zip(*columns, as_bytes(batch.column(7)), strict=True):
                if held and here != last:
                    yield from joined(held)
                    held = []
                held.append((node, component, side, shingle_set(text, hashes, size)))
                last = here
        if held:
            yield from joined(held)

    def joined(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, component, side, sets = zip(*held, strict=True)
        cell = Cell(*(np.array(x, np.int64) for x in (node, component, side)), list(sets), percent)
        a, b = cell.forest()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(cell.node[a]), pa.array(cell.node[b])], names=["hub", "node"])

    return map_arrow(full, search, "hub long, node long")


def classes_of(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, node, did, th, component) per document; component is the class's node."""
    tune(docs.sparkSession)
    spark, shingles = docs.sparkSession, written(shingled(docs, size, percent), "jaccard-docs")
    keyed = told_apart(shingles)
    blocks = written(shared_blocks(keyed), "jaccard-blocks")
    documents = written(keyed.drop("keys", "mark"), "jaccard-nodes")
    # the block keys, of which there are as many as shingles nearly, are on disk only until the blocks are known
    discard(keyed)
    discard(shingles)
    free_shuffles(spark)
    stars = written(stars_of(blocks), "jaccard-stars")
    nodes = stars.select("node").union(stars.select("hub")).distinct()
    texts = written(texts_of(docs, documents, nodes), "jaccard-texts")
    first = written(verified(stars, texts, size, percent), "jaccard-links")
    discard(texts)
    free_shuffles(spark)
    classes = joined_classes(first, "jaccard-first")
    more = written(tree_links(docs, blocks, classes, documents, size, percent), "jaccard-more")
    if not more.isEmpty():
        classes = joined_classes(first.unionByName(more), "jaccard-all")
    return documents.join(classes, "node", "left").select("doc_id", "n", "node", "did", "th", F.coalesce("component", "node").alias("component"))


def joined_classes(found: DataFrame, name: str) -> DataFrame:
    return components(found.select(F.col("hub").alias("a"), F.col("node").alias("b")), name)


def jaccard_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    found = written(classes_of(docs.select("doc_id", "text"), size, percent), "jaccard-classes")
    # copies are combined per node first; each side of a join is a written table, so that Spark can split hot keys
    nodes = written(found.filter("n > 0").groupBy("node", "component").agg(F.min("doc_id").alias("low")), "jaccard-nodes")
    least = written(nodes.groupBy("component").agg(F.min("low").alias("component_id")), "jaccard-least")
    named = written(nodes.select("node", "component").join(least, "component").select("node", "component_id"), "jaccard-named")
    joined = found.filter("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (nulls last), then of the least hash of the text.

    A document without words is a class of its own; rows equal in doc_id and text are one document."""
    found = written(classes_of(docs.select("doc_id", "text"), size, percent), "jaccard-classes")
    least = found.filter("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "did", "th")).alias("at"))
    chosen = least.select(F.col("at.did").alias("_did"), F.col("at.th").alias("_th")).unionByName(found.filter("n = 0").select(F.col("did").alias("_did"), F.col("th").alias("_th")).distinct())
    needed = ["doc_id", "text"]
    keyed = packed(docs, needed).withColumn("_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("_th", F.xxhash64("text"))
    return unpacked(keyed.join(chosen, ["_did", "_th"], "left_semi").dropDuplicates(["_did", "_th"]), docs.columns, needed)


#: The same by a plain self-join of shingles and a transitive closure; for small tables.
ORACLE_SQL = r"""
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select r, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end)) as g from w),
n as (select r, count(*) as n from s group by r),
p as (select a.r as a, b.r as b, count(*) as k from s a join s b on a.g = b.g and a.r < b.r group by 1, 2),
l as (select a, b from p join n x on p.a = x.r join n y on p.b = y.r where 100 * k >= 90 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
reach as (select r as a, r as b from w union select reach.a, e.b from reach join e on reach.b = e.a),
c as (select reach.a as r, min(w.doc_id) as component_id from reach join w on reach.b = w.r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from w join c on w.r = c.r left join n on w.r = n.r
"""
