"""Personal data by a skip-chain conditional random field (operator 8).

The base rules find e-mail and IP addresses, cards and phone numbers. The field then labels the
*candidate tokens* of a document: space-separated tokens with a digit or ``@``. Its potentials are
a score of the shape features of each token and its neighbours, a transition for candidates that stand next to each other, a
skip potential between a candidate and the one before it with the same core (equal but for case, punctuation and
digits' separators), and another between similar ones (the same last seven digits, or the same domain), which make distant repetitions agree.
Marginals come from loopy sum-product message passing; runs of tokens labelled alike with a marginal of at least
``CERTAIN`` are added as spans where no base span is. Base spans always stay.

The field is trained here on what the base rules mark (distant supervision) in at most ``SAMPLE_DOCS`` documents of at most
``SAMPLE_CHARS`` code points, those of least hash. Weights start from independent estimates, a softmax regression and log ratios of
how often labels meet to how often they would by chance; ``STEPS`` steps then follow the gradient of the field's own likelihood: counts
expected given the sample's labels less those expected without them, both from message passing, with all potentials moving together. A candidate that
the base rules leave but that repeats or resembles one they mark has no known label; it is left open. Every document is labelled, whole.

Defined cases: null text is empty and has no spans; spans are in code points, end exclusive;
repeated rows are labelled each; texts and tokens may be of any length; of two labels with the same marginal the first counts; other columns, whatever
their names, are ignored; an empty table gives an empty result; a sample without personal data adds no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, tune

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Most documents that are trained on, and the code points of the longest of them.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 50_000
STEPS, RATE, RIDGE = 20, 0.5, 1e-4
CERTAIN = 0.95
#: Pseudo-counts of the pairwise potentials: meetings by chance, and repetitions that agree.
CHANCE, AGREEING = 5.0, 200.0
ROUNDS = 10

_HAS = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WHITE = frozenset(" \t\n\v\f\r")
#: A token from its first digit or ``@`` on; what stands before is found by stepping back, so each character is read once.
_TAIL = re.compile(r"[0-9@][^\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """An address can only stand around an ``@``, so each is looked at once: linear on any text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in order."""
    if not _HAS.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    # a run of digits that fails from its start fails from within, as what follows it is the same
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def _bucket(n: int) -> int:
    return n if n < 5 else 5 + (n > 6) + (n > 9) + (n > 11) + (n > 15) + (n > 19)


_DOTTED = re.compile(r"\d{1,3}(\.\d{1,3}){3}")
_MAILISH = re.compile(r"[^@]+@[^@]+\.[^@]+")
N_FEATURES = 96


def shape(core: str) -> list[int]:
    """Numbers of the binary features, below 40, of one candidate without its outer punctuation."""
    d = digits_of(core)
    f = [_bucket(len(d))]
    flags = ("@" in core, bool(_MAILISH.fullmatch(core)), "." in core, bool(_DOTTED.fullmatch(core)), core.startswith("+"), "(" in core, "-" in core, len(d) == len(core), len(d) >= 12 and luhn(d), any("a" <= c <= "f" for c in core), any(c.isalpha() for c in core), len(core) > 20, ":" in core, "=" in core)
    f += [12 + i for i, x in enumerate(flags) if x]
    return f


_EDGE = "#*$%&|<>!?,;:\"'[]{}…"


def candidates(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[bool], list[str]]:
    """Extents without outer punctuation, features, whether each stands right after the one before, and cores for comparison."""
    at, cores, follows, last, done = [], [], [], -2, 0
    for m in _TAIL.finditer(text):
        begin = m.start()
        while begin > done and text[begin - 1] not in _WHITE:
            begin -= 1
        done = m.end()
        raw = text[begin:done]
        a = begin + len(raw) - len(raw.lstrip(_EDGE))
        core = raw.strip(_EDGE).rstrip(".")
        if not core:
            continue
        at.append((a, a + len(core)))
        cores.append(core)
        follows.append(last >= 0 and begin - last == 1)
        last = done
    shapes = [shape(c) for c in cores]
    features = []
    for i, f in enumerate(shapes):
        near = [40 + x for x in shapes[i - 1] if x < 28] if follows[i] else [94]
        near += [68 + x for x in shapes[i + 1] if x < 26] if i + 1 < len(shapes) and follows[i + 1] else [95]
        features.append(f + near)
    return at, features, follows, ["".join(c for c in x.lower() if c.isalnum() or c in "@.") for x in cores]


#: Kinds of edges: neighbours, equal cores, similar cores.
CHAIN, SAME, SIMILAR = range(3)


def similar(core: str) -> str:
    """What similar cores have in common: the domain of an address, or the last seven digits; empty if there is none."""
    if "@" in core:
        return core[core.rindex("@") :]
    digits = digits_of(core)
    return digits[-7:] if len(digits) >= 7 else ""


def edges_of(follows: list[bool], cores: list[str]) -> list[tuple[int, int, int]]:
    """(from, to, kind): neighbours, and each candidate with the last one before that has the same core, or else a similar one."""
    out = [(i - 1, i, CHAIN) for i in range(1, len(follows)) if follows[i]]
    seen: dict[str, int] = {}
    like: dict[str, int] = {}
    for i, core in enumerate(cores):
        plain, near = core.replace(".", ""), similar(core)
        if plain in seen and len(plain) > 2:
            out.append((seen[plain], i, SAME))
        elif near and near in like:
            out.append((like[near], i, SIMILAR))
        seen[plain] = i
        if near:
            like[near] = i
    return out


def truth(at: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The label that the base spans give each candidate; both lists are in order of their starts."""
    out = [0] * len(at)
    for begin, kind, end in spans:
        low, high = 0, len(at)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if at[middle][1] <= begin else (low, middle)
        while low < len(at) and at[low][0] < end:
            out[low] = kind + 1
            low += 1
    return out


class Model:
    """unary: features x labels; pairwise: for each kind of edge the log potentials of two labels."""

    def __init__(self, unary: np.ndarray, pairwise: np.ndarray):
        self.unary, self.pairwise = unary, pairwise

    def scores(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.unary[flat], starts, axis=0)

    def beliefs(self, score: np.ndarray, edges: np.ndarray, joint: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Marginals of the candidates after ROUNDS rounds of messages, and if asked those of the edges."""
        n, k = len(edges), score.shape[1]
        if not n:
            return softmax(score), np.zeros((0, k, k)) if joint else None
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        forward = self.pairwise[edges[:, 2]]
        potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(n) + n, np.arange(n)])
        messages = np.zeros((2 * n, k))

        def gathered() -> np.ndarray:
            belief = score.copy()
            for label in range(k):
                belief[:, label] += np.bincount(target, messages[:, label], len(score))
            return belief

        for _ in range(ROUNDS):
            new = logsum((gathered()[source] - messages[back])[:, :, None] + potential)
            messages = 0.5 * messages + 0.5 * (new - new.max(axis=1, keepdims=True))
        belief = gathered()
        if not joint:
            return softmax(belief), None
        out = belief[source] - messages[back]
        pairs = out[:n, :, None] + forward + out[n:, None, :]
        return softmax(belief), softmax(pairs.reshape(n, k * k)).reshape(n, k, k)

    def marginals(self, features: list[list[int]], follows: list[bool], cores: list[str]) -> np.ndarray:
        flat, starts = flattened(features)
        return self.beliefs(self.scores(flat, starts), np.array(edges_of(follows, cores), np.int64).reshape(-1, 3))[0]


def flattened(features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(f) for f in features])
    return np.concatenate([np.asarray(f) for f in features]), np.concatenate([[0], ends[:-1]])


def logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sampled(docs: DataFrame) -> list[tuple[list[list[int]], list[int], list[tuple[int, int, int]]]]:
    """(features, labels, edges) of the sample's documents that have candidates."""
    some = docs.filter(F.col("doc_id").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS))
    ids = some.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("_h")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or not _HAS.search(text):
                    continue
                at, features, follows, cores = candidates(text)
                if at:
                    rows.append((str(doc), features, truth(at, base_spans(text)), [list(e) for e in edges_of(follows, cores)]))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            nested = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), nested, pa.list_(pa.int32()), nested), strict=True)], names=["d", "f", "y", "e"])

    # one text for each of at most SAMPLE_DOCS ids, none of them long
    chosen = some.withColumn("_h", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id"])
    rows = map_arrow(chosen.select("doc_id", "text"), run, "d string, f array<array<int>>, y array<int>, e array<array<int>>").collect()
    return [(r.f, r.y, [tuple(e) for e in r.e]) for r in sorted(rows, key=lambda r: r.d)]


def train(docs: list[tuple[list[list[int]], list[int], list[tuple[int, int, int]]]]) -> Model:
    features, y, edges, k = [], [], [], len(LABELS)
    for f, labels, own in docs:
        edges += [(a + len(features), b + len(features), kind) for a, b, kind in own]
        features += f
        y += labels
    if not any(y):
        unary = np.zeros((N_FEATURES, k))
        unary[:, 0] = 10
        return Model(unary, np.zeros((3, k, k)))
    flat, starts = flattened(features)
    label, pairs = np.array(y), np.array(edges, np.int64).reshape(-1, 3)
    distant = pairs[pairs[:, 2] != CHAIN]
    known = np.ones(len(y), bool)
    for a, b in ((0, 1), (1, 0)):
        known[distant[(label[distant[:, a]] > 0) & (label[distant[:, b]] == 0), b]] = False
    held = np.where(known[:, None] & (np.eye(k)[label] == 0), -1e6, 0.0)
    model = Model(independent([f for f, x in zip(features, known.tolist(), strict=True) if x], np.eye(k)[label[known]]), meetings(label, pairs, known))
    of = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(flat))))
    for _ in range(STEPS):
        score = model.scores(flat, starts)
        given, joint_given = model.beliefs(score + held, pairs, True)
        belief, joint = model.beliefs(score, pairs, True)
        off = (given - belief) / len(y)
        slope = np.stack([np.bincount(flat, off[of, label], N_FEATURES) for label in range(k)], axis=1)
        model.unary += RATE * (slope - RIDGE * model.unary)
        for kind in range(3):
            if len(mine := np.flatnonzero(pairs[:, 2] == kind)):
                model.pairwise[kind] += RATE * ((joint_given[mine] - joint[mine]).mean(axis=0) - RIDGE * model.pairwise[kind])
    return model


def independent(features: list[list[int]], truth: np.ndarray) -> np.ndarray:
    """Weights of a softmax regression on each candidate by itself."""
    x = np.zeros((len(features), N_FEATURES), bool)
    for i, f in enumerate(features):
        x[i, f] = True
    x, inverse = np.unique(x, axis=0, return_inverse=True)
    y, x = np.zeros((len(x), truth.shape[1])), x.astype(np.float32)
    np.add.at(y, inverse.ravel(), truth)
    weight, unary, speed = y.sum(axis=1, keepdims=True), np.zeros((N_FEATURES, truth.shape[1])), np.zeros((N_FEATURES, truth.shape[1]))
    for _ in range(400):
        speed = 0.9 * speed - 0.5 * (x.T @ (softmax(x @ unary) * weight - y) / weight.sum() + RIDGE * unary)
        unary += speed
    return unary


def meetings(label: np.ndarray, pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each kind of edge the log ratio of how often two known labels meet to how often they would by chance."""
    k = len(LABELS)
    prior = np.bincount(label[known], minlength=k).astype(float) + 1
    prior /= prior.sum()
    # chance meetings as pseudo-counts leave pairs without evidence neutral; equal labels of repetitions get a prior of their own
    chance, pairs = np.outer(prior, prior), pairs[known[pairs[:, 0]] & known[pairs[:, 1]]]
    out = []
    for kind, agreeing in ((CHAIN, 0.0), (SAME, AGREEING), (SIMILAR, AGREEING)):
        seen = CHANCE * chance + agreeing * np.diag(prior)
        mine = pairs[pairs[:, 2] == kind]
        np.add.at(seen, (label[mine[:, 0]], label[mine[:, 1]]), 1)
        out.append(np.log(seen / seen.sum() / chance).clip(-4, 4))
    return np.array(out)


def added(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Spans beyond the base ones."""
    at, features, follows, cores = candidates(text)
    if not at:
        return []
    taken = truth(at, base)
    if all(taken):
        return []
    p = model.marginals(features, follows, cores)
    label = np.where(p.max(axis=1) >= CERTAIN, p.argmax(axis=1), 0)
    out: list[tuple[int, int, int]] = []
    for i, (a, b) in enumerate(at):
        if not label[i] or taken[i]:
            continue
        kind = int(label[i]) - 1
        if out and i and follows[i] and out[-1][2] == at[i - 1][1] and out[-1][1] == kind:
            out[-1] = (out[-1][0], kind, b)
        else:
            out.append((a, kind, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    tune(spark)
    shared = spark.sparkContext.broadcast(train(sampled(docs)))
    fields = [docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    names = [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in it:
            found = [(t or "", base_spans(t or "")) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in spans) for _, spans in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for _, spans in found]
            every = [joined(sorted(spans + added(t, spans, model))) for t, spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(every, pa.string())], names=names)

    return map_arrow(docs, run, T.StructType(fields))
