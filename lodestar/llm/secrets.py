"""Secret scans over a trigram inverted index (operator 4).

From each rule's regular expression a Boolean query over trigrams is derived that every match
must satisfy: literal stretches give conjunctions, alternatives give disjunctions. Each shard of
documents (one Arrow batch) gets an inverted index from the trigrams of those queries to bitmaps of documents;
the queries are answered by intersecting and uniting postings, and the regular expression runs
over the candidates only. Rules without a mandatory trigram run over every text. Index and
queries are folded to lower-case ASCII, which can only add candidates.

Defined cases: null text is empty and has no spans; spans are in code points, end exclusive; spans of equal start go in the order of the rules;
repeated rows are scanned each; texts and secrets may be of any length; other columns, whatever their names, are ignored or, by ``redact``,
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, map_arrow, tune

#: Most strings that a literal stretch may stand for before it is cut.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def _either(word: str) -> str:
    """``word`` with its ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')}"
#: The base rules, in the order of their kinds.
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
_KEY = "(?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"
#: Further formats of keys. Public prefixes of well-known issuers.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live", "[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    # From the start of a run of its letters and at the first eyJ there, so that long runs are read once.
    Rule("webtoken", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}"),
    # To the END line, or else over the headers and base64 lines that follow.
    Rule("private", rf"-----BEGIN {_KEY}(?:(?:[^-]|-(?!----))*+-----END {_KEY}|(?:\r?\n[A-Za-z-]+:\x20[^\r\n]*)*(?:\r?\n(?=\r?\n))?(?:\r?\n[A-Za-z0-9+/=]+(?=\r?\n|\Z))*)"),
)
RULES = BASE + MORE

# A query is True (no condition), an int (a trigram), or ("and" | "or", frozenset of queries).
Query = bool | int | tuple


def both(*parts: Query) -> Query:
    flat: set[Query] = set()
    for p in parts:
        if isinstance(p, tuple) and p[0] == "and":
            flat |= p[1]
        elif p is not True:
            flat.add(p)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def either(*parts: Query) -> Query:
    if any(p is True for p in parts):
        return True
    flat: set[Query] = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def trigrams(text: str) -> Query:
    b = text.encode()
    return both(*(b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)))


def of_strings(strings: set[str]) -> Query:
    return either(*map(trigrams, strings)) if strings else True


def fold(c: str) -> str:
    return c.lower() if c.isascii() else c


def class_letters(items: list) -> set[str] | None:
    """The folded letters of a class, or None if they are many or not listed."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(fold(chr(value)))
        elif op is C.RANGE and value[1] - value[0] < 4:
            out |= {fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def analyse(nodes) -> tuple[set[str] | None, Query]:
    """(all strings it can match, if few; what any match must contain) of a parsed expression."""
    whole, strings, need = True, {""}, True
    for op, value in nodes:
        exact, must = _node(op, value)
        if exact is not None and len(strings) * len(exact) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in exact}
            continue
        whole = False
        need = both(need, of_strings(strings), must)
        strings = exact if exact is not None else {""}
    return (strings, need) if whole else (None, both(need, of_strings(strings)))


def _node(op, value) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {fold(chr(value))}, True
    if op is C.IN:
        return class_letters(value), True
    if op is C.SUBPATTERN:
        return analyse(value[3])
    if op is C.BRANCH:
        found = [analyse(x) for x in value[1]]
        if all(e is not None for e, _ in found) and len(joined := set().union(*(e for e, _ in found))) <= MAX_STRINGS:
            return joined, True
        return None, either(*(both(q, of_strings(e) if e is not None else True) for e, q in found))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        exact, must = analyse(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, True
        if low == high == 1:
            return exact, must
        return None, both(must, of_strings(exact) if exact is not None else True) if low else True
    if op is C.AT:
        return {""}, True
    return None, True  # any character, negated literals, assertions, references: no condition


def query_of(pattern: str) -> Query:
    exact, must = analyse(_parser.parse(pattern))
    return both(must, of_strings(exact)) if exact is not None else must


def letters_of(query: Query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(letters_of, query[1]))


class Index:
    """Postings (bitmaps of documents) of the trigrams in ``wanted`` over one shard."""

    def __init__(self, texts: list[bytes | None], wanted: np.ndarray, table: np.ndarray):
        joined = np.frombuffer(b"\0\0\0".join(t or b"" for t in texts).lower(), np.uint8)
        self.n = len(texts)
        self.postings = np.zeros((len(wanted), self.n), bool)
        self.row = {int(w): i for i, w in enumerate(wanted)}
        if len(joined) >= 3:
            codes = joined[:-2].astype(np.int32) << 16
            codes |= joined[1:-1].astype(np.int32) << 8
            codes |= joined[2:]
            at = np.flatnonzero(table[codes])
            starts = np.cumsum([0] + [len(t or b"") + 3 for t in texts[:-1]])
            self.postings[np.searchsorted(wanted, codes[at]), np.searchsorted(starts, at, "right") - 1] = True

    def answer(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, int):
            return self.postings[self.row[query]]
        parts = [self.answer(q) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), query_of(r.pattern)) for r in rules]
        self.wanted = np.array(sorted(set().union(*(letters_of(q) for _, _, q in self.rules))), np.int32)
        self.table = np.zeros(1 << 24, bool)
        self.table[self.wanted] = True

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end) in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        index, decoded = Index(texts, self.wanted, self.table), {}
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in np.flatnonzero(index.answer(query)).tolist():
                if not texts[i]:
                    continue
                if i not in decoded:
                    decoded[i] = texts[i].decode()
                for m in pattern.finditer(decoded[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def joined(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def map_spans(docs: DataFrame, rules: tuple[Rule, ...], fields: list[T.StructField], make: Callable) -> DataFrame:
    """``docs`` scanned; ``make(batch, spans)`` gives the columns of the result."""
    tune(docs.sparkSession)
    at, names = docs.columns.index("text"), [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in it:
            yield pa.RecordBatch.from_arrays(make(batch, scanner.scan(as_bytes(batch.column(at)))), names=names)

    return map_arrow(docs, run, T.StructType(fields))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans."""
    docs, kinds = docs.select("doc_id", "text"), [r.kind for r in rules]

    def make(batch: pa.RecordBatch, found: list) -> list[pa.Array]:
        base = [[s for s in spans if s[1] < len(BASE)] for spans in found]
        counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(len(BASE))]
        digests = [hashlib.sha256(joined(spans, kinds).encode()).hexdigest() for spans in base]
        return [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(s, kinds) for s in found], pa.string())]

    fields = [docs.schema["doc_id"], *(T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return map_spans(docs, rules, fields, make)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of secrets in the texts replaced by ``mark``."""
    at = docs.columns.index("text")

    def make(batch: pa.RecordBatch, found: list) -> list[pa.Array]:
        columns = list(batch.columns)
        if any(found):
            columns[at] = pa.array([replaced(t, s, mark) if s else t for t, s in zip(columns[at].to_pylist(), found, strict=True)], columns[at].type)
        return columns

    return map_spans(docs, rules, docs.schema.fields, make)


def replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, last = [], 0
    for a, _, b in spans:
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]])
