"""Toxicity by a counterfactually regularised classifier (operator 7).

A logistic model over the words of a document (present or not, so that length does not matter)
is trained on at most ``SAMPLE_DOCS`` labelled rows, those of least hash, with an L1 penalty, which leaves the words that tell.
Each training document that has an identity term is also read with the term swapped for others,
and the squared change of its logit is added to the loss, so neutral mentions of a group do not
raise the score. Rows held out (crc32 of doc_id modulo 4 is 2) are never learnt from; nothing but the text enters a score.

Defined cases: null or empty text scores as a text without known words; a null doc_id is not held
out; repeated labels of a document count as rows, and so do repeated documents; a text over ``SAMPLE_CHARS`` code points isn't learnt from, but any is scored whole;
without labels of both kinds every score is the smoothed share of label 1; ties in the order of the sample fall to doc_id, label and
the text's hash; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, map_arrow, tune
from .decontam import FOLD

#: Most labelled rows that training reads, the code points of the longest of them, and the fewest rows a word must stand in.
SAMPLE_DOCS = 20_000
SAMPLE_CHARS = 200_000
LEAST_DOCS = 5
L1, RIDGE, COUNTERFACTUAL, ROUNDS = 1.5e-3, 1e-4, 5.0, 300
THRESHOLD = 0.3
CACHE = 500_000
#: Identity terms in English, German, French and Spanish, swapped within a row. Fixed values.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("behinderte", "blinde", "gehörlose", "autisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("handicapés", "aveugles", "sourds", "autistes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("discapacitados", "ciegos", "sordos", "autistas"),
)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def words_of(text: bytes | None) -> set[bytes]:
    return set(text.translate(FOLD).split()) if text else set()


@lru_cache(maxsize=1)
def swaps() -> dict[int, list[int]]:
    """Hash of each identity term to those of the others in its row."""
    out: dict[int, list[int]] = {}
    for row in ([word_hash(w.encode()) for w in row] for row in IDENTITIES):
        for h in row:
            out.setdefault(h, []).extend(o for o in row if o != h and o not in out.get(h, ()))
    return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, list[int]]]:
    """(label, word hashes) of the training documents."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y")).filter(~held_out())
    order = [F.xxhash64("doc_id"), "doc_id", "y"]
    chosen = usable.orderBy(*order).limit(SAMPLE_DOCS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            words = [sorted(map(word_hash, words_of(t))) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words, pa.list_(pa.int64()))], names=["y", "words"])

    # at most SAMPLE_DOCS ids; where documents repeat, at most so many rows again
    texts = docs.filter(F.coalesce(F.char_length("text"), F.lit(0)) <= SAMPLE_CHARS).select("doc_id", "text")
    met = texts.join(F.broadcast(chosen), "doc_id").orderBy(*order, F.xxhash64("text")).limit(SAMPLE_DOCS)
    table = map_arrow(met.select("text", "y"), run, "y int, words array<long>").toArrow()
    return [(y, w) for y, w in zip(table.column("y").to_pylist(), table.column("words").combine_chunks(), strict=True)] if table.num_rows else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list) -> tuple[float, dict[int, float]]:
    """The intercept, and the weights that are not 0 by word hash."""
    y = np.array([r[0] for r in rows], float)
    positive = float(y.sum())
    prior = math.log((positive + 1) / (len(y) - positive + 9))
    if not len(y) or positive in (0, len(y)):
        return prior, {}
    lists = [np.asarray(r[1].values if hasattr(r[1], "values") else r[1], np.int64) for r in rows]
    order = np.lexsort(([int(x.sum() & 0x7FFFFFFF) for x in lists], y))
    lists, y = [lists[i] for i in order], y[order]
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists)
    vocab, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    terms = swaps()
    kept = (counts >= LEAST_DOCS) | np.isin(vocab, list(terms))
    number = np.cumsum(kept) - 1
    of = np.repeat(np.arange(len(y)), sizes)
    live = kept[inverse]
    of, column = of[live], number[inverse[live]]
    vocab = vocab[kept]
    if not len(vocab):
        return prior, {}
    # pairs (a, b): a document with the identity term a is read with b instead; the score changes by w[b] - w[a]
    place = {int(h): i for i, h in enumerate(vocab.tolist())}
    seen = {h: n for h, n in zip(vocab.tolist(), np.bincount(column, minlength=len(vocab)).tolist(), strict=True)}
    pairs = np.array([(place[a], place.get(b, -1), seen[a]) for a in terms if a in place for b in terms[a]], np.int64).reshape(-1, 3)
    n, w, bias = len(y), np.zeros(len(vocab) + 1), prior  # the last weight stands for terms that no document has; it stays 0
    v, vb, t = w.copy(), bias, 1.0
    # step size from a bound of the curvature: the largest eigenvalue of X'X / 4n by power iteration
    u = np.ones(len(vocab)) / math.sqrt(len(vocab))
    top = 1.0
    for _ in range(8):
        z = np.bincount(of, u[column], n)
        u = np.bincount(column, z[of], len(vocab))
        top = float(np.linalg.norm(u)) or 1.0
        u /= top
    step = 1 / (top / (4 * n) * 1.2 + 0.25 + 4 * COUNTERFACTUAL * (pairs[:, 2].sum() / n if len(pairs) else 0))
    for _ in range(ROUNDS):
        residual = (sigmoid(np.bincount(of, v[column], n) + vb) - y) / n
        slope = np.append(np.bincount(column, residual[of], len(vocab)), 0.0)
        if len(pairs):
            change = 2 * COUNTERFACTUAL * (v[pairs[:, 1]] - v[pairs[:, 0]]) * pairs[:, 2] / n
            np.add.at(slope, pairs[:, 1], change)
            np.add.at(slope, pairs[:, 0], -change)
            slope[-1] = 0
        new = v - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        nb = vb - step * float(residual.sum())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    # the penalty chose the words; Newton's method fits those alone, with little shrinkage
    on = np.flatnonzero(w[:-1])
    if len(on):
        k = len(on)
        back = np.full(len(vocab), -1)
        back[on] = np.arange(k)
        inside = back[column] >= 0
        x = np.ones((n, k + 1), np.float32)
        x[:, :k] = 0
        x[of[inside], back[column[inside]]] = 1
        # swapped words as rows of differences, weighted by the share of documents they stand for
        local = {int(j): i for i, j in enumerate(on)}
        ridge = np.diag(np.append(np.full(k, RIDGE), 1e-9))
        for a, b, c in pairs.tolist():
            d = np.zeros(k + 1)
            for j, sign in ((a, -1.0), (b, 1.0)):
                if j in local:
                    d[local[j]] += sign
            ridge += 2 * COUNTERFACTUAL * c / n * np.outer(d, d)
        fit = np.append(w[on], bias)
        for _ in range(30):
            p = sigmoid(x @ fit)
            hessian = (x * (p * (1 - p) / n)[:, None]).T @ x + ridge
            move = np.linalg.solve(hessian, x.T @ ((p - y) / n) + ridge @ fit)
            fit = fit - move / max(1.0, float(np.abs(move).max()) / 2)
        w[on], bias = fit[:k], float(fit[k])
    return bias, {int(vocab[i]): float(w[i]) for i in on}


class Weights(dict):
    """Weight of a word, remembered by its bytes; emptied when full."""

    def __init__(self, known: dict[int, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = self.known.get(word_hash(word), 0.0)
        return value


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(train(sample(docs, labels)))
    scored = docs.select("doc_id", held_out().alias("held_out"), "text")
    fields = [scored.schema["doc_id"], scored.schema["held_out"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, known = shared.value
        weights = Weights(known)
        for batch in it:
            sums = np.array([math.fsum(map(weights.__getitem__, words_of(t))) for t in as_bytes(batch.column(2))], float)
            score = sigmoid(sums + bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[f.name for f in fields])

    return map_arrow(scored, run, T.StructType(fields))
