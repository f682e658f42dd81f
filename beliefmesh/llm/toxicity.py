"""Toxicity: a logistic classifier on the words of a text, trained with counterfactuals.

Labelled sentences are taken in pairs that differ in one identity term: where a sentence mentions a group, its term is
swapped for another of the same list; where it mentions none, two terms of a list are placed in it in turn. A bare
mention, without other words, is a pair of each such sentence too. `penalty` times the mean square of the change in
*score* within a pair is added to the loss, so that neutral mentions of any group score alike. Features are the presence
of the `n_words` words that tell the classes apart best, scaled by their log odds ratio; the rarer class weighs more, up
to `boost` times.

Learns from a bounded sample of labelled documents (`sample_docs` smallest hashes of the id; held-out ids never) and of
`n_swaps` of their sentences (smallest hashes); the driver gets feature numbers of the sample, at most sample_docs *
n_words, and counts for the vocabulary. Scores are of all words of whole texts.

Defined cases: null and empty texts get the score of a text without known words; a very long text is one set of words;
without labels every score is 0; a null id counts as held out; repeated rows score alike, ties among words go by the
word; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmesh.llm.common import bounded_sample, held_out, lean, materialise, pick, small_batches

SAMPLE_DOCS = 8000
N_WORDS = 1500
N_SWAPS = 4000
LONGEST = 40  # words of a sentence; longer ones are cut
# fixed values: identity terms whose mention must not by itself move a score; those of a list stand for each other
IDENTITY = [
    ["women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "lesbians", "gays"],
    ["muslim", "christian", "jewish", "hindu", "black", "white", "asian", "arab", "gay", "lesbian", "transgender", "disabled", "elderly"],
    ["frauen", "männer", "muslime", "christen", "juden", "hindus", "flüchtlinge", "einwanderer", "schwarze", "schwule", "lesben", "behinderte"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "hindous", "réfugiés", "immigrés", "noirs", "arabes", "lesbiennes", "handicapés"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "hindúes", "refugiados", "inmigrantes", "negros", "árabes", "lesbianas", "discapacitados"],
]
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def pairs_of(text: str | None, identity: list[list[str]]) -> list[tuple[int, list[str], str, str]]:
    """(hash, other words, term, other term) of every sentence of the text; the hash decides what is placed or swapped."""
    out = []
    for sentence in SENTENCE.split((text or "").lower()):
        words = WORD.findall(sentence)
        for at in range(0, len(words), LONGEST):
            own = set(words[at : at + LONGEST])
            h = zlib.crc32(" ".join(words[at : at + LONGEST]).encode())
            mentioned = [(t, terms) for terms in identity for t in terms if t in own]
            terms = identity[h % len(identity)]
            if not mentioned:
                mentioned = [(terms[h // 16 % len(terms)], terms)]
            for a, terms in mentioned:
                others = [t for t in terms if t != a and t not in own]
                if others:
                    out.append((h, sorted(own - {a}), a, others[h // 256 % len(others)]))
    return out


def extract(rows: DataFrame, identity: list[list[str]]) -> DataFrame:
    """Of each labelled text its words and, of its sentences, the two pairs of the smallest hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [sorted(pairs_of(t, identity))[:2] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "words": [sorted(words_of(t)) for t in b["text"]], "pairs": [[{"h": h, "rest": rest, "a": x, "b": y} for h, rest, x, y in p] for p in pairs]})

    return rows.mapInPandas(lean(run), "doc_id long, toxic int, words array<string>, pairs array<struct<h:long,rest:array<string>,a:string,b:string>>")


def objective(w: np.ndarray, b: float, x: np.ndarray, y: np.ndarray, rows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], scale: np.ndarray, penalty: float, l2: float) -> tuple[float, np.ndarray, float]:
    """Loss and its gradients by weights of the scaled features and by bias: logistic loss of the rows, ridge, and penalty
    times the mean squared change in score. pairs: scaled features of the other words, columns of the two terms."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p = sigmoid(x @ w + b)
    r = ((p - y) * rows).astype(x.dtype)
    loss = -float((rows * np.where(y > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum()) + l2 / 2 * float(w @ w)
    g, gb = x.T @ r + l2 * w, float(r.sum())
    rest, one, two = pairs
    if len(one) and penalty > 0:
        z = rest @ w + b
        s1, s2 = sigmoid(z + scale[one] * w[one]), sigmoid(z + scale[two] * w[two])
        loss += penalty * float(((s1 - s2) ** 2).mean())
        d1, d2 = (2 * penalty / len(one) * (s1 - s2) * s * (1 - s) * sign for s, sign in ((s1, 1), (s2, -1)))
        g = g + rest.T @ (d1 + d2).astype(x.dtype) + (np.bincount(one, d1 * scale[one], len(w)) + np.bincount(two, d2 * scale[two], len(w))).astype(x.dtype)
        gb += float((d1 + d2).sum())
    return loss, g, gb


def train(x: np.ndarray, y: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], scale: np.ndarray, penalty: float = 5.0, l2: float = 1e-4, steps: int = 600, boost: float = 4.0) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on `objective`. Weights of the unscaled features, and the bias."""
    n, k = x.shape
    x = x * scale
    pairs = (pairs[0] * scale, *pairs[1:])
    rows = np.where(y > 0, min(boost, (n - y.sum()) / max(1.0, y.sum())), 1.0).astype(np.float32)
    rows /= rows.sum()
    w, b, vw, vb = np.zeros(k, np.float32), 0.0, np.zeros(k, np.float32), 0.0
    # a bound of the curvature: a quarter of the mean squared norm for the loss, half of it for the squared differences
    bend = float((rows * ((x**2).sum(1) + 1)).sum()) / 4
    if len(pairs[1]) and penalty > 0:
        bend += penalty / 2 * float(((pairs[0] ** 2).sum(1) + 2).mean())
    rate = 0.75 / bend
    for _ in range(steps):
        _, g, gb = objective(w + 0.9 * vw, b + 0.9 * vb, x, y, rows, pairs, scale, penalty, l2)
        vw, vb = 0.9 * vw - rate * g, 0.9 * vb - rate * gb
        w, b = w + vw, b + vb
    return w * scale, b


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, n_words: int = N_WORDS, identity: list[list[str]] | list[str] = IDENTITY, penalty: float = 5.0, n_swaps: int = N_SWAPS) -> dict | None:
    """weights by word, bias, and swaps, the number of sentence pairs used. identity: lists of terms, or one list."""
    identity = [identity] if isinstance(identity[0], str) else identity
    terms = {t for group in identity for t in group}
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = materialise(bounded_sample(known, F.col("doc_id"), sample_docs))
    # at most sample_docs rows of two numbers: safe to broadcast at any input size
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = materialise(extract(texts, identity))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return None
    by_word = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("c1"), F.count(F.lit(1)).cast("double").alias("c"))
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1.0), (F.col("c") - F.col("c1") + 0.5) / (n0 + 1.0)
    spread = F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c") - F.col("c1") + 0.5))
    best = by_word.where("c >= 3").withColumn("z", F.abs(F.log(p1 / p0)) / spread).orderBy(F.desc("z"), "word").limit(n_words)
    odds = {r["word"]: float(r["odds"]) for r in best.select("word", F.abs(F.log(p1 / p0)).alias("odds")).collect()}
    vocabulary = sorted({*odds, *terms})
    # identity terms keep scale 1, so that the penalty draws together plain weights
    scale = np.array([1.0 if v in terms else min(4.0, odds[v]) for v in vocabulary], np.float32)
    column = {w: i for i, w in enumerate(vocabulary)}

    known = lambda words: [column[w] for w in words if w in column]

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "at": [known(ws) for ws in b["words"]]})

    def swaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"at": [known(ws) for ws in b["rest"]], "one": b["a"].map(column), "two": b["b"].map(column)})

    got = rows.mapInPandas(lean(numbers), "doc_id long, toxic int, at array<int>").toPandas().sort_values("doc_id", kind="stable")
    chosen = rows.select(F.explode("pairs").alias("p")).select("p.*").distinct().orderBy("h", "a", "b", "rest").limit(n_swaps // 2)
    pairs = chosen.coalesce(1).mapInPandas(lean(swaps), "at array<int>, one int, two int").toPandas()

    def matrix(lists: list, more: int = 0) -> np.ndarray:
        out = np.zeros((len(lists) + more, len(vocabulary)), np.float32)
        for i, at in enumerate(lists):
            out[i, np.asarray(at, int)] = 1
        return out

    # each sentence's pair, then the bare mention of the same two terms
    one, two = (np.tile(pairs[c].to_numpy(np.int64), 2) for c in ("one", "two"))
    w, b = train(matrix(list(got["at"])), got["toxic"].to_numpy(np.float32), (matrix(list(pairs["at"]), len(pairs)), one, two), scale, penalty)
    return {"weights": {v: float(w[i]) for v, i in column.items() if w[i] != 0}, "bias": float(b), "swaps": len(one)}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = (model or {}).get("weights", {})
        known, bias = frozenset(weights), (model or {}).get("bias", -np.inf)
        for b in batches:
            z = np.array([bias + sum(map(weights.__getitem__, sorted(known & words_of(t)))) for t in b["text"]], np.float64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -500, 500))) if model else np.zeros(len(b))})

    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInPandas(lean(run), "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    s = score(docs, fit(docs, labels, sample_docs))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
