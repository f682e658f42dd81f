"""Language identification by a byte convolutional network, trained here in numpy on labelled text.

The network reads windows of 256 bytes of UTF-8: filters of 2, 3 and 4 bytes (on one-hot bytes, hence tables of 256
rows), ReLU, max pooling over the window, softmax over the languages. A document's score is the softmax of its windows'
mean log-probability, weighted by their bytes; all of its windows count.

Training takes `sample_docs` labelled documents (the smallest hashes of the id; held-out ids never) and `windows` places
in each, also by hash, so the driver gets at most sample_docs * windows * 256 characters.

Defined cases: null text, or one without any letter, gives `und` with score 0; without any labelled text all is `und`;
a null id counts as held out; repeated rows are scored alike; a very long text is scored by all its windows; ties between
languages go to the first by name; an empty table gives an empty result; other columns, also ones called `score` or
`lang_pred`, are ignored by `predict` and kept by `accept`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmesh.llm.common import bounded_sample, held_out, lean, pick, small_batches

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_DOCS = 4000
UND = "und"


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (zero-padded), the text each belongs to, and its number of bytes."""
    parts, owner, size = [], [], []
    for i, b in enumerate(texts):
        n = max(1, -(-len(b) // LENGTH))
        parts.append(b.ljust(n * LENGTH, b"\0"))
        owner += [i] * n
        size += [LENGTH] * (n - 1) + [max(1, len(b) - (n - 1) * LENGTH)]
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, LENGTH), np.array(owner), np.array(size, np.float64)


def train(texts: list[bytes], langs: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> dict | None:
    """Adam on softmax cross-entropy; gradients flow through the pooled positions only."""
    if not texts:
        return None
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    x = np.frombuffer(b"".join(t[:LENGTH].ljust(LENGTH, b"\0") for t in texts), np.uint8).reshape(-1, LENGTH)
    rng = np.random.default_rng(seed)
    shapes = {f"t{w}": (w, 256, FILTERS) for w in WIDTHS} | {f"b{w}": (FILTERS,) for w in WIDTHS} | {"out": (FILTERS * len(WIDTHS), len(names)), "bias": (len(names),)}
    p = {k: (rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s)) for k, s in shapes.items()}
    m, v, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    columns = np.arange(FILTERS)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xb, pooled, where = x[at], [], []
            for w in WIDTHS:
                n = LENGTH - w + 1
                conv = sum(p[f"t{w}"][k].astype(np.float32)[xb[:, k : k + n]] for k in range(w))
                top = conv.argmax(1)
                where.append(top)
                pooled.append(np.take_along_axis(conv, top[:, None, :], 1)[:, 0, :] + p[f"b{w}"])
            raw = np.concatenate(pooled, 1)
            h = np.maximum(raw, 0)
            z = h @ p["out"] + p["bias"]
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(at)), y[at]] -= 1
            dz = prob / len(at)
            g = {"out": h.T @ dz + 1e-4 * p["out"], "bias": dz.sum(0)}
            dh = (dz @ p["out"].T) * (raw > 0)
            for j, w in enumerate(WIDTHS):
                d = dh[:, j * FILTERS : (j + 1) * FILTERS]
                g[f"b{w}"] = d.sum(0)
                g[f"t{w}"] = np.stack([np.bincount((np.take_along_axis(xb, where[j] + k, 1).astype(np.int64) * FILTERS + columns).ravel(), d.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(w)])
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {"names": names, **{k: a.astype(np.float32) for k, a in p.items()}}


class Network:
    """Inference: tables over byte pairs hold the sums of two filter rows, so a position costs three look-ups."""

    def __init__(self, model: dict):
        self.names, self.out, self.bias = model["names"], model["out"], model["bias"]
        t2, t3, t4 = (model[f"t{w}"] for w in WIDTHS)
        two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.first = np.ascontiguousarray(np.concatenate([two(t2[0], t2[1]), two(t3[0], t3[1]), two(t4[0], t4[1])], 1))
        self.third, self.last = t3[2], two(t4[2], t4[3])
        self.add = np.concatenate([model[f"b{w}"] for w in WIDTHS])

    def log_probs(self, windows: np.ndarray, step: int = 64) -> np.ndarray:
        found = np.empty((len(windows), 3 * FILTERS), np.float32)
        for i in range(0, len(windows), step):
            x = windows[i : i + step].astype(np.uint16)
            pair = (x[:, :-1] << 8) | x[:, 1:]
            a = self.first.take(pair, axis=0)
            a[:, :-1, FILTERS : 2 * FILTERS] += self.third.take(x[:, 2:], axis=0)
            a[:, :-2, 2 * FILTERS :] += self.last.take(pair[:, 2:], axis=0)
            a[:, -1, FILTERS : 2 * FILTERS] = -np.inf
            a[:, -2:, 2 * FILTERS :] = -np.inf
            found[i : i + step] = a.max(1)
        z = np.maximum(found + self.add, 0) @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and number of windows of each text."""
        windows, owner, size = windows_of(texts)
        logs = self.log_probs(windows) * size[:, None]
        sums = np.stack([np.bincount(owner, logs[:, j], len(texts)) for j in range(len(self.names))], 1) / np.bincount(owner, size, len(texts))[:, None]
        e = np.exp(sums - sums.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        return e.argmax(1), e.max(1), np.bincount(owner, minlength=len(texts))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = 2) -> dict | None:
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    room = F.greatest(F.lit(1), F.length("text") - LENGTH + 2)
    places = F.array(*[F.expr("text").substr((F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1).cast("int"), F.lit(LENGTH)) for k in range(windows)])
    got = bounded_sample(labelled.select("doc_id", "lang", places.alias("places")), F.col("doc_id"), sample_docs, of=docs).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    rows = [(t.encode()[:LENGTH], lang) for lang, places in zip(got["lang"], got["places"], strict=True) for t in dict.fromkeys(places) if re.search(r"[^\W\d_]", t)]
    return train([t for t, _ in rows], [x for _, x in rows])


def identify(docs: DataFrame, model: dict | None, keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns of docs (default doc_id), then lang_pred, score and n_windows. Inputs are the texts alone."""
    keep = keep or ["doc_id"]
    carried = [c for c in keep if c != "text"]
    letter = re.compile(r"[^\W\d_]")
    step = 256

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(model) if model else None
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.iloc[at : at + step]
                lang, value, count = np.full(len(b), UND, object), np.zeros(len(b)), np.zeros(len(b), np.int64)
                texts = b["text"].tolist()
                some = [i for i, t in enumerate(texts) if net and t is not None and letter.search(t)]
                if some:
                    k, p, n = net.score([texts[i].encode() for i in some])
                    lang[some], value[some], count[some] = np.array(net.names, object)[k], p, n
                yield b[keep].assign(lang_pred=lang, score=value, n_windows=count)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, n_windows long"
    small_batches(docs.sparkSession)
    return pick(docs, *carried, "text").mapInPandas(lean(score), schema)


def predict(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_windows of every document."""
    got = identify(docs, fit(docs, sample_docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("score").cast("double").alias("score"), "n_windows")


def accept(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents with a language: not `und`, and a score of at least `least`."""
    columns = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"__{i}") for i, c in enumerate(columns)])
    got = identify(flat, fit(docs), flat.columns)
    kept = got.where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return kept.select(*[F.col(x).alias(c) for x, c in zip(flat.columns, columns, strict=True)])
