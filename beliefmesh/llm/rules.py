"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Statistics of every whole text are computed on Python workers in one pass. From a bounded sample of labelled documents
(`sample_docs` smallest hashes of the id), rules for the low-quality class are grown on two thirds (the condition with
the best information gain is added until no good document is covered), pruned on the other third (conditions are
dropped from the end while (p - n) / (p + n) doesn't fall), and kept while precise enough. The ordered rules become one
Spark `CASE WHEN` over the statistics, so that the verdict is readable in the plan.

Defined cases: null or empty text has no words and fails the base rule; without labels the list is empty and only the
base rule rejects; null labels or ids aren't learned from; repeated rows are judged alike; a very long text is one row;
ties in learning go to the first statistic and cut; an empty table gives an empty result; other columns, also ones called
as a statistic, are ignored by `judge` and kept by `accept`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmesh.llm.common import bounded_sample, held_out, lean, materialise, pick, small_batches

SAMPLE_DOCS = 6000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbols_per_word", "dup_line_share", "repeat_share", "mean_word", "upper_share", "marks_per_word", "digit_share", "distinct_share", "letter_share", "words_per_line"]
WINDOW = 5
# fixed values: the word and symbol definitions of the contract
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"


def statistics(text: str | None) -> tuple:
    """BASE, then RATIOS."""
    words = WORD.findall(text or "")
    n = len(words)
    if not n:
        return (0,) * len(BASE) + (0.0,) * len(RATIOS)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    seen, lines, repeated = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            repeated += line in seen
            seen.add(line)
    again = 0
    if n > WINDOW:
        ids: dict[str, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
        distinct = len(ids)
        key = w[: n - WINDOW + 1].copy()
        for k in range(1, WINDOW):  # exact: each step numbers the distinct (prefix, next word) pairs anew
            key = key * distinct + w[k : n - WINDOW + 1 + k]
            if k < WINDOW - 1 and distinct > 6000:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.zeros(n + 1, np.int64)
        start = np.nonzero(count[inverse] > 1)[0]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + WINDOW, -1)
        again = int((hit.cumsum()[:n] > 0).sum())
    else:
        distinct = len(set(words))
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((a >= 65) & (a <= 90)).sum())
    letters = upper + int(((a >= 97) & (a <= 122)).sum()) + int((a >= 192).sum())
    marks = sum(map(text.count, "!?;:~^=+_"))
    digits = int(((a >= 48) & (a <= 57)).sum())
    return (n, chars, symbols, repeated, again, symbols / n, repeated / lines, again / n, chars / n, upper / max(1, letters), marks / n, digits / chars, distinct / n, letters / chars, n / lines)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [statistics(t) for t in b["text"]]
            values = dict(zip(BASE + RATIOS, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in BASE + RATIOS}
            yield b[keep].assign(**{c: np.array(v, np.int64 if c in BASE else np.float64) for c, v in values.items()})

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{c} long" for c in BASE] + [f"{c} double" for c in RATIOS])
    small_batches(docs.sparkSession)
    return pick(docs, *[c for c in keep if c != "text"], "text").mapInPandas(lean(run), schema)


Condition = tuple[str, str, float]


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for name, sign, at in rule:
        hit &= x[name] >= at if sign == ">=" else x[name] <= at
    return hit


def grow(x: dict[str, np.ndarray], y: np.ndarray, cuts: int = 24, longest: int = 4) -> list[Condition]:
    """Add the condition of most information gain until the rule covers no negative or nothing is gained."""
    rule, alive = [], np.ones(len(y), bool)
    while len(rule) < longest:
        p0, n0 = int((y & alive).sum()), int((~y & alive).sum())
        if not n0 or not p0:
            break
        best = (0.0, None)
        for name, v in x.items():
            inside = v[alive & y]
            for at in np.unique(np.quantile(inside, np.linspace(0, 1, cuts))):
                for sign in (">=", "<="):
                    hit = alive & (v >= at if sign == ">=" else v <= at)
                    p, n = int((hit & y).sum()), int((hit & ~y).sum())
                    if p and p + n < p0 + n0:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, sign, float(at)))
        if best[1] is None:
            break
        rule.append(best[1])
        alive &= covers([best[1]], x, len(y))
    return rule


def learn(table: pd.DataFrame, bad: np.ndarray, precision: float = 0.95, least: int = 4, most: int = 32, seed: int = 3) -> list[list[Condition]]:
    """The ordered rules, each a conjunction of thresholds that finds low-quality documents."""
    rules, names = [], BASE + RATIOS
    x = {c: table[c].to_numpy(np.float64) for c in names}
    rest = np.ones(len(bad), bool)
    for r in range(most):
        at = np.nonzero(rest)[0]
        if bad[at].sum() < least:
            break
        mix = np.random.default_rng(seed + r).permutation(at)
        a, b = mix[: 2 * len(mix) // 3], mix[2 * len(mix) // 3 :]
        rule = grow({c: v[a] for c, v in x.items()}, bad[a])
        xb = {c: v[b] for c, v in x.items()}
        worth = lambda q: (lambda hit: ((hit & bad[b]).sum() - (hit & ~bad[b]).sum()) / max(1, hit.sum()))(covers(q, xb, len(b)))  # noqa: B023, E731
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covers(rule, {c: v[at] for c, v in x.items()}, len(at))
        found = int((hit & bad[at]).sum())
        if not rule or found < least or found < precision * hit.sum():
            break
        rules.append(rule)
        rest[at[hit]] = False
    return rules


def condition(rule: list[Condition]) -> Column:
    both = [F.col(c) >= F.lit(at) if sign == ">=" else F.col(c) <= F.lit(at) for c, sign, at in rule]
    out = both[0]
    for c in both[1:]:
        out = out & c
    return out


def fired(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that covers the row, null if none does."""
    case = None
    for i, rule in enumerate(rules):
        case = F.when(condition(rule), F.lit(i)) if case is None else case.when(condition(rule), F.lit(i))
    return F.lit(None).cast("int") if case is None else case


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[list[Condition]]:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = materialise(bounded_sample(known, F.col("doc_id"), sample_docs))
    # at most sample_docs rows of two numbers: safe to broadcast at any input size
    got = with_statistics(pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "quality"]).toPandas()
    got = got.sort_values("doc_id", kind="stable").reset_index(drop=True)
    return learn(got, got["quality"].to_numpy() == 0) if len(got) else []


def judge(docs: DataFrame, rules: list[list[Condition]], keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns, the base statistics, base_failed, kept, rule (the first that covers the row)."""
    keep = keep or ["doc_id"]
    s = with_statistics(docs, keep)
    s = s.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)).withColumn("rule", fired(rules))
    return s.select(*[F.col(f"`{c}`") for c in keep], *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def accept(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The kept documents, with the columns of docs."""
    columns = docs.columns
    rules = fit(docs, labels, sample_docs)
    flat = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"__{i}") for i, c in enumerate(columns)])
    return judge(flat, rules, flat.columns).where("kept").select(*[F.col(x).alias(c) for x, c in zip(flat.columns, columns, strict=True)])
