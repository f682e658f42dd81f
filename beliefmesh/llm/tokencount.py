"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

1. Every whole text is split into pre-tokens on Python workers, with their frequencies. Pre-tokens in a small table of
   frequent ones (the `frequent` most common in a bounded sample of `sample_docs` texts, counted by the library; sent
   with the task, so bounded by that parameter) are looked up and summed there and then: a hash join. The rest, rare
   ones, stay with the document as (pre-token, frequency).
2. The frequencies of rare pre-tokens are dealt and sorted by pre-token, where each distinct one is counted by the
   library once and joined to its run of frequencies as it passes (a merge join with one shuffle); the products are
   summed per document. A rare pre-token is in few documents, so the join has no hot key: common ones are in the
   table, and those that a sample missed are pre-aggregated per document.

The table of frequent pre-tokens sets the cost only; results don't depend on it. Every text takes this way, whatever its
characters: no text is encoded whole. Pre-tokens of over `LONGEST` code points, such as a line of dashes, are never in the
table, so they are dealt by SPREAD salts beside the pre-token: one that many documents share is in many tasks, each of
which counts it once.

Defined cases: null text is empty and has 0 tokens; a very long text is one row, a very long pre-token one entry of it;
null and repeated ids keep one row per row; ties among equally frequent pre-tokens go by the pre-token and don't change
a count; other columns, also such as `row` or `piece`, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmesh.llm.common import bounded_sample, lean, materialise, pick, small_batches, worker_state
from beliefmesh.llm.tokens import Splitter, load, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
SAMPLE_DOCS = 8000
FREQUENT = 250_000
LONGEST = 400  # longer pre-tokens are not put in tables
SPREAD = 64


def tokenizer(path: str):
    cache = worker_state("tokenizers")
    if path not in cache:
        cache[path] = load(path)
    return cache[path]


def count_pieces(path: str, pretokens: list[str]) -> list[int]:
    return [len(e) for e in tokenizer(path).encode_batch_fast(pretokens, add_special_tokens=False)]


def frequent_table(docs: DataFrame, path: str, sample_docs: int, frequent: int) -> dict[str, int]:
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Splitter(tokenizer(path))
        for b in batches:
            c = Counter(p for t in b["text"] if t for p in pieces(t) if len(p) <= LONGEST)
            yield pd.DataFrame({"piece": pd.Series(list(c.keys()), dtype=object), "n": list(c.values())})

    sample = bounded_sample(pick(docs, "doc_id", "text"), F.col("doc_id"), sample_docs, of=docs)
    counted = sample.repartition(8).mapInPandas(lean(split, "tokenizers"), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    words = [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(frequent).collect()]
    return dict(zip(words, count_pieces(path, words), strict=True)) if words else {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, sample_docs: int = SAMPLE_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every whole text."""
    path = path or vocabulary_path(VOCABULARY)
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(frequent_table(docs, path, sample_docs, frequent))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = table.value
        pieces = Splitter(tokenizer(path))
        for b in batches:
            size, base, rare = [], [], []
            for t in b["text"]:
                if not t:
                    size.append(0), base.append(0), rare.append(None)
                    continue
                size.append(len(t.encode("utf-8", "surrogatepass")))
                n, rest = 0, []
                for p, f in Counter(pieces(t)).items():
                    k = known.get(p)
                    if k is None:
                        rest.append((p, f))
                    else:
                        n += k * f
                base.append(n)
                rare.append(rest or None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": size, "base": base, "pieces": pd.Series([None if r is None else [x for x, _ in r] for r in rare], dtype=object), "times": pd.Series([None if r is None else [x for _, x in r] for r in rare], dtype=object)})

    # numbered as it is written, so that the numbers are distinct and the same at each reading
    split_docs = pick(docs, "doc_id", "text").mapInPandas(lean(split, "tokenizers"), "doc_id long, n_bytes long, base long, pieces array<string>, times array<int>")
    parts = materialise(split_docs.withColumn("row", F.monotonically_increasing_id()))
    rare = parts.where("pieces is not null").select("row", F.explode(F.arrays_zip("pieces", "times")).alias("x")).select("row", "x.pieces", "x.times").withColumnRenamed("pieces", "piece").withColumnRenamed("times", "f")

    def times_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, k = None, 0
        for b in batches:  # equal pre-tokens follow each other: each is counted once
            new = b["piece"].drop_duplicates()
            counts = dict(zip(new, count_pieces(path, new.tolist()) if last is None or new.iloc[0] != last else [k, *count_pieces(path, new.tolist()[1:])], strict=True)) if len(new) else {}
            if len(new):
                last = new.iloc[-1]
                k = counts[last]
            yield pd.DataFrame({"row": b["row"], "n": np.array([counts[p] for p in b["piece"]], np.int64) * b["f"].to_numpy(np.int64)})

    # frequencies and counts meet by pre-token in one shuffle
    salt = F.when(F.length("piece") > LONGEST, F.pmod("row", F.lit(SPREAD)))
    met = rare.repartition("piece", salt).sortWithinPartitions("piece").mapInPandas(lean(times_pieces, "tokenizers"), "row long, n long")
    sums = met.groupBy("row").agg(F.sum("n").alias("more"))
    n = F.col("base") + F.coalesce("more", F.lit(0))
    return parts.drop("pieces", "times").join(sums, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))

