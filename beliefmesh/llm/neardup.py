"""MinHash near-duplicate detection, verified by odd sketches and then on full shingle sets.

1. Every whole text gives its set of word shingles (as 64-bit hashes), `samples` MinHash values of the set, the keys of
   25 bands of 5 values, and an odd sketch: every (place, value) of the MinHash flips one bit of a 1536-bit map, so that
   the xor of two maps has as many ones as the samples differ, less collisions. Equal sets become one class, named by
   its smallest id; only class representatives go on.
2. Stars: every class is paired with the smallest class of its band buckets, then with the smallest of each bucket where
   that is in another component still. Pairs whose odd sketches differ too much are dropped (5 standard deviations
   beyond what the threshold gives), the rest is confirmed on full sets. Components of the confirmed links follow from
   alternating large-star and small-star steps.
3. The rest: only pairs of a bucket that lie in different components can still matter. They are compared by odd sketch
   within the bucket, confirmed on full sets, and joined to the components. So a large group of near copies costs
   about one pair a member, and no link between different components is lost.

Bucket and centre keys can be hot: they meet in sort-merge joins that adaptive execution splits, after aggregation by
min and max alone. The chance to miss a pair at the threshold is (1 - t^5)^25: 4e-7 at 0.85 and 5e-5 at 0.8.

Defined cases: null text, or one without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle has its whole sequence as its one shingle; a very long text is one set; rows that repeat an id with
another text are documents of their own; a null id has a null component and is kept; of equal sets the smallest id leads;
other columns are ignored by `near_duplicates` and kept by `accept`; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmesh.llm.common import lean, materialise, pick, small_batches, worker_state

BANDS, ROWS, SAMPLES, BITS = 25, 5, 768, 1536
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
KNOWN = 150_000  # words whose hash a worker keeps


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_state("word hashes")
    if len(known) > KNOWN:
        for w in list(known)[KNOWN // 2 :]:
            del known[w]
    h = list(map(known.get, words))
    if None in h:
        for i, x in enumerate(h):
            if x is None:
                h[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    h = np.array(h, np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Hashing:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, SAMPLES, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)[:, None]
        self.mix = rng.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
        self.place = rng.integers(1, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
        self.band = rng.integers(0, 1 << 63, BANDS, np.uint64)

    def samples(self, s: np.ndarray) -> np.ndarray:
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            low = np.minimum(low, (self.a * x[i : i + 1024] + self.b).min(1))
        return low

    def bands(self, low: np.ndarray) -> np.ndarray:
        v = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        k = ((v + np.uint64(0x632BE59BD9B4E019)) * self.mix).sum(1) ^ self.band
        k ^= k >> np.uint64(31)
        return (k * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def odd(self, low: np.ndarray) -> np.ndarray:
        at = ((low.astype(np.uint64) + np.uint64(1)) * self.place >> np.uint64(33)) % np.uint64(BITS)
        return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def odd_limit(percent: int, sigmas: float = 5.0) -> int:
    """Most differing bits of two odd sketches at similarity `percent` / 100, with `sigmas` standard deviations of both
    errors: of the sample (how many of its values differ) and of the folding (how many of their bits meet)."""
    t = percent / 100
    differ = SAMPLES * (1 - t)
    flips = 2 * differ
    expected = BITS / 2 * (1 - math.exp(-2 * flips / BITS))
    sampling = 2 * math.exp(-2 * flips / BITS) * math.sqrt(differ * t)
    # bins that hold an odd number of flips: variance of their count
    two, four = (1 - 2 / BITS) ** flips, (1 - 4 / BITS) ** flips
    folding = BITS / 4 * (1 - four) + BITS**2 / 4 * (four - two**2)
    return math.ceil(expected + sigmas * math.sqrt(sampling**2 + folding))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, cls (digest of the set, null if empty), bands, odd."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing = Hashing()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                rows = []
                for t in b["text"]:
                    s = shingles(t, size)
                    if len(s):
                        low = hashing.samples(s)
                        rows.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), hashing.bands(low), hashing.odd(low)))
                    else:
                        rows.append((0, None, None, None))
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "th": b["th"].to_numpy(), **{c: [r[i] for r in rows] for i, c in enumerate(("n_shingles", "cls", "bands", "odd"))}})

    small_batches(docs.sparkSession)
    texts = pick(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    return texts.mapInPandas(lean(run, "word hashes"), "doc_id long, th long, n_shingles long, cls string, bands array<long>, odd array<long>")


FILTER_BITS = (1 << 25) - 39  # a prime


def shared_ids(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """classes with `rep`, a number of its own for each class: its smallest id (`lead`), or, where several classes have
    that one, a number below all ids for all but one of them. Then the classes (rep, lead, cls) of such ids, or None."""
    twice = classes.groupBy("lead").agg(F.count(F.lit(1)).alias("k"), F.min("cls").alias("least")).where("k > 1").drop("k")
    twice = materialise(twice)
    if twice.isEmpty():
        return classes.withColumn("rep", F.col("lead")), None
    low = classes.agg(F.min("lead")).first()[0]
    other = materialise(classes.select("cls", "lead").join(twice, "lead").where("cls != least").select("cls", (F.lit(low - 1) - F.monotonically_increasing_id()).alias("own")))
    out = materialise(classes.join(other, "cls", "left").withColumn("rep", F.coalesce("own", "lead")).drop("own"))
    return out, materialise(out.join(twice.select("lead"), "lead", "left_semi").select("rep", "lead", "cls"))


def full_sets(docs: DataFrame, ids: DataFrame, size: int, shared: DataFrame | None = None) -> DataFrame:
    """id, set: the shingle sets of the classes numbered in ids(id).

    A bitmap of FILTER_BITS places (4 MB, whatever the number of ids) goes to the scan of the texts, so that about only
    the named documents' sets are shuffled to the exact semi-join; a full bitmap would only let more sets through.
    """
    if shared is not None:  # a number may stand for one of several texts of an id
        ids = materialise(ids.join(shared.withColumnRenamed("rep", "id"), "id", "left").select("id", F.coalesce("lead", "id").alias("doc"), F.col("cls").alias("own")))
    words = ids.withColumn("id", F.col("id" if shared is None else "doc")).selectExpr(f"cast(pmod(id, {FILTER_BITS}) div 64 as int) as w", f"shiftleft(1L, cast(pmod(id, {FILTER_BITS}) % 64 as int)) as b")
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64 + 1, np.int64)
    bitmap[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    named_bits = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = named_bits.value
        for whole in batches:
            at = np.mod(whole["id"].to_numpy(np.int64), FILTER_BITS)
            named = whole[(bits[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)) == 1]
            for i in range(0, len(named), 1000):
                b = named.iloc[i : i + 1000]
                sets = [shingles(t, size) for t in b["text"]]
                found = {"id": b["id"], "set": [s.view(np.int64) for s in sets]}
                yield pd.DataFrame(found if plain else found | {"digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]})

    plain = shared is None
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    got = texts.mapInPandas(lean(run, "word hashes"), "id long, set array<long>" + ("" if plain else ", digest string"))
    if plain:
        return got.join(ids, "id", "left_semi")
    both = got.withColumnRenamed("id", "doc").join(ids, "doc").where("own is null or own = digest")
    return both.select("id", "set").dropDuplicates(["id"])


def confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int, shared: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    pairs = materialise(pairs)
    ids = materialise(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct())
    sets = materialise(full_sets(docs, ids, size, shared))
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of the component) for every node of links(a, b) that isn't a root itself."""
    edges = materialise(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("x", "y")
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct())


def confirm_roots(docs: DataFrame, pairs: DataFrame, size: int, percent: int, shared: DataFrame | None = None) -> DataFrame:
    """Links between components: (ra, rb) of the pairs (a, b, ra, rb) that full sets confirm."""
    good = confirm(docs, pairs.select("a", "b"), size, percent, shared)
    return good.join(pairs.select("a", "b", "ra", "rb"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def merged_roots(classes: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """known(node, root) after its components are joined by links between roots."""
    top = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rows = classes.select(F.col("rep").alias("node")).distinct().join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def classified(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, th, n_shingles, cls, root (a number of the component), component_id (null for a null id) of every row."""
    sig = materialise(signatures(docs, size))
    classes = sig.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("lead"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes, shared = shared_ids(materialise(classes))
    rows = classes.select("rep", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").drop("last")
    members = materialise(rows.join(buckets, "band"))
    info = classes.select("rep", "n", "odd")
    near = " + ".join(f"bit_count(o1[{i}] ^ o2[{i}])" for i in range(BITS // 64)) + f" <= {odd_limit(percent)} and least(n1, n2) * 100 >= greatest(n1, n2) * {percent}"
    tell = lambda name, k: info.select(F.col("rep").alias(name), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}"))
    close = lambda pairs: pairs.join(tell("b", 2), "b").join(tell("a", 1), "a").where(near)
    # one pair a class: with the smallest of its centres
    stars = members.groupBy("rep").agg(F.min("centre").alias("a")).where("a < rep").select("a", F.col("rep").alias("b"))
    first = materialise(components(confirm(docs, close(stars).select("a", "b"), size, percent, shared)))
    # then with the other centres of its buckets, where they are in another component still
    rooted = lambda df, name, root: df.join(first.select(F.col("node").alias(name), F.col("root").alias(root)), name, "left").withColumn(root, F.coalesce(root, name))
    others = rooted(rooted(members.where("rep != centre").select("rep", "centre").distinct(), "rep", "ra"), "centre", "rb").where("ra != rb")
    others = materialise(others.select(F.col("centre").alias("a"), F.col("rep").alias("b"), "ra", "rb").distinct())
    first = materialise(merged_roots(classes, first, confirm_roots(docs, close(others), size, percent, shared)))
    # what is left: buckets whose members lie in different components
    placed = members.select("band", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = materialise(placed)
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    open_rows = placed.join(split, "band").join(classes.select("rep", "n", "odd", "bands"), "rep")
    open_rows = materialise(open_rows.withColumn("i", F.expr("cast(array_position(bands, band) as int)")))
    one = open_rows.select("band", F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("n").alias("n1"), F.col("odd").alias("o1"), "i", F.col("bands").alias("k1"))
    two = open_rows.select("band", F.col("rep").alias("b"), F.col("root").alias("rb"), F.col("n").alias("n2"), F.col("odd").alias("o2"), F.col("bands").alias("k2"))
    # each pair once: in the first band that both share
    once = "not arrays_overlap(slice(k1, 1, i - 1), slice(k2, 1, i - 1))"
    rest = one.join(two, "band").where("ra < rb").where(near).where(once).select("a", "b", "ra", "rb").distinct()
    last = merged_roots(classes, first, confirm_roots(docs, materialise(rest), size, percent, shared))
    merged = classes.select("cls", "rep", "lead").join(last.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "lead", F.coalesce("root", "rep").alias("root"))
    if shared is None:
        merged = merged.select("cls", "root", F.col("root").alias("top"))
    else:
        merged = merged.join(merged.groupBy("root").agg(F.min("lead").alias("top")), "root").select("cls", "root", "top")
    out = sig.select("doc_id", "th", "n_shingles", "cls").join(merged, "cls", "left")
    return out.select("doc_id", "th", "n_shingles", "cls", "root", F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return classified(docs, size, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def accept(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with the columns of docs: one with the smallest id, and of several such
    texts that of the smallest digest. Rows without an id or without words are in no group and stay, all of them."""
    first = classified(docs, size, percent).where("cls is not null and doc_id = component_id").groupBy("root").agg(F.min(F.struct("cls", "th", "doc_id")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias("__kept"), F.col("x.th").alias("__kept_text"))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = docs.where(~alone).withColumn("__text", F.xxhash64("text"))
    named = texts.join(kept, (F.col("doc_id") == F.col("__kept")) & (F.col("__text") == F.col("__kept_text")), "left_semi")
    return named.dropDuplicates(["doc_id", "__text"]).drop("__text").unionByName(docs.where(alone))
