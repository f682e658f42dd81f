"""Operators that SQL can't express against plain versions: the network, the decision list, the whole pipeline."""

import collections

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components

from beliefmesh.llm import common, langid, mixing, neardup, packing, rules, tokens

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rank int, slot string"


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"word{i}" for i in range(20000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "plain words. " * 9, "en", "a", 9), (3, "plain words. " * 9, "en", "a", 9), (3, "other words. " * 9, "en", "a", 9), (None, "no id here", "fr", None, 26), (5, long_text, "de", "a", 1), (7, "... !!! 123", None, "a", 11)]
    return spark.createDataFrame([(*r, True, 1, "s") for r in rows], ODD)


def direct(model, window):
    """The network by its definition: one-hot bytes, a dot product at each place of each filter, relu, pooling, softmax."""
    pooled = []
    for w in langid.WIDTHS:
        filters, bias = model[f"t{w}"].astype(float), model[f"b{w}"].astype(float)
        for f in range(langid.FILTERS):
            at = [sum(filters[k, window[i + k], f] for k in range(w)) for i in range(len(window) - w + 1)]
            pooled.append(max(max(at) + bias[f], 0.0))
    z = np.array(pooled) @ model["out"].astype(float) + model["bias"].astype(float)
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_the_network_is_a_convolution(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    net = langid.Network(model)
    texts = [r["text"].encode() for r in docs.orderBy("doc_id").limit(12).collect()]
    lang, score, count = net.score(texts)
    for i, t in enumerate(texts):
        windows, _, size = langid.windows_of([t])
        logs = np.array([np.log(direct(model, w)) for w in windows])
        mean = (logs * size[:, None]).sum(0) / size.sum()
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert lang[i] == p.argmax() and score[i] == pytest.approx(p.max(), abs=1e-4) and count[i] == len(windows)


def kept_by(learned, text):
    """The base rule, then the list applied condition by condition."""
    s = dict(zip(rules.BASE + rules.RATIOS, rules.statistics(text), strict=True))
    if s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]:
        return False
    return not any(all(s[name] >= at if sign == ">=" else s[name] <= at for name, sign, at in rule) for rule in learned)


def test_the_decision_list_row_by_row(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = rules.fit(docs, labels)
    assert learned
    for d in (docs, odd):
        texts = {str(r["doc_id"]) + str(hash(r["text"])): r["text"] for r in d.collect()}
        want = collections.Counter(kept_by(learned, r["text"]) for r in d.collect())
        got = rules.judge(d, learned, ["doc_id", "text"]).collect()
        assert texts and all(r["kept"] == kept_by(learned, r["text"]) for r in got) and len(got) == sum(want.values())


def plain_run(spark, docs, labels):
    """The pipeline's documents and pieces by plain loops over collected rows."""
    model, learned = langid.fit(docs), None
    net = langid.Network(model)
    rows = [r for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    _, score, _ = net.score([r["text"].encode() for r in rows])
    rows = [r for r, s in zip(rows, score, strict=True) if s >= 0.4]
    learned = rules.fit(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if kept_by(learned, r["text"])]
    root = brute_components({r["doc_id"]: r["text"] for r in rows}, 5, 80)
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    # the mix: documents of a source in hash order, in blocks; then blocks by earliest deadline
    hashed = spark.createDataFrame(rows, docs.schema).withColumn("t", mixing.tie_of()).withColumn("h", F.pmod(F.xxhash64("doc_id", "t"), F.lit(common.HASH_SPAN))).orderBy("h").collect()
    own = collections.defaultdict(list)
    for r in hashed:
        own["null" if r["source"] is None else f"s:{r['source']}"].append(r["doc_id"])
    keys = sorted(own)
    slots = mixing.earliest_deadlines(mixing.fine_units([len(own[k]) ** 0.5 for k in keys]), [-(-len(own[k]) // 32) for k in keys])
    order = [d for _, k, j in sorted((s, k, j) for k, ss in zip(keys, slots, strict=True) for j, s in enumerate(ss)) for d in own[k][32 * j : 32 * j + 32]]
    t = tokens.load(tokens.vocabulary_path(packing.VOCABULARY))
    text = {r["doc_id"]: r["text"] for r in rows}
    pieces = []
    for d in order:
        n = len(t.encode(text[d], add_special_tokens=False).ids) + 1
        pieces += [(d, k, min(4096, n - i)) for k, i in enumerate(range(0, n, 4096))]
    return order, pieces


def test_pipeline_against_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    order, pieces = plain_run(spark, docs, labels)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(pieces) == sorted(got[["doc_id", "piece", "length"]].itertuples(index=False, name=None))
    used = got.groupby("sequence_id").length.sum()
    assert (used <= 4096).all() and len(used) <= 1.05 * -(-sum(n for _, _, n in pieces) // 4096) + 1
    before = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        before = spark.createDataFrame(stage(spark, before, SF).collect(), before.schema)
    assert [r["doc_id"] for r in before.collect()] == order


def test_stages_on_odd_and_empty_rows(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for d in (odd, odd.where("false"), docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == d.columns and out.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, SF).select("doc_id").count() >= (d.count() if d is odd else 0)
    assert langid.accept(odd).where("text is null or text = ''").count() == 0
    assert {r["text"][:5] for r in neardup.accept(odd).where("doc_id = 3").collect()} == {"plain", "other"}


def test_nothing_is_left_behind(spark):
    common.release(spark)
    corpus_pipeline.run(spark, SF).count()
    assert common.SCRATCH == []
