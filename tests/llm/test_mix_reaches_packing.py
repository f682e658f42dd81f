"""The mix in the packed sequences; blocks bounded for the driver; columns that clash."""

import numpy as np
from pyspark.sql import functions as F

from beliefmesh.llm import mixing, packing


def corpus(spark, n=3000):
    rng = np.random.default_rng(5)
    source = ["hot"] * (n // 2) + ["b"] * (n // 3) + [None] * (n - n // 2 - n // 3)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 400))), s, "slot clash", 7) for i, s in enumerate(source)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, block int")


def test_sequences_follow_the_mix(spark):
    d = corpus(spark)
    turn = {r["doc_id"]: r["turn"] // 8 for r in mixing.schedule(d.withColumn("t", mixing.tie_of()), tie=["t"], block_rows=4).collect()}
    got = packing.pack(d, window=8, block_rows=4).toPandas()
    whole = packing.pack(d).toPandas()
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got[same].itertuples(index=False, name=None)) == sorted(whole[same].itertuples(index=False, name=None))
    windows = got.assign(w=got.doc_id.map(turn)).groupby("sequence_id").w.agg(["min", "max"]).sort_index()
    assert (windows["min"] == windows["max"]).all() and windows["min"].is_monotonic_increasing and list(windows.index) == list(range(len(windows)))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum().to_numpy()[:-1]])).all() and s.length.sum() <= 4096
    # while all sources last, each window has their target shares of documents to within a block
    share = np.sqrt([1500, 1000, 500]) / np.sqrt([1500, 1000, 500]).sum()
    first = got[(got.piece == 0) & (got.doc_id.map(turn) < 20)].merge(d.select("doc_id", "source").toPandas(), on="doc_id")
    for k, p in zip(("hot", "b", None), share, strict=True):
        own = first[first.source.isna()] if k is None else first[first.source == k]
        assert abs(len(own) / 4 - 160 * p) < 1 + 1e-6


def test_one_window_is_the_whole_plan(spark):
    d = corpus(spark, 600)
    count = lambda x: x.select("sequence_id").distinct().count()
    assert count(packing.pack(d, window=1 << 20)) == count(packing.pack(d))
    assert packing.pack(d.where("false"), window=8).count() == 0


def test_mix_and_pack_agree_on_the_order(spark):
    d = corpus(spark, 800)
    mixed = [r["doc_id"] for r in mixing.mix(d, block_rows=4).collect()]
    turn = {r["doc_id"]: r["turn"] for r in mixing.schedule(d.withColumn("t", mixing.tie_of()), tie=["t"], block_rows=4).collect()}
    assert [turn[k] for k in mixed] == sorted(turn.values()) and mixing.mix(d).columns == d.columns
    assert sorted(map(str, mixing.mix(d).collect())) == sorted(map(str, d.collect()))


def test_the_driver_holds_a_bounded_number_of_blocks(spark):
    d = corpus(spark, 2000)
    got = mixing.schedule(d, block_rows=2, most_blocks=50).toPandas()
    blocks = got.assign(s=got.source.fillna("")).groupby(["s", "block"])
    assert blocks.ngroups <= 50 + 3 and len(got) == 2000 and blocks.slot.nunique().max() == 1
    assert blocks.slot.first().is_unique and ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    assert sorted(blocks.turn.first()) == list(range(blocks.ngroups))


def test_many_sources(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), F.col("id") % 3000).alias("source"))
    got = mixing.schedule(d, block_rows=1)
    assert got.count() == 6000 and got.select("slot").distinct().count() == 6000
