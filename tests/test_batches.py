"""What Python holds at once is bounded, whatever the size of a table."""

from pyspark.sql import functions as F

from beliefmesh.functions import batches, text
from beliefmesh.operators import compiler


def test_texts_and_graphs_come_in_batches_of_8_mb(spark):
    before = spark.conf.get(batches.KEY)
    try:
        spark.conf.set(batches.KEY, "67108864")
        docs = spark.range(4000).select("id", F.repeat(F.lit("word  "), 1000).alias("text"))
        assert {len(r["d"]) for r in docs.select(text.text_digest(F.col("text")).alias("d")).distinct().collect()} == {71}
        assert int(str(spark.conf.get(batches.KEY)).rstrip("b")) == batches.MOST
        spark.conf.set(batches.KEY, "1000000")
        batches.limit(spark)
        assert spark.conf.get(batches.KEY).rstrip("b") == "1000000"
    finally:
        spark.conf.set(batches.KEY, before)


def test_large_graphs_are_taken_on_a_few_at_a_time(spark):
    """A batch of graphs was made Python objects 1024 at a time, of any size."""
    rows = spark.range(400).repartition(1).select(F.col("id").alias("graph_id"), F.repeat(F.lit("x"), 50_000).alias("t"))
    got = compiler.by_graph(rows, lambda part: [[{"n": len(part)}] for _ in part], "n int").collect()
    assert len(got) == 400 and max(r["n"] for r in got) * 50_000 <= 2 * compiler.BYTES
