"""The size of the cascade's filters, and urls of odd shapes."""

from pyspark.sql import functions as F

from beliefmesh.llm import urlfilter


def test_filters_follow_the_list_not_the_universe(spark):
    listed = spark.range(5).select(F.concat(F.lit("k"), F.col("id") * 1000).alias("key"))
    size = {}
    for n in (20_000, 400_000):
        c = urlfilter.build(listed, spark.range(n).select(F.concat(F.lit("k"), "id").alias("key")))
        size[n] = [bits for _, _, bits, _ in c.levels]
        got = {r["key"] for r in spark.range(n).select(F.concat(F.lit("k"), "id").alias("key")).where(c.contains("key")).collect()}
        assert got == {f"k{i * 1000}" for i in range(5)}
    assert all(bits <= 64 * 8 for levels in size.values() for bits in levels)


def test_a_wrong_count_of_the_universe_changes_sizes_alone(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%3'")
    want = {r["key"] for r in listed.collect()}
    for size in (1, 400, 10**9):
        c = urlfilter.build(listed, universe, size)
        assert {r["key"] for r in universe.where(c.contains("key")).collect()} == want


def test_repeated_and_long_urls(spark):
    long_url = "http://" + "a." * 500 + "net/fr/" + "x" * 20000
    rows = [(1, long_url), (1, long_url), (2, "http://b.example.com/en/" + "y" * 50000), (None, "http://www.example.com/en/?q")]
    d = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "verdict": F.lit("v")})
    got = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.judge(d).collect()), key=str)
    assert got == [(1, "net/fr/", "block"), (1, "net/fr/", "block"), (2, "example.com/en/", "block"), (None, "www.example.com/en/", "allow")]
