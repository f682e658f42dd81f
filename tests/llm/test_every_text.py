"""Token counts of texts of all scripts go by pre-tokens; captures are read off the assembled records."""

import pytest
from pyspark.sql import functions as F

from beliefmesh.llm import queries, tokencount, tokens, warc

TEXTS = [
    "“It’s here” — and there… don’t", "中文 与 English，混合。日本語のテキスト", "😀 👩‍👩‍👧 ok", "no break space   x", "Привет, мир! Ελληνικά 1234",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftex", "-" * 5000, "é" * 3000, "   \n\n\t  x  ", "", None, "߀१½²\u0085\x1c",
]


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load(tokens.vocabulary_path(tokencount.VOCABULARY))


def test_texts_of_all_scripts(spark, tokenizer):
    d = spark.createDataFrame([(i % 5, t, "clash") for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, piece string")
    want = sorted((i % 5, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS * 3))
    for frequent in (5, 100_000):
        got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(d, frequent=frequent, sample_docs=4).collect())
        assert got == want


def test_pieces_make_up_the_text_and_its_count(tokenizer):
    split = tokens.Splitter(tokenizer)
    for t in TEXTS:
        pieces = split(t or "")
        assert "".join(pieces) == (t or "") and sum(tokencount.count_pieces(tokens.vocabulary_path(tokencount.VOCABULARY), pieces)) == len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert all(p == "<|endoftext|>" or "<|endoftext|>" not in p for p in pieces) and len(pieces) <= max(1, len(t or ""))


def test_a_lost_request_or_metadata_record_shows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x y", "p" * 200, "c"), (2, "http://a/2", "p" * 200, "c"), (None, None, "q" * 300, "c"), (3, "u", None, "c")], "page_id long, url string, html string, digest string")
    warc.write(pages, f"file://{tmp_path}/w")
    records = warc.read(spark, f"file://{tmp_path}/w").cache()
    assert records.count() == 12
    rows = {r["page_id"]: r for r in warc.assemble(records).select("page_id", warc.header("request", "warc-target-uri").alias("uri"), "record_type", "refers_to", "metadata", "response").collect()}
    assert rows[1]["uri"] == "http://a/x%20y" and rows[None]["uri"] is None and rows[2]["refers_to"] == 1 and rows[3]["record_type"] == "response"
    cut = warc.assemble(records.where("not (type = 'metadata' and page_id <=> 2)"))
    assert {r["page_id"]: r["metadata"] is None for r in cut.collect()} == {1: False, 2: True, 3: False, None: False}
    # a response that names its request, instead of the other way round
    turned = records.where("page_id = 1 and type in ('request', 'response')").withColumn("concurrent_to", F.when(F.col("type") == "response", F.array(F.lit("<r>"))).otherwise(F.expr("cast(array() as array<string>)"))).withColumn("record_id", F.when(F.col("type") == "request", F.lit("<r>")).otherwise(F.col("record_id")))
    assert warc.assemble(turned).first()["request"]["record_id"] == "<r>"


def test_warc_query_reads_the_transaction(spark):
    rows = queries.op6_warc(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows.where("record_type is null or page_id is null").count() == 0
