"""Archives follow the pages' own partitions, not the number of shuffle partitions."""

import glob

import pytest

from beliefmesh.llm import warc

FEW = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def dealt(spark):
    before = {k: spark.conf.get(k, None) for k in [*FEW, "spark.sql.autoBroadcastJoinThreshold"]}
    for k, v in FEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pages(spark):
    """600 pages: every third has the payload of the page before it."""
    return spark.createDataFrame([(i, f"http://h/{i}", f"page {i - (i % 3 == 2)} " * 20) for i in range(600)], "page_id long, url string, html string").repartition(3)


def test_payloads_are_not_dealt_by_digest(dealt, tmp_path):
    warc.write(pages(dealt), f"file://{tmp_path}/w")
    assert len(glob.glob(f"{tmp_path}/w/part-*")) <= 3


@pytest.mark.parametrize("most", ["10m", "-1"])
def test_first_copies_as_a_small_and_as_a_large_table(dealt, most):
    dealt.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    rows = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(dealt)).select("page_id", "record_type", "refers_to").collect()}
    assert rows == {i: ("revisit", i - 1) if i % 3 == 2 else ("response", None) for i in range(600)}
