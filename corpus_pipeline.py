"""A corpus pipeline: documents with a language, of good quality, one of each group of near duplicates, mixed by source
and packed into sequences that follow the mix. Each stage takes (spark, docs, sf_dir); all but the last return the columns
of documents, whatever these are called.

Every stage's cases: an empty table gives an empty result; a very long text is one row like others; extra columns are kept
(ignored by the last), also ones that clash with inner names. What nulls, repeated rows and ties give is said at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from beliefmesh.llm import common, langid, mixing, neardup, packing, rules


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are `und` or whose language is uncertain go: null, empty and letterless texts among them. A null id or
    lang isn't learned from; repeated rows are judged alike, and all stay or go."""
    return langid.accept(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go: null and empty texts among them. Without labels the base
    rule alone decides; repeated rows are judged alike, and all stay or go; a value at a threshold is beyond it."""
    return rules.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the smallest id; of repeated
    rows one, of other texts with that id none unless alone. Rows without an id or words are in no group and all stay."""
    return neardup.accept(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix; a null source is a source. Repeated rows are separate rows; equal
    deadlines go by the order of sources. The last stage packs window by window of this order."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence. Sequences hold documents of one window of the mix, and
    are numbered in its order. A null text is empty, a document of its end alone; repeated rows are packed each; ties among
    equal lengths go by hash."""
    return packing.pack(docs, window=WINDOW)


#: Blocks of the mix (of 32 documents) that are packed together.
WINDOW = 256

STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("pack", pack)]

#: Learned models and tokenizers have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages write on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = len(common.SCRATCH)
    folder = common.shared_folder(spark)
    path = None
    for name, stage in STAGES:
        done, path = path, f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        common.release(spark, before)
        if done:
            common.delete(spark, done)
    return docs
