"""A training corpus from documents, in five stages of the operators in linkloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from linkloom.llm.common import new_folder, table
from linkloom.sources.shipping import shipped
from linkloom.sources.storage import drop, scratch


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain gives a toxic probability under one half; trained on the labelled
    rows of this stage's input."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@shipped
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages cut out; one that loses all its words goes, one that had
    none stays."""
    out = line_dedup.dedup_lines(docs)
    return out.where(r"_ld_gone = 0 or text rlike '[^\\x20\\x09-\\x0D]'").drop("_ld_lines", "_ld_gone")


@shipped
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more in five-word shingles: that of the
    least (doc_id, text hash). SimHash fingerprints with a common Golay key propose, MinHash bands add
    what is farther than three bits apart, the similarity itself decides."""
    return near_copies.keep_one(docs)


@shipped
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@shipped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with counts and digests."""
    return bpe.round_trip(docs, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: Classifiers, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    What a stage made besides, and its predecessor's output, is deleted once it is written. Rows
    with a null text pass all stages but near duplicates, where they count as one empty text; of
    repeated rows that stage keeps one. Null ids stay. Empty documents give an empty result. Other
    columns are carried up to the last stage, which has the columns of bpe.round_trip.
    """
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            drop(spark, f"{folder}/{i - 1}")
    return docs
