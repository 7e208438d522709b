"""The corpus pipeline: five of the operators in llm, each stage working on what the one before it kept.

Defined cases, for every stage: null and empty texts are documents like others (as bags of one zero passage, without
lines, with fingerprint zero, without passages, as id 0); repeated rows are judged alike, and SimHash near-dedup leaves one
of them; null ids are rows like others; an empty table gives an empty result; further columns, whatever their names,
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orthant.llm import decontamination, line_dedup, packing, quality_classifier, simhash_dedup
from orthant.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), quality_classifier.usable_labels())
    return quality_classifier.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines that an earlier document keeps."""
    return line_dedup.line_dedup(docs, counted=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash_dedup.keep_first(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmarks),
    ("packing", pack),
]
#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
