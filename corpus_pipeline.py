"""A corpus from documents to a mixed training set: five operators, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontaminate, langid, linedup, mixing, simhash
from helixframe.llm.common import cut, forget


# Every stage takes null, empty and very long texts, null and repeated doc_ids, repeated rows, ties, an empty table and
# columns of any name, as its module's docstrings say in full.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages learned; those without a letter (null and empty texts too) or with an unsure
    language go. Ties go to the first language by name; repeated rows share their fate; without a lang nothing is learned and no document stays."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of any number of lines leave their texts; every document stays. The first copy is that
    of the smallest doc_id, null ids last; rows that repeat id and text are one document; null texts stay null."""
    return linedup.dedup(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id, null ids last; of repeated rows one.
    Null and wordless texts are a group."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of texts; every document stays. Null texts stay null, clean ones as they are."""
    return decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by their source's target weight, in random order. A null source is one of its own; rows that
    repeat a doc_id draw the same number."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_sources),
]

#: Language ID and SimHash have no counterpart in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        done = cut(stage(spark, docs, sf_dir))
        forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
