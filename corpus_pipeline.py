"""From raw documents to packed training sequences: five stages, each written before the next reads it.

What becomes of unusual rows: a null, empty or blank text has too few words and goes in the first stage, where a stage is
run by itself it is an empty text (no group of copies, no personal data, a packed end sign alone). A null
doc_id is kept by every stage. Repeated rows are judged alike; of rows with the same id and text that are a
copy of a smaller id's, none stays, of rows of the id that stays, all. Other columns go through as they are, whatever their
names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fencewatch.llm import jaccard, packing, pii, quality, repetition
from fencewatch.llm.common import table
from fencewatch.llm.queries import vocabulary
from fencewatch.sources.scratch import written

#: No SQL expresses the learned stages; tests compare each stage with a plain version of it.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of enough words that repeat too little of themselves to be rejected."""
    return repetition.kept(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, learned from the labels of these documents, accepts."""
    return quality.accepted(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.distinct_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return pii.masked(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; the last stage's rows are not written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
