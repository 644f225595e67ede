"""A corpus from raw documents to packed training sequences, in four stages.

Each stage reads what the one before kept; all but the last return the columns of
``documents``, extra ones and their names untouched. Stages are written as Parquet and read
again as the next one's input.

What all stages do with odd rows: a null or empty text is a document without words. The
classifier judges it by its site and path, the near-copy stage keeps it, the mix takes none
of it. A null source or language is a group of its own, a null id a document without a
name. Rows that stand twice are near copies of each other, and one stays. An empty table
passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, forest, mixing, packing, quality
from millrace.llm.common import shared_dir
from millrace.session import table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return forest.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, once or twice)."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, random rounding and tokenizer can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; stage outputs go to the folder that executors share, and go when the next is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = len(common._tables)
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{k}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        common.drop_written(spark, before)
        if k:
            common.drop(spark, [f"{base}/{k - 1}"])
    return docs
