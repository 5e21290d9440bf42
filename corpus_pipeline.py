"""From raw documents to packed training sequences.

Each stage takes what the one before kept and returns the columns of ``documents``; the last
returns pieces and their places in the sequences. Results are written as Parquet between
stages, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.llm import decontaminate, linededup, ngramjoin, packing, toxicity
from facetspark.llm.common import read_table, stored


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts, and texts like no labelled example, stay; repeated rows
    are judged alike; a null doc_id is no reason to go; an empty table stays empty."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document without any line left stays, empty. Other
    columns pass unchanged, but for ``n_chars``, which is that of the new text."""
    kept = linededup.dedup_lines(docs, counts=False)
    return kept.select([F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, the one with the smallest id; of repeated rows of that id
    the first as read, of null ids any only if there is no other. Texts without words all stay."""
    return ngramjoin.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none, repeated rows go or stay alike."""
    return decontaminate.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences. A null or empty text is one piece, its end id; a very long
    one is cut into pieces; repeated rows are packed each; an empty table gives no pieces; other columns are not read."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", repeated_lines),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", packed_sequences),
]

#: The first stage is a fitted classifier, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
