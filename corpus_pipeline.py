"""Pipeline from raw documents to packed training windows, by operators of `loomsearch.llm`.

Every stage but the last returns the columns of `documents`; the last returns the places of documents in windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomsearch.llm import decontam, line_dedup, ngram_join, packing, quality
from loomsearch.llm._shared import read_table, remove, scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    Null and empty texts have score 0 and rows with a null id stay; rows with equal ids and texts share one fate, as do
    ties with the last document kept. Without labels of both kinds, all stay. Columns beside `doc_id` and `text` are
    carried along.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs across documents; one left without text is dropped.

    Null ids and texts and texts that were blank before stay as they are; rows with equal ids count as one document,
    and the one of smallest id keeps its lines.
    """
    return line_dedup.drop_recurring(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest id.

    Null ids, null texts and texts without words stay; rows with equal ids and texts stay or go together.
    """
    return ngram_join.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null ids and texts stay, repeated rows share one fate."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 words, best fit decreasing; null ids and texts without words are in none, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack_windows),
]

#: Neither a trained classifier nor best-fit packing can be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and read again.

    A stage's output is deleted once the next one's is written; that of the last but one stays, as the result reads it.
    An empty table gives no windows.
    """
    docs = read_table(spark, sf_dir, "documents")
    base = scratch_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}-{name}")
            docs = spark.read.parquet(f"{base}/{i}-{name}")
            if i:
                remove(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
