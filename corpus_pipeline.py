"""Documents to training sequences: quality rules, near duplicates, repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it left and returns the
columns of documents, the last the packed pieces. run() writes each stage's rows and reads them again.

In every stage null and empty texts, null ids, repeated rows, ties and very long texts have a result: see each
stage. An empty table stays empty; columns beside those of documents are carried along and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, near_dup, packing, quality, store, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the fences of their language and source keep.

    A null or empty text has no words, so it goes; repeated rows are judged each, alike; a null language or source
    is one of its own; ids don't matter.
    """
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id.

    Rows without a doc_id stay, and so does a text without words; of repeated rows one stays; where ids clash,
    each group still keeps one row.
    """
    return near_dup.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the word windows that also stand elsewhere; none goes, and n_chars follows the text.

    Null texts stay null; of repeated rows all words of windows go, as each stands elsewhere too.
    """
    return substrings.cut_texts(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no benchmark item. Null and empty texts leak none; repeated rows fare alike."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in packed sequences; a null or empty text is its end id, repeated rows are packed each."""
    return packing.digests(packing.pack(docs))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: The tiling and the tokenizer can't be told in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return store.written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
