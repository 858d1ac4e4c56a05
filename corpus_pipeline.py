"""The corpus pipeline: ``documents`` through five operators, each stage judged on its own input.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents.

A null text counts as empty: it is scored and compared as such, and if kept packs to the one closing id. A null doc_id
sorts last: its row stays only where no row with an id holds the same text. Of repeated rows one stays. Ties between copies
go to the smallest doc_id. Texts of any length count whole. With no usable label every document scores 0.5 and passes the first stage. Empty
tables give no rows. Further columns of any name travel along unchanged up to packing, which reads id and text only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filelake.llm.exact_dedup import drop_exact_duplicates
from filelake.llm.packing import pack_documents
from filelake.llm.rule_quality import drop_low_quality
from filelake.llm.simhash import drop_near_duplicates
from filelake.llm.substring_dedup import remove_repeats
from filelake.session import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that a smaller document also holds leave the text."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Classifier, fingerprints and packing cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
