"""A training corpus from raw documents: filter, deduplicate, clean, replace personal data, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return
the columns of documents. What a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import packing, pii, similar, substrings, toxicity
from siftline.llm.common import materialize, release, table


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(columns) if "n_chars" in columns else docs


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 over five-word shingles the smallest doc_id stays."""
    return similar.drop_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that also start in a document of smaller doc_id go; every document stays, emptied ones too."""
    return counted(substrings.remove_repeats(docs), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates, keyed by the session's siftline.pii.key; the synthetic tables need no secret one."""
    return counted(pii.replace_personal_data(docs, spark.conf.get("siftline.pii.key", "synthetic")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def fresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun after the executors have given back the heap that the one before it filled."""
    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [
    ("toxicity", fresh(toxic)),
    ("near_duplicates", fresh(near_duplicates)),
    ("repeated_passages", fresh(repeated_passages)),
    ("personal_data", fresh(personal_data)),
    ("packing", fresh(pack)),
]

#: SQL can express neither the learnt filter nor the surrogates; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
