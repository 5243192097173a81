"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet to
the shared folder and reads it back as the next stage's documents, so a lost executor never costs more than the
stage it was working on. Repeated rows and rows with null ids are documents like others; nulls and further columns pass
through every stage but the last; an empty table stays empty. Rows keep the columns of ``documents`` up to the last stage, which returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hayrick.llm import stages
from hayrick.session import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts go; an empty table stays empty."""
    return stages.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 80 %). Null and empty texts are in no group and stay."""
    return stages.keep_one_of_each_group(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data and secrets replaced. Null and empty texts stay as they are."""
    return stages.hide_private(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null and empty texts have no words and are never taken."""
    return stages.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, ends) of every document. Null and empty texts have no tokens."""
    return stages.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("personal data", private_data),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: Near-duplicate components, learned patterns and token ids have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
