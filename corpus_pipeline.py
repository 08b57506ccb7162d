"""The corpus pipeline: stages applied to ``documents`` one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All stages
but the last return the columns that they got; an empty table stays empty in
all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.bpe import bpe_encode
from waymark.llm.jaccard import keep_one
from waymark.llm.mixing import keep_mixed
from waymark.llm.quality_rules import keep_by_rules
from waymark.llm.secrets import redact_secrets
from waymark.llm.store import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and blank texts go; documents without a source are one host; repeated
    rows are judged each.
    """
    return keep_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that the n-gram Jaccard join links, that of the smallest doc_id.

    Rows of one doc_id are one document; rows without doc_id stay; null and
    blank texts are linked with nothing.
    """
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; null texts stay null, repeated rows stay."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, every part in order of its slots, repeated (twice at most) or left out as the targets of their sources say.

    Documents without words are in no slot; those without a source form the
    last source; repeated rows share their copies.
    """
    return keep_mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document of the mix; a null text has no ids, repeated documents have a row each."""
    return bpe_encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Byte-pair merges and signatures are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
