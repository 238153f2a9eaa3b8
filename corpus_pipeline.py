"""A training corpus from raw documents: rules, near and exact dedup, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, common, mixing, quality, simhash, suffix


#: Distinct texts of a source that may share a line.
LINE_DOCS = 10
#: Words of a repeat: over 50.
REPEAT = 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and lines that more than LINE_DOCS distinct texts of a source hold, however large it is."""
    return quality.keep(docs, most_docs=LINE_DOCS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that occur elsewhere go from the texts."""
    return suffix.without_repeats(docs, words=REPEAT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the order, as the curriculum takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and the token ids."""
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SimHash components, suffix arrays and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs)
    return docs
