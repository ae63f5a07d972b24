"""From raw documents to encoded training rows, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read back as the next one's documents. All but the last return the columns of documents.

In every stage null texts count as empty, rows that repeat or share an id are told apart, texts are read whole however long
they are, columns of any other name come along, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, mixing, near_dups, quality, secrets
from pointloom.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays. Sets are those of five words in a row, the set similarity is 0.8 or
    more, as for every stage on word shingles whose contract names no other width. Documents without words all stay."""
    return near_dups.without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark; no document goes."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the text that decoding gives back."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=tuple(c for c in docs.columns if c != "n_tokens"))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("bpe", encode),
]
#: The stages learn their rules and thresholds, which SQL can't express; tests compare with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
