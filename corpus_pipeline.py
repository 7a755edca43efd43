"""A training corpus from ``documents``: five stages, each on all that the one before it kept.

Defined results: an empty table passes every stage as an empty one. A null or blank
text fails the quality rules. A null doc_id keeps its row, is told from others by its
text, and comes first in the token files. Of rows that are equal in id and text the
near-dedup stage leaves one. The mix may repeat a row, at most three times, and the
token stage writes each. Columns besides doc_id, text and source are carried
unchanged, whatever their names, up to the token stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, near_copies, quality_rules, tokens
from quarry.llm.common import new_path, read
from quarry.llm.registry import tokenizer_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    tokens.write_tokens(docs, folder, tokenizer_path())
    return tokens.read_tokens(spark, folder)


STAGES = [
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_files),
]

#: XXH64 fingerprints and tokenizer ids aren't in reach of SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
