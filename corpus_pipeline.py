"""From documents to training files: filter, de-duplicate, decontaminate, mix, write tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm.decontaminate import decontaminate
from quotemill.llm.jaccard_join import keep_one_of_each
from quotemill.llm.mixing import MAX_REPEATS, mix_sources
from quotemill.llm.quality import filter_quality
from quotemill.llm.queries import vocabulary
from quotemill.llm.text import table
from quotemill.llm.token_files import read_token_files, write_token_files
from quotemill.session import work_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the basic rules and the limits of their language and source."""
    return filter_quality(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark; mostly shared ones go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), chars_col="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources repeated to their tempered weight.

    Only the number of readings is handed on: the token files are in the order of ids, not of the blocks.
    """
    return mix_sources(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and checksum of every document in the token files, read back from them."""
    folder = work_path(spark, "token-files")
    files = write_token_files(docs, folder, vocabulary("byte_bpe_50k.json"), end_id=2, copies=True)
    return read_token_files(files)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

# Sketches, automata and tokenizers have no SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
