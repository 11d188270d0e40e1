"""Scoring of distinct news texts: class probabilities and a sentiment in [-1, 1].

A score depends only on the text, so every distinct text is scored once and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.joins import missing_keys
from quotemill.sources.tables import is_built

# Texts per scorer call.
BATCH_SIZE = 128

# Word lists of the built-in scorer.
POSITIVE_WORDS = [
    "beat", "beats", "exceeds", "gain", "gains", "growth", "profit", "profits", "purchase",
    "raise", "raises", "record", "strong", "surge", "surges", "upgrade", "upgraded",
]
NEGATIVE_WORDS = [
    "bankruptcy", "cut", "cuts", "decline", "declines", "default", "downgrade", "downgraded",
    "error", "fall", "falls", "fraud", "lawsuit", "loss", "losses", "miss", "misses", "recall",
    "weak",
]
NEUTRAL_WEIGHT = 3.0

# Scores a batch of texts: one (positive, negative, neutral) row per text.
Scorer = Callable[[list[str]], "list[tuple[float, float, float]]"]


class UnscoredTextsError(RuntimeError):
    """News texts without a score would silently drop out of the features."""


def _count_words(text: Column, words: list[str]) -> Column:
    tokens = F.split(F.lower(text), "[^a-z]+")
    listed = F.array(*[F.lit(w) for w in words])
    return F.size(F.filter(tokens, lambda t: F.array_contains(listed, t)))


def lexicon_scores(texts: DataFrame, column: str) -> DataFrame:
    """The built-in scorer, as native expressions: weights grow with the listed words found."""
    positive = F.pow(1.0 + _count_words(F.col(column), POSITIVE_WORDS), F.lit(2.0))
    negative = F.pow(1.0 + _count_words(F.col(column), NEGATIVE_WORDS), F.lit(2.0))
    weighed = texts.select(column, positive.alias("_pos"), negative.alias("_neg"))
    total = F.col("_pos") + F.col("_neg") + F.lit(NEUTRAL_WEIGHT)
    shares = weighed.select(
        column,
        (F.col("_pos") / total).cast("float").alias("p_positive"),
        (F.col("_neg") / total).cast("float").alias("p_negative"),
        (F.lit(NEUTRAL_WEIGHT) / total).cast("float").alias("p_neutral"),
    )
    return shares.withColumn("sentiment", F.col("p_positive") - F.col("p_negative"))


def score_texts(
    texts: DataFrame, column: str, load_scorer: Callable[[], Scorer], partitions: int | None = None
) -> DataFrame:
    """Score texts with a model: ``load_scorer`` runs once per task and returns the batch scorer.

    Each task sorts its texts by length, so a batch carries little padding.
    """
    spread = texts.select(column)
    spread = spread.repartition(partitions, column) if partitions else spread.repartition(column)
    ordered = spread.sortWithinPartitions(F.length(column), column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for batch in batches:
            values = batch[column].tolist()
            rows = []
            for start in range(0, len(values), BATCH_SIZE):
                rows += scorer(values[start : start + BATCH_SIZE])
            scores = pd.DataFrame(rows, columns=["p_positive", "p_negative", "p_neutral"], dtype="float32")
            scores.insert(0, column, values)
            scores["sentiment"] = scores["p_positive"] - scores["p_negative"]
            yield scores

    schema = f"`{column}` string, p_positive float, p_negative float, p_neutral float, sentiment float"
    return ordered.mapInPandas(run, schema)


def unscored_texts(news: DataFrame, scored: DataFrame, column: str) -> DataFrame:
    """Distinct non-null texts of the news that have no score yet."""
    return missing_keys(news, scored, column)


def assert_all_scored(news: DataFrame, scores: DataFrame, column: str = "title") -> None:
    n = unscored_texts(news, scores, column).count()
    if n:
        raise UnscoredTextsError(f"{n} distinct {column} texts have no score")


def score_new_texts(
    spark: SparkSession,
    news: DataFrame,
    cache_path: str,
    column: str,
    score: Callable[[DataFrame, str], DataFrame] = lexicon_scores,
) -> DataFrame:
    """Score the texts the cache lacks, append them to it, and return the cache.

    The commit protocol makes an append all or nothing, and a repeated run only scores what is
    still missing.
    """
    texts = news.select(column).where(F.col(column).isNotNull()).distinct()
    if is_built(spark, cache_path):
        texts = unscored_texts(news, spark.read.parquet(cache_path), column)
    score(texts, column).write.mode("append").option("compression", "zstd").parquet(cache_path)
    return spark.read.parquet(cache_path)


def compact_scores(spark: SparkSession, chunks: list[DataFrame], path: str, column: str) -> DataFrame:
    """Union score tables by name into a new path, ordered by text."""
    merged = chunks[0]
    for chunk in chunks[1:]:
        merged = merged.unionByName(chunk, allowMissingColumns=True)
    ordered = merged.repartitionByRange(column).sortWithinPartitions(column)
    ordered.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
