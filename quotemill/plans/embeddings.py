"""News embeddings as features: means per symbol and window, and components fitted on the training days alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.session import staged


def daily_vectors(articles: DataFrame, vector: str, dim: int, time: str = "published_at") -> DataFrame:
    """Per symbol and day, the number of articles with a vector and the sums ``_sum_0 ...`` of its entries.

    One aggregate per entry: the rows of a day are combined inside the tasks, and no row is exploded.
    """
    usable = articles.where((F.size(vector) == dim) & F.col("symbol").isNotNull() & F.col(time).isNotNull())
    sums = [F.sum(F.get(vector, F.lit(i)).cast("double")).alias(f"_sum_{i}") for i in range(dim)]
    return usable.groupBy("symbol", F.to_date(time).alias("date")).agg(F.count(F.lit(1)).alias("_n"), *sums)


def window_means(daily: DataFrame, dim: int, days: int) -> DataFrame:
    """Per symbol and day with news: ``news_count`` and ``embedding``, the mean over the days up to and with this one."""
    window = Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    n = F.sum("_n").over(window)
    entries = [(F.sum(f"_sum_{i}").over(window) / n).alias(f"_mean_{i}") for i in range(dim)]
    means = daily.select("symbol", "date", n.alias("news_count"), *entries)
    return means.select("symbol", "date", "news_count", F.array(*[f"_mean_{i}" for i in range(dim)]).alias("embedding"))


def news_embeddings(articles: DataFrame, vector: str, dim: int, days: int, time: str = "published_at") -> DataFrame:
    return window_means(daily_vectors(articles, vector, dim, time), dim, days)


@dataclass(frozen=True)
class Projection:
    """Mean and leading axes (columns) of the vectors of the training days, and their shares of the variance."""

    mean: np.ndarray
    axes: np.ndarray
    explained: list[float]

    def columns(self, vector: str, prefix: str = "component") -> list[Column]:
        """The coordinates of a vector, one column each; null for a null vector."""
        out = []
        for k in range(self.axes.shape[1]):
            start = float(self.mean @ self.axes[:, k])
            weights = F.array(*[F.lit(float(w)) for w in self.axes[:, k]])
            product = F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            out.append((product - start).alias(f"{prefix}_{k + 1}"))
        return out

    def transform(self, df: DataFrame, vector: str = "embedding", prefix: str = "component") -> DataFrame:
        """The rows with their coordinates; the vector is left out."""
        return df.select(*[c for c in df.columns if c != vector], *self.columns(vector, prefix))


def fit_projection(train: DataFrame, k: int, vector: str = "embedding") -> Projection:
    """Principal axes of the rows it is given, which must be those of the training split."""
    rows = staged(train.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector)).alias("_v"), vector), "projection")
    dim = rows.agg(F.max(F.size(vector))).first()[0]
    if dim is None:
        raise ValueError("there is no training row with a vector")
    fitted = PCA(k=min(k, dim), inputCol="_v", outputCol="_p").fit(rows)
    means = rows.agg(*[F.avg(F.get(vector, F.lit(i))) for i in range(dim)]).first()
    return Projection(np.array(means, dtype=float), fitted.pc.toArray(), [float(e) for e in fitted.explainedVariance])


def split_projection(df: DataFrame, train_end, k: int, vector: str = "embedding", date: str = "date") -> DataFrame:
    """All rows in the components of the rows before ``train_end``, with the split they belong to.

    Components need two training vectors; with fewer, as in a table whose days are all flooded, they are null for every row.
    """
    is_train = F.col(date) < F.lit(train_end)
    rows = df.withColumn("split", F.when(is_train, "train").otherwise("test"))
    train = df.where(is_train & F.col(vector).isNotNull())
    if train.limit(2).count() < 2:
        unknown = [F.lit(None).cast("double").alias(f"component_{i + 1}") for i in range(k)]
        return rows.select(*[c for c in rows.columns if c != vector], *unknown)
    return fit_projection(train, k, vector).transform(rows, vector)


def with_news_components(rows: DataFrame, components: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Rows with the components of their symbol and day: 0 without news, next to the count and a marker."""
    names = [c for c in components.columns if c.startswith("component_")]
    joined = rows.join(components.select(*keys, "news_count", *names), list(keys), "left")
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in names]
    missing = F.col("news_count").isNull().cast("bigint").alias("no_news")
    return joined.select(*rows.columns, F.coalesce("news_count", F.lit(0)).cast("bigint").alias("news_count"), missing, *filled)
