"""Quality rules: fixed basic rules, then limits taken from each language's and source's own documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.text import pieces, renamed, schema_with, stage, texts_of, with_columns, without

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# A sketch bucket is as wide as 2 % of its values; smaller values than SMALLEST count as zero.
GAMMA = 1.02
SMALLEST = 1e-4
# Groups with fewer documents take the limits of their language.
MIN_GROUP = 100
# By metric: quartile distances from the median that are normal, and slack below and above. The slack
# keeps short clean texts, whose ratios scatter, inside the limits of very even groups.
REACH = 3.0
SLACK = {"mean_word": (2.5, 4.5), "symbol_ratio": (math.inf, 0.1), "dup_line_ratio": (math.inf, 0.5)}


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of five words that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= size:
        return 0
    index: dict[bytes, int] = {}
    a = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    # Windows get numbers that are equal where their words are: two words, four words, then five.
    _, two = np.unique(a[:-1] * len(index) + a[1:], return_inverse=True)
    _, four = np.unique(two[:-2] * n + two[2:], return_inverse=True)
    _, five, times = np.unique(four[: n - 4] * len(index) + a[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[five] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_stats(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The five statistics, and the lines that hold a word."""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(joined) if joined.isascii() else len(joined.decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents plus the five statistics and ``n_lines_with_words``, of whole texts."""
    names = (*STATS, "n_lines_with_words")
    docs = without(docs, *names)

    def measured(batches):
        for batch in pieces(batches):
            rows = [text_stats(t) for t in texts_of(batch, text_col)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield with_columns(batch, **{n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    return docs.mapInArrow(measured, schema_with(docs, **{n: T.LongType() for n in names}))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _metrics():
    return {
        "mean_word": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines_with_words"), F.lit(1)),
    }


def sketches(measured: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Quantile sketches of the documents that pass the basic rules: counts by logarithmic bucket.

    Sketches merge by adding counts, in any order and with the same result, so partial sketches are
    combined before the shuffle and a language's sketch is the sum of its sources'.
    """
    bucket = F.when(F.col("value") < SMALLEST, F.lit(None)).otherwise(F.ceil(F.log(F.col("value")) / math.log(GAMMA)))
    return (
        measured.filter(~base_failed())
        .select(
            F.coalesce(F.col(lang_col), F.lit("")).alias("__lang"),
            F.coalesce(F.col(source_col), F.lit("")).alias("__source"),
            F.explode(F.create_map(*[x for n, v in _metrics().items() for x in (F.lit(n), v)])).alias("metric", "value"),
        )
        .groupBy("__lang", "__source", "metric", bucket.cast("int").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def limits_of(cells: DataFrame, group: list[str]) -> DataFrame:
    """Lowest and highest accepted value of each metric by group, one row a group."""
    keys = [*group, "metric"]
    # Any value of a bucket is within 1 % of this one; zero sorts first.
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    merged = cells.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    whole, running = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    ranked = merged.select(
        *keys, value.alias("value"), F.sum("n").over(running).alias("upto"), F.sum("n").over(whole).alias("total")
    )
    at = {q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value"))) for q in (0.25, 0.5, 0.75)}
    quartiles = ranked.groupBy(*keys).agg(
        F.max("total").alias("total"), *[v.alias(f"q{int(100 * q)}") for q, v in at.items()]
    )
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (below, above) in SLACK.items():
        here = F.col("metric") == name
        if below < math.inf:
            low = F.when(here, F.col("q50") - REACH * (F.col("q75") - F.col("q50")) - below).otherwise(low)
        high = F.when(here, F.col("q50") + REACH * (F.col("q50") - F.col("q25")) + above).otherwise(high)
    bounds = quartiles.select(*group, "metric", "total", low.alias("low"), high.alias("high"))
    picked = [
        F.max(F.when(F.col("metric") == n, F.col(side))).alias(f"__{n}_{side}") for n in SLACK for side in ("low", "high")
    ]
    return bounds.groupBy(*group).agg(F.max("total").alias("__total"), *picked)


def adaptive_limits(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per language and source: its own limits, or its language's where it has few documents."""
    cells = stage(sketches(measured, lang_col, source_col), "quality-sketches")
    own, common = limits_of(cells, ["__lang", "__source"]), limits_of(cells, ["__lang"])
    names = [f"__{n}_{side}" for n in SLACK for side in ("low", "high")]
    wide = common.select("__lang", *[F.col(n).alias(f"{n}_lang") for n in names])
    enough = F.col("__total") >= MIN_GROUP
    return own.join(wide, "__lang").select(
        "__lang", "__source", *[F.when(enough, F.col(n)).otherwise(F.col(f"{n}_lang")).alias(n) for n in names]
    )


def judge(measured: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Measured documents plus ``base_failed`` and ``kept``."""
    names = [f"__{n}_{side}" for n in SLACK for side in ("low", "high")]
    inside = F.lit(True)
    for name, value in _metrics().items():
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        inside &= (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))
    joined = (
        without(measured, "base_failed", "kept")
        .withColumn("__lang", F.coalesce(F.col(lang_col), F.lit("")))
        .withColumn("__source", F.coalesce(F.col(source_col), F.lit("")))
        .join(limits, ["__lang", "__source"], "left")
    )
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside}).drop(
        "__lang", "__source", *names
    )


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """One row per document: id, language, source, the statistics, ``base_failed`` and ``kept``.

    A document fails the basic rules with fewer than 10 words or when more than 20 % of its words stand in
    repeated five-word windows. Mean word length, symbols per word and the share of repeated lines must then
    lie within limits around the median of the same language and source (see SLACK and REACH). A null text
    has no words and fails; a null language or source is the group of the empty string; rows that repeat an
    id are judged each. With no documents there are no limits and no rows.
    """
    measured = stage(measure(docs.select(id_col, lang_col, source_col, text_col), text_col).drop(text_col), "quality-stats")
    return judge(measured, adaptive_limits(measured, lang_col, source_col), lang_col, source_col)


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that ``quality_verdicts`` keeps, with their own columns only."""
    inner, place = renamed(docs)
    text, lang, source = place[text_col], place[lang_col], place[source_col]
    measured = measure(inner, text)
    stats = stage(measure(inner.select(text, lang, source), text).drop(text), "quality-stats")
    kept = judge(measured, adaptive_limits(stats, lang, source), lang, source).filter("kept")
    return kept.select(*place.values()).toDF(*docs.columns)
