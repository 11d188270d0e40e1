"""Mixing sources: temper their token shares, then visit each source in blocks of permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.text import release, renamed, stage

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 4.0
BLOCKS = 64
SEED = 17
# The exponent is searched among the multiples of 1 / STEPS; every job narrows the bracket by WAYS.
STEPS = 2**40
WAYS = 32
# Readings that are short of a whole number by less than this part of it are whole.
MARGIN = 1e-9
ROWS_PER_RANGE = 20_000
# Up to so many sources travel to every task as a small table; with more, rows are dealt out by source and salt.
FEW_SOURCES = 10_000
SALTS = 64
PLACES = float(2**60)


def token_count(text: Column) -> Column:
    """Words separated by ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(epoch: Column, key: Column, seed: int = SEED) -> Column:
    """Where the permutation of an epoch puts a row: 60 hashed bits as a whole number."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def solve_exponent(
    sources: DataFrame, budget: float | None, max_repeats: float | None, target_entropy: float | None
) -> float:
    """The smallest exponent in [0, 1] whose weights keep the limits, or 1 if none does.

    ``sources`` has one row per source with ``n_tokens`` above 0. Both the entropy of the weights and the
    repeats of the most repeated source fall as the exponent grows, so bisection finds it. Each job tries
    several cuts of the bracket and returns two sums a cut.
    """
    n = F.col("n_tokens").cast("double")
    least, most = sources.agg(F.min(n), F.max(n)).first()
    if least is None:
        return 1.0

    def holds(cuts: list[int]) -> list[bool]:
        sums = []
        for cut in cuts:
            power = F.pow(n, F.lit(cut / STEPS))
            sums += [F.sum(power), F.sum(power * F.log(n))]
        row = sources.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        out = []
        for i, cut in enumerate(cuts):
            alpha, total, logs = cut / STEPS, row[2 * i], row[2 * i + 1]
            entropy = math.log(total) - alpha * logs / total
            repeats = (budget / total if budget else most ** (1 - alpha)) * least ** (alpha - 1)
            # Up to rounding: a step of the exponent changes the repeats by more.
            fits = max_repeats is None or repeats <= max_repeats * (1 + 1e-15)
            out.append(fits and (target_entropy is None or entropy <= target_entropy + 1e-12))
        return out

    low, high = 0, STEPS
    if holds([0])[0]:
        return 0.0
    while high - low > 1:
        cuts = sorted({low + (high - low) * i // WAYS for i in range(1, WAYS)} - {low, high}) or [(low + high) // 2]
        for cut, good in zip(cuts, holds(cuts), strict=True):
            if good:
                high = cut
                break
            low = cut
    return high / STEPS


def source_weights(
    tokens: DataFrame,
    budget: float | None = None,
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
) -> DataFrame:
    """One row per source: ``n_docs, n_tokens, weight, budget, whole_blocks, rest``.

    ``tokens`` has ``source, n_tokens``, one row per document. Weights are token shares to the power of the
    solved exponent, normalised. Without a ``budget`` in tokens, the smallest is taken for which every source
    is read in full at least once. ``whole_blocks`` full permutations fit into a source's budget, ``rest``
    tokens are left for the start of one more. Sources without tokens get one block.
    """
    sums = stage(
        tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "mix-sources"
    )
    filled = sums.filter("n_tokens > 0")
    alpha = solve_exponent(filled, budget, max_repeats, target_entropy)
    n, any_tokens = F.col("n_tokens").cast("double"), F.col("n_tokens") > 0
    total, most = filled.agg(F.sum(F.pow(n, F.lit(alpha))), F.max(n)).first()
    total, most = total or 1.0, most or 1.0
    whole = budget or most ** (1 - alpha) * total
    weight = F.when(any_tokens, F.pow(n, F.lit(alpha)) / total).otherwise(0.0)
    # Rounded, so that sums taken in another order give the same whole numbers.
    spend = F.when(any_tokens, F.round(weight * F.lit(whole), 3)).otherwise(0.0)
    blocks = F.when(any_tokens, F.floor(F.col("budget") / F.col("n_tokens") * (1 + MARGIN))).otherwise(1).cast("int")
    rest = F.floor(F.col("budget") - F.col("whole_blocks") * F.col("n_tokens")).cast("long")
    plan = sums.select("*", weight.alias("weight"), spend.alias("budget"))
    return stage(plan.withColumn("whole_blocks", blocks).withColumn("rest", F.greatest(rest, F.lit(0))), "mix-plan")


def with_sources(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Join rows with the table of sources, one row each, so that a source with most of the rows is not one task's.

    A table that is small by its own count is broadcast. A larger one is copied once for each salt, and
    rows take their salt from the hash of ``key``.
    """
    if sources.count() <= FEW_SOURCES:
        return rows.join(F.broadcast(sources), "source")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    copies = sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["source", "salt"]).drop("salt")


def last_places(tokens: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Per source the last place of its partial block: ``source, last``, or no row if nothing fits.

    Tokens are first summed over ranges of places, whose number follows the size of the source; only the
    one range where the rest runs out is looked at row by row. The ranges before it give their last place with
    their sums. No task orders a whole source.
    """
    plan = plan.select("source", "whole_blocks", "rest", F.ceil(F.col("n_docs") / ROWS_PER_RANGE).alias("n_ranges"))
    place = place_of(F.col("whole_blocks"), F.col("id"), seed)
    placed = with_sources(tokens, plan, "id").select("source", "rest", "n_ranges", "n_tokens", place.alias("place"))
    number = F.floor(F.col("place") / F.lit(PLACES) * F.col("n_ranges")).cast("long")
    placed = stage(placed.select("source", "rest", "n_tokens", "place", number.alias("range")), "mix-places")
    sums = placed.groupBy("source", "range").agg(
        F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.max("place").alias("last")
    )
    ranges = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("upto", F.sum("n").over(ranges)).withColumn("before", F.col("upto") - F.col("n"))
    sums = stage(sums.withColumn("last", F.max("last").over(ranges.rowsBetween(Window.unboundedPreceding, -1))), "mix-ranges")
    over = sums.filter("upto > rest").groupBy("source").agg(F.min(F.struct("range", "before", "last")).alias("cut"))
    cut = stage(over.select("source", "cut.*"), "mix-cuts")
    rows = placed.join(cut.select("source", "range", "before"), ["source", "range"])
    # Documents at the same place are peers: all of them fit or none.
    fits = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place")) + F.col("before") <= F.col("rest")
    here = rows.withColumn("fits", fits).filter("fits").select("source", F.col("place").alias("last"))
    earlier = cut.filter("last IS NOT NULL").select("source", "last")
    last = stage(here.union(earlier).groupBy("source").agg(F.max("last").alias("last")), "mix-last")
    release(placed, sums)
    return last


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: float | None = None,
    max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None,
    n_blocks: int = BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """The documents of a tempered mixture: their own columns plus ``epoch``, ``block`` and ``place``.

    Every source is read in epochs, each a permutation of all its documents, until its budget is spent
    (see ``source_weights``). ``epoch`` counts the permutations, ``place`` orders one. ``block`` cuts every
    source's reading into ``n_blocks`` parts of equal length, so each block holds the sources at their
    weights; reading blocks in order, and rows by ``place`` within one, gives the mixture. Without a
    ``budget`` every document occurs at least once and at most ``max_repeats`` + 1 times.

    A null source is the source "". Null and empty texts have no tokens and go with the others of their
    source; a source without any tokens is read once. Rows that repeat an id share their places. Without
    documents there are no rows. Columns named like the three results are replaced.
    """
    inner, names = renamed(docs)
    source = F.coalesce(F.col(names[source_col]).cast("string"), F.lit(""))
    key = F.col(names[id_col])
    tokens = stage(
        inner.select(source.alias("source"), key.alias("id"), token_count(F.col(names[text_col])).alias("n_tokens")),
        "mix-tokens",
    )
    plan = source_weights(tokens, budget, max_repeats, target_entropy)
    last = last_places(tokens, plan, seed)
    # The budget in epochs, at least one so that a source without tokens is spread over all blocks as well.
    length = F.when(F.col("n_tokens") > 0, F.col("budget") / F.col("n_tokens")).otherwise(1.0)
    readings = stage(
        plan.join(last, "source", "left").select("source", "whole_blocks", "last", length.alias("length")), "mix-readings"
    )
    release(tokens)
    rows = with_sources(inner.withColumn("source", source), readings, names[id_col])
    partial = place_of(F.col("whole_blocks"), key, seed) <= F.col("last")
    epochs = F.expr("sequence(0, whole_blocks)")
    epochs = F.when(F.coalesce(partial, F.lit(False)), epochs).otherwise(F.slice(epochs, 1, F.col("whole_blocks")))
    rows = rows.withColumn("epoch", F.explode(epochs)).withColumn("place", place_of(F.col("epoch"), key, seed))
    block = F.floor((F.col("epoch") + F.col("place") / F.lit(PLACES)) / F.col("length") * n_blocks)
    block = F.least(block, F.lit(n_blocks - 1)).cast("int")
    rows = rows.withColumn("block", block)
    own = [c for c in docs.columns if c.lower() not in ("epoch", "block", "place")]
    return rows.select(*[F.col(names[c]) for c in own], "epoch", "block", "place").toDF(*own, "epoch", "block", "place")
