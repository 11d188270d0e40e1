"""Order statistics of groups of any size.

A window over a group puts the whole group into one task. Here a group is reduced to its distinct
values with their counts, so a value that repeats without end costs one row, and a group with many
distinct values is cut into value ranges, again and again while one is too large. Each range is ordered by itself,
and the ranges are chained by a prefix sum over the small table of range totals. The cut points come from a
sample drawn by hash, so they are the same on every recomputation. All columns that are ranked in the same groups share
one such pass.

Medians and quantiles order nothing but what lies next to them: counting passes narrow the interval around each of their
places until it holds few distinct values.

Callers whose groups are bounded by their definition, such as the symbols of one date, say so with
``rows_per_bucket=BOUNDED`` and get one window per group instead. That is a statement about the data
model, never a measurement. The results are the same either way:

- a null value has no rank, counts nowhere, and is no candidate for a median or quantile;
- rows of a null group have no rank; medians, quantiles and positions treat null as a group of its own;
- a group without any value keeps its row, with a null median or quantile.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.joins import join_null_safe
from quotemill.session import staged

# Groups bounded by definition are ordered whole.
BOUNDED = None
# Distinct values of one range, the sample the cut points come from, and the cuts of one step, one less than a power
# of two. So many steps number more ranges than there can be values.
ROWS_PER_BUCKET = 500_000
SAMPLE_PER_GROUP = 4_096
CUTS_PER_STEP = 1_023
STEPS = 6
# Tables of up to so many intervals, by count, are sent to every task.
FEW_INTERVALS = 100_000


def unit_hash(*columns) -> Column:
    """A hash of the columns, uniform on [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


# Places drawn by :func:`seeded_place` are below this.
PLACES = 2.0**60


def seeded_place(seed: int, *columns: str) -> Column:
    """A place drawn by a seeded hash of the columns: 60 bits of an MD5, which any SQL engine repeats."""
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def cut_points(
    distinct_values: DataFrame,
    by: Sequence[str],
    value: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    step: int = 0,
) -> DataFrame:
    """Per group with more than ``rows_per_bucket`` rows: sorted cut points ``_cuts``.

    ``distinct_values`` has one row per (group, value) and its multiplicity ``_n``. Each ``step`` draws another sample.
    """
    sizes = (
        distinct_values.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") > rows_per_bucket)
    )
    sample = (
        join_null_safe(distinct_values, sizes, list(by))
        .where(unit_hash(value, *by, F.lit(step)) < F.lit(float(SAMPLE_PER_GROUP)) / F.col("_size"))
        .groupBy(*by)
        .agg(F.collect_list(value).alias("_sample"), F.max("_size").alias("_size"))
    )
    wanted = F.ceil(F.col("_size") / F.lit(rows_per_bucket)).cast("int") - 1
    return sample.select(*by, spread_cuts(F.sort_array("_sample"), wanted).alias("_cuts"))


def spread_cuts(sample: Column, wanted: Column) -> Column:
    """At most ``wanted`` and CUTS_PER_STEP values at even distances of a sorted sample."""
    wanted = F.least(wanted, F.lit(CUTS_PER_STEP))
    position = lambda i: F.greatest(
        F.lit(1), F.ceil(i * F.size(sample) / (wanted + 1)).cast("int")
    )
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), wanted), lambda i: F.element_at(sample, position(i)))
    )


def bucket_of(cuts: Column, value: Column) -> Column:
    """Number of cut points below ``value``; 0 for groups that were not cut. A binary search."""
    strides = [F.lit(1 << k) for k in reversed(range((CUTS_PER_STEP + 1).bit_length() - 1))]
    step = lambda at, k: F.when(F.get(cuts, at + k - 1) < value, at + k).otherwise(at)
    return F.aggregate(F.array(*strides), F.lit(0), step)


def in_ranges(
    distinct_values: DataFrame, by: Sequence[str], value: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``_bucket``, the number of the value range in its group; 0 for groups that fit one.

    The input is as for :func:`cut_points`. What is still too large after a step is cut again. The result is stored.
    """
    placed = staged(distinct_values.withColumn("_bucket", F.lit(0).cast("bigint")), "ranges")
    keys = [*by, "_bucket"]
    for step in range(STEPS):
        # Samples cut unevenly: ranges up to twice the size are left.
        cuts = staged(cut_points(placed, keys, value, rows_per_bucket * min(step + 1, 2), step), "range-cuts")
        if cuts.isEmpty():
            break
        cut = join_null_safe(placed, cuts, keys, "left")
        number = F.col("_bucket") * (CUTS_PER_STEP + 1) + bucket_of(F.col("_cuts"), F.col(value))
        placed = staged(cut.withColumn("_bucket", number).drop("_cuts"), "ranges")
    return placed


def ranked_values(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per (group, distinct non-null value) with its place in the group.

    Adds ``_n`` (rows with the value), ``_before`` (rows with a smaller value) and ``_total``
    (non-null rows of the group).
    """
    by = list(by)
    # `_n > 0` always holds; it keeps the shuffled input of all uses identical, so it is reused.
    distinct_values = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 0)
    )
    placed = in_ranges(distinct_values, by, value, rows_per_bucket)
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy(*by, "_bucket")
        .agg(F.sum("_n").alias("_rows"))
        .select(
            *by,
            "_bucket",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(group).alias("_total"),
        )
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = placed.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return join_null_safe(counted, totals, [*by, "_bucket"]).select(
        *by, value, "_n", (F.col("_offset") + F.col("_inside")).alias("_before"), "_total"
    )


def average_rank() -> Column:
    """Average rank of tied rows, from the columns of :func:`ranked_values`."""
    return F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)


def with_average_ranks(
    df: DataFrame,
    by: Sequence[str],
    outputs: dict[str, str],
    pct: bool = False,
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the average-tie rank of each ``outputs[name]`` column within its ``by`` group.

    Values are compared in their own type. A null has no rank and does not count, and the rows of a
    null group have none. With ``pct`` the rank is divided by the number of non-null rows. Columns of one type are
    stacked, so that one pass over the value ranges ranks all of them, and one join gives the ranks back.
    """
    by = list(by)
    if rows_per_bucket is BOUNDED:
        return df.withColumns({name: _window_rank(by, c, pct) for name, c in outputs.items()})
    rows = staged(df.withColumn("_row", F.monotonically_increasing_id()), "rank-rows")
    same_type, others = _of_one_type(df, outputs)
    names = list(same_type)
    known = F.col("_value").isNotNull()
    for key in by:
        known = known & F.col(key).isNotNull()
    values = _stacked(rows, by, same_type).where(known)
    ranked = ranked_values(values, [*by, "_column"], "_value", rows_per_bucket)
    rank = average_rank() / F.col("_total") if pct else average_rank()
    ranked = ranked.select(*by, "_column", "_value", rank.alias("_rank"))
    # A row's own columns travel with its first value only. Nulls match nothing and stay out of the join.
    payload = F.struct(*[c for c in df.columns if c not in same_type]).alias("_payload")
    columns = dict.fromkeys(["_row", *by, *same_type.values()])
    entries = _stacked(rows.select(*columns, payload), by, same_type, "_row", "_payload")
    found = entries.where(known).join(ranked, [*by, "_column", "_value"]).select("_row", "_column", "_payload", "_rank")
    none = entries.where(~known).select("_row", "_column", "_payload", F.lit(None).cast("double").alias("_rank"))
    places = [F.max(F.when(F.col("_column") == i, F.col("_rank"))).alias(n) for i, n in enumerate(names)]
    out = found.unionByName(none).groupBy("_row").agg(F.first("_payload", True).alias("_payload"), *places)
    out = out.select("_payload.*", *names)
    if others:
        out = with_average_ranks(out, by, others, pct, rows_per_bucket)
    return out.select(*[c for c in df.columns if c not in outputs], *outputs)


def _of_one_type(df: DataFrame, outputs: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """The outputs whose columns have the type of the first one, and the others: values are compared in their type."""
    types = {name: df.select(c).schema[0].dataType for name, c in outputs.items()}
    first = next(iter(types.values()))
    return (
        {n: c for n, c in outputs.items() if types[n] == first},
        {n: c for n, c in outputs.items() if types[n] != first},
    )


def _stacked(df: DataFrame, by: Sequence[str], outputs: dict[str, str], *once: str) -> DataFrame:
    """One row ``(by, _column, _value)`` per output; columns named ``once`` are null but in the first."""
    row = [c for c in once if c == "_row"]
    once = [c for c in once if c != "_row"]
    items = [
        F.struct(
            F.lit(i).alias("_column"), F.col(c).alias("_value"),
            *[(F.col(o) if i == 0 else F.lit(None).cast(df.schema[o].dataType)).alias(o) for o in once],
        )
        for i, c in enumerate(outputs.values())
    ]
    return df.select(*row, *by, F.explode(F.array(*items)).alias("_item")).select(*row, *by, "_item.*")


def with_pct_rank(df: DataFrame, by: Sequence[str], value: str, out: str, **options) -> DataFrame:
    return with_average_ranks(df, by, {out: value}, pct=True, **options)


def group_medians(
    df: DataFrame,
    by: Sequence[str],
    outputs: dict[str, str],
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact median of each ``outputs[name]`` column, one row per group."""
    by = list(by)
    if rows_per_bucket is BOUNDED:
        return df.groupBy(*by).agg(*[F.median(c).alias(name) for name, c in outputs.items()])
    same_type, others = _of_one_type(df, outputs)
    middle = lambda n: [F.floor((n + 1) / F.lit(2)), F.floor((n + 2) / F.lit(2))]
    found = order_statistics(_stacked(df, by, same_type), [*by, "_column"], "_value", middle, rows_per_bucket)
    low, high = (F.get("_values", F.lit(i)).cast("double") for i in (0, 1))
    found = found.withColumn("_median", (low + high) / F.lit(2.0))
    medians = [F.max(F.when(F.col("_column") == i, F.col("_median"))).alias(n) for i, n in enumerate(same_type)]
    out = join_null_safe(df.select(*by).distinct(), found.groupBy(*by).agg(*medians), by, "left")
    if others:
        out = join_null_safe(out, group_medians(df, by, others, rows_per_bucket), by)
    return out.select(*by, *outputs)


def order_statistics(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    places: Callable[[Column], list[Column]],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The values at some places of each group's order: ``(by, _total, _values)``.

    ``places`` makes the places, counted from 1, from the number of non-null values, ``_total``; groups without any
    have no row. Each place starts with its whole group as interval. While one holds more than about
    ``rows_per_bucket`` distinct values, it is cut at the quantiles of a sample of them, the rows of all parts are
    counted, and the part that holds the place is its interval. Only what is left in the end is ordered. All counting is
    combined inside the tasks, so a group's rows never meet.
    """
    by = list(by)
    rows = staged(df.select(*by, F.col(value).alias("_value")).where(F.col("_value").isNotNull()), "selection")
    kind = rows.schema["_value"].dataType
    edges = [F.lit(None).cast(kind).alias("_low"), F.lit(None).cast(kind).alias("_high")]
    distinct = F.approx_count_distinct("_value").alias("_distinct")
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"), distinct)
    ranks = F.array(*[p.cast("bigint") for p in places(F.col("_total"))])
    # _below counts the rows of the group before the interval.
    targets = groups.select(
        *by, "_total", *edges, F.lit(0).cast("bigint").alias("_below"), "_distinct", F.posexplode(ranks).alias("_place", "_rank")
    )
    targets = staged(targets, "selection-targets")
    interval = [*by, "_low", "_high"]
    for step in range(STEPS):
        large = targets.where(F.col("_distinct") > rows_per_bucket)
        if large.isEmpty():
            break
        inside = _inside(rows, large.select(*interval, "_distinct").distinct(), by)
        drawn = unit_hash("_value", F.lit(step)) < F.lit(float(SAMPLE_PER_GROUP)) / F.col("_distinct")
        sample = inside.where(drawn).select(*interval, "_value").distinct()
        sample = sample.groupBy(*interval).agg(F.sort_array(F.collect_list("_value")).alias("_sample"))
        cuts = staged(sample.select(*interval, spread_cuts(F.col("_sample"), F.lit(CUTS_PER_STEP)).alias("_cuts")), "selection-cuts")
        counted = _inside(rows, cuts, by).withColumn("_bin", bucket_of(F.col("_cuts"), F.col("_value")))
        counted = counted.groupBy(*interval, "_bin").agg(F.count(F.lit(1)).alias("_n"), distinct)
        before = Window.partitionBy(*interval).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        parts = join_null_safe(counted, cuts, interval).withColumns(
            {
                "_new_low": F.coalesce(F.get("_cuts", F.col("_bin") - 1), F.col("_low")),
                "_new_high": F.coalesce(F.get("_cuts", F.col("_bin")), F.col("_high")),
            }
        )
        parts = parts.drop("_cuts", "_bin").withColumnRenamed("_distinct", "_new_distinct")
        below = F.col("_below") + F.col("_before")
        narrowed = join_null_safe(large, parts, interval).where((F.col("_rank") > below) & (F.col("_rank") <= below + F.col("_n")))
        narrowed = narrowed.select(
            *by, "_total", F.col("_new_low").alias("_low"), F.col("_new_high").alias("_high"), below.alias("_below"),
            F.col("_new_distinct").alias("_distinct"), "_place", "_rank",
        )
        targets = staged(targets.where(F.col("_distinct") <= rows_per_bucket).unionByName(narrowed), "selection-targets")
    left = _inside(rows, targets.select(*interval).distinct(), by).groupBy(*interval, "_value").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*interval).orderBy("_value"))
    left = left.withColumn("_upto", upto)
    rank = F.col("_rank") - F.col("_below")
    hits = join_null_safe(targets, left, interval).where((rank > F.col("_upto") - F.col("_n")) & (rank <= F.col("_upto")))
    values = F.transform(F.sort_array(F.collect_list(F.struct("_place", "_value"))), lambda v: v["_value"])
    return hits.groupBy(*by).agg(F.max("_total").alias("_total"), values.alias("_values"))


def _inside(rows: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """Each row with the intervals ``(by, _low, _high]`` it lies in; a null edge is open."""
    intervals = staged(intervals, "intervals")
    named = intervals.withColumnsRenamed({c: f"_right_{i}" for i, c in enumerate(by)})
    same = (F.col("_low").isNull() | (F.col("_value") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_value") <= F.col("_high")))
    for i, c in enumerate(by):
        same = F.col(c).eqNullSafe(F.col(f"_right_{i}")) & same
    if intervals.count() <= FEW_INTERVALS:
        named = F.broadcast(named)
    return rows.join(named, same).drop(*[f"_right_{i}" for i in range(len(by))])


def _window_rank(by: Sequence[str], column: str, pct: bool) -> Column:
    group = Window.partitionBy(*by)
    first = F.rank().over(group.orderBy(F.col(column).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
    rank = first + (ties - 1) / F.lit(2.0)
    if pct:
        rank = rank / F.count(column).over(group)
    ranked = F.col(column).isNotNull()
    for key in by:
        ranked = ranked & F.col(key).isNotNull()
    return F.when(ranked, rank)


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    fractions: Sequence[float],
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """Linearly interpolated quantiles per group, as the array ``quantiles``."""
    by = list(by)
    if rows_per_bucket is BOUNDED:
        levels = F.array(*[F.lit(float(f)) for f in fractions])
        return df.groupBy(*by).agg(F.percentile(value, levels).alias("quantiles"))
    place = lambda n, f: (n - 1) * F.lit(float(f))
    around = lambda n: [e(place(n, f)) + 1 for f in fractions for e in (F.floor, F.ceil)]
    found = order_statistics(df, by, value, around, rows_per_bucket)
    levels = []
    for i, fraction in enumerate(fractions):
        low, high = (F.get("_values", F.lit(k)).cast("double") for k in (2 * i, 2 * i + 1))
        at = place(F.col("_total"), fraction)
        levels.append(low + (high - low) * (at - F.floor(at)))
    found = found.select(*by, F.array(*levels).alias("quantiles"))
    return join_null_safe(df.select(*by).distinct(), found, by, "left")


def quantile_bucket(pct, n_buckets: int) -> Column:
    """Bucket 1..n of a percentile rank: its ceiling after scaling, clipped."""
    pct = F.col(pct) if isinstance(pct, str) else pct
    # least/greatest skip nulls, so a missing rank is kept missing explicitly.
    bucket = F.greatest(F.least(F.ceil(pct * n_buckets), F.lit(n_buckets)), F.lit(1))
    return F.when(pct.isNotNull(), bucket).cast("bigint")


def hashed_positions(
    df: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    seed: int,
    out: str,
    rows_per_bucket: int | None = ROWS_PER_BUCKET,
) -> DataFrame:
    """Position 0.. of each row in its group, in the order of a seeded hash of its key.

    The hash is uniform, so equal ranges of it cut a large group evenly; their number follows the
    group's size.
    """
    by, key = list(by), list(key)
    hashed = df.withColumn("_h", seeded_place(seed, *key))
    if rows_per_bucket is BOUNDED:
        whole = Window.partitionBy(*by).orderBy("_h", *key)
        return hashed.withColumn(out, (F.row_number().over(whole) - 1).cast("bigint")).drop("_h")
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_bucket)).alias("_slices"))
    unit = F.col("_h") / F.lit(PLACES)
    hashed = join_null_safe(hashed, sizes, by).withColumn(
        "_slice", F.least(F.floor(unit * F.col("_slices")), F.col("_slices") - 1)
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*by, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*by, "_slice").orderBy("_h", *key)
    numbered = hashed.withColumn("_row", F.row_number().over(inside) - 1)
    return (
        join_null_safe(numbered, offsets, [*by, "_slice"])
        .withColumn(out, (F.col("_offset") + F.col("_row")).cast("bigint"))
        .drop("_h", "_slices", "_slice", "_row", "_offset")
    )
