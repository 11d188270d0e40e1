"""Order statistics and as-of joins of bounded, whole and cut groups against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import asof, buckets, calendar, joins
from quotemill.plans import evaluation, experiments

# Declared bounded, small enough for one range, and cut.
LIMITS = [buckets.BOUNDED, 1_000_000, 50]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are one value of one group."""
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame(
        {
            "k": np.arange(n),
            "g": np.where(rng.random(n) < 0.8, "hot", rng.integers(0, 20, n).astype(str)),
            "v": np.round(rng.normal(size=n), 3),
        }
    )
    pdf.loc[pdf.index % 3 == 0, ["g", "v"]] = ["hot", 0.125]
    pdf.loc[pdf.index % 17 == 0, "v"] = np.nan
    pdf["w"] = rng.random(n)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k bigint, g string, v double, w double")
    return df, pdf


@pytest.mark.parametrize("limit", LIMITS)
def test_average_ranks(skewed, limit):
    df, pdf = skewed
    out = buckets.with_average_ranks(df, ["g"], {"r": "v", "s": "w"}, rows_per_bucket=limit)
    out = out.toPandas().sort_values("k")
    for name, source in (("r", "v"), ("s", "w")):
        np.testing.assert_allclose(out[name].astype(float), pdf.groupby("g")[source].rank())
    pct = buckets.with_pct_rank(df, ["g"], "v", "p", rows_per_bucket=limit).toPandas().sort_values("k")
    np.testing.assert_allclose(pct.p.astype(float), pdf.groupby("g").v.rank(pct=True))


@pytest.mark.parametrize("limit", LIMITS)
def test_medians_and_quantiles(skewed, limit):
    df, pdf = skewed
    medians = buckets.group_medians(df, ["g"], {"mv": "v", "mw": "w"}, limit).toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(medians[["mv", "mw"]].astype(float), pdf.groupby("g")[["v", "w"]].median())
    levels = [0.0, 0.1, 0.35, 1.0]
    found = buckets.group_quantiles(df, ["g"], "w", levels, limit).toPandas().set_index("g").sort_index()
    expected = pdf.groupby("g").w.quantile(levels).unstack()
    np.testing.assert_allclose(np.stack(found.quantiles), expected, rtol=1e-12)


@pytest.fixture(scope="module")
def odd(spark):
    """Null groups, groups without a value, null values, and numbers that doubles cannot tell apart."""
    rows = [
        ("a", 2**53), ("a", 2**53 + 1), ("a", None), ("a", 2**53 + 1), (None, 5), (None, 7), (None, None), ("b", None), ("b", None),
        ("c", 1),
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k bigint, g string, v bigint")


@pytest.mark.parametrize("limit", [*LIMITS, 1])
def test_nulls_and_large_numbers(odd, limit):
    ranks = {r.k: r.r for r in buckets.with_average_ranks(odd, ["g"], {"r": "v"}, rows_per_bucket=limit).collect()}
    assert ranks == {0: 1.0, 1: 2.5, 2: None, 3: 2.5, 4: None, 5: None, 6: None, 7: None, 8: None, 9: 1.0}
    share = {r.k: r.p for r in buckets.with_pct_rank(odd, ["g"], "v", "p", rows_per_bucket=limit).collect()}
    assert share[0] == pytest.approx(1 / 3) and share[9] == 1 and share[4] is None
    medians = {r.g: r.m for r in buckets.group_medians(odd, ["g"], {"m": "v"}, limit).collect()}
    assert medians == {"a": float(2**53 + 1), None: 6.0, "b": None, "c": 1.0}
    quantiles = {r.g: r.quantiles for r in buckets.group_quantiles(odd, ["g"], "v", [0.0, 0.5, 1.0], limit).collect()}
    assert quantiles[None] == [5.0, 6.0, 7.0] and quantiles["c"] == [1.0, 1.0, 1.0]
    assert quantiles["b"] in (None, [None] * 3)
    places = buckets.hashed_positions(odd, ["g"], ["k"], 3, "at", limit).collect()
    assert len(places) == 10
    for group, n in (("a", 4), (None, 3), ("b", 2), ("c", 1)):
        assert sorted(r["at"] for r in places if r.g == group) == list(range(n))


@pytest.mark.parametrize("limit", [*LIMITS, 1])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join_of_nulls(spark, limit, direction):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 5), (4, "b", 5)], "id bigint, s string, t bigint")
    right = spark.createDataFrame([("a", 5, 50), ("a", None, 1), (None, 5, 2), ("a", 9, 90)], "s string, u bigint, v bigint")
    out = asof.asof_join(left, right, "t", "u", ["s"], {"found": "v"}, direction, rows_per_bucket=limit)
    assert {r.id: r.found for r in out.collect()} == {1: 50, 2: None, 3: None, 4: None}


def test_groups_larger_than_one_step_are_cut_twice(spark, monkeypatch):
    monkeypatch.setattr(buckets, "CUTS_PER_STEP", 3)
    df = spark.range(2000).selectExpr("'g' g", "id * 7919 % 2003 v", "1 _n")
    sizes = buckets.in_ranges(df, ["g"], "v", 50).groupBy("_bucket").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    rows = sizes.orderBy("_bucket").collect()
    assert len(rows) > 8 and all(x.b < y.a for x, y in zip(rows, rows[1:], strict=False))
    ranks = buckets.with_average_ranks(df, ["g"], {"r": "v"}, rows_per_bucket=50).orderBy("v").collect()
    assert [r.r for r in ranks] == [float(i + 1) for i in range(2000)]


def test_binary_search_of_cuts(spark):
    rows = [(list(range(0, 2 * n, 2)), v) for n in (0, 1, 2, 7, 100, 1023) for v in (-1, 0, 1, 5, n, 2 * n - 2, 2 * n)]
    df = spark.createDataFrame([*rows, (None, 3)], "cuts array<bigint>, v bigint")
    found = df.withColumn("b", buckets.bucket_of(F.col("cuts"), F.col("v"))).collect()
    assert all(r.b == sum(c < r.v for c in r.cuts or []) for r in found) and len(found) == len(rows) + 1


def test_counting_narrows_a_large_group(spark):
    # A class of a million rows with half of them equal: the places are found without ordering it.
    df = spark.range(1_000_000).selectExpr(
        "if(id % 10 = 0, 'b', 'a') g", "if(id % 2 = 0, 0.25D, pow(10D, -(id % 300)) * (1 + id % 1009 / 1009)) v", "cast(id % 77777 as float) w"
    )
    levels = [0.0, 0.1, 0.5, 0.73, 0.999, 1.0]
    found = buckets.group_quantiles(df, ["g"], "v", levels, 1000).toPandas().set_index("g").sort_index()
    pdf = df.toPandas()
    expected = pdf.groupby("g").v.quantile(levels).unstack()
    np.testing.assert_allclose(np.stack(found.quantiles), expected, rtol=1e-12, atol=0)
    medians = buckets.group_medians(df, ["g"], {"v": "v", "w": "w"}, 1000).toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(medians[["v", "w"]].astype(float), pdf.groupby("g")[["v", "w"]].median(), rtol=1e-12)


def test_middle_of_single_precision_numbers(spark):
    # Their sum in single precision would be rounded once more than their mean is.
    df = spark.createDataFrame([(0.1,), (0.7000001,)], "v float").withColumn("g", F.lit(1))
    whole, cut = (buckets.group_medians(df, ["g"], {"m": "v"}, limit).first().m for limit in (buckets.BOUNDED, 1))
    assert whole == cut == (float(np.float32(0.1)) + float(np.float32(0.7000001))) / 2


def test_columns_of_several_types_are_ranked_together(spark, skewed):
    df, pdf = skewed
    df = df.withColumn("x", F.col("k").cast("string")).withColumn("y", F.col("w").cast("float"))
    out = buckets.with_average_ranks(df, ["g"], {"v": "v", "rk": "k", "rw": "w", "rx": "x", "ry": "y"}, pct=True, rows_per_bucket=50)
    assert sorted(out.columns) == sorted([*df.columns, "rk", "rw", "rx", "ry"])
    out = out.toPandas().sort_values("k").reset_index(drop=True)
    pdf = pdf.assign(x=pdf.k.astype(str), y=pdf.w.astype("float32"))
    for name, source in (("v", "v"), ("rk", "k"), ("rw", "w"), ("rx", "x"), ("ry", "y")):
        np.testing.assert_allclose(out[name].astype(float), pdf.groupby("g")[source].rank(pct=True))


def test_no_task_orders_a_hot_group(spark, skewed):
    df, _ = skewed
    distinct = df.where("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = buckets.cut_points(distinct, ["g"], "v", 50)
    sizes = (
        distinct.join(cuts, ["g"], "left")
        .withColumn("b", buckets.bucket_of(F.col("_cuts"), F.col("v")))
        .groupBy("g", "b")
        .count()
    )
    assert sizes.agg(F.max("count")).first()[0] <= 120
    assert sizes.where("g = 'hot'").count() > 10


def test_quantile_bucket_is_not_ntile(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.2, 0.21, 1.0)], "p double")
    found = [r[0] for r in df.select(buckets.quantile_bucket("p", 5)).collect()]
    assert found == [1, 1, 2, 5]


@pytest.mark.parametrize("limit", LIMITS)
def test_hashed_positions_are_a_permutation(skewed, limit):
    df, pdf = skewed
    out = buckets.hashed_positions(df, ["g"], ["k"], 1, "at", limit).toPandas()
    for _, group in out.groupby("g"):
        assert sorted(group["at"]) == list(range(len(group)))
    again = buckets.hashed_positions(df, ["g"], ["k"], 1, "at").toPandas()
    assert out.set_index("k")["at"].sort_index().equals(again.set_index("k")["at"].sort_index())


def test_shuffle_within_date_is_a_seeded_permutation(spark, skewed):
    _, pdf = skewed
    df = spark.createDataFrame(pdf[["k", "w"]].assign(date=pdf.g, symbol=pdf.k.astype(str)), "k bigint, w double, date string, symbol string")
    moved = experiments.shuffle_within_date(df, ["w"], 3).toPandas()
    assert len(moved) == len(pdf)
    before = pdf.groupby("g").w.apply(sorted)
    assert before.equals(moved.groupby("date").w.apply(sorted).rename_axis("g").rename("w"))
    joined = moved.merge(pdf[["k", "w"]], on="k")
    assert (joined.w_x == joined.w_y).mean() < 0.2
    other = experiments.shuffle_within_date(df, ["w"], 4).toPandas()
    assert not other.sort_values("k").w.reset_index(drop=True).equals(moved.sort_values("k").w.reset_index(drop=True))


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, limit, direction, strict):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"s": rng.choice(["hot", "hot", "hot", "b", "c"], 800), "t": rng.integers(0, 500, 800), "id": range(800)})
    right = pd.DataFrame({"s": rng.choice(["hot", "hot", "b"], 300), "u": rng.integers(0, 500, 300)})
    right = right.drop_duplicates().assign(value=lambda d: d.u * 10.0)
    out = asof.asof_join(
        spark.createDataFrame(left), spark.createDataFrame(right), "t", "u", ["s"], {"found": "value"},
        direction, strict, rows_per_bucket=limit,
    ).toPandas().sort_values("id")
    expected = pd.merge_asof(
        left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="s",
        direction=direction, allow_exact_matches=not strict,
    ).sort_values("id")
    assert len(out) == len(left)
    np.testing.assert_array_equal(out.found.astype(float), expected.value.astype(float))


def test_asof_rejects_unknown_direction(spark):
    df = spark.range(1).selectExpr("id s", "id t")
    with pytest.raises(ValueError):
        asof.asof_join(df, df, "t", "t", ["s"], {"x": "t"}, "nearest")


def test_next_trading_day(spark):
    # Friday, Monday, Wednesday.
    days = ["2024-01-05", "2024-01-08", "2024-01-10"]
    prices = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("cast(d as timestamp_ntz) date")
    trading = calendar.trading_calendar(prices)

    def lookup(same_day):
        rows = calendar.next_trading_days(trading, "2024-01-03", same_day).collect()
        return {str(r.news_day): r.day_idx for r in rows}

    after, same = lookup(False), lookup(True)
    assert after == {
        "2024-01-03": 1, "2024-01-04": 1, "2024-01-05": 2, "2024-01-06": 2, "2024-01-07": 2,
        "2024-01-08": 3, "2024-01-09": 3,
    }
    assert same == {
        "2024-01-03": 1, "2024-01-04": 1, "2024-01-05": 1, "2024-01-06": 2, "2024-01-07": 2,
        "2024-01-08": 2, "2024-01-09": 3, "2024-01-10": 3,
    }


def test_one_to_one_join_is_checked(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "s string, x int")
    two = spark.createDataFrame([("a", 1), ("a", 2)], "s string, y int")
    assert joins.left_join_one_to_one(one, two.limit(1), ["s"]).count() == 2
    with pytest.raises(joins.DuplicateKeysError):
        joins.left_join_one_to_one(one, two, ["s"])


def test_missing_text_matches_nothing(spark):
    left = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, text string")
    right = spark.createDataFrame([("x", 0.5), (None, 9.0)], "text string, score double")
    rows = joins.left_join_on_text(left, right, "text", ["id"]).orderBy("id").collect()
    assert [(r.id, r.score) for r in rows] == [(1, 0.5), (2, None), (3, None)]


@pytest.mark.parametrize("limit", LIMITS)
def test_rank_ic_and_calibration(spark, limit):
    rng = np.random.default_rng(2)
    n = 2000
    p = rng.dirichlet([2, 3, 2], n).round(3)
    pdf = pd.DataFrame(
        {
            "date": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 8, n), "D"),
            "score": rng.normal(size=n).round(1),
            "forward_return": rng.normal(size=n),
            "label": rng.choice(["DOWN", "HOLD", "UP"], n),
            "p_down": p[:, 0], "p_hold": p[:, 1], "p_up": p[:, 2],
        }
    )
    df = spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("timestamp_ntz"))
    ics = evaluation.rank_ic(df, "score", "forward_return", min_rows=50, rows_per_bucket=limit).toPandas()
    expected = pdf.groupby("date").apply(
        lambda d: d.score.rank().corr(d.forward_return.rank()), include_groups=False
    )
    np.testing.assert_allclose(ics.sort_values("date").ic, expected, rtol=1e-9)
    errors = evaluation.calibration_error(df, rows_per_bucket=limit).toPandas().set_index("rating").ece
    for i, name in enumerate(["DOWN", "HOLD", "UP"]):
        values = pdf[f"p_{name.lower()}"]
        bins = pd.qcut(values, 10, labels=False, duplicates="drop")
        gap = (values.groupby(bins).mean() - (pdf.label == name).groupby(bins).mean()).abs()
        assert errors[name] == pytest.approx((gap * values.groupby(bins).size()).sum() / n, rel=1e-9)


def test_small_groups_have_no_ic(spark):
    df = spark.createDataFrame([("d", float(i), float(i)) for i in range(10)], "date string, a double, b double")
    assert evaluation.rank_ic(df, "a", "b", min_rows=11).count() == 0
    assert evaluation.rank_ic(df, "a", "b", min_rows=10).first()["ic"] == pytest.approx(1.0)
