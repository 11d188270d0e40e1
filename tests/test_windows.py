"""Window operators against pandas, on series that cross blocks, parts and gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import ewm, rolling, series
from quotemill.operators.series import DAILY, Series, home_rows, numbered, split_series
from quotemill.plans import indicators, nyse


def make_frame(spark, values_by_symbol):
    parts = []
    for symbol, values in values_by_symbol.items():
        dates = pd.date_range("1990-01-01", periods=len(values), freq="D")
        parts.append(pd.DataFrame({"symbol": symbol, "date": dates, "x": values}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), "symbol string, date timestamp_ntz, x double")
    return df, pdf


def collect(df, column):
    return df.toPandas().sort_values(["symbol", "date"])[column].astype(float).to_numpy()


def long_values(n, seed=0):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))


@pytest.mark.parametrize("span", [2, 9, 12, 50])
def test_ewm_on_long_series(spark, span):
    df, pdf = make_frame(spark, {"a": long_values(5000), "b": long_values(7, 1)})
    out = ewm.with_ewm(df, DAILY, {"y": ewm.from_span("x", span)})
    expected = pdf.groupby("symbol")["x"].transform(lambda v: v.ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(collect(out, "y"), expected, rtol=1e-11)


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 51, 0.5])
@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
def test_ewm_with_gaps(spark, alpha, share):
    values = long_values(4000, 2)
    values[np.random.default_rng(3).random(4000) < share] = np.nan
    values[:5] = np.nan
    values[1000:2600] = np.nan
    df, pdf = make_frame(spark, {"a": values, "b": [np.nan, 1, 2, np.nan, 4, 5]})
    out = ewm.with_ewm(df, DAILY, {"y": ewm.Ewm("x", alpha, "anywhere")})
    expected = pdf.groupby("symbol")["x"].transform(lambda v: v.ewm(alpha=alpha, adjust=False).mean())
    np.testing.assert_allclose(collect(out, "y"), expected, rtol=1e-10)


def test_ewm_std_with_leading_gap(spark):
    values = np.r_[[np.nan] * 3, np.random.default_rng(4).normal(0, 0.02, 3000)]
    df, pdf = make_frame(spark, {"a": values})
    out = ewm.with_ewm_std(df, DAILY, "x", 21, 21, "y")
    expected = pdf["x"].ewm(span=21, adjust=False, min_periods=21).std()
    np.testing.assert_allclose(collect(out, "y"), expected, rtol=1e-9)


@pytest.mark.parametrize("rows", [3, 14, 60, 67, 200, 210])
def test_rolling_is_null_until_full(spark, rows):
    values = long_values(700)
    values[[50, 300]] = np.nan
    values[400] *= 1e6
    df, pdf = make_frame(spark, {"a": values, "b": long_values(150, 5)})
    out = rolling.with_rolling(
        df, DAILY, {"m": rolling.Rolling("x", rows), "s": rolling.Rolling("x", rows, "std")}
    )
    groups = pdf.groupby("symbol")["x"]
    mean = groups.transform(lambda v: v.rolling(rows).apply(np.mean, raw=True))
    std = groups.transform(lambda v: v.rolling(rows).apply(lambda w: np.std(w, ddof=1), raw=True))
    np.testing.assert_allclose(collect(out, "m"), mean, rtol=1e-12)
    np.testing.assert_allclose(collect(out, "s"), std, rtol=1e-9)


def test_long_frames_share_short_pieces():
    pieces = rolling.plan_pieces({"a": rolling.Rolling("x", 20), "b": rolling.Rolling("x", 200)})
    assert pieces == {"a": 20, "b": 20}


def test_near_flag(spark):
    values = np.zeros(200)
    values[[20, 150]] = 1
    df, _ = make_frame(spark, {"a": values})
    out = rolling.near_flag(df.withColumn("bad", F.col("x") > 0), DAILY, "bad", 60, 8, "near")
    near = collect(out.withColumn("near", F.col("near").cast("double")), "near")
    expected = [any(0 <= i - b <= 60 or 0 < b - i <= 8 for b in (20, 150)) for i in range(200)]
    assert list(near == 1) == expected


def test_split_series_gives_the_same_indicators(spark):
    rng = np.random.default_rng(6)
    frames = []
    for symbol, n in (("hot", 3000), ("b", 300)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "date": pd.date_range("1980-01-01", periods=n, freq="h"),
                    "adj_close": close,
                    "adj_open": close * 0.99,
                    "adj_high": close * (1 + rng.random(n) / 50),
                    "adj_low": close * (1 - rng.random(n) / 50),
                    "volume": rng.integers(0, 1000, n),
                }
            )
        )
    schema = "symbol string, date timestamp_ntz, adj_close double, adj_open double, adj_high double, adj_low double, volume bigint"
    df = spark.createDataFrame(pd.concat(frames), schema)
    whole = indicators.compute_stock_indicators(df).toPandas().sort_values(["symbol", "date"])
    parts, by_part = split_series(df, Series(bounded=False), rows_per_part=1500, back=1400, rows_per_bucket=200)
    assert by_part.by == ("symbol", "_part")
    cut = home_rows(indicators.compute_stock_indicators(parts, series=by_part))
    cut = cut.toPandas().sort_values(["symbol", "date"])
    assert len(cut) == len(whole)
    for name in indicators.INDICATORS:
        np.testing.assert_allclose(
            cut[name].astype(float).to_numpy(), whole[name].astype(float).to_numpy(), rtol=1e-8, atol=1e-12
        )


FLAT_ROWS = 600_000


@pytest.fixture(scope="module")
def flat(spark):
    """One series that moves for 100 rows, stands still for nearly 600,000 and moves again."""
    x = F.when((F.col("id") % 599_000 < 100) & (F.col("id") > 0), 1 + F.col("id") % 7).otherwise(0).cast("double")
    gap = F.when((F.col("id") < 3) | F.col("id").between(300, 200_000) | (F.col("id") % 5 == 2), None).otherwise(F.col("id") % 11 + 1.0)
    df = spark.range(FLAT_ROWS).select(
        F.lit("a").alias("symbol"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("date"), x.alias("x"), gap.alias("gap"),
    )
    return df, df.toPandas().sort_values("date").reset_index(drop=True)


@pytest.mark.parametrize("rows_per_part", [None, 150_000, 50_000])
def test_averages_of_600_000_rows_whole_and_split(flat, rows_per_part):
    df, pdf = flat
    averages = {
        "fast": ewm.Ewm("x", 0.5), "slow": ewm.Ewm("x", 1 / 14), "slower": ewm.from_span("x", 2000),
        "sparse": ewm.Ewm("gap", 1 / 14, "anywhere"),
    }
    if rows_per_part is None:
        out = ewm.with_ewm(df, DAILY, averages)
    else:
        parts, by_part = split_series(df, Series(bounded=False), rows_per_part, back=100)
        out = home_rows(ewm.with_ewm(parts, by_part, averages))
    out = out.toPandas().sort_values("date").reset_index(drop=True)
    assert len(out) == FLAT_ROWS
    for name, spec in averages.items():
        expected = pdf[spec.column].ewm(alpha=spec.alpha, adjust=False).mean()
        # Down to the smallest numbers that are held in full.
        np.testing.assert_allclose(out[name].astype(float), expected, rtol=1e-8, atol=1e-300)


def test_split_averages_know_what_came_before_their_part(spark):
    values = np.r_[[np.nan] * 900, np.random.default_rng(5).normal(0, 0.02, 1700), [np.nan] * 800, [1.0, np.nan]]
    df, pdf = make_frame(spark, {"a": values, "b": values[::-1][:20], "c": [np.nan] * 30})
    parts, by_part = split_series(df, Series(bounded=False), 300, back=1, rows_per_bucket=100)
    ordered_parts, ordered = numbered(parts, by_part)
    first = values.copy()
    first[2600:] = 0.5
    for frame, by in ((parts, by_part), (ordered_parts, ordered)):
        out = home_rows(ewm.with_ewm(frame, by, {"y": ewm.Ewm("x", 0.3, "anywhere"), "z": ewm.Ewm("x", 0.02, "anywhere")}))
        for name, alpha in (("y", 0.3), ("z", 0.02)):
            expected = pdf.groupby("symbol")["x"].transform(lambda v: v.ewm(alpha=alpha, adjust=False).mean())  # noqa: B023
            np.testing.assert_allclose(collect(out, name), expected, rtol=1e-9)
    df, pdf = make_frame(spark, {"a": first[:2601]})
    parts, by_part = split_series(df, Series(bounded=False), 300, back=1, rows_per_bucket=100)
    out = home_rows(ewm.with_ewm_std(parts, by_part, "x", 1001, 700, "y"))
    expected = pdf["x"].ewm(span=1001, adjust=False, min_periods=700).std()
    np.testing.assert_allclose(collect(out, "y"), expected, rtol=1e-7)


def test_fast_averages_leave_the_blocks_of_others_alone(spark):
    df, pdf = make_frame(spark, {"a": long_values(3000)})
    df, ordered = numbered(df, DAILY)
    out = ewm.with_ewm(df, ordered, {"y": ewm.Ewm("x", 0.9)})
    out = ewm.with_ewm(out, ordered, {"z": ewm.Ewm("x", 0.01)})
    np.testing.assert_allclose(collect(out, "z"), pdf["x"].ewm(alpha=0.01, adjust=False).mean(), rtol=1e-11)
    assert out.where(F.col("_block") != F.floor(F.col("_at") / series.BLOCK_ROWS)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 100])
def test_affine_scan(spark, n):
    rows = [(k, i, (float(i + k), 0.5 if i % 3 else 0.0)) for k in (0, 1) for i in range(n - k)]
    maps = spark.createDataFrame(rows, "k int, at int, m struct<sum: double, decay: double>")
    found = {(r.k, r.at): r.m for r in ewm.affine_scan(maps, ["k"], "at", ["m"]).collect()}
    for k in (0, 1):
        y = 0.0
        for i in range(n - k):
            assert found[k, i] == pytest.approx(y)
            y = i + k + (0.5 if i % 3 else 0.0) * y
    assert len(found) == 2 * n - 1


def test_short_series_are_not_split(spark):
    df, _ = make_frame(spark, {"a": [1.0, 2.0, 3.0]})
    same, same_series = split_series(df, DAILY)
    assert same_series == DAILY and home_rows(same) is same and same.collect() == df.collect()


def test_rows_without_a_time_are_in_no_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", None, 2.0), (None, 1, 3.0)], "symbol string, date int, x double")
    for series_ in (DAILY, Series(bounded=False)):
        rows = home_rows(split_series(df, series_)[0]).select("symbol", "date", "x").collect()
        assert sorted(r.x for r in rows) == [1.0, 3.0]


@pytest.mark.parametrize("bounded", [True, False])
def test_directions_after_a_long_flat_stretch(spark, bounded):
    """A price that moves and then stands still: the averages get tiny, their ratios do not."""
    rng = np.random.default_rng(11)
    # The second series is cut after 66,000 rows; what moved long before is history of the rows behind the cut.
    n, start = (5100, 0) if bounded else (69_000, 60_000)
    moving = (np.arange(n) >= start) & (np.arange(n) < start + 100)
    close = 100 * np.exp(np.cumsum(np.where(moving, rng.normal(0, 0.02, n), 0.0)))
    spread = np.where(moving, 0.01, 0.0)
    pdf = pd.DataFrame({"symbol": "a", "date": pd.date_range("1990-01-01", periods=n, freq="h"), "adj_close": close,
                        "adj_high": close * (1 + spread), "adj_low": close * (1 - spread)})
    schema = "symbol string, date timestamp_ntz, adj_close double, adj_high double, adj_low double"
    df = spark.createDataFrame(pdf, schema)
    if bounded:
        out = indicators.directional_indicators(df)
    else:
        parts, by_part = split_series(df, Series(bounded=False), rows_per_part=66_000)
        out = home_rows(indicators.directional_indicators(parts, by_part))
    out = out.toPandas().sort_values("date").reset_index(drop=True)
    up, down = pdf.adj_high.diff(), -pdf.adj_low.diff()
    plus, minus = up.where((up > down) & (up > 0), 0), down.where((down > up) & (down > 0), 0)
    reach = pd.concat(
        [pdf.adj_high - pdf.adj_low, pdf.adj_high - pdf.adj_close.shift(), pdf.adj_low - pdf.adj_close.shift()], axis=1
    ).max(axis=1)
    smooth = lambda v: v.ewm(alpha=1 / 14, adjust=False).mean()
    for name, moves in (("plus_di", plus), ("minus_di", minus)):
        expected = (100 * smooth(moves) / smooth(reach))[start + 1 :]
        np.testing.assert_allclose(out[name].astype(float)[start + 1 :], expected, rtol=1e-6)


def test_split_needs_room_for_its_halo(spark):
    df, _ = make_frame(spark, {"a": [1.0]})
    with pytest.raises(ValueError):
        split_series(df, DAILY, rows_per_part=100, back=200)


@pytest.mark.parametrize("plan", [nyse.daily_return, nyse.moving_averages, nyse.volatility, nyse.momentum])
def test_split_timestamp_series(spark, plan):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(
        {
            "symbol": np.where(np.arange(2500) < 2300, "hot", "b"),
            "timestamp": pd.date_range("2020-01-01", periods=2500, freq="min"),
            "close": rng.random(2500) + 1,
            "volume": 1,
        }
    )
    df = spark.createDataFrame(pdf, "symbol string, timestamp timestamp_ntz, close double, volume bigint")
    whole = plan(df).toPandas().sort_values("timestamp").reset_index(drop=True)
    cut = plan(df, rows_per_part=300).toPandas().sort_values("timestamp").reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, cut[whole.columns], rtol=1e-9)


def test_numbering_is_kept(spark):
    df, _ = make_frame(spark, {"a": [1.0, 2.0]})
    once, ordered = numbered(df, Series(), 10)
    again, same = numbered(once, ordered, 20)
    assert again is once and same == ordered


def test_one_shuffle_for_all_indicators(spark):
    df = spark.range(10).selectExpr(
        "cast(id % 3 as string) symbol", "timestamp_ntz'2000-01-01' + make_dt_interval(cast(id as int)) date", "1D adj_close",
        "1D adj_open", "1D adj_high", "1D adj_low", "id volume",
    )
    plan = indicators.compute_stock_indicators(df)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 1


def test_flat_and_monotone_prices(spark):
    n = 40
    frames = []
    for symbol, close in (("flat", np.full(n, 10.0)), ("up", 10.0 + np.arange(n))):
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol, "date": pd.date_range("2000-01-01", periods=n), "adj_close": close,
                    "adj_open": close, "adj_high": close, "adj_low": close, "volume": 0,
                }
            )
        )
    schema = "symbol string, date timestamp_ntz, adj_close double, adj_open double, adj_high double, adj_low double, volume bigint"
    df = spark.createDataFrame(pd.concat(frames), schema)
    out = indicators.compute_stock_indicators(df).toPandas().sort_values("date")
    flat, up = (out[out.symbol == s].reset_index(drop=True) for s in ("flat", "up"))
    assert flat.rsi_14d.isna().all() and flat.dmi.isna().all() and flat.adx.isna().all()
    assert up.rsi_14d[:13].isna().all() and (up.rsi_14d[13:] == 100).all()
    assert flat.relative_volume_21d.isna().all()
    assert not out.golden_cross.any() and out.golden_cross.notna().all()
    assert up.sma_200.isna().all()


def test_missing_high_and_low(spark):
    rng = np.random.default_rng(9)
    n = 300
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    high, low = close * 1.02, close * 0.98
    high[[40, 41, 120]] = np.nan
    low[[41, 200]] = np.nan
    pdf = pd.DataFrame({"symbol": "a", "date": pd.date_range("2000-01-01", periods=n), "adj_close": close,
                        "adj_high": high, "adj_low": low})
    df = spark.createDataFrame(
        pdf, "symbol string, date timestamp_ntz, adj_close double, adj_high double, adj_low double"
    ).withColumns({c: F.nanvl(c, F.lit(None)) for c in ("adj_high", "adj_low")})
    out = indicators.directional_indicators(df).toPandas().sort_values("date")
    up, down = pdf.adj_high.diff(), -pdf.adj_low.diff()
    plus = up.where((up > down) & (up > 0), 0)
    reach = pd.concat(
        [pdf.adj_high - pdf.adj_low, pdf.adj_high - pdf.adj_close.shift(), pdf.adj_low - pdf.adj_close.shift()], axis=1
    ).max(axis=1)
    smooth = lambda v: v.ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(out.plus_di.astype(float), 100 * smooth(plus) / smooth(reach), rtol=1e-9)


def test_registry_is_complete():
    assert len(indicators.INDICATORS) == 26
    assert all(spec.description for spec in indicators.INDICATORS.values())
    assert series.HALO_BACK < series.ROWS_PER_PART
