"""The policy and the embedding features against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.plans import embeddings, policy

DAY = dt.datetime(2020, 1, 1)


def frame(spark, rows):
    rows = [(s, DAY + dt.timedelta(days=d), e, float(c)) for s, d, e, c in rows]
    return spark.createDataFrame(rows, "symbol string, date timestamp_ntz, expected double, close double")


def test_actions_depend_on_what_is_held(spark):
    scores = [-0.9, 0.0, 0.5, 0.05, None, 0.5, -0.5, -0.5, 0.2, 0.1]
    df = frame(spark, [("a", i, e, 1) for i, e in enumerate(scores)])
    out = policy.with_actions(df, "expected", 0.1, -0.1).orderBy("date").collect()
    assert [r.action for r in out] == ["HOLD", "HOLD", "BUY", "HOLD", "HOLD", "BUY", "SELL", "HOLD", "BUY", "HOLD"]
    assert [r.position for r in out] == [0, 0, 1, 1, 1, 1, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        policy.with_actions(df, "expected", -0.1, 0.1)


def test_returns_of_a_random_policy(spark):
    rng = np.random.default_rng(3)
    n, symbols = 60, ["a", "b", "c"]
    score, price = rng.normal(size=(n, 3)), 10 * np.exp(np.cumsum(rng.normal(0, 0.05, (n, 3)), axis=0))
    df = frame(spark, [(s, i, float(score[i, k]), price[i, k]) for i in range(n) for k, s in enumerate(symbols)])
    daily = policy.run_policy(df, "expected", 0.7, -0.7, 0.002).orderBy("date")
    held, before, equity, highest = np.zeros(3), np.zeros(3), 1.0, 1.0
    rows = daily.collect()
    for i, r in enumerate(rows):
        held = np.where(score[i] > 0.7, 1, np.where(score[i] < -0.7, 0, held))
        weight = held / held.sum() if held.sum() else held
        change = price[i + 1] / price[i] - 1 if i + 1 < n else np.zeros(3)
        net = weight @ change - 0.002 * np.abs(weight - before).sum()
        equity *= 1 + net
        highest = max(highest, equity)
        before = weight
        assert r.net_return == pytest.approx(net, abs=1e-12) and r.n_positions == held.sum()
        assert r.equity == pytest.approx(equity) and r.drawdown == pytest.approx(1 - equity / highest, abs=1e-12)
        assert r.market_return == pytest.approx(change.mean(), abs=1e-12)
    one = policy.summary(daily).first()
    net = np.array([r.net_return for r in rows])
    assert one.sharpe == pytest.approx(net.mean() / net.std(ddof=1) * np.sqrt(252))
    assert one.total_return == pytest.approx(equity - 1) and one.max_drawdown == pytest.approx(max(r.drawdown for r in rows))


def test_losing_everything_stays(spark):
    daily = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, 3.0)], "date int, net_return double")
    assert [(r.equity, r.drawdown) for r in policy.with_equity(daily).orderBy("date").collect()][1:] == [(0.0, 1.0), (0.0, 1.0)]


@pytest.fixture(scope="module")
def articles(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        vector = (rng.normal(size=6) * [5, 3, 1, 0.5, 0.2, 0.1] + 2).tolist()
        rows.append((rng.choice(["a", "b"]).item(), DAY + dt.timedelta(days=int(rng.integers(0, 90)), hours=3), vector))
    return rows + [("a", DAY, None), ("a", DAY, [1.0]), (None, DAY, [1.0] * 6), ("b", None, [1.0] * 6)]


def test_means_of_windows(spark, articles):
    df = spark.createDataFrame(articles, "symbol string, published_at timestamp_ntz, v array<double>")
    found = {(r.symbol, r.date): r for r in embeddings.news_embeddings(df, "v", 6, 5).collect()}
    usable = [(s, t.date(), np.array(v)) for s, t, v in articles if s and t and v and len(v) == 6]
    assert set(found) == {(s, d) for s, d, _ in usable}
    for (s, d), r in found.items():
        near = [v for x, t, v in usable if x == s and 0 <= (d - t).days < 5]
        assert r.news_count == len(near)
        np.testing.assert_allclose(r.embedding, np.mean(near, axis=0), rtol=1e-12)


def test_components_know_the_training_days_only(spark, articles):
    df = spark.createDataFrame(articles, "symbol string, published_at timestamp_ntz, v array<double>")
    means = embeddings.news_embeddings(df, "v", 6, 5)
    end = dt.date(2020, 2, 20)
    # Wild vectors on later days must change nothing.
    wild = means.withColumn("embedding", F.when(F.col("date") >= end, F.transform("embedding", lambda e: e * 100)).otherwise(F.col("embedding")))
    train = [r.embedding for r in means.where(F.col("date") < end).collect()]
    fitted = embeddings.fit_projection(wild.where(F.col("date") < end), 3)
    np.testing.assert_allclose(fitted.mean, np.mean(train, axis=0), rtol=1e-12)
    np.testing.assert_allclose(fitted.axes.T @ fitted.axes, np.eye(3), atol=1e-10)
    values = np.linalg.eigvalsh(np.cov(np.array(train).T))[::-1]
    np.testing.assert_allclose(fitted.explained, values[:3] / values.sum(), rtol=1e-9)
    out = embeddings.split_projection(wild, end, 3)
    rows = out.where("split = 'train'").toPandas()
    found = rows[["component_1", "component_2", "component_3"]].to_numpy()
    np.testing.assert_allclose(np.cov(found.T), np.diag(values[:3]), atol=1e-9)
    np.testing.assert_allclose(found.mean(axis=0), 0, atol=1e-10)
    assert out.where("split = 'test'").count() == means.where(F.col("date") >= end).count()
    joined = embeddings.with_news_components(spark.createDataFrame([("a", end), ("z", end)], "symbol string, date date"), out)
    none = joined.where("symbol = 'z'").first()
    assert (none.news_count, none.no_news, none.component_1) == (0, 1, 0.0)


def test_without_training_vectors_components_are_null(spark, articles):
    df = spark.createDataFrame(articles, "symbol string, published_at timestamp_ntz, v array<double>")
    means = embeddings.news_embeddings(df, "v", 6, 5)
    assert embeddings.split_projection(means.where("false"), dt.date(2020, 2, 20), 3).collect() == []
    first = means.agg(F.min("date")).first()[0]
    early = means.where(F.col("date") == first).limit(1)
    for rows in (means, early.unionByName(means.where(F.col("date") > first))):
        end = first if rows is means else first + dt.timedelta(days=1)
        out = embeddings.split_projection(rows, end, 3)
        assert out.columns == ["symbol", "date", "news_count", "split", "component_1", "component_2", "component_3"]
        assert out.count() == rows.count() and out.where("component_1 IS NOT NULL").isEmpty()
