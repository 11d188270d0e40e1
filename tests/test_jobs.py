"""Labels, splits, models, experiments, files and streams."""

import importlib.util
import json
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators.joins import DuplicateKeysError
from quotemill.plans import evaluation, experiments, labels, modeling, prices, splits, tuning
from quotemill.schemas import HEADLINE_FEATURES, PRICE_FEATURES
from quotemill.session import staged, work_path
from quotemill.sources import articles, tables
from quotemill.streaming import messages, ticks


def bars(spark, opens, dates=None, closes=None):
    n = len(opens)
    dates = pd.date_range("2020-01-01", periods=n) if dates is None else pd.to_datetime(dates)
    closes = opens if closes is None else closes
    pdf = pd.DataFrame({"symbol": "a", "date": dates, "adj_open": opens, "adj_close": closes})
    return spark.createDataFrame(pdf, "symbol string, date timestamp_ntz, adj_open double, adj_close double")


def test_forward_return_enters_at_the_next_open(spark):
    opens = [float(i + 1) for i in range(12)]
    opens[2] = -1.0
    out = labels.with_forward_return(bars(spark, opens)).orderBy("date").collect()
    assert out[0].forward_return == pytest.approx(np.log(9 / 2))
    assert out[1].forward_return is None  # its entry open is not positive
    assert [r.label_end_date is None for r in out] == [False] * 4 + [True] * 8


def test_a_gap_in_the_prices_has_no_label(spark):
    dates = list(pd.date_range("2020-01-01", periods=6)) + list(pd.date_range("2020-02-10", periods=14))
    out = labels.label_stock(bars(spark, np.arange(20) + 1.0, dates)).orderBy("date").collect()
    assert all(r.forward_return is None for r in out[:6])
    assert out[6].forward_return is not None and out[8].trailing_return is None
    assert out[13].trailing_return is not None
    assert all(r.label is None for r in out)  # the threshold needs 21 returns


def test_bad_prices_flag_both_sides(spark):
    closes = np.full(120, 10.0)
    closes[30:] = 25.0
    out = prices.flag_bad_prices(bars(spark, closes)).orderBy("date").collect()
    assert [i for i, r in enumerate(out) if r.near_bad_price] == list(range(22, 91))


def test_incomplete_rows_go_last(spark):
    df = spark.sql("select 1 a, false near_bad_price union all select null, false union all select 2, true")
    assert [r.a for r in labels.drop_incomplete_rows(df).collect()] == [1]


def dated(spark, n=100, symbols=4):
    return spark.sql(
        f"select 's' || s symbol, timestamp_ntz'2020-01-01' + make_dt_interval(cast(d as int)) date, d "
        f"from (select explode(sequence(0, {n - 1})) d) cross join (select explode(sequence(1, {symbols})) s)"
    ).withColumn("label_end_date", F.col("date") + F.make_dt_interval(F.lit(8)))


def test_splits_match_index_arithmetic(spark):
    out = splits.chronological_split(dated(spark, 300)).toPandas()
    days = {name: (g.d.min(), g.d.max()) for name, g in out.groupby("split")}
    assert days == {"train": (0, 201), "val": (216, 240), "test": (255, 299)}
    assert out.groupby("symbol").size().nunique() == 1
    assert splits.chronological_split(dated(spark, 100)).where("split = 'val'").count() == 0


def test_walk_forward_folds(spark):
    df = dated(spark, 200)
    dates = np.arange(200)
    usable = dates[dates < int(200 * (0.72 + 0.13)) - 14]
    cuts = np.linspace(int(len(usable) * 0.5), len(usable), 6).astype(int)
    out = splits.walk_forward_splits(df, 5).toPandas()
    for fold, (start, end) in enumerate(zip(cuts[:-1], cuts[1:])):
        rows = out[out.fold == fold]
        val = rows[rows.role == "val"].d
        assert (val.min(), val.max()) == (usable[start], usable[end - 1])
        assert rows[rows.role == "train"].d.max() == usable[start] - 15
    splits.assert_no_leakage(splits.walk_forward_splits(df, 5), splits.split_bounds(df))


def test_leakage_is_an_error(spark):
    df = dated(spark).withColumn("label_end_date", F.col("date") + F.make_dt_interval(F.lit(40)))
    with pytest.raises(splits.LeakageError):
        splits.assert_no_leakage(splits.walk_forward_splits(df, 3), splits.split_bounds(df))


def test_sample_keeps_whole_symbols(spark):
    df = dated(spark, 5, 20)
    once = splits.sample_symbols(df, 0.3, 1).toPandas()
    assert once.symbol.nunique() == 6 and (once.groupby("symbol").size() == 5).all()
    again = splits.sample_symbols(df, 0.3, 1).toPandas()
    assert set(once.symbol) == set(again.symbol)
    assert splits.sample_symbols(df, 0.001, 1).select("symbol").distinct().count() == 1


def model_rows(spark, n=600):
    rng = np.random.default_rng(0)
    x = rng.normal(size=n)
    label = np.where(x > 0.4, "UP", np.where(x < -0.4, "DOWN", "HOLD"))
    pdf = pd.DataFrame(
        {
            "symbol": [f"s{i % 6}" for i in range(n)],
            "date": pd.to_datetime("2020-01-01") + pd.to_timedelta(np.arange(n) // 6, "D"),
            "x": x, "noise": rng.normal(size=n), "label": label,
        }
    )
    df = spark.createDataFrame(pdf, "symbol string, date timestamp_ntz, x double, noise double, label string")
    df = df.withColumn("noise", F.when(F.col("noise") > -1, F.col("noise")))
    df = df.withColumn("label_end_date", F.col("date") + F.make_dt_interval(F.lit(8)))
    return staged(df, "test-model-rows")


def test_forest_learns_and_is_saved(spark):
    rows = model_rows(spark)
    model = modeling.fit_forest(rows, ["x", "noise"], {"n_trees": 5, "max_depth": 4})
    score = modeling.score_predictions(model.predict(rows)).first()
    assert score["macro_f1"] > 0.9 and score["log_loss"] < 0.5
    path = work_path(spark, "test-model")
    modeling.save_model(spark, model, path, {"study_name": "s", "start_date": "2010", "params": {"n_trees": 5}})
    again = modeling.load_model(spark, path)
    assert again.features == ["x", "noise"]
    assert modeling.score_predictions(again.predict(rows)).first() == score
    assert modeling.load_saved_params(spark, path, "s", "2010") == {"n_trees": 5}
    with pytest.raises(ValueError):
        modeling.load_saved_params(spark, path, "other", "2010")
    p = model.predict(rows).selectExpr("p_down + p_hold + p_up total").agg(F.min("total"), F.max("total")).first()
    assert p[0] == pytest.approx(1) and p[1] == pytest.approx(1)


def test_importance_goes_to_the_real_feature(spark):
    model = modeling.fit_forest(model_rows(spark), ["x", "noise"], {"n_trees": 5, "max_depth": 4})
    shares = modeling.importance_by_group(spark, model, {"real": ["x"], "noise": ["noise"]}).toPandas()
    shares = shares.set_index("feature_group").share
    assert shares["real"] > 0.9 and shares.sum() == pytest.approx(1)


def test_boosted_trees_learn(spark):
    rows = model_rows(spark)
    early, late = rows.where("date < '2020-03-01'"), rows.where("date >= '2020-03-01'")
    model = modeling.fit_boosted(early, late, ["x"], {"n_trees": 3, "max_depth": 2})
    assert modeling.score_predictions(model.predict(late)).first()["macro_f1"] > 0.9


def boosting_rows(spark, n=1500):
    """The label follows x, but where x is missing it is always UP; z is missing by half and says nothing."""
    x = F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") * 7919 % 1009) / 1009.0)
    label = F.when(F.col("x").isNull() | (F.col("x") > 0.8), "UP").when(F.col("x") < 0.3, "DOWN").otherwise("HOLD")
    rows = spark.range(n).select("id", x.alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") % 13).cast("double").alias("z"))
    return rows.withColumn("label", label)


def test_joint_boosting_lowers_the_loss_every_round(spark, tmp_path):
    rows = boosting_rows(spark)
    train, val = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")
    model = modeling.fit_boosted(train, val, ["x", "z"], {"n_trees": 6, "max_depth": 2, "learning_rate": 0.5}, seed=3)
    assert model.gappy == ["x", "z"] and len(model.trees) == 18
    losses = [train for train, _ in model.losses]
    assert all(after < before for before, after in zip(losses, losses[1:], strict=False)) and losses[0] < np.log(3)
    # Each round's loss once more, by SQL from stored predictions.
    for rounds in (1, 4, 6):
        path = str(tmp_path / f"p{rounds}")
        model.predict(train, rounds).write.parquet(path)
        found = duckdb.sql(
            f"""WITH p AS (SELECT * FROM '{path}/*.parquet'), w AS (SELECT label, (SELECT count(*) FROM p) / (3.0 * count(*)) AS w FROM p GROUP BY label)
            SELECT sum(-ln(CASE label WHEN 'DOWN' THEN p_down WHEN 'HOLD' THEN p_hold ELSE p_up END) * w) / sum(w),
                   max(abs(p_down + p_hold + p_up - 1)) FROM p JOIN w USING (label)"""
        ).fetchall()[0]
        assert found[0] == pytest.approx(losses[rounds - 1], rel=1e-9) and found[1] < 1e-12
    # A missing x is known for what it is, though it lies on neither side of the others.
    assert model.predict(rows.where("x IS NULL")).agg(F.min("p_up")).first()[0] > 0.8
    again = modeling.fit_boosted(train, val, ["x", "z"], {"n_trees": 6, "max_depth": 2, "learning_rate": 0.5}, seed=3)
    np.testing.assert_allclose(again.losses, model.losses, rtol=1e-9)
    modeling.save_model(spark, model, str(tmp_path / "model"), {"params": {}})
    loaded = modeling.load_model(spark, str(tmp_path / "model"))
    assert loaded.best_round == model.best_round
    both = [sorted(m.predict(val).select("id", "p_up").collect()) for m in (model, loaded)]
    assert both[0] == both[1]


def test_joint_boosting_stops_early(spark):
    rows = boosting_rows(spark, 400)
    # Labels of the validation rows are turned around: every round makes them worse.
    val = rows.withColumn("label", F.when(F.col("label") == "UP", "DOWN").when(F.col("label") == "DOWN", "UP").otherwise("HOLD"))
    model = modeling.fit_boosted(rows, val, ["x"], {"n_trees": 9, "max_depth": 2, "learning_rate": 1.0, "patience": 2, "subsample": 0.8})
    assert len(model.losses) < 9 and model.best_round == len(model.losses) - 2


def test_search_picks_from_the_front(spark):
    rows = model_rows(spark, 1200)
    found = modeling.walk_forward_tune(
        spark, rows, ["x", "noise"], {"max_depth": [1, 4], "n_trees": [3]}, n_folds=2, fraction=0.5, n_finalists=1
    )
    assert found.trials.count() == 2 and found.params["max_depth"] == 4
    assert found.key[0] > 0.9


def test_a_broken_search_makes_the_same_trials(spark, tmp_path, monkeypatch):
    rows = staged(model_rows(spark, 1200), "rows")
    space = {"max_depth": [1, 2], "n_trees": tuning.Range(2, 4, whole=True)}
    search = lambda store, **more: modeling.walk_forward_tune(
        spark, rows, ["x"], space, 2, 0.5, n_finalists=1, check_leakage=False, n_trials=3, store=str(tmp_path / store), **more
    )
    whole = search("whole").trials.orderBy("trial").collect()
    calls, fit = [], modeling.fit_forest

    def broken(*args):
        calls.append(1)
        if len(calls) == 4:  # in the second fold of the second trial
            raise RuntimeError("lost")
        return fit(*args)

    monkeypatch.setattr(modeling, "fit_forest", broken)
    with pytest.raises(RuntimeError):
        search("broken")
    assert search("broken").trials.orderBy("trial").collect() == whole and len(whole) == 3
    assert len(calls) == 4 + 4 + 1  # the first trial was not done again
    with pytest.raises(tuning.SearchSettingsError):
        search("broken", seed=1)


def test_proposals_move_towards_good_trials():
    space = {"rate": tuning.Range(0.01, 1.0, log=True), "depth": [1, 2, 3, 4], "n": tuning.Range(1, 9, whole=True)}
    done = []
    for trial in range(60):
        params = tuning.propose(space, done, trial, 5)
        assert 0.01 <= params["rate"] <= 1 and params["depth"] in (1, 2, 3, 4) and params["n"] in range(1, 10)
        loss = abs(np.log(params["rate"] / 0.1)) + abs(params["depth"] - 3) + abs(params["n"] - 7) / 4
        done.append({"trial": trial, "params": params, "log_loss": loss, "macro_f1": -loss})
    first, last = ([t["log_loss"] for t in done[a:b]] for a, b in ((0, 8), (40, 60)))
    assert np.mean(last) < 0.6 * np.mean(first)
    # A proposal depends on the trials before it alone.
    assert tuning.propose(space, done, 30, 5) == done[30]["params"]
    assert tuning.propose(space, done[:30], 30, 6) != done[30]["params"]


def test_pareto_front(spark):
    trials = spark.createDataFrame(
        [(0, 1.0, 0.5), (1, 0.9, 0.4), (2, 1.0, 0.4), (3, 1.1, 0.6), (4, 0.9, 0.4)],
        "trial bigint, log_loss double, macro_f1 double",
    )
    front = modeling.pareto_front(trials)
    assert sorted(r.trial for r in front.collect()) == [0, 1, 3, 4]
    assert [r.trial for r in modeling.best_trials(front, 3).collect()] == [3, 0, 1]


def test_feature_set_is_checked(spark):
    df = spark.sql("select 's' symbol, 1 x, 2 y, 'UP' label")
    assert modeling.feature_names(df) == ["x", "y"]
    modeling.assert_feature_set(df, ["y", "x"])
    with pytest.raises(modeling.FeatureSetError):
        modeling.assert_feature_set(df, ["x"])


def test_f1_and_majority(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 2), (2, 2), (2, 2)], "y bigint, pred bigint")
    found = evaluation.f1_scores(evaluation.confusion_counts(pairs)).first()
    assert found.macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2)  # the absent class does not count
    every = evaluation.f1_scores(evaluation.confusion_counts(pairs), all_classes=True).first()
    assert every.macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 3) and every.hold_f1 == 0
    ties = spark.createDataFrame([("UP",), ("DOWN",)], "label string")
    assert evaluation.majority_class(ties).first()["majority"] == 0


def test_experiments_use_their_features(spark):
    names = [e.name for e in experiments.EXPERIMENTS]
    assert names == ["A", "B", "C", "B_placebo", "B_same_day"]
    columns = ["symbol", "date", *PRICE_FEATURES, *HEADLINE_FEATURES, *[f"{c}_same_day" for c in HEADLINE_FEATURES]]
    others = ["label", "label_end_date", "trailing_return", "threshold", "forward_return", "close", "volume"]
    row = ", ".join(f"{i} as `{c}`" for i, c in enumerate(columns + others))
    df = spark.sql(f"select {row}")
    b, same = experiments.EXPERIMENTS[1], experiments.EXPERIMENTS[4]
    plain = experiments.experiment_features(df, b, 0).first()
    fresher = experiments.experiment_features(df, same, 0).first()
    assert plain["news_count_1d"] == columns.index("news_count_1d")
    assert fresher["news_count_1d"] == columns.index("news_count_1d_same_day")
    assert "news_count_1d" in experiments.experiment_features(df, experiments.EXPERIMENTS[3], 0).columns


def test_one_to_one_fusion(spark):
    df = spark.sql("select 's' symbol, timestamp_ntz'2020-01-01' date")
    features = df.selectExpr("*", "1f news_count_1d").union(df.selectExpr("*", "2f"))
    from quotemill.plans.news_features import fuse_prices_news

    with pytest.raises(DuplicateKeysError):
        fuse_prices_news(df, features)


def test_build_once(spark):
    path = work_path(spark, "test-build")
    calls = []

    def build():
        calls.append(1)
        return spark.sql("select 1 x, timestamp_ntz'2020-01-01' date union all select 2, timestamp_ntz'2021-01-01'")

    assert tables.load_or_build(spark, path, build).count() == 2
    assert tables.load_or_build(spark, path, build, start_date="2020-06-01", columns=["x"]).collect() == [(2,)]
    assert len(calls) == 1
    tables.load_or_build(spark, path, build, force_build=True)
    assert len(calls) == 2
    scan = tables.scan_parquet(spark, path, ["x"], "2020-06-01")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in scan


def article_rows(spark):
    rows = [
        (i, "h", "s", f"<p>b{i}</p>", "w", None if i % 2 else "u", "a", ["A"] if i % 3 else [], f"2024-01-0{1 + i % 7} 10:00:00.123456")
        for i in range(1, 9)
    ]
    schema = "id bigint, headline string, summary string, content string, source string, url string, author string, symbols array<string>, t string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("created_at", F.col("t").cast("timestamp")).withColumn("updated_at", F.col("created_at")).drop("t")


def test_envelope(spark):
    records = messages.to_envelope(messages.to_message(article_rows(spark))).orderBy("key")
    row = records.first()
    value = json.loads(row.value)
    assert row.key == "1" and list(value) == messages.MESSAGE_FIELDS
    assert value["content"] == "b1" and value["url"] is None and value["created_at"].startswith("2024-01-02T10:00:00.123456")
    assert row.timestamp.microsecond == 123000
    back = messages.from_envelope(records).drop("content").orderBy("id").collect()
    assert back == article_rows(spark).drop("content").orderBy("id").collect()


def test_a_topic_keeps_the_creation_time_in_a_header(spark):
    records = messages.to_envelope(messages.to_message(article_rows(spark))).drop("timestamp")
    found = records.select(F.col("key").cast("bigint").alias("id"), messages.creation_time(records).alias("t")).join(article_rows(spark), "id")
    assert found.where(F.date_trunc("millisecond", "created_at") != F.col("t")).count() == 0 and found.count() == 8


def test_a_broken_backfill_goes_on_with_its_day(spark, tmp_path, monkeypatch):
    rows, end, path, log = article_rows(spark), "2024-01-09 00:00:00", str(tmp_path / "history"), str(tmp_path / "log")
    calls, write = [], messages.to_envelope

    def broken(df):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return write(df)

    monkeypatch.setattr(messages, "to_envelope", broken)
    with pytest.raises(RuntimeError):
        messages.backfill_by_day(rows, end, log, path)
    assert len(messages.finished_days(spark, log)) == 3
    # What a lost run left of the day at hand is written over.
    left = spark.read.parquet(path).drop("day").limit(1)
    day = sorted(messages.finished_days(spark, log), key=lambda d: -int(d.rsplit("-", 1)[1][:-1]))[0].rsplit("-", 1)[0] + "-4d"
    left.write.parquet(f"{path}/day={day}")
    rest = messages.backfill_by_day(rows, end, log, path)
    assert len(rest) == 4 and rest[0] == day
    assert messages.backfill_by_day(rows, end, log, path) == []
    keys = [r.key for r in spark.read.parquet(path).collect()]
    assert sorted(keys) == sorted(str(r.id) for r in rows.where("created_at >= '2024-01-02'").collect())


def test_lasting_memory_lets_every_id_through_once(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    row = article_rows(spark).where("id = 1")

    def land(*deliveries):
        for number, day, version in deliveries:
            created = F.timestamp_seconds(F.lit(1_700_000_000 + 86_400 * day))
            one = row.withColumns({"id": F.lit(number).cast("bigint"), "created_at": created, "updated_at": created + F.make_dt_interval(hours=F.lit(version))})
            messages.land_articles(one.coalesce(1), landing)
            time.sleep(0.02)

    def run():
        stream = messages.dedupe_lasting(messages.live_articles(spark, landing, 1))
        ticks.to_parquet(stream.select("id", "updated_at"), out, checkpoint).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    # Number 3 is nine days older than what came before it, number 1 comes again after that.
    land((1, 20, 0), (2, 21, 0), (1, 20, 1), (3, 11, 0), (1, 20, 2))
    assert run() == [1, 2, 3]
    # A new run remembers, and a month back is not too late for a first delivery.
    land((2, 21, 3), (3, 11, 1), (4, -30, 0))
    assert run() == [1, 2, 3, 4]


def test_backfill_slices(spark):
    found = articles.backfill_articles(article_rows(spark), "2024-01-06 00:00:00", ["A"], 3)
    rows = {r.id: r.day_slice for r in found.collect()}
    # Ids 2, 3 and 4 were created on the 3rd, 4th and 5th; 3 is about no symbol.
    assert rows == {2: 0, 4: 2}
    everything = articles.backfill_articles(article_rows(spark), "2024-01-06 00:00:00", ["*"], 3)
    assert everything.count() == 3
    created = [r.created_at for r in articles.oldest_first(everything).collect()]
    assert created == sorted(created)


def test_stream_dedupe_equals_batch(spark):
    landing = work_path(spark, "test-landing")
    rows = article_rows(spark)
    again = rows.where("id % 2 = 0").withColumn("updated_at", F.col("updated_at") + F.make_dt_interval(hours=F.lit(1)))
    messages.land_articles(rows, landing)
    messages.land_articles(again, landing)
    out = work_path(spark, "test-unique")
    stream = messages.dedupe_stream(messages.live_articles(spark, landing, 1), 30)
    ticks.to_parquet(stream.select("id"), out, work_path(spark, "test-checkpoint")).awaitTermination()
    batch = messages.dedupe_batch(rows.unionByName(again))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(r.id for r in batch.collect())
    latest = {r.id: r.updated_at for r in batch.collect()}
    assert latest[2] == again.where("id = 2").first().updated_at


def test_nothing_first_delivered_is_lost(spark):
    """Micro-batches out of order, one article later than the stream remembers, one delivered again."""
    landing, out = work_path(spark, "test-landing"), work_path(spark, "test-unique")
    days = {1: "2024-01-20", 2: "2024-01-21", 3: "2024-01-02", 4: "2024-01-22", 5: "2024-01-15"}
    for name in (1, 2, 3, 2, 4, 5, 3):
        day = F.lit(f"{days[name]} 10:00:00").cast("timestamp")
        row = article_rows(spark).where("id = 1").withColumn("id", F.lit(name).cast("bigint"))
        messages.land_articles(row.withColumn("created_at", day).withColumn("updated_at", day), landing)
        time.sleep(0.02)
    stream = messages.dedupe_stream(messages.live_articles(spark, landing, 1))
    ticks.to_parquet(stream.select("id"), out, work_path(spark, "test-checkpoint")).awaitTermination()
    published = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(published) == [1, 2, 4, 5]
    landed = spark.read.schema(messages.ARTICLE_SCHEMA).json(landing)
    assert [r.id for r in messages.missed_articles(landed, spark.read.parquet(out)).collect()] == [3]


def test_memory_is_longer_than_the_backfill(spark):
    with pytest.raises(ValueError):
        messages.dedupe_stream(article_rows(spark), remembered_days=7)
    with pytest.raises(ValueError):
        messages.dedupe_stream(article_rows(spark), backfill_days=30)


def test_rate_stream_projection(spark):
    stream = ticks.project_result(ticks.rate_stream(spark, 50))
    run = ticks.to_memory(stream, "rate_results")
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("rate_results").count():
                break
        row = spark.table("rate_results").first()
        assert row.result == row.value + 1
    finally:
        run.stop()


def test_console_sink(spark, tmp_path):
    ticks.write_landing_files(
        spark.sql("select 'A' id, 1D price, 't' time, '5' day_volume, 0D change, 0D change_percent"), str(tmp_path / "in")
    )
    run = ticks.to_console(ticks.tick_stream(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    run.processAllAvailable()
    assert sum(p["numInputRows"] for p in run.recentProgress) == 1
    run.stop()


def test_landing_files_are_short(spark):
    path = work_path(spark, "test-ticks")
    rows = spark.range(30).coalesce(1).selectExpr(
        "'A' id", "1D price", "'t' time", "'5' day_volume", "0D change", "0D change_percent"
    )
    ticks.write_landing_files(rows, path, ticks.RECORDS_PER_FILE)
    sizes = spark.read.text(path).groupBy(F.input_file_name()).count().toPandas()["count"]
    assert sorted(sizes) == [8, 11, 11]


def test_xgboost_is_optional():
    # It is not bundled, and nothing else needs it.
    assert modeling.xgboost_available() is (importlib.util.find_spec("xgboost") is not None)


def test_repeated_texts_are_changed_once_in_place(spark):
    from quotemill.operators.repeats import change_repeated

    changes = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def loud(text):
        if text is not None:
            changes.add(1)
        return None if text == "gone" else f"{text}!"

    texts = ["a"] * 50 + ["b", "a"] * 30 + [f"t{i % 7}" for i in range(300)] + [None, "gone", "", None, "gone", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    for remembered in (1, 2, 5, 256):
        before = changes.value
        rows = change_repeated(df, "t", loud, remembered).collect()
        assert [r.i for r in rows] == list(range(len(texts)))
        assert [r.t for r in rows] == [None if t == "gone" else f"{t}!" for t in texts], remembered
    # Null is a text of its own; ten texts besides it are changed once each.
    assert changes.value - before == 11
    assert change_repeated(df.where("i < 0"), "t", loud).collect() == []


def test_messages_of_equal_bodies_are_cleaned_like_others(spark):
    from quotemill.functions.text import clean_text

    rows = article_rows(spark).withColumn("content", F.lit("<p>**x** &amp; y</p>"))
    expected = rows.select("id", clean_text("content").alias("c")).orderBy("id").collect()
    found = messages.to_message(rows).orderBy("id").collect()
    assert [(r.id, r.content) for r in found] == [(r.id, r.c) for r in expected]
    assert messages.to_message(rows).columns == messages.MESSAGE_FIELDS


def test_landing_files_are_compressed(spark):
    path = work_path(spark, "landing")
    rows = article_rows(spark).withColumn("content", F.repeat(F.lit("long body "), 10_000))
    messages.land_articles(rows, path)
    size = spark.read.format("binaryFile").option("pathGlobFilter", "part*").load(path).agg(F.sum("length")).first()[0]
    assert size < rows.count() * 10_000
    back = spark.read.schema(messages.ARTICLE_SCHEMA).json(path)
    assert back.exceptAll(rows.select(*back.columns)).isEmpty() and back.count() == rows.count()


def test_few_events_become_many_parts_of_articles(spark, tmp_path, monkeypatch):
    from quotemill.sources import testbed

    spark.range(100).selectExpr(
        "id AS event_id", "'x' AS event_type", "'' AS props", "id AS user_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts"
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(10).selectExpr("id AS page_id", "repeat('p', 1000) AS html").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(testbed, "ARTICLE_BYTES", 10_000)
    rows = testbed.live_articles(spark, str(tmp_path)).withColumn("part", F.spark_partition_id())
    assert rows.count() == 110
    # The single file of events is dealt by what its articles hold; all articles of a page are in one part.
    assert 3 <= rows.select("part").distinct().count() <= 11
    assert rows.groupBy(F.col("id") % 10).agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()


def test_lasting_memory_lets_the_earliest_of_a_batch_through(spark):
    landing, out = work_path(spark, "landing"), work_path(spark, "out")
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 10 = 9 THEN NULL ELSE id % 500 END AS id", "string(id) AS headline",
        "timestamp'2024-01-01' AS created_at",
        "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, (id * 7919) % 3000) AS updated_at",
    )
    messages.land_articles(rows, landing)
    stream = messages.dedupe_lasting(messages.live_articles(spark, landing))
    ticks.to_parquet(stream, out, work_path(spark, "checkpoint")).awaitTermination()
    first = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("updated_at").alias("updated_at"))
    found = spark.read.parquet(out).select("id", "updated_at")
    assert sorted(found.collect()) == sorted(first.collect())
    # One micro-batch of many ids is not a Python call for each of them.
    plan = stream._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" not in plan


def write_events_and_pages(spark, folder, events=400):
    """Events in no order of time over 30 days, and pages for their bodies."""
    spark.range(events).selectExpr(
        "id AS event_id", "concat('h', id) AS event_type", "'' AS props", "id AS user_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval((id * 7) % 30) AS ts",
    ).write.parquet(f"{folder}/events.parquet")
    spark.range(50).selectExpr("id AS page_id", "repeat('p', 100) AS html").write.parquet(f"{folder}/pages.parquet")


def rows_and_batches(spark, name, folder, monkeypatch, partitions):
    """What a query gives with so many shuffle partitions, the landed files and the micro-batches that read them."""
    from quotemill import catalog
    from quotemill.catalog import job_queries
    from quotemill.sources import testbed

    paths, before = {}, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(testbed, "ARTICLE_BYTES", 10_000)
    monkeypatch.setattr(job_queries, "work_path", lambda s, n: paths.setdefault(n, work_path(s, n)))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = catalog.queries()[name](spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = spark.read.schema(messages.ARTICLE_SCHEMA).json(paths["articles"]).inputFiles()
    # Only micro-batches that read files have a log of them.
    log = spark.read.text(f"{paths['checkpoint']}/sources/0").where("value LIKE '{%'")
    return rows, len(files), log.select(F.get_json_object("value", "$.batchId")).distinct().count()


@pytest.mark.parametrize("name", ["stream_news_dedupe", "stream_news_dedupe_lasting"])
def test_many_landed_files_are_read_in_few_micro_batches(spark, tmp_path, monkeypatch, name):
    write_events_and_pages(spark, str(tmp_path))
    rows, files, batches = rows_and_batches(spark, name, str(tmp_path), monkeypatch, 24)
    # Every id once, those later than the memory as well.
    assert sorted(rows) == sorted((i, f"h{i}") for i in range(400))
    assert files > 3 * messages.MICRO_BATCHES and batches == messages.MICRO_BATCHES


def test_micro_batches_take_all_files(spark):
    path, rows = work_path(spark, "landing"), article_rows(spark)
    for files, expected in ((1, 1), (4, 1), (5, 2), (9, 3)):
        found = f"{path}-{files}"
        for _ in range(files):
            messages.land_articles(rows.coalesce(1), found)
        assert messages.files_per_batch(spark, found) == expected, files
