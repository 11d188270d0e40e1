"""Rank correlations, deciles, calibration, baselines and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.catalog import common, sql
from quotemill.catalog.base import MIN_ROWS, comparable, query, rounded
from quotemill.functions import scalars
from quotemill.plans import evaluation, experiments, modeling, news_timing

P = sql.PREDICTIONS

SEGMENT_MIN_ROWS = 3

FRAME = f"""{P},
frame AS MATERIALIZED (
    SELECT symbol, date, p_up - p_down AS score, forward_return, exp(forward_return) - 1 AS simple_return,
        greatest(least(ceil({sql.pct_rank("volatility_21d")} * 3), 3), 1)::BIGINT AS volatility_tercile,
        greatest(least(ceil({sql.pct_rank("traded")} * 5), 5), 1)::BIGINT AS liquidity_quintile, has_news
    FROM (SELECT *, close * volume AS traded FROM predictions)
)"""


def _ic(keys: str, where: str, min_rows: int, name: str, score: str = "score", source: str = "frame") -> str:
    by = f"PARTITION BY {keys}"
    ranks = ", ".join(
        f"rank() OVER ({by} ORDER BY {c}) + (count(*) OVER ({by}, {c}) - 1) / 2.0::DOUBLE AS {r}"
        for c, r in ((score, "rx"), ("forward_return", "ry"))
    )
    return f"""
{name}_ranks AS (SELECT {keys}, {ranks} FROM {source} WHERE {where}),
{name} AS (SELECT {keys}, CASE WHEN count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) END AS ic
    FROM {name}_ranks GROUP BY {keys} HAVING count(*) >= {min_rows})"""


def _frame(spark, sf):
    return evaluation.ranking_frame(common.predictions(spark, sf))


@query(
    "ranking_frame",
    f"WITH {FRAME} SELECT symbol, date, {rounded('score', 'forward_return', 'simple_return')}, volatility_tercile, "
    "liquidity_quintile, has_news FROM frame",
)
def _(spark, sf):
    return comparable(_frame(spark, sf))


@query("rank_ic", f"WITH {FRAME}, {_ic('date', 'true', MIN_ROWS, 'ics')} SELECT date, {rounded('ic')} FROM ics")
def _(spark, sf):
    return comparable(evaluation.rank_ic(_frame(spark, sf), "score", "forward_return", min_rows=MIN_ROWS))


@query(
    "rank_ic_by",
    f"WITH {FRAME}, {_ic('date, volatility_tercile', 'volatility_tercile IS NOT NULL', SEGMENT_MIN_ROWS, 'ics')} "
    "SELECT date, "
    + ", ".join(f"round(max(ic) FILTER (volatility_tercile = {i}), 6) + 0.0 AS ic_{i}" for i in (1, 2, 3))
    + " FROM ics GROUP BY date",
)
def _(spark, sf):
    return comparable(
        evaluation.rank_ic_by(
            _frame(spark, sf), "score", "forward_return", "volatility_tercile", [1, 2, 3], SEGMENT_MIN_ROWS
        )
    )


@query(
    "vol_neutral_ic",
    f"WITH {FRAME}, {_ic('date, volatility_tercile', 'volatility_tercile IS NOT NULL', SEGMENT_MIN_ROWS, 'ics')} "
    "SELECT date, round(avg(ic), 6) + 0.0 AS volatility_neutral_ic FROM ics GROUP BY date",
)
def _(spark, sf):
    ics = evaluation.segment_ics(_frame(spark, sf), SEGMENT_MIN_ROWS)
    return comparable(
        ics.where(F.col("_in_volatility_neutral_ic")).select("date", "volatility_neutral_ic")
    )


DECILES = f"""
pct AS (SELECT *, {sql.pct_rank("score")} AS pct FROM frame),
deciles AS (SELECT date, avg(simple_return) FILTER (pct > 0.9::DOUBLE) AS top,
    avg(simple_return) FILTER (pct <= 0.1::DOUBLE) AS bottom, avg(simple_return) AS mean FROM pct GROUP BY date)"""


@query("decile_spread", f"WITH {FRAME}, {DECILES} SELECT date, {rounded('top', 'bottom', 'mean')}, "
       "round(top - bottom, 6) + 0.0 AS spread FROM deciles")
def _(spark, sf):
    return comparable(evaluation.decile_returns(_frame(spark, sf)))


THIN = "(row_number() OVER (ORDER BY date) - 1) % 8 = 0"


@query(
    "independent_dates",
    f"WITH {sql.PRICES} SELECT date FROM (SELECT DISTINCT date FROM prices) QUALIFY {THIN}",
)
def _(spark, sf):
    return evaluation.independent_dates(common.prices(spark, sf).select("date").distinct())


def _t(source: str, column: str) -> str:
    return (
        f"(SELECT avg(v) / nullif(stddev_samp(v) / sqrt(count(v)), 0) FROM (SELECT {column} AS v FROM {source} QUALIFY {THIN}))"
    )


@query(
    "t_stat",
    f"WITH {FRAME}, {_ic('date', 'true', MIN_ROWS, 'ics')} SELECT round({_t('ics', 'ic')}, 4) + 0.0 AS t, count(ic) AS n FROM ics",
)
def _(spark, sf):
    ics = evaluation.rank_ic(_frame(spark, sf), "score", "forward_return", min_rows=MIN_ROWS)
    thinned = evaluation.independent_dates(ics).agg(evaluation.t_stat("ic").alias("t"))
    return comparable(ics.agg(F.count("ic").alias("n")).withColumn("t", thinned.scalar()), digits=4)


SEGMENTS = ", ".join(
    [
        _ic("date", "true", SEGMENT_MIN_ROWS, "ics"),
        _ic("date, volatility_tercile", "volatility_tercile IS NOT NULL", SEGMENT_MIN_ROWS, "vol"),
        _ic("date, liquidity_quintile", "liquidity_quintile IS NOT NULL", SEGMENT_MIN_ROWS, "liq"),
        _ic("date, has_news", "has_news IS NOT NULL", SEGMENT_MIN_ROWS, "nws"),
        "neutral AS (SELECT date, avg(ic) AS ic FROM vol GROUP BY date)",
        "spreads AS (SELECT date, top - bottom AS spread FROM deciles WHERE top IS NOT NULL OR bottom IS NOT NULL)",
    ]
)

METRIC_SQL = {
    "ic": "(SELECT avg(ic) FROM ics)",
    "ic_t": _t("ics", "ic"),
    "ic_positive_days": "(SELECT avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END) FROM ics)",
    "volatility_neutral_ic": "(SELECT avg(ic) FROM neutral)",
    "volatility_neutral_ic_t": _t("neutral", "ic"),
    **{f"ic_volatility_{i}": f"(SELECT avg(ic) FROM vol WHERE volatility_tercile = {i})" for i in (1, 2, 3)},
    **{f"ic_liquidity_{i}": f"(SELECT avg(ic) FROM liq WHERE liquidity_quintile = {i})" for i in range(1, 6)},
    "top_decile_bps": "(SELECT avg(top) * 10000 FROM deciles)",
    "bottom_decile_bps": "(SELECT avg(bottom) * 10000 FROM deciles)",
    "spread_bps": "(SELECT avg(spread) * 10000 FROM spreads)",
    "spread_t": _t("spreads", "spread"),
    "top_minus_mean_bps": "(SELECT avg(top - mean) * 10000 FROM deciles)",
    "ic_news": "(SELECT avg(ic) FROM nws WHERE has_news)",
    "ic_no_news": "(SELECT avg(ic) FROM nws WHERE NOT has_news)",
}


@query(
    "ranking_metrics",
    f"WITH {FRAME}, {DECILES}, {SEGMENTS} SELECT "
    + ", ".join(f"round({e}::DOUBLE, 4) + 0.0 AS {n}" for n, e in METRIC_SQL.items()),
)
def _(spark, sf):
    summary, _daily = evaluation.ranking_metrics(_frame(spark, sf), SEGMENT_MIN_ROWS)
    return comparable(summary, digits=4)


@query(
    "ranking_metrics_daily",
    f"WITH {FRAME}, {DECILES}, {SEGMENTS} SELECT d.date, round(i.ic, 6) + 0.0 AS ic, round(n.ic, 6) + 0.0 AS volatility_neutral_ic, "
    "round(l.ic, 6) + 0.0 AS most_liquid_ic, round(w.ic, 6) + 0.0 AS news_ic, round((top - bottom) * 10000, 4) + 0.0 AS spread_bps "
    "FROM deciles d LEFT JOIN ics i ON i.date = d.date LEFT JOIN neutral n ON n.date = d.date "
    "LEFT JOIN liq l ON l.date = d.date AND l.liquidity_quintile = 5 LEFT JOIN nws w ON w.date = d.date AND w.has_news",
)
def _(spark, sf):
    _summary, daily = evaluation.ranking_metrics(_frame(spark, sf), SEGMENT_MIN_ROWS)
    return comparable(daily.withColumn("spread_bps", F.round("spread_bps", 4)))


CLASSES = ", ".join(
    f"SELECT '{name}' AS rating, p_{name.lower()} AS p, (y = {i})::INT AS hit FROM predictions"
    for i, name in enumerate(["DOWN", "HOLD", "UP"])
).replace(", SELECT", " UNION ALL SELECT")


@query(
    "calibration_error",
    f"""WITH {P}, long AS MATERIALIZED ({CLASSES}),
edges AS (SELECT rating, list_distinct(list_sort(quantile_cont(p, [{", ".join(
    sql.number(i * 0.1) if i < 10 else "1.0" for i in range(11))}]))) AS e FROM long GROUP BY rating),
binned AS (SELECT long.*, greatest(len(list_filter(e, lambda x: x < p)), 1) AS bin FROM long JOIN edges USING (rating)),
bins AS (SELECT rating, bin, avg(p) AS predicted, avg(hit) AS observed, count(*) AS n FROM binned GROUP BY ALL)
SELECT rating, round(sum(abs(predicted - observed) * n) / sum(n), 6) + 0.0 AS ece FROM bins GROUP BY rating""",
)
def _(spark, sf):
    return comparable(evaluation.calibration_error(common.predictions(spark, sf)))


# --- Classification ----------------------------------------------------------------------------

ARGMAX = (
    "CASE WHEN p_down >= p_hold AND p_down >= p_up THEN 0 WHEN p_hold >= p_up THEN 1 ELSE 2 END::BIGINT"
)


@query("argmax_class", f"WITH {P} SELECT symbol, date, {ARGMAX} AS pred FROM predictions")
def _(spark, sf):
    df = common.predictions(spark, sf)
    return df.select("symbol", "date", scalars.argmax_class(*evaluation.PROBABILITIES).alias("pred"))


SCALE = [1.5, 0.8, 1.1]


@query(
    "class_scale_argmax",
    f"WITH {P}, s AS (SELECT symbol, date, p_down * 1.5::DOUBLE AS p_down, p_hold * 0.8::DOUBLE AS p_hold, "
    f"p_up * 1.1::DOUBLE AS p_up FROM predictions) SELECT symbol, date, {ARGMAX} AS pred FROM s",
)
def _(spark, sf):
    scaled = [F.col(p) * F.lit(s) for p, s in zip(evaluation.PROBABILITIES, SCALE)]
    df = common.predictions(spark, sf)
    return df.select("symbol", "date", scalars.argmax_class(*scaled).alias("pred"))


def _f1(source: str, per_model: bool = True) -> str:
    parts = []
    for i in range(3):
        parts.append(
            f"coalesce(2.0 * sum((y = {i} AND pred = {i})::INT) / nullif(sum((y = {i})::INT + (pred = {i})::INT), 0), 0) AS f{i}, "
            f"(sum((y = {i})::INT + (pred = {i})::INT) > 0)::INT AS o{i}"
        )
    columns = ", ".join(parts)
    return f"SELECT model, {columns} FROM {source} GROUP BY model" if per_model else f"SELECT {columns} FROM {source}"


@query(
    "macro_f1",
    f"WITH {P}, pairs AS (SELECT y, {ARGMAX} AS pred FROM predictions), f AS ({_f1('pairs', False)}) "
    "SELECT round((f0 + f1 + f2) / 3, 6) + 0.0 AS macro_f1, round(f0, 6) + 0.0 AS down_f1, round(f1, 6) + 0.0 AS hold_f1, "
    "round(f2, 6) + 0.0 AS up_f1 FROM f",
)
def _(spark, sf):
    pairs = common.predictions(spark, sf).select(
        scalars.label_index().alias("y"), scalars.argmax_class(*evaluation.PROBABILITIES).alias("pred")
    )
    return comparable(evaluation.f1_scores(evaluation.confusion_counts(pairs), all_classes=True))


TRUE_P = "CASE y WHEN 0 THEN p_down WHEN 1 THEN p_hold ELSE p_up END"


@query(
    "log_loss",
    f"WITH {P} SELECT round(-avg(ln(least(greatest({TRUE_P}, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) + 0.0 "
    "AS log_loss FROM predictions",
)
def _(spark, sf):
    loss = evaluation.log_loss(scalars.label_index(), evaluation.PROBABILITIES)
    return comparable(common.predictions(spark, sf).agg(loss.alias("log_loss")))


@query(
    "class_prior",
    f"WITH {P} SELECT "
    + ", ".join(
        f"round(avg((y = {i})::INT), 6) + 0.0 AS prior_{n}" for i, n in enumerate(["down", "hold", "up"])
    )
    + " FROM predictions",
)
def _(spark, sf):
    return comparable(evaluation.class_prior(common.predictions(spark, sf)))


@query("majority_baseline", f"WITH {P} SELECT y AS majority FROM predictions GROUP BY y ORDER BY count(*) DESC, y LIMIT 1")
def _(spark, sf):
    return evaluation.majority_class(common.predictions(spark, sf))


def _lagged(source: str) -> str:
    """Rows of a prediction table that have a resolved earlier label, and that label."""
    return f"""lagged AS MATERIALIZED (
    SELECT p.*, r.label AS lagged_label FROM {source} p
    ASOF JOIN (SELECT symbol, label_end_date, label FROM {source} WHERE label_end_date IS NOT NULL) r
    ON r.symbol = p.symbol AND r.label_end_date <= p.date)"""


LAGGED = f"{P}, {_lagged('predictions')}"


@query("persistence_baseline", f"WITH {LAGGED} SELECT symbol, date, label, lagged_label AS pred FROM lagged")
def _(spark, sf):
    rows = evaluation.resolved_label_lag(common.predictions(spark, sf))
    return rows.where(F.col("lagged_label").isNotNull()).select(
        "symbol", "date", "label", F.col("lagged_label").alias("pred")
    )


TRAILING = "CASE WHEN trailing_return > threshold THEN 'UP' WHEN trailing_return < -threshold THEN 'DOWN' ELSE 'HOLD' END"


@query("trailing_return_baseline", f"WITH {P} SELECT symbol, date, {TRAILING} AS pred FROM predictions")
def _(spark, sf):
    return common.predictions(spark, sf).select(
        "symbol", "date", evaluation.trailing_return_label().alias("pred")
    )


def _index(expression: str) -> str:
    return f"CASE {expression} WHEN 'DOWN' THEN 0 WHEN 'HOLD' THEN 1 WHEN 'UP' THEN 2 END::BIGINT"


CUT = "TIMESTAMP '1997-06-01'"
SCALED_ARGMAX = ARGMAX.replace("p_down", "p_down * 1.5::DOUBLE").replace("p_hold", "p_hold * 0.8::DOUBLE").replace(
    "p_up", "p_up * 1.1::DOUBLE"
)


@query(
    "evaluate_model",
    f"""WITH {P},
train AS (SELECT * FROM predictions WHERE date < {CUT}),
tests AS (SELECT * FROM predictions WHERE date >= {CUT}),
{_lagged("tests")},
prior AS (SELECT y, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM train GROUP BY y),
pairs AS (
    SELECT 'model' AS model, y, {ARGMAX} AS pred FROM lagged
    UNION ALL SELECT 'majority_class', y, (SELECT y FROM prior ORDER BY n DESC, y LIMIT 1) FROM lagged
    UNION ALL SELECT 'persistence', y, {_index("lagged_label")} FROM lagged
    UNION ALL SELECT 'trailing_return', y, {_index("(" + TRAILING + ")")} FROM lagged
    UNION ALL SELECT 'model_scaled', y, {SCALED_ARGMAX} FROM lagged
),
f AS ({_f1("pairs")}),
losses AS (
    SELECT 'model' AS model, -avg(ln({TRUE_P})) AS log_loss FROM lagged
    UNION ALL SELECT 'class_prior', -avg(ln(share)) FROM lagged JOIN prior ON prior.y = lagged.y
)
SELECT coalesce(f.model, losses.model) AS model, round((f0 + f1 + f2) / (o0 + o1 + o2), 6) + 0.0 AS macro_f1,
    round(f0, 6) + 0.0 AS down_f1, round(f1, 6) + 0.0 AS hold_f1, round(f2, 6) + 0.0 AS up_f1,
    round(log_loss, 6) + 0.0 AS log_loss FROM f FULL JOIN losses ON f.model = losses.model""",
)
def _(spark, sf):
    rows = common.predictions(spark, sf)
    cut = F.lit("1997-06-01").cast("timestamp_ntz")
    table = evaluation.evaluate_model(
        rows.where(F.col("date") >= cut), rows.where(F.col("date") < cut), SCALE
    )
    return comparable(table)


# --- Seeds and comparisons ---------------------------------------------------------------------

SEEDED = f"""{P},
runs AS (SELECT symbol, date, seed, p_up * (1 - seed * 0.1::DOUBLE) AS p_up, p_down * (1 - seed * 0.05::DOUBLE) AS p_down,
    1 - p_up * (1 - seed * 0.1::DOUBLE) - p_down * (1 - seed * 0.05::DOUBLE) AS p_hold
    FROM predictions, range(3) AS s(seed))"""


def _runs(spark, sf):
    rows = common.predictions(spark, sf).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    rows = rows.withColumns(
        {
            "p_up": F.col("p_up") * (1 - F.col("seed") * F.lit(0.1)),
            "p_down": F.col("p_down") * (1 - F.col("seed") * F.lit(0.05)),
        }
    )
    return rows.withColumn("p_hold", 1 - F.col("p_up") - F.col("p_down"))


@query(
    "seed_average",
    f"WITH {SEEDED} SELECT symbol, date, "
    + ", ".join(f"round(avg({p}), 6) + 0.0 AS {p}" for p in evaluation.PROBABILITIES)
    + " FROM runs GROUP BY ALL",
)
def _(spark, sf):
    return comparable(evaluation.seed_average(_runs(spark, sf)))


@query(
    "seed_mean_and_spread",
    f"WITH {SEEDED}, m AS (SELECT seed, -avg(ln(p_up)) AS log_loss FROM runs GROUP BY seed) "
    "SELECT round(avg(log_loss), 6) + 0.0 AS log_loss_mean, round(stddev_pop(log_loss), 6) + 0.0 AS log_loss_std FROM m",
)
def _(spark, sf):
    per_seed = _runs(spark, sf).groupBy("seed").agg((-F.avg(F.log("p_up"))).alias("log_loss"))
    return comparable(evaluation.mean_and_spread(per_seed, [], ["log_loss"]))


@query(
    "compare_to_baseline",
    f"""WITH {FRAME}, other AS (SELECT frame.* REPLACE (score * (1 + volatility_tercile) AS score) FROM frame),
{_ic("date", "true", MIN_ROWS, "base")}, {_ic("date", "true", MIN_ROWS, "alt", source="other")},
diff AS (SELECT coalesce(alt.date, base.date) AS date, alt.ic - base.ic AS d FROM alt FULL JOIN base ON alt.date = base.date)
SELECT round(avg(d), 6) + 0.0 AS delta_ic, round({_t("diff", "d")}, 4) + 0.0 AS delta_ic_t FROM diff""",
)
def _(spark, sf):
    from quotemill.session import staged

    frame = staged(_frame(spark, sf), "frame")
    other = frame.withColumn("score", F.col("score") * (1 + F.col("volatility_tercile")))
    base = evaluation.rank_ic(frame, "score", "forward_return", min_rows=MIN_ROWS)
    alternative = evaluation.rank_ic(other, "score", "forward_return", min_rows=MIN_ROWS)
    row = evaluation.compare_to_baseline(alternative, base, ["ic"])
    return comparable(row.withColumn("delta_ic_t", F.round("delta_ic_t", 4)))


def _place(seed: int) -> str:
    """Places in a date as the operator draws them."""
    return f"row_number() OVER (PARTITION BY date ORDER BY ('0x' || md5('{seed}:' || symbol)[1:15])::BIGINT, symbol)"


@query(
    "shuffle_within_date",
    f"WITH {P}, takers AS (SELECT symbol, date, {_place(1)} AS place FROM predictions), "
    f"givers AS (SELECT date, p_up, p_down, {_place(7920)} AS place FROM predictions) "
    f"SELECT symbol, date, {rounded('p_up', 'p_down')} FROM takers JOIN givers USING (date, place)",
)
def _(spark, sf):
    frame = common.predictions(spark, sf).select("symbol", "date", "p_up", "p_down")
    return comparable(experiments.shuffle_within_date(frame, ["p_up", "p_down"], seed=1))


@query(
    "shuffle_within_date_totals",
    f"WITH {P} SELECT date, count(*) AS n, round(sum(p_up), 6) + 0.0 AS p_up, round(max(p_down), 6) + 0.0 AS p_down "
    "FROM predictions GROUP BY date",
)
def _(spark, sf):
    frame = common.predictions(spark, sf).select("symbol", "date", "p_up", "p_down")
    moved = experiments.shuffle_within_date(frame, ["p_up", "p_down"], seed=1)
    return comparable(
        moved.groupBy("date").agg(
            F.count(F.lit(1)).alias("n"), F.sum("p_up").alias("p_up"), F.max("p_down").alias("p_down")
        )
    )


# --- Trials ------------------------------------------------------------------------------------

TRIALS = f"""{P},
trials AS (SELECT (substr(symbol, 2)::BIGINT) AS trial, -avg(ln({TRUE_P})) AS log_loss,
    avg(({ARGMAX} = y)::INT) AS macro_f1 FROM predictions GROUP BY symbol),
front AS (SELECT * FROM trials t WHERE NOT EXISTS (SELECT 1 FROM trials o WHERE o.log_loss <= t.log_loss
    AND o.macro_f1 >= t.macro_f1 AND (o.log_loss < t.log_loss OR o.macro_f1 > t.macro_f1)))"""


def _trials(spark, sf):
    from quotemill.session import staged

    rows = common.predictions(spark, sf).withColumns(
        {"y": scalars.label_index(), "pred": scalars.argmax_class(*evaluation.PROBABILITIES)}
    )
    return staged(
        rows.groupBy(F.substring("symbol", 2, 10).cast("bigint").alias("trial")).agg(
            evaluation.log_loss(F.col("y"), evaluation.PROBABILITIES).alias("log_loss"),
            F.avg((F.col("y") == F.col("pred")).cast("double")).alias("macro_f1"),
        ),
        "trials",
    )


@query("pareto_front", f"WITH {TRIALS} SELECT trial, {rounded('log_loss', 'macro_f1')} FROM front")
def _(spark, sf):
    return comparable(modeling.pareto_front(_trials(spark, sf)))


@query(
    "best_trials",
    f"WITH {TRIALS} SELECT trial, {rounded('log_loss', 'macro_f1')} FROM front "
    "ORDER BY front.macro_f1 DESC, front.log_loss, trial LIMIT 3",
)
def _(spark, sf):
    return comparable(modeling.best_trials(modeling.pareto_front(_trials(spark, sf))))


# --- Single features and news timing -----------------------------------------------------------

SINGLE = ["momentum_14d", "volatility_21d", "trailing_return"]


def _mean_ics(source: str, by: str) -> str:
    return f"""numbered_ics AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY date) - 1 AS place FROM {source}),
thin AS (SELECT {by}, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS ic_t FROM numbered_ics WHERE place % 8 = 0 GROUP BY {by})
SELECT n.{by}, round(avg(ic), 6) + 0.0 AS ic, round(any_value(ic_t), 4) + 0.0 AS ic_t, count(*) AS n_dates
FROM numbered_ics n JOIN thin ON thin.{by} = n.{by} GROUP BY n.{by}"""


@query(
    "feature_ics",
    f"WITH {P}, long AS ("
    + " UNION ALL ".join(f"SELECT date, forward_return, '{c}' AS feature, {c} AS score FROM predictions" for c in SINGLE)
    + f"), {_ic('date, feature', 'true', MIN_ROWS, 'ics', source='long')}, {_mean_ics('ics', 'feature')}",
)
def _(spark, sf):
    found = evaluation.feature_ics(common.predictions(spark, sf), SINGLE, min_rows=MIN_ROWS)
    return comparable(found.withColumn("ic_t", F.round("ic_t", 4)))


@query(
    "news_window_ics",
    f"""WITH {sql.PRICES}, {sql.SCORED_NEWS}, {sql.news_features(True)},
moves AS (SELECT symbol, date, adj_close / lag(adj_close) OVER {sql.W} - 1 AS same_day,
    lead(adj_open) OVER {sql.W} / adj_close - 1 AS overnight,
    lead(adj_close) OVER {sql.W} / lead(adj_open) OVER {sql.W} - 1 AS next_day FROM prices),
excess AS (SELECT symbol, date, same_day - median(same_day) OVER (PARTITION BY date) AS same_day,
    overnight - median(overnight) OVER (PARTITION BY date) AS overnight,
    next_day - median(next_day) OVER (PARTITION BY date) AS next_day FROM moves),
toned AS (SELECT e.*, d.tone / d.articles AS score FROM excess e JOIN trading USING (date)
    JOIN daily d ON d.symbol = e.symbol AND d.day_idx = trading.day_idx),
long AS ({" UNION ALL ".join(
    f"SELECT date, '{w}' AS window, score, {w} AS forward_return FROM toned WHERE {w} IS NOT NULL"
    for w in ("same_day", "overnight", "next_day"))}),
{_ic('date, "window"', "true", 3, "ics", source="long")}, {_mean_ics("ics", '"window"')}""",
)
def _(spark, sf):
    table, calendar, daily = common.daily_news(spark, sf, same_day=True)
    found = news_timing.news_window_ics(table, calendar, daily, min_rows=3)
    return comparable(found.withColumn("ic_t", F.round("ic_t", 4)))
