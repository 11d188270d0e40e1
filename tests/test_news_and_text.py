"""Text cleaning, parsing rules, de-duplication, scoring and news features."""

import pytest
from pyspark.sql import functions as F

from quotemill.functions import text
from quotemill.operators.calendar import trading_calendar
from quotemill.plans import news, news_features, sentiment
from quotemill.session import work_path
from quotemill.sources import csv_files


def run(spark, build, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(build("t")).collect()]


HTML = [
    ("<p>a</p>b", " a b"),
    ("x<br/>y<BR >z<hr />w", "x y z w"),
    ("<script type='x'>if (a<b) {}\n</script>k", " k"),
    ("<article>a</article>", " a</article>"),
    ("<body class=x>b</body><table>", " b</body><table>"),
    ("<h2 id=a>t</h2><h7>", " t <h7>"),
    ("<img src=a>&amp;&lt;b&gt; &eacute;&#39;&hellip;", " &<b> é'…"),
    ("&amp;lt;", "&lt;"),
    ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
    ("<a\nhref=x>l</a>", " l "),
    (None, ""),
    ("", ""),
]


def test_strip_html(spark):
    assert run(spark, text.strip_html, [a for a, _ in HTML]) == [b for _, b in HTML]


MARKDOWN = [
    ("![alt](u.png) x", "alt x"),
    ("[name](http://u) y", "name y"),
    ("## Head\ntext\n#no", "Head\ntext\n#no"),
    ("**bold** *it* ***both***", "bold it both"),
    ("__u__ _v_", "u v"),
    ("~~gone~~", "gone"),
    ("`code` ```block```", "code block"),
    ("> quote\n>no", "quote\n>no"),
    ("- one\n* two\n+ three", "one\ntwo\nthree"),
    ("1. one\n22. two\n3.no", "one\ntwo\n3.no"),
    ("a\n---\nb", "a\n\nb"),
    ("a\n| x | y |\nb", "a\n\nb"),
    ("a $1 \\ b", "a $1 \\ b"),
]


def test_strip_markdown(spark):
    assert run(spark, text.strip_markdown, [a for a, _ in MARKDOWN]) == [b for _, b in MARKDOWN]


def test_clean_text(spark):
    values = ["<p>a</p>\t\t <b>b</b>", "a\n\n\n\n\nb", "  x \x1f\n", "&lt;b&gt; **c**", None]
    assert run(spark, text.clean_text, values) == ["a b", "a\n\nb", "x", "<b> c", ""]


def test_dates_that_do_not_parse_are_null(spark):
    values = ["2023-12-16 23:00:00 UTC", "2023-12-16", "2023-13-16 23:00:00 UTC", "2023-12-16 23:00:00", "", None]
    found = run(spark, news.parse_utc, values)
    assert str(found[0]) == "2023-12-16 23:00:00" and found[1:] == [None] * 5


def articles(spark, rows):
    schema = "symbol string, published_at string, title string, url string, lsa_summary string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


def test_dedupe_keeps_the_first_and_prefers_a_summary(spark):
    df = articles(
        spark,
        [
            ("A", "2020-01-01 10:00:00", "Up", "u", None),
            ("A", "2020-01-01 10:00:00", "Up", "u", "s"),
            ("A", "2020-01-01 09:00:00", "UP", "z", None),
            ("A", "2020-01-02 09:00:00", "up", "u", None),
            ("B", "2020-01-01 09:00:00", "up", None, None),
            ("B", "2020-01-01 09:00:00", "up", "a", None),
        ],
    )
    once = news.dedupe_articles(df)
    found = {(r.symbol, str(r.published_at), r.title, r.url, r.lsa_summary) for r in once.collect()}
    assert found == {
        ("A", "2020-01-01 09:00:00", "UP", "z", None),
        ("A", "2020-01-02 09:00:00", "up", "u", None),
        ("B", "2020-01-01 09:00:00", "up", "a", None),
    }
    assert news.dedupe_articles(once).count() == once.count()
    ties = news.dedupe_articles(df.where("url = 'u' and published_at < '2020-01-02'"))
    assert ties.first()["lsa_summary"] == "s"


def test_flooded_days_go_as_a_whole(spark):
    df = articles(spark, [("A", "2020-01-01 10:00:00", f"t{i}", "u", None) for i in range(4)])
    df = df.unionByName(articles(spark, [("A", "2020-01-02 10:00:00", "t", "u", None)]))
    assert news.drop_flooded_days(df, 3).count() == 1
    assert news.drop_flooded_days(df, 4).count() == 5


def test_scores(spark):
    df = spark.createDataFrame([("Profits beat",), ("Fraud, loss and error",), ("nothing",)], "title string")
    rows = {r.title: r for r in sentiment.lexicon_scores(df, "title").collect()}
    assert rows["Profits beat"].sentiment > 0.5 and rows["Fraud, loss and error"].sentiment < -0.5
    assert rows["nothing"].sentiment == 0
    for r in rows.values():
        assert r.p_positive + r.p_negative + r.p_neutral == pytest.approx(1, abs=1e-6)


def test_model_scorer_is_loaded_per_task_and_batched(spark):
    def load():
        seen = []

        def score(texts):
            seen.append(len(texts))
            assert len(texts) <= sentiment.BATCH_SIZE
            assert [len(t) for t in texts] == sorted(len(t) for t in texts)
            return [(0.5, 0.25, 0.25)] * len(texts)

        return score

    df = spark.range(500).selectExpr("repeat('x', cast(id % 97 as int)) || id as title")
    out = sentiment.score_texts(df, "title", load, 3)
    assert out.count() == 500 and out.first()["sentiment"] == 0.25


def test_scoring_is_incremental(spark):
    cache = work_path(spark, "test-scores")
    scored = []

    def score(texts, column):
        scored.append(texts.count())
        return sentiment.lexicon_scores(texts, column)

    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "title string")
    sentiment.score_new_texts(spark, df, cache, "title", score)
    more = df.union(spark.createDataFrame([("c",)], "title string"))
    assert sentiment.score_new_texts(spark, more, cache, "title", score).count() == 3
    sentiment.score_new_texts(spark, more, cache, "title", score)
    assert scored == [2, 1, 0]


def test_unscored_headlines_are_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "title string")
    with pytest.raises(sentiment.UnscoredTextsError):
        sentiment.assert_all_scored(df, df.limit(1))
    sentiment.assert_all_scored(df, df)


def feature_rows(spark, same_day):
    # Friday, Monday, Tuesday, Wednesday; B has no row on Tuesday.
    days = ["2020-01-03", "2020-01-06", "2020-01-07", "2020-01-08"]
    prices = spark.createDataFrame(
        [("A", d) for d in days] + [("B", d) for d in days if d != "2020-01-07"], "symbol string, d string"
    ).selectExpr("symbol", "cast(d as timestamp_ntz) date")
    df = articles(
        spark,
        [
            ("A", "2020-01-03 12:00:00", "profit", "1", "gain"),
            ("A", "2020-01-04 12:00:00", "loss", "2", None),
            ("B", "2020-01-06 12:00:00", "profit", "3", None),
            ("A", "2020-01-08 12:00:00", "profit", "4", None),
            ("C", "2020-01-03 12:00:00", "profit", "5", None),
        ],
    )
    titles = sentiment.lexicon_scores(df.select("title").distinct(), "title")
    summaries = sentiment.lexicon_scores(df.select("lsa_summary").distinct().dropna(), "lsa_summary")
    out = news_features.news_features(prices, df, titles, summaries, same_day, "2009-01-01")
    return {(r.symbol, str(r.date)[:10]): r for r in out.collect()}


def test_features_never_see_their_own_day(spark):
    rows = feature_rows(spark, same_day=False)
    assert len(rows) == 7
    assert rows["A", "2020-01-03"].news_count_1d == 0 and rows["A", "2020-01-03"].sentiment_mean_1d is None
    monday = rows["A", "2020-01-06"]
    # Friday's and Saturday's articles; equal and opposite scores.
    assert monday.news_count_1d == 2 and monday.sentiment_mean_1d == pytest.approx(0)
    assert monday.sentiment_std_7d == pytest.approx(0.375) and monday.positive_ratio_1d == 0.5
    assert monday.negative_count_1d == 1 and monday.summary_count_7d == 1
    assert monday.days_since_last_news == 0 and rows["A", "2020-01-08"].days_since_last_news == 2
    # B's article counts on Tuesday, where B has no price; Wednesday sees it one day later.
    assert rows["B", "2020-01-08"].news_count_1d == 0 and rows["B", "2020-01-08"].news_count_7d == 1
    assert rows["B", "2020-01-08"].days_since_last_news == 1


def test_same_day_features(spark):
    rows = feature_rows(spark, same_day=True)
    assert rows["A", "2020-01-03"].news_count_1d == 1 and rows["A", "2020-01-06"].news_count_1d == 1
    assert rows["A", "2020-01-08"].news_count_1d == 1 and rows["B", "2020-01-06"].news_count_1d == 1


def test_calendar_starts_at_the_history(spark):
    prices = spark.sql("select explode(sequence(date'2020-01-01', date'2020-01-05')) d").selectExpr("cast(d as timestamp_ntz) date")
    found = trading_calendar(prices, "2020-01-03").orderBy("date").collect()
    assert [(str(r.date)[:10], r.day_idx) for r in found] == [("2020-01-03", 1), ("2020-01-04", 2), ("2020-01-05", 3)]


def test_news_file_with_breaks_bodies_and_bad_rows(spark, tmp_path):
    columns = ["Date", "Article_title", "Stock_symbol", "Url", "Article", "Lsa_summary"]
    path = tmp_path / "news.csv"
    path.write_text(
        ",".join(columns)
        + '\n2023-12-16 23:00:00 UTC,"He said ""no"", twice",aapl,http://a,"line\n\nbreak, and comma", short \n'
        + "broken row\n"
        + "2023-99-16,T,b,u,x,\n"
    )
    rows, rejects = csv_files.split_news(csv_files.scan_news_csv(spark, str(path), columns))
    out = news.normalize_news(rows).collect()
    assert [(r.symbol, r.title, r.lsa_summary) for r in out] == [
        ("AAPL", 'He said "no", twice', "short"),
        ("B", "T", None),
    ]
    assert str(out[0].published_at) == "2023-12-16 23:00:00" and out[1].published_at is None
    assert [r.line for r in rejects.collect()] == ["broken row"]


def test_price_files_with_another_header(spark, tmp_path):
    (tmp_path / "aa.csv").write_text(
        "date,volume,open,high,low,close,adj close\n2020-01-02,10,1,2,0.5,2,1\n2020-01-03,10,1,2,0.5,0,1\n"
    )
    (tmp_path / "bb.csv").write_text("date,close,adj close,open,high,low,volume,extra\n2020-01-02,4,2,4,8,2,7,x\n")
    headers = {
        f"file://{tmp_path}/{name}.csv": csv_files.csv_header(spark, f"{tmp_path}/{name}.csv") for name in ("aa", "bb")
    }
    expected = [("AA", 10, 0.5, 1.0, 0.25), ("BB", 7, 2.0, 4.0, 1.0)]
    columns = ["symbol", "volume", "adj_open", "adj_high", "adj_low"]
    # By default every file is read by its own header; a single kind of header is read by Spark's CSV reader.
    found = csv_files.scan_price_csv(spark, f"{tmp_path}/*.csv").orderBy("symbol").select(*columns).collect()
    assert [tuple(r) for r in found] == expected
    alone = csv_files.scan_price_csv(spark, f"{tmp_path}/bb*.csv").select(*columns).collect()
    assert [tuple(r) for r in alone] == expected[1:]
    wrong = {f"{tmp_path}/*.csv": headers[f"file://{tmp_path}/aa.csv"]}
    with pytest.raises(Exception, match="header"):
        csv_files.scan_price_csv(spark, [], headers=wrong).collect()
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        csv_files.scan_price_csv(spark, f"{tmp_path}/none.csv")
    (tmp_path / "short.csv").write_text("close,date,adj close,open,high,low,volume\n1,2020-01-02,1\n")
    with pytest.raises(Exception, match="does not fit"):
        csv_files.scan_price_csv(spark, f"{tmp_path}/[as]*.csv").collect()
    out = csv_files.scan_price_csv(spark, [], headers=headers).orderBy("symbol").collect()
    assert [(r.symbol, r.volume, r.adj_open, r.adj_high, r.adj_low) for r in out] == [
        ("AA", 10, 0.5, 1.0, 0.25),
        ("BB", 7, 2.0, 4.0, 1.0),
    ]


def test_only_references_go_through_python(spark):
    import html

    from quotemill.functions import text

    texts = ["&amp;lt; &copy &notit; &ampx; &#38;amp; &#x80;&#xD800;&#1;", "&", "&&lt;&", "x" * 50, "&am<b>p; &l<i>t;", "&#x1F600;é&Acirc;;", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = df.select("i", text.unescape_entities(F.col("t")).alias("u"), text.strip_html("t").alias("s"), text.strip_tags("t").alias("p")).collect()
    for r in rows:
        assert r.u == (None if texts[r.i] is None else html.unescape(texts[r.i]))
        assert r.s == html.unescape(r.p)
    # The texts stay with Spark: what the Python function is given are the few references in them.
    plan = df.select(text.strip_html("t"))._jdf.queryExecution().optimizedPlan().toString()
    taken = next(line for line in plan.splitlines() if "EvalPython" in line)
    assert "_characters" in taken and "regexp_extract_all" in plan and "regexp_replace(" not in taken
