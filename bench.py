"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from quotemill import catalog
from quotemill.session import get_session

# The wide jobs of each pipeline: prices, news, evaluation, files and streams.
HEADLINES = [
    "compute_stock_indicators",
    "market_indicators",
    "label_stock",
    "build_metrics_dataset",
    "walk_forward_splits",
    "nyse_moving_averages",
    "clean_news",
    "news_features",
    "fuse_prices_news",
    "asof_join_general",
    "score_news_incremental",
    "clean_text",
    "ranking_metrics",
    "calibration_error",
    "evaluate_model",
    "shuffle_within_date",
    "scan_price_csv",
    "stream_news_publish",
    "fit_classifier",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # Start the JVM's and the Python workers' machinery outside the timings.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
