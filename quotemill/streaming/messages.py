"""Article messages: cleaning, keying, publishing and de-duplication, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from quotemill.functions.text import clean_text
from quotemill.operators.repeats import change_repeated
from quotemill.schemas import ARTICLE_SCHEMA
from quotemill.session import staged
from quotemill.sources.articles import BACKFILL_DAYS, backfill_articles, matches_symbols, oldest_first
from quotemill.sources.tables import is_built

# Fields of a message, in order.
MESSAGE_FIELDS = [
    "id", "headline", "summary", "content", "source", "url", "author", "symbols",
    "created_at", "updated_at",
]

# Name of the header with the creation time, in milliseconds.
CREATED_HEADER = "created_at_ms"

# How landing files are compressed.
LANDING_CODEC = "gzip"

# Micro-batches that read what has landed, if there are as many files.
MICRO_BATCHES = 4

# Times keep their microseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def land_articles(articles: DataFrame, path: str) -> None:
    """Append articles to a folder as compressed JSON lines, which :func:`live_articles` follows.

    A compressed file is read by one task, so there should be as many as the readers have cores.
    """
    articles.write.options(**JSON_TIMES, compression=LANDING_CODEC).mode("append").json(path)


def live_articles(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, schema=ARTICLE_SCHEMA
) -> DataFrame:
    """Articles landing as JSON files in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def files_per_batch(spark: SparkSession, path: str, batches: int = MICRO_BATCHES) -> int:
    """Files of a micro-batch, for what has landed by now to be read in so many of them, all of it.

    A micro-batch runs a task and commits files for every partition of the state, however few rows it brings, and reads a compressed
    file with one core. One for each file would take longer with every file, also where the files are small.
    """
    landed = len(spark.read.schema(ARTICLE_SCHEMA).json(path).inputFiles())
    return max(1, -(-landed // batches))


def kafka_articles(spark: SparkSession, bootstrap_servers: str, topic: str) -> DataFrame:
    """Articles from a topic of JSON messages (needs Spark's Kafka connector)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), ARTICLE_SCHEMA).alias("m")).select("m.*")


def creation_time(records: DataFrame) -> Column:
    """The creation time of records, from their header: a topic's own time is that of its writing."""
    found = F.filter("headers", lambda h: h["key"] == CREATED_HEADER)
    return F.timestamp_millis(F.get(found, F.lit(0))["value"].cast("string").cast("bigint"))


def to_message(articles: DataFrame, *others: str) -> DataFrame:
    """Articles to message rows: the fields in order, the body cleaned, then any other columns asked for.

    A body that is delivered again next to its first delivery is cleaned once.
    """
    return change_repeated(articles.select(*MESSAGE_FIELDS, *others), "content", clean_text)


def to_envelope(messages: DataFrame) -> DataFrame:
    """Message rows to records: key, JSON value, and the creation time in whole milliseconds.

    Topics keep no given time of a record, so it is a header as well, see :func:`creation_time`.
    """
    # Missing fields are written as null, like the other fields.
    value = F.to_json(F.struct(*MESSAGE_FIELDS), {"ignoreNullFields": "false", **JSON_TIMES})
    millis = F.unix_millis("created_at")
    header = F.struct(F.lit(CREATED_HEADER).alias("key"), millis.cast("string").cast("binary").alias("value"))
    return messages.select(
        F.col("id").cast("string").alias("key"),
        value.alias("value"),
        F.timestamp_millis(millis).alias("timestamp"),
        F.array(header).alias("headers"),
    )


def from_envelope(records: DataFrame) -> DataFrame:
    return records.select(F.from_json("value", ARTICLE_SCHEMA).alias("m")).select("m.*")


def publish_batch(records: DataFrame, path: str | None = None, kafka: dict[str, str] | None = None) -> None:
    """Write records to a topic, or append them to a parquet store with the same columns."""
    if kafka is not None:
        writer = records.drop("timestamp").write.format("kafka").option("kafka.acks", "all")
        writer.options(**kafka).save()
    else:
        records.write.option("compression", "zstd").mode("append").parquet(path)


def publish_stream(
    articles: DataFrame,
    checkpoint: str,
    path: str | None = None,
    kafka: dict[str, str] | None = None,
    symbols: Sequence[str] = ("*",),
    available_now: bool = False,
) -> StreamingQuery:
    """Publish a stream of articles, one record per article, with a checkpoint."""
    records = to_envelope(to_message(articles.where(matches_symbols(symbols))))
    writer = records.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    if kafka is not None:
        return writer.format("kafka").option("kafka.acks", "all").options(**kafka).start()
    return writer.format("parquet").option("compression", "zstd").option("path", path).start()


# Rows that a task gathers before it keeps one for each id.
FOLD_ROWS = 100_000

# Days a stream remembers an article: the longest back-fill, and a day for what arrives late.
REMEMBERED_DAYS = BACKFILL_DAYS + 1


def dedupe_stream(
    messages: DataFrame, remembered_days: int = REMEMBERED_DAYS, backfill_days: int = BACKFILL_DAYS
) -> DataFrame:
    """Drop re-delivered articles of a stream: the first record of an id within the remembered days.

    The memory must be longer than the back-fill, or rows of the back-fill that arrive after newer live
    rows would count as late. A stream drops what is later than its memory, also first deliveries;
    :func:`missed_articles` finds those.
    """
    if remembered_days <= backfill_days:
        raise ValueError(f"a back-fill of {backfill_days} days needs a longer memory than {remembered_days} days")
    timed = messages.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("created_at", f"{remembered_days} days").dropDuplicatesWithinWatermark(["id"])


def dedupe_lasting(messages: DataFrame, keep_days: int | None = None) -> DataFrame:
    """Drop re-delivered articles of a stream, however late they or their first delivery come.

    Ids are keyed state; no watermark drops anything. Of several versions in one micro-batch the earliest is let through: the rows
    of an id meet in one task, which holds the earliest of each id, so a feed of long rows should limit its micro-batches.
    Rows without an id are no articles. With ``keep_days`` an id is forgotten so long after its last delivery, which calls Python
    for every id; that is for streams that run on, as one that ends with its input would wait for the time to pass. For more ids
    than fit into memory, set RocksDB as the session's state store.
    """

    def earliest_per_id(batches):
        """Of the rows of a task the first version of each id; those without a time come last."""
        held, unseen = [], 0

        def reduced() -> pa.Table:
            rows = pa.Table.from_batches(held)
            order = rows.select(["id", "updated_at"]).append_column("place", pa.array(np.arange(len(rows))))
            order = pc.sort_indices(order, [("id", "ascending"), ("updated_at", "ascending"), ("place", "ascending")], null_placement="at_end")
            ids = rows.column("id").take(order).combine_chunks()
            first = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True)
            return rows.take(order.filter(pa.concat_arrays([pa.array([True]), first])))

        for batch in batches:
            held.append(batch)
            unseen += len(batch)
            if unseen > FOLD_ROWS:
                held, unseen = reduced().to_batches(), 0
        if sum(map(len, held)):
            yield from reduced().to_batches(max_chunksize=10_000)

    def first_delivery(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        rows = pd.concat(list(batches))
        state.update(((state.get[0] if known else 0) + len(rows),))
        state.setTimeoutDuration(keep_days * 86_400_000)
        if not known:
            yield rows.sort_values("updated_at", kind="stable").head(1)

    articles = messages.where(F.col("id").isNotNull())
    if keep_days is None:
        return articles.repartition("id").mapInArrow(earliest_per_id, messages.schema).dropDuplicates(["id"])
    lives = GroupStateTimeout.ProcessingTimeTimeout
    return articles.groupBy("id").applyInPandasWithState(first_delivery, messages.schema, "deliveries long", "append", lives)


def missed_articles(landed: DataFrame, published: DataFrame) -> DataFrame:
    """Articles that have landed, of which no version was published: their latest version, once.

    Run it after the stream to deliver what came later than its memory. Rows without an id are no
    articles.
    """
    known = published.select("id").distinct()
    return dedupe_batch(landed.where(F.col("id").isNotNull()).join(known, "id", "left_anti").select(*landed.columns))


def dedupe_batch(messages: DataFrame) -> DataFrame:
    """The latest version of each article; copies are combined map-side."""
    others = [c for c in messages.columns if c != "id"]
    latest = messages.groupBy("id").agg(
        F.max(F.struct("updated_at", *[F.col(c).alias(f"v_{c}") for c in others])).alias("_m")
    )
    return latest.select("id", *[F.col("_m")[f"v_{c}"].alias(c) for c in others]).select(
        *messages.columns
    )


def finished_days(spark: SparkSession, log: str) -> set[str]:
    """Days that a back-fill has published in full."""
    if not is_built(spark, log):
        return set()
    return {r.day for r in spark.read.schema("day string").json(log).collect()}


def backfill_by_day(
    stored: DataFrame,
    end,
    log: str,
    path: str | None = None,
    kafka: dict[str, str] | None = None,
    symbols: Sequence[str] = ("*",),
    backfill_days: int = BACKFILL_DAYS,
) -> list[str]:
    """Publish the days before ``end`` from the store, oldest first and one by one; returns those published now.

    A day is entered in the ``log`` when all of it is out, so a run that broke off goes on with the day it was at. In a
    folder a day is a partition that is written anew as a whole: nothing is lost or repeated. A topic may hold the
    first part of the broken day twice, which consumers drop by id. Days are told apart by their start, so a run goes on
    if it has the same ``end``.
    """
    spark = stored.sparkSession
    end = end if isinstance(end, Column) else F.lit(end).cast("timestamp")
    first = F.date_format(F.to_utc_timestamp(end, F.current_timezone()), "yyyy-MM-dd'T'HH-mm-ss.SSS").alias("end")
    name = spark.range(1).select(first).first()["end"]
    done, published = finished_days(spark, log), []
    days = {place: f"{name}-{backfill_days - place}d" for place in range(backfill_days)}
    days = {place: day for place, day in days.items() if day not in done}
    if not days:
        return published
    # Read and cleaned once for all days, in the order of the store; putting a day in order reads its rows twice.
    history = backfill_articles(stored, end, symbols, backfill_days).where(F.col("day_slice").isin(*days))
    history = staged(to_message(history, "day_slice"), "back-fill")
    for place, day in days.items():
        records = to_envelope(oldest_first(history.where(F.col("day_slice") == place).drop("day_slice")))
        if kafka is not None:
            publish_batch(records, kafka=kafka)
        else:
            records.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/day={day}")
        spark.createDataFrame([(day,)], "day string").coalesce(1).write.mode("append").json(log)
        published.append(day)
    return published


def backfill_then_live(
    stored: DataFrame,
    live: DataFrame,
    end,
    history_path: str,
    live_path: str,
    checkpoint: str,
    symbols: Sequence[str] = ("*",),
    backfill_days: int = BACKFILL_DAYS,
    available_now: bool = True,
    kafka: dict[str, str] | None = None,
) -> StreamingQuery:
    """Publish the last days from the store, day by day, then follow the live stream, both to folders or to a topic.

    The back-fill is complete before the stream starts; called again with the same ``end`` it goes on where it broke off.
    Consumers drop what both feeds deliver by id.
    """
    backfill_by_day(stored, end, f"{history_path}-days", history_path, kafka, symbols, backfill_days)
    path = None if kafka is not None else live_path
    return publish_stream(live, checkpoint, path, kafka, symbols, available_now)
