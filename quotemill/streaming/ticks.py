"""Live ticks: landing files, the JSON file stream, and its sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotemill.schemas import TICK_SCHEMA

# Fixed values of a demonstration feed: records per landing file, and files per micro-batch.
RECORDS_PER_FILE = 11
FILES_PER_TRIGGER = 5


def write_landing_files(ticks: DataFrame, path: str, records_per_file: int = 0) -> None:
    """Append ticks as JSON-lines files, of at most ``records_per_file`` records if that is not 0.

    Files appear under their final name only when complete.
    """
    ticks.write.option("maxRecordsPerFile", records_per_file).mode("append").json(path)


def tick_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """JSON landing files with a fixed schema, as a stream; all that have landed unless limited."""
    reader = spark.readStream.schema(TICK_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def rate_stream(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Generated rows ``timestamp, value``, for smoke tests."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def project_result(stream: DataFrame, column: str = "value") -> DataFrame:
    return stream.withColumn("result", F.col(column) + F.lit(1))


def to_console(stream: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
    """Append to the console."""
    writer = stream.writeStream.outputMode("append").format("console").option("truncate", False)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def to_parquet(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append to parquet files, resuming from the checkpoint."""
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("compression", "zstd")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def to_memory(stream: DataFrame, name: str) -> StreamingQuery:
    """Append to an in-memory table, for small checks only."""
    return stream.writeStream.outputMode("append").format("memory").queryName(name).start()
