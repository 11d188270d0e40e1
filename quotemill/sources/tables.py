"""Parquet tables: pruned reads, all-or-nothing writes, build-once datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet(
    spark: SparkSession, path: str, columns=None, start_date: str | None = None
) -> DataFrame:
    """Parquet with a date predicate and a column list, both pushed into the scan."""
    df = spark.read.parquet(path)
    if start_date is not None:
        df = df.where(F.col("date") >= F.lit(start_date).cast("timestamp_ntz"))
    return df.select(*columns) if columns else df


def scan_as_table(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Run SQL over a parquet path, named ``{source}`` in the query."""
    return spark.sql(query.replace("{source}", f"parquet.`{path}`"))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """All or nothing: the committer publishes the files only once every task has finished."""
    writer = df.write.mode(mode).option("compression", "zstd")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)


def is_built(spark: SparkSession, path: str) -> bool:
    """Whether a committed parquet table is at the path."""
    try:
        return len(spark.read.format("binaryFile").load(f"{path}/_SUCCESS").columns) > 0
    except AnalysisException:
        return False


def load_or_build(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    force_build: bool = False,
    start_date: str | None = None,
    columns=None,
) -> DataFrame:
    """The table at the path, built first if it is missing or a rebuild is asked for.

    ``start_date`` and ``columns`` only select what is returned; the stored table is complete.
    """
    if force_build or not is_built(spark, path):
        write_parquet(build(), path)
    return scan_parquet(spark, path, columns, start_date)


def write_by_symbol(df: DataFrame, path: str) -> None:
    """Overwrite with the rows of a symbol together.

    Rows are spread over several tasks per symbol and range-sorted, so a heavy symbol is not one file.
    """
    df.repartitionByRange("symbol", "timestamp").sortWithinPartitions("symbol", "timestamp").write.mode(
        "overwrite"
    ).parquet(path)
