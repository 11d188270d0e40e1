"""Helpers shared by the operators: batches of texts, safe column names, tables."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.session import staged

# Rows without an id take part as the document with the smallest one.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``staged``, and let go of the shuffles behind it.

    Executors keep shuffle files until the driver's garbage collection finds that nothing refers to them, which may
    be much later. Asking for it between the steps keeps what lies on their disks to that of one step.
    """
    out = staged(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Empty staged tables that nothing reads any more, so that their files do not lie around until the end of a job.

    Each is overwritten by a table without rows. What was written from it stays; reading it again is an error.
    """
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(folder)


def key_of(id_col: str) -> Column:
    """The id, never null, so that plain equality joins find every row."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that clash with nothing, and where each column went."""
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*place.values()), place


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    return [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **arrays: pa.Array) -> pa.RecordBatch:
    """The batch with some columns replaced or added at the end, and some left out."""
    names = [n for n in batch.schema.names if n not in drop]
    columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
    columns.update(arrays)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def schema_with(df: DataFrame, drop: tuple[str, ...] = (), **kinds: T.DataType) -> T.StructType:
    """Schema of ``with_columns`` over the rows of ``df``."""
    fields = {f.name: T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name not in drop}
    for name, kind in kinds.items():
        fields[name] = T.StructField(name, kind, True)
    return T.StructType(list(fields.values()))


def pieces(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is held at once stays small next to long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches whose texts add up to about ``most`` bytes; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for first, last in zip(cuts, cuts[1:], strict=False):
            if last > first:
                yield batch.slice(first, last - first)
