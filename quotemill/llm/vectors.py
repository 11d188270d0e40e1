"""Helpers for columns of vectors: whole numbers from their entries, sums over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_entries(batch: pa.RecordBatch, dim: int, scale: float, most: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and ``floor(scale * entry)`` of the rows with ``dim`` entries, none null or non-finite.

    The batch has the columns ``id`` and ``vector``. Whole numbers beyond ``most`` count as ``most``.
    """
    vectors = batch.column(batch.schema.get_field_index("vector"))
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    ids, vectors = batch.column(batch.schema.get_field_index("id")).filter(right), vectors.filter(right)
    # Nulls among the entries arrive as NaN.
    entries = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(entries).all(axis=1)
    whole = np.clip(np.floor(entries[finite] * scale), -most, most).astype(np.int64)
    return ids.filter(pa.array(finite)), whole


def rows_of(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def as_lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], list], exact: bool = False) -> dict[int, object]:
    """Sums by position of the lists that ``partial`` makes of each task's batches.

    Each task gives one list, of a length that depends on the dimensions alone, so what is shuffled and returned does
    not grow with the rows. ``exact`` sums are of whole numbers of up to 38 digits.
    """
    kind = pa.decimal128(38) if exact else pa.float64()

    def run(batches):
        values = partial(batches)
        values = [Decimal(int(v)) for v in values] if exact else values
        where = pa.array(np.arange(len(values), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([where, pa.array(values, kind)], names=["place", "value"])

    parts = df.mapInArrow(run, f"place int, value {'decimal(38,0)' if exact else 'double'}")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    return {r.place: int(r.value) if exact else r.value for r in rows}


def gram(rows: np.ndarray) -> np.ndarray:
    """``rows.T @ rows`` of whole numbers, exactly, as Python integers.

    Products are summed as doubles for as many rows as stay below 2^53, which is all there are in practice.
    """
    dim = rows.shape[1]
    total = np.zeros((dim, dim), dtype=object)
    if not rows.size:
        return total
    largest = int(np.abs(rows).max())
    if largest**2 >= 2**53:
        big = rows.astype(object)
        return big.T.dot(big)
    step = max(1, 2**53 // max(largest**2, 1))
    for start in range(0, len(rows), step):
        part = rows[start : start + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total
