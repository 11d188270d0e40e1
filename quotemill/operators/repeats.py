"""Costly changes of a text column whose texts come again and again."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Different texts that a task remembers: the last ones it met.
REMEMBERED = 256
SLOT, FIRST = "_slot", "_first"


def change_repeated(df: DataFrame, column: str, change: Callable[[Column], Column], remembered: int = REMEMBERED) -> DataFrame:
    """``change`` of a text column, made once for rows of a task that are close together and have the same text.

    Every text gets a slot among the last ones met. Only the first row of a slot carries its text through ``change``,
    the others take what came out of it: no row leaves its task or its place, so this needs no shuffle and works on streams.
    Rows of equal texts should stand together, or hardly anything is shared; the result is the same in any order.
    """
    place = df.columns.index(column)

    def mark(batches):
        slots = OrderedDict()
        for batch in batches:
            taken, first = [], []
            for text in batch.column(place).to_pylist():
                new = text not in slots
                if new:
                    slots[text] = slots.popitem(last=False)[1] if len(slots) == remembered else len(slots)
                else:
                    slots.move_to_end(text)
                taken.append(slots[text])
                first.append(new)
            first = pa.array(first, pa.bool_())
            texts = pc.if_else(first, batch.column(place), pa.scalar(None, batch.column(place).type))
            columns = [texts if i == place else c for i, c in enumerate(batch.columns)]
            columns += [pa.array(taken, pa.int32()), first]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, SLOT, FIRST])

    def fill(batches):
        changed = [None] * remembered
        for batch in batches:
            texts = []
            *columns, slots, first = batch.columns
            for text, slot, new in zip(columns[place].to_pylist(), slots.to_pylist(), first.to_pylist(), strict=True):
                if new:
                    changed[slot] = text
                texts.append(changed[slot])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])

    plain = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    marked = T.StructType([*plain, T.StructField(SLOT, T.IntegerType()), T.StructField(FIRST, T.BooleanType())])
    once = df.mapInArrow(mark, marked).withColumn(column, F.when(F.col(FIRST), change(F.col(column))))
    return once.mapInArrow(fill, plain)
