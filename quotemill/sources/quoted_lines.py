"""Records of CSV files with line breaks inside quotes, read in parallel from byte ranges of one file.

Whether a line begins inside quotes depends on all lines before it, but only through one bit. A first pass finds, for
every byte range, what the range makes of either value of that bit. These maps are chained over the ranges of a
file, a table of one row per range, by running sums. The second pass then cuts each range into records by itself. What
lies across the edge of a range, a piece at either end, is put together in a small shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.session import staged

# A quoted field begins with a quote and holds doubled ones; text after its end belongs to it up to the next comma.
# Quotes anywhere else are plain characters.
_CLOSED = r'"(?:[^"]+|"")*+"[^,]*+'
_FIELD = rf'(?:{_CLOSED}|[^,"][^,]*+|)'
_FROM_OUTSIDE = re.compile(rf"{_FIELD}(?:,{_FIELD})*+")
_FROM_INSIDE = re.compile(rf'(?:[^"]+|"")*+"[^,]*+(?:,{_FIELD})*+')

# Kinds of pieces: whole records, and those that go on over an edge.
WHOLE, HEAD, TAIL = 0, 1, 2


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open at the end of a line, given whether they are at its start."""
    if '"' not in line:
        return inside
    return (_FROM_INSIDE if inside else _FROM_OUTSIDE).fullmatch(line) is None


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines in the order of the file, with the byte range they begin in."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch that lie in one range: a task may read several ranges, one after the other."""
    ends = pc.run_end_encode(batch.column("start")).run_ends.to_pylist()
    first = 0
    for end in ends:
        part = batch.slice(first, end - first)
        files = pc.run_end_encode(part.column("file"))
        at = 0
        for stop, file in zip(files.run_ends.to_pylist(), files.values.to_pylist(), strict=True):
            yield (file, part.column("start")[0].as_py()), part.slice(at, stop - at)
            at = stop
        first = end


def _range_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether quotes are open at its end if they are closed, or open, at its start."""

    def row(key, state):
        columns = [[key[0]], [key[1]], [state[0]], [state[1]]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["file", "start", "closed", "open"])

    key, state = None, None
    for batch in batches:
        for here, part in _runs(batch):
            if here != key:
                if key is not None:
                    yield row(key, state)
                key, state = here, (False, True)
            lines = part.column("value")
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                if state[0] == state[1]:
                    state = (ends_inside(line, state[0]),) * 2
                else:
                    state = tuple(ends_inside(line, s) for s in state)
    if key is not None:
        yield row(key, state)


def range_states(maps: DataFrame) -> DataFrame:
    """Per range ``(file, start, inside)``: whether quotes are open where it begins.

    A range either sets the bit, keeps it or turns it. So the bit is the one set last, turned as often as there were
    turning ranges since.
    """
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("closed") == F.col("open"), F.col("closed") & ~F.col("open")
    counted = maps.withColumn("_turns", F.sum(turns.cast("int")).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(sets, F.struct("closed", "_turns")), True).over(earlier)
    before = F.coalesce(F.lag("_turns").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    counted = counted.select("file", "start", last.alias("_set"), before.alias("_before"))
    turned = (F.col("_before") - F.coalesce(F.col("_set._turns"), F.lit(0))) % 2 == 1
    return counted.select("file", "start", (F.coalesce(F.col("_set.closed"), F.lit(False)) != turned).alias("inside"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces ``(file, start, place, kind, text)``, ``place`` counting those of a range.

    The lines before the first beginning of a record are a HEAD, the unfinished record at the end is a TAIL. A
    range inside one record is only a HEAD.
    """
    names = ["file", "start", "place", "kind", "text"]
    key, inside, held, place, kind = None, False, [], 0, WHOLE

    def done(rows):
        files, starts, places, kinds, texts = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        columns = [pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(places, pa.int64()), pa.array(kinds, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=names)

    for batch in batches:
        rows = []
        for here, part in _runs(batch):
            if here != key:
                if held:
                    rows.append((*key, place, kind if kind == HEAD else TAIL, "\n".join(held)))
                key, held, place = here, [], 0
                inside = part.column("inside")[0].as_py()
                if inside is None:
                    raise ValueError(f"byte range {here} was not there when the ranges were read first")
                kind = HEAD if inside else WHOLE
            for line in part.column("value").to_pylist():
                held.append(line)
                inside = ends_inside(line, inside)
                if inside:
                    continue
                if kind == HEAD or held != [""]:
                    rows.append((*key, place, kind, "\n".join(held) if len(held) > 1 else line))
                    place += 1
                held, kind = [], WHOLE
        yield done(rows)
    if held:
        yield done([(*key, place, kind if kind == HEAD else TAIL, "\n".join(held))])


def csv_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Records ``(file, start, place, record)`` of CSV files, also of those with line breaks inside quotes.

    Files are split like text files; ``start`` is the byte range a record begins in and ``place`` its number there, so
    the first record of a file is ``start = 0 and place = 0``. Empty lines outside of quotes are no records. The table of
    ranges, one row for each of usually 128 MB, is sent to every task. The files are read once for the ranges, once for what
    lies over their edges and once for the records, and must not change meanwhile.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = _lines(spark, paths)
    maps = staged(lines.mapInArrow(_range_maps, "file string, start long, closed boolean, open boolean"), "csv-ranges")
    states = staged(range_states(maps), "csv-ranges")
    # A broadcast join leaves the lines in their order.
    located = lines.join(F.broadcast(states), ["file", "start"], "left").select("file", "start", "inside", "value")
    pieces = located.mapInArrow(_pieces, "file string, start long, place long, kind int, text string")
    # A record over an edge: its TAIL, ranges that are wholly inside it, and the HEAD where it ends.
    cut = staged(pieces.where(F.col("kind") != WHOLE), "csv-pieces")
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.last(F.when(F.col("kind") == TAIL, F.struct("start", "place")), True).over(order)
    owned = cut.select("file", "start", "place", begins.alias("begin"))
    parts = F.sort_array(F.collect_list(F.struct("start", "place", "text")))
    joined = cut.join(owned, ["file", "start", "place"]).groupBy("file", "begin").agg(parts.alias("parts"))
    joined = joined.select(
        "file", "begin.start", "begin.place", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("record")
    )
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "start", "place", F.col("text").alias("record"))
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.where(F.col("record") != "")
