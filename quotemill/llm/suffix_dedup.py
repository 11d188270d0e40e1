"""Suffix dedup: remove every byte inside a long string that also starts somewhere else.

Two equal strings of ``length`` bytes have the same *anchor*: the leftmost smallest hash among their short
substrings, at the same distance from their start. So each document is cut into runs of starting places with a common
anchor; a run's *slice* is the text of its strings. Slices that could share a string have the same key, a hash of
the bytes that all strings at such distances from the anchor hold. Slices without a partner are done
with; equal slices repeat as a whole; only different slices with the same key need their suffixes sorted.

Those are laid out in columns, aligned at their anchors, and sorted from the last column to the first: each round
inserts one symbol per slice in front of its suffix. The suffixes of a round are put in order by that symbol and
their order in the round before, which makes the symbols before them the collection's Burrows-Wheeler
transform, and common prefixes grow by one or are cut to the least on the way between two neighbours. A string
repeats where its suffix shares ``length`` bytes with a neighbour. As equal strings stand in the same column, a round
keeps the suffixes of one column only, and each is read and replaced in sequence.

Keys with very many different slices are split by a narrower range of distances, whose strings have more bytes
in common, until single strings are left, for which counting is enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.text import key_of, pieces, stage, texts_of

LENGTH = 400
GRAM = 32
# Ranges of distances from the anchor at first; keys with more slices than LARGEST halve theirs.
RANGES = 2
LARGEST = 4096
# Starting places hashed at once, and slices sorted at once.
CHUNK = 1 << 21
COLLECTION = 8192

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _rng.integers(0, 2**63, 8)]


def _name(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - 2**63


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """For each place with a whole string ahead, the place of its anchor."""
    h = _TABLE[data]
    size, step = 1, 0
    while size < GRAM:
        h = h[:-size] * _ODD[step] + h[size:]
        size, step = 2 * size, step + 1
    h ^= h >> np.uint64(33)
    h *= _ODD[-1]
    # Forty bits of the hash, then the place, so that the smallest is also the leftmost.
    h &= np.uint64(0xFFFFFFFFFF << 24)
    h |= np.arange(len(h), dtype=np.uint64)
    width = length - GRAM + 1
    n = len(h) - width + 1
    blocks = np.full(-(-len(h) // width) * width, 2**64 - 1, np.uint64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def _cuts(length: int, ranges: int) -> np.ndarray:
    """First distances of equal ranges over all distances from a string's start to its anchor."""
    return np.unique(np.linspace(0, length - GRAM + 1, ranges + 1).astype(np.int64))


def _key(data: bytes, anchor: int, cuts: np.ndarray, number: int, length: int) -> int:
    """Name of the bytes common to all strings whose distance to the anchor is in this range."""
    low, high = int(cuts[number]), int(cuts[number + 1])
    return _name(data[anchor - low : anchor - high + 1 + length], number + 1)


def runs_of(text: bytes, length: int, ranges: int = RANGES):
    """Runs of starting places: ``(key, slice, first, last, lead)``, lead being the distance to the anchor."""
    cuts = _cuts(length, ranges)
    for start in range(0, len(text) - length + 1, CHUNK):
        data = text[start : start + CHUNK + length - 1]
        anchors = _anchors(np.frombuffer(data, np.uint8), length)
        number = np.searchsorted(cuts, anchors - np.arange(len(anchors)), side="right") - 1
        edges = np.flatnonzero((np.diff(anchors) != 0) | (np.diff(number) != 0)) + 1
        firsts = np.concatenate([[0], edges])
        lasts = np.concatenate([edges - 1, [len(anchors) - 1]])
        for first, last, anchor, k in zip(
            firsts.tolist(), lasts.tolist(), anchors[firsts].tolist(), number[firsts].tolist(), strict=True
        ):
            part = data[first : last + length]
            yield _key(data, anchor, cuts, k, length), _name(part), start + first, start + last, anchor - first


RUNS = "id long, text_hash long, key long, slice long, first int, last int, lead int"


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def cut(batches):
        for batch in pieces(batches, 200):
            rows = []
            for name, digest, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, "text"), strict=True
            ):
                rows += [(name, digest, *run) for run in runs_of(text, length)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3
            names = [c.split()[0] for c in RUNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("id", "text_hash", "text").mapInArrow(cut, RUNS)


def sort_columns(slices: list[bytes], leads: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """Starting places of each slice whose string also starts in another slice of its group.

    ``groups`` numbers the collections from 0; slices of different ones are never compared.
    """
    m = len(slices)
    sizes = np.array([len(s) for s in slices])
    lead = int(leads.max())
    begins = lead - leads  # the anchor is in column ``lead`` for all
    ends = begins + sizes
    width = int(ends.max())
    table = np.zeros((width, m), np.uint8)
    for i, s in enumerate(slices):
        table[begins[i] : ends[i], i] = np.frombuffer(s, np.uint8)
    by_end = np.argsort(groups, kind="stable")
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[list[int]] = [[] for _ in range(m)]
    for column in range(width - 1, -1, -1):
        # Slices that end here come before all others: nothing follows their symbol.
        fresh = by_end[ends[by_end] == column + 1]
        rows = np.concatenate([fresh, order])
        least = np.concatenate([np.zeros(len(fresh), np.int64), common])
        if len(order) and len(fresh):
            least[len(fresh)] = 0
        here = np.flatnonzero(begins[rows] <= column)
        key = groups[rows[here]] * 256 + table[column, rows[here]]
        sort = np.argsort(key, kind="stable")
        place, key = here[sort], key[sort]
        common = np.zeros(len(place), np.int64)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(same):
            # Least common prefix on the way from one to the other in the order of the round before.
            spans = np.empty(2 * len(same), np.int64)
            spans[::2], spans[1::2] = place[same - 1] + 1, place[same] + 1
            common[same] = 1 + np.minimum.reduceat(np.append(least, 0), spans)[::2]
        order = rows[place]
        long = common >= length
        if long.any():
            for i in order[long | np.append(long[1:], False)]:
                found[i].append(column - begins[i])
    return [np.array(f[::-1], np.int64) for f in found]


def _stretches(places: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, breaks + 1]].tolist(), places[np.r_[breaks, len(places) - 1]].tolist(), strict=True))


# Different slices: ``home`` and ``off`` say where a slice stands in one of the first runs, ``lead`` where its anchor is.
SLICES = "home long, off int, key long, slice long, lead int, n long, data binary"
FOUND = "home long, first int, last int"


def _sorted_slices(slices: DataFrame, length: int) -> DataFrame:
    """Repeating starting places in slices, grouped by key, whose numbers are bounded."""

    def work(held):
        data = [d for b in held for d in b.column("data").to_pylist()]
        keys, leads, homes, offs = (
            np.concatenate([b.column(c).to_numpy().astype(np.int64) for b in held]) for c in ("key", "lead", "home", "off")
        )
        _, groups = np.unique(keys, return_inverse=True)
        rows = []
        for i, places in enumerate(sort_columns(data, leads, groups, length)):
            rows += [(int(homes[i]), int(offs[i]) + a, int(offs[i]) + b) for a, b in _stretches(places)]
        if rows:
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["home", "first", "last"]
            )
        return None

    def sort(batches):
        held, size, last = [], 0, None
        for batch in pieces(batches):
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if size >= COLLECTION and keys[a] != last:
                    if (out := work(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + b - a, keys[a]
        if held and (out := work(held)) is not None:
            yield out

    n = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slices.repartition(n, "key").sortWithinPartitions("key").mapInArrow(sort, FOUND)


def _split(slices: DataFrame, length: int, ranges: int) -> DataFrame:
    """The same starting places as shorter slices, cut at narrower ranges of distances."""
    cuts = _cuts(length, ranges)

    def cut(batches):
        for batch in pieces(batches, 500):
            rows = []
            for home, off, _, _, lead, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = np.arange(len(data) - length + 1)
                number = np.searchsorted(cuts, lead - places, side="right") - 1
                edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(places)]
                for a, b in zip(edges, edges[1:], strict=False):
                    part = data[a : b - 1 + length]
                    rows.append((home, off + a, _key(data, lead, cuts, int(number[a]), length), _name(part), lead - a, n, part))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], batch.schema.names)

    return slices.select(*[c.split()[0] for c in SLICES.split(", ")]).mapInArrow(cut, SLICES)


def _repeats_among(slices: DataFrame, length: int, ranges: int) -> DataFrame:
    """Repeating starting places ``(home, first, last)`` among different slices."""
    found = None
    while True:
        groups = slices.groupBy("key").agg(F.count("*").alias("slices"))
        small = slices.join(groups.filter((F.col("slices") > 1) & (F.col("slices") <= LARGEST)).select("key"), "key")
        here = _sorted_slices(small, length)
        found = here if found is None else found.union(here)
        large = groups.filter(F.col("slices") > LARGEST).select("key")
        if large.isEmpty():
            return found
        ranges = min(2 * ranges, length - GRAM + 1)
        parts = stage(_split(slices.join(large, "key"), length, ranges), "suffix-parts")
        # Parts that are equal repeat as a whole; one of them stands for all from here on.
        equal = parts.groupBy("key", "slice").agg(F.count("*").alias("rows")).filter("rows > 1").select("key", "slice")
        last = F.col("off") + F.octet_length("data") - length
        whole = parts.join(equal, ["key", "slice"])
        found = found.union(whole.select("home", F.col("off").alias("first"), last.cast("int").alias("last")))
        # What is found for one of several equal parts holds for them all, and they are found already.
        slices = stage(parts.dropDuplicates(["key", "slice"]), "suffix-slices")


def find_repeats(docs: DataFrame, length: int) -> DataFrame:
    """Repeating starting places of documents ``(id, text_hash, text)``: ``(id, text_hash, first, last)``."""
    runs = stage(_runs(docs, length), "suffix-runs")
    keys = runs.groupBy("key").agg(
        F.count("*").alias("rows"), F.min("slice").alias("low"), F.max("slice").alias("high")
    )
    # Written before the join, so that adaptive execution can split the rows of a hot key.
    keys = stage(keys.filter("rows > 1").select("key", (F.col("low") != F.col("high")).alias("mixed")), "suffix-keys")
    met = stage(runs.join(keys, "key"), "suffix-met")
    alike = met.filter("not mixed").select("id", "text_hash", "first", "last")

    mixed = met.filter("mixed")
    home = F.xxhash64("key", "slice")
    place = F.struct("id", "text_hash", "first", "last", "lead")
    kinds = mixed.groupBy("key", "slice").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    kinds = stage(kinds.select(home.alias("home"), "key", "slice", "n", "at.*"), "suffix-kinds")
    slices = stage(_slice_bytes(docs, kinds, length), "suffix-slices")
    repeats = _repeats_among(slices, length, RANGES)
    whole = kinds.filter("n > 1").select("home", F.lit(0).alias("a"), (F.col("last") - F.col("first")).alias("b"))
    inside = whole.union(repeats.select("home", "first", "last"))
    partly = mixed.withColumn("home", home).join(inside, "home")
    partly = partly.select("id", "text_hash", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last"))
    return alike.union(partly)


def _slice_bytes(docs: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """The bytes of each different slice, cut from one of the documents that hold it."""
    wanted = kinds.groupBy("id", "text_hash").agg(
        F.collect_list(F.struct("home", "key", "slice", "first", "last", "lead", "n")).alias("wanted")
    )

    def cut(batches):
        for batch in pieces(batches, 200):
            rows = []
            for text, wanted in zip(texts_of(batch, "text"), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    data = text[w["first"] : w["last"] + length]
                    rows.append((w["home"], 0, w["key"], w["slice"], w["lead"], w["n"], data))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = [c.split()[0] for c in SLICES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    found = docs.join(wanted, ["id", "text_hash"]).select("text", "wanted").mapInArrow(cut, SLICES)
    # Rows that repeat an id and text give their slices again.
    return found.dropDuplicates(["home"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes).

    Every byte covered by a string of ``length`` bytes (UTF-8) that also starts at another place of any document,
    the same one included, is removed; overlapping occurrences count, and all strings are judged on the input.
    ``n_spans`` counts the maximal removed runs. Matches never cross documents. A null text is empty. Rows that repeat
    an id and a text are two occurrences of all their strings; rows that only share an id are documents of
    their own; a null id comes back null. Strings are told apart by the bytes themselves where different texts
    meet, and by 64-bit hashes where equal texts do. Without documents there are no rows.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        key_of(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    )
    repeats = find_repeats(texts.select("id", "text_hash", "text"), length)
    spans = repeats.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = texts.join(spans, ["id", "text_hash"], "left").select("doc_id", "text", "spans")

    def remove(batches):
        for batch in pieces(batches, 200):
            rows = []
            for name, text, spans in zip(
                batch.column(0).to_pylist(), texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True
            ):
                kept, at, removed, n = [], 0, 0, 0
                merged: list[list[int]] = []
                for first, last in sorted((s["first"], s["last"] + length) for s in spans or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last)
                    else:
                        merged.append([first, last])
                for first, last in merged:
                    kept.append(text[at:first])
                    removed, n, at = removed + last - first, n + 1, last
                kept.append(text[at:])
                rows.append((name, len(text), removed, n, b"".join(kept)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
