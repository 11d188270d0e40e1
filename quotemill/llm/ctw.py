"""Language-model scoring by context-tree weighting over byte contexts.

Every bit of a byte is coded in the tree that belongs to the bits before it, whose nodes are the last
0, 1, ... ``depth`` bytes. A node holds the Krichevsky-Trofimov estimate of its bit counts and mixes it half
and half with what its longer contexts say. After training, the share that a node's own estimate has kept in
this mixture is its weight, so the probability of a bit is found from the longest context upwards.

Work is divided in two ways. Documents are dealt into blocks of bounded size; a block asks once for every context
and word that occurs in it, and gets the answers back as a table of its own. Contexts are
divided by their last three bytes: all longer contexts of such a triple are in one partition, which weights its
part of the trees alone, some subtrees at a time. Only the nodes of up to two bytes need all partitions: their counts
are summed in one more aggregation. UTF-8 has some 33,000 pairs of bytes, each with at most 255 nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.text import by_bytes, stage, texts_of
from quotemill.llm.word_hashes import WordHasher

DEPTH = 5
BLOCK_BYTES = 32_000_000
# Bytes of text turned into numbers at once, of which each byte takes some fifty.
PIECE_BYTES = 250_000
# Numbers that gather, at least, before they are folded.
FOLD = 250_000
# Rows of a batch that goes back to Spark.
SENT = 50_000
# Context bytes that all nodes of a partition's subtree share, and codes that are weighted together.
SHARED = 3
TOGETHER = 25_000
HELD_OUT = (7, 2)
# No byte of UTF-8 text: stands before the first byte and after the last.
EDGE = 0xFF
GRAM, WORD = 0, 1
# The end of a text, counted as a word.
END = 0
LN10 = math.log(10)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after moving small arguments up."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] += np.log(x[low])
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to any sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for every byte and end of the lower-cased texts, and where each text starts.

    From its highest byte down a number holds the contexts from the nearest to the farthest byte, then the
    byte itself, so ordering the numbers puts the contexts of a common ending together.
    """
    edge = bytes([EDGE])
    joined = np.frombuffer(b"".join(edge * depth + t.lower() + edge for t in texts), np.uint8).astype(np.int64)
    codes = joined[depth:].copy()
    for back in range(1, depth + 1):
        codes |= joined[depth - back : len(joined) - back] << (8 * (depth + 1 - back))
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(codes), bool)
    ends = np.cumsum(sizes + depth)[:-1] - depth
    for k in range(depth):
        keep[ends + k] = False
    return codes[keep], starts


class Words:
    """Hashes of the words of texts, each text closed by its end."""

    def __init__(self):
        self.hasher = WordHasher()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words one after the other, and where each text starts."""
        words, sizes = [], []
        for hashes, first in self.hasher.batches(texts):
            words.append(np.insert(hashes, first[1:], END))
            sizes.append(np.diff(first) + 1)
        sizes = np.concatenate(sizes)
        return np.concatenate(words).view(np.int64), np.cumsum(sizes) - sizes


class Places:
    """Where each of some distinct keys stands, as an open-addressing table that is asked for many at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys, 0)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """Places of keys, all of which must be known."""
        at = self._first(asked)
        out = self.slots[at]
        left = np.flatnonzero(self.keys[out] != asked)
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.slots[at[left]]
            left = left[self.keys[out[left]] != asked[left]]
        return out


def _bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the eight bits of each code's byte: the tree (1 and the bits before) and the bit."""
    byte = codes & 255
    k = np.arange(8)[:, None]
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


class ContextNodes:
    """The nodes of ``shortest`` and more context bytes above some codes, weighted from the longest up."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, shortest: int = 2):
        tree, self.bit = _bits(codes)
        weights = np.broadcast_to(counts, tree.shape).ravel().astype(float)
        ones = weights * self.bit.ravel()
        self.at, self.kt, self.own, self.keys = {}, {}, {}, {}
        longer = None
        for d in range(depth, shortest - 1, -1):
            keys, at = np.unique(((codes >> (8 * (depth - d + 1))) << 8 | tree).ravel(), return_inverse=True)
            n1 = np.bincount(at, ones, len(keys))
            n0 = np.bincount(at, weights, len(keys)) - n1
            own = log_kt(n0, n1)
            if longer is None:
                mixed = own
            else:
                child_keys, child = longer
                parent = np.searchsorted(keys, (child_keys >> 16) << 8 | (child_keys & 255))
                mixed = math.log(0.5) + np.logaddexp(own, np.bincount(parent, child, len(keys)))
                self.own[d] = np.exp(math.log(0.5) + own - mixed)
            self.at[d], self.kt[d], self.keys[d] = at, (n1 + 0.5) / (n0 + n1 + 1), keys
            longer = keys, mixed
        self.top = {"key": longer[0], "zeros": n0, "ones": n1, "mixed": longer[1]}
        self.depth, self.shortest, self.tree, self.codes = depth, shortest, tree, codes

    def log10_probabilities(self, top: TopNodes, pairs: PairNodes | None = None) -> np.ndarray:
        """Of the codes' bytes after their contexts; ``pairs`` if the shortest contexts here have three bytes."""
        p = self.kt[self.depth][self.at[self.depth]]
        for d in range(self.depth - 1, self.shortest - 1, -1):
            own = self.own[d][self.at[d]]
            p = own * self.kt[d][self.at[d]] + (1 - own) * p
        if pairs is not None:
            two = np.searchsorted(pairs.key, ((self.codes >> (8 * (self.depth - 1))) << 8 | self.tree).ravel())
            p = pairs.own[two] * pairs.kt[two] + (1 - pairs.own[two]) * p
        one = ((self.codes >> (8 * self.depth)) << 8 | self.tree).ravel()
        p = top.own1[one] * top.kt1[one] + (1 - top.own1[one]) * p
        none = self.tree.ravel()
        p = top.own0[none] * top.kt0[none] + (1 - top.own0[none]) * p
        p = np.where(self.bit.ravel() == 1, p, 1 - p).reshape(self.tree.shape)
        return np.log(p).sum(axis=0) / LN10


class PairNodes:
    """The nodes of two context bytes, in the order of their keys."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray):
        order = np.argsort(key)
        self.key, self.zeros, self.ones = key[order], zeros[order], ones[order]
        self.kt, self.own, self.mixed = TopNodes._nodes(self.zeros, self.ones, longer[order])


class TopNodes:
    """The nodes of one context byte and of none, as dense tables."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray):
        size = 1 << 16
        n0, n1, below = (np.bincount(key, v, size) for v in (zeros, ones, longer))
        self.kt1, self.own1, mixed = self._nodes(n0, n1, below)
        tree = np.arange(size) & 255
        self.kt0, self.own0, _ = self._nodes(*(np.bincount(tree, v, 256) for v in (n0, n1, mixed)))

    @staticmethod
    def _nodes(n0, n1, below):
        own = log_kt(n0, n1)
        mixed = math.log(0.5) + np.logaddexp(own, below)
        return (n1 + 0.5) / (n0 + n1 + 1), np.exp(math.log(0.5) + own - mixed), mixed


def _whole(batches) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _above(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the nodes with one context byte less, and the sums of the values over their children."""
    keys, at = np.unique((key >> 16) << 8 | (key & 255), return_inverse=True)
    return keys, *(np.bincount(at, v, len(keys)) for v in values)


def _subtrees(codes: np.ndarray, counts: np.ndarray, shift: int, together: int):
    """Codes and counts in pieces of about ``together`` codes; codes that agree above ``shift`` bits stay together."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    root = codes >> shift
    starts = np.flatnonzero(root[1:] != root[:-1]) + 1
    _, first = np.unique(starts // together, return_index=True)
    cuts = [0, *starts[first].tolist(), len(codes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield codes[a:b], counts[a:b]


def _in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Documents with the number of their block, drawn by hash; the number of blocks follows their size."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.crc32(name) % HELD_OUT[0] == HELD_OUT[1]).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = F.lit(size // block_bytes + 1)
    return plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), blocks))


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys or not sum(map(len, keys)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Sorted and summed where they lie: numpy's unique with its inverse holds twice as much.
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys, counts = keys[order], np.concatenate(counts)[order]
    del order
    starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    return keys[starts], np.add.reduceat(counts, starts)


class Counts:
    """Sums by key of what is added, in the order of the keys."""

    def __init__(self):
        self.keys = self.counts = np.zeros(0, np.int64)
        self.new: tuple[list, list] = ([], [])

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        for held, more in zip(self.new, (keys, counts), strict=True):
            held.append(more)
        # In proportion to what is held, so that it is copied a few times only.
        if sum(map(len, self.new[0])) > max(FOLD, len(self.keys) // 2):
            self.fold()

    def fold(self) -> None:
        keys, counts = _counted(*self.new)
        self.new = ([], [])
        # Only what is new is sorted; the rest makes room for it.
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.counts[at[known]] += counts[known]
        self.keys = np.insert(self.keys, at[~known], keys[~known])
        self.counts = np.insert(self.counts, at[~known], counts[~known])


def _asked(blocks: DataFrame, depth: int) -> DataFrame:
    """Per block, every context with a next byte and every word in it, with its training count."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts come and counts go in batches, so that neither is held whole.
        words, held, block = Words(), {GRAM: Counts(), WORD: Counts()}, None
        for batch in by_bytes(batches, "text", PIECE_BYTES):
            block = batch.column("block")[0].as_py()
            texts = texts_of(batch, "text")
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for kind, counts in held.items():
                found, starts = grams(texts, depth) if kind == GRAM else words.of(texts)
                used = np.repeat(train, np.diff([*starts, len(found)]))
                for part in (True, False):
                    k, n = np.unique(found[used == part], return_counts=True)
                    counts.add(k, n if part else np.zeros_like(n))
        for kind, counts in held.items():
            counts.fold()
            for a in range(0, len(counts.keys), SENT):
                k, n = counts.keys[a : a + SENT], counts.counts[a : a + SENT]
                columns = [np.full(len(k), kind, np.int8), k, np.full(len(k), block), n]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["kind", "key", "block", "n"])

    return blocks.groupBy("block").applyInArrow(ask, "kind byte, key long, block long, n long")


def _log_probabilities(trained: DataFrame, depth: int) -> DataFrame:
    """Per context and byte the log10 probability under all training counts: ``key, value``."""
    # The last context bytes decide the partition, so that each holds whole subtrees.
    shared, together = min(SHARED, depth), TOGETHER
    shift = 8 * (depth + 1 - shared)
    n = int(trained.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = trained.repartition(n, F.shiftright(F.col("key"), shift))

    def upper(batches):
        for codes, counts in _subtrees(*_whole(batches), shift, together):
            top = ContextNodes(codes, counts, depth, shared).top
            sums = _above(top["key"], top["zeros"], top["ones"], top["mixed"])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, sums)), ["key", "zeros", "ones", "mixed"])

    sums = split.mapInArrow(upper, "key long, zeros double, ones double, mixed double").groupBy("key")
    nodes = sums.agg(F.sum("zeros"), F.sum("ones"), F.sum("mixed")).toArrow()
    nodes, pairs = [nodes.column(i).to_numpy() for i in range(4)], None
    if shared == SHARED:
        pairs = PairNodes(*nodes)
        nodes = _above(pairs.key, pairs.zeros, pairs.ones, pairs.mixed)
    top = TopNodes(*nodes)

    def score(batches):
        for codes, counts in _subtrees(*_whole(batches), shift, together):
            values = ContextNodes(codes, counts, depth, shared).log10_probabilities(top, pairs)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(values.astype(np.float32))], ["key", "value"])

    # Written, so that neither of the two shuffles is kept for the steps that follow.
    return stage(split.mapInArrow(score, "key long, value float"), "ctw-values")


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "score double, n_bytes long, bits_per_byte double"
)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: its probability under the model and under single word counts.

    Texts are lower-cased (A-Z). Documents whose crc32(id as text) mod 7 is 2 are held out, all others train both
    the context trees and the word counts. ``score`` is the log10 probability that the trees give to the bytes of
    the whole text and its end, ``bits_per_byte`` the code length of the same for each of the ``n_bytes`` and the end.
    ``base_score`` sums log10((c + 1) / (N + V + 1)) over the words and one end. A null text is the empty one,
    of a single token; a null id is the empty string when dividing and comes back null; rows repeating an id
    are documents of their own. Words are told apart by 64-bit hashes. Without documents there are no rows.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6 bytes, so that contexts fit a long")
    blocks = _in_blocks(docs, id_col, text_col, block_bytes)
    asked = stage(_asked(blocks, depth), "ctw-asked")
    counts = stage(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    words = counts.filter(F.col("kind") == WORD)
    n_train, n_distinct = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    n_train = n_train or 0
    whole = float(n_train + n_distinct + 1)
    trees = _log_probabilities(counts.filter(F.col("kind") == GRAM).select("key", "n"), depth)
    values = trees.select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value", F.lit(0).cast("long").alias("count")).union(
        words.select("kind", "key", F.lit(0.0).cast("float"), "n")
    )
    answers = asked.select("kind", "key", "block").join(values, ["kind", "key"]).select("block", "kind", "key", "value", "count")

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kind, key = (answers.column(c).to_numpy() for c in ("kind", "key"))
        is_gram = kind == GRAM
        contexts, counted = Places(key[is_gram]), Places(key[~is_gram])
        logs = answers.column("value").to_numpy()[is_gram]
        times = answers.column("count").to_numpy()[~is_gram]
        base_logs, seen = np.log10((times + 1) / whole), times > 0
        del kind, key, is_gram, times
        words, out = Words(), []
        for batch in by_bytes(texts.to_batches(), "text", PIECE_BYTES):
            data = texts_of(batch, "text")
            found, starts = grams(data, depth)
            total = np.add.reduceat(logs[contexts.of(found)].astype(float), starts)
            found, starts = words.of(data)
            place = counted.of(found)
            sizes = np.array([len(t) for t in data])
            columns = [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(np.diff([*starts, len(found)])),
                pa.array(np.add.reduceat(seen[place].astype(np.int64), starts)),
                pa.array(np.full(len(data), n_train, np.int64)),
                pa.array(np.add.reduceat(base_logs[place], starts)),
                pa.array(total),
                pa.array(sizes),
                pa.array(-total / math.log10(2) / (sizes + 1)),
            ]
            out.append(pa.Table.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")]))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
