"""Benchmark decontamination: match documents against a suffix automaton of the test items."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.text import pieces, renamed, schema_with, texts_of, with_columns, without

WINDOW = 10
# Words are runs of these bytes after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Items whose texts add up to more are matched in several blocks, one automaton at a time.
BLOCK_BYTES = 2_000_000


class ItemAutomaton:
    """Generalised suffix automaton over the words of all items.

    A state stands for the word sequences that end at the same places of the items. Every state with
    sequences of ``window`` words knows the items that hold them; the end of an item shorter than that
    is marked, since such an item counts as one window.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for name, text in items:
            words = [self.words.setdefault(w, len(self.words)) for w in WORD.findall(text.lower())]
            state, path = 0, []
            for word in words:
                state = self._extend(state, word)
                path.append(state)
            if words:
                ends.append((name, words))
        self._mark(ends)

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            there = self.next[last][word]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            same = self.length[there] == self.length[at] + 1
            self.link[new] = there if same else self._split(at, word, there)
        return new

    def _split(self, at: int, word: int, there: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _mark(self, ends: list[tuple[str, list[int]]]) -> None:
        window, link, length = self.window, self.link, self.length
        self.items: dict[int, set[str]] = {}
        own: dict[int, set[str]] = {}
        for name, words in ends:
            state, seen = 0, set()
            for word in words:
                state = at = self.next[state][word]
                while at > 0 and at not in seen:
                    seen.add(at)
                    if length[link[at]] < window <= length[at]:
                        self.items.setdefault(at, set()).add(name)
                    at = link[at]
            if len(words) < window:
                own.setdefault(state, set()).add(name)
        # Links lead to shorter sequences, so parents come first in the order of lengths.
        self.home = [-1] * len(link)
        self.short: list[tuple] = [()] * len(link)
        self.own = {s: (length[s], frozenset(names)) for s, names in own.items()}
        for state in sorted(range(1, len(link)), key=length.__getitem__):
            up = link[state]
            if length[state] >= window:
                self.home[state] = state if length[up] < window else self.home[up]
            self.short[state] = self.short[up] + ((self.own[up],) if up in self.own else ())

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Covered stretches of the words, as first and last positions, and the items found."""
        spans: list[list[int]] = []
        found: set[str] = set()
        follow, link, length, window = self.next, self.link, self.length, self.window
        get, own, short = self.words.get, self.own, self.short
        state = matched = 0
        for i, word in enumerate(map(get, words)):
            if word is None:
                state = matched = 0
                continue
            there = follow[state].get(word)
            while there is None and state:
                state = link[state]
                matched = length[state]
                there = follow[state].get(word)
            if there is None:
                matched = 0
                continue
            state = there
            matched += 1
            longest = 0
            if matched >= window:
                longest = window
                found |= self.items[self.home[state]]
            if state in own and matched == length[state]:
                longest = max(longest, matched)
                found |= own[state][1]
            for size, names in short[state]:
                longest = max(longest, size)
                found |= names
            if longest:
                first = i - longest + 1
                while spans and first <= spans[-1][1] + 1:
                    first = min(first, spans.pop()[0])
                spans.append([first, i])
        return spans, found


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents plus ``n_words``, ``n_hit``, ``hit_spans`` and ``item_ids``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Words of a document
    inside any occurrence of a window are hit; ``hit_spans`` are the maximal runs of them as word positions,
    ``item_ids`` the items with occurring windows, sorted as strings. Null texts have no words, items
    without words match nothing, items with the same id are one item, and a null id is the item "".
    With no items nothing is hit. Columns named like the results are replaced.

    Items travel to the tasks in blocks of bounded size, and every document passes the blocks one after
    the other without a shuffle.
    """
    docs = without(docs, "n_words", "n_hit", "hit_spans", "item_ids")
    texts = items.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = docs
    for block in range(blocks):
        mine = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).distinct()
        found = _match_block(found, [(r["id"], r["text"].encode()) for r in mine.collect()], text_col, window, block > 0)
    return found


def _match_block(docs: DataFrame, items: list[tuple[str, bytes]], text_col: str, window: int, more: bool) -> DataFrame:
    def match(batches):
        automaton = ItemAutomaton(items, window)
        for batch in pieces(batches):
            n_words, n_hit, spans, names = [], [], [], []
            if more:
                before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_spans", "item_ids")]
            for row, text in enumerate(texts_of(batch, text_col)):
                words = WORD.findall(text.lower())
                here, found = automaton.match(words)
                if more:
                    here = _merged(here + [[s["first"], s["last"]] for s in before[0][row]])
                    found |= set(before[1][row])
                n_words.append(len(words))
                n_hit.append(sum(last - first + 1 for first, last in here))
                spans.append([{"first": first, "last": last} for first, last in here])
                names.append(sorted(found))
            yield with_columns(
                batch,
                n_words=pa.array(n_words, pa.int64()),
                n_hit=pa.array(n_hit, pa.int64()),
                hit_spans=pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                item_ids=pa.array(names, pa.list_(pa.string())),
            )

    return docs.mapInArrow(
        match,
        schema_with(
            docs, n_words=T.LongType(), n_hit=T.LongType(), hit_spans=SPANS, item_ids=T.ArrayType(T.StringType())
        ),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    chars_col: str | None = None,
    max_coverage: float = 0.5,
    window: int = WINDOW,
) -> DataFrame:
    """Documents without the passages they share with test items; their own columns only.

    Every hit run (see ``find_contamination``) is cut out from the start of its first word to the end of its
    last, and ``chars_col``, if there is one, then counts the characters left. Documents with more than
    ``max_coverage`` of their words hit go altogether. Documents without a hit come back unchanged.
    """
    inner, place = renamed(docs)
    text = place[text_col]
    found = find_contamination(inner, items, text, window=window)
    found = found.filter(F.col("n_hit") <= max_coverage * F.col("n_words"))

    def cut(batches):
        for batch in pieces(batches):
            out = []
            spans = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
            values = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            for value, hit in zip(values, spans, strict=True):
                if hit:
                    at = [m.span() for m in WORD.finditer(value.lower())]
                    for span in reversed(hit):
                        value = value[: at[span["first"]][0]] + value[at[span["last"]][1] :]
                out.append(value)
            yield with_columns(
                batch, ("n_words", "n_hit", "hit_spans", "item_ids"), **{text: pa.array(out, pa.binary()).cast(pa.string())}
            )

    if chars_col:
        found = found.withColumn("changed", F.col("n_hit") > 0)
    cleaned = found.mapInArrow(cut, schema_with(found, ("n_words", "n_hit", "hit_spans", "item_ids")))
    if chars_col:
        count, kind = place[chars_col], docs.schema[chars_col].dataType
        cleaned = cleaned.withColumn(count, F.when(F.col("changed"), F.length(text).cast(kind)).otherwise(F.col(count)))
    return cleaned.select(*place.values()).toDF(*docs.columns)
