"""Token counts: words that are one token are counted, only the others are merged."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quotemill.llm.text import pieces, schema_with, texts_of, with_columns, without

WORD_END = "</w>"
CACHED_WORDS = 200_000


def whole_tokens(tokenizer, word_end: str = WORD_END) -> frozenset[str]:
    """Vocabulary strings proven to come out as the one token of their own when merged alone.

    Every string with a word end is put through the merges once, so a pre-token found in the result
    needs no merging. The vocabulary bounds the work.
    """
    proven = []
    for piece, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if piece.endswith(word_end) and len(piece) > len(word_end):
            alone = piece[: -len(word_end)]
            merged = tokenizer.model.tokenize(alone)
            if len(merged) == 1 and merged[0].id == number:
                proven.append(alone)
    return frozenset(proven)


class WordCounter:
    """Counts tokens of texts; holds the tokenizer, the proven strings and a bounded cache of words."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, int] = {}

    def word(self, word: str) -> int:
        """Tokens of a text without ASCII white space."""
        for special in self.special:
            if special in word:  # found in the text as it is, and one token each
                rest = word.split(special)
                return len(rest) - 1 + sum(self.word(x) for x in rest if x)
        total = 0
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word)):
            total += 1 if piece in self.whole else len(self.tokenizer.model.tokenize(piece))
        return total

    def text(self, text: bytes) -> int:
        # No pre-token holds white space and none looks beyond it, so words can be counted one by one.
        total, known = 0, self.known
        for word, times in Counter(text.split()).items():
            n = known.get(word)
            if n is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                n = known[word] = self.word(word.decode())
            total += times * n
        return total


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Documents plus ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    For tokenizers whose pre-tokens never hold white space and end in ``</w>``. Special strings inside a
    text count as their one token, nothing is added, truncated or padded. Null is the empty text: no bytes,
    no tokens. Rows are independent of each other; columns named like the results are replaced. ``path``
    must be readable by every executor.
    """
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    whole = whole_tokens(Tokenizer.from_file(path))

    def count(batches):
        counter = None
        for batch in pieces(batches):
            counter = counter or WordCounter(path, whole)
            texts = texts_of(batch, text_col)
            n_tokens = [counter.text(t) for t in texts]
            yield with_columns(
                batch,
                n_bytes=pa.array([len(t) for t in texts], pa.int64()),
                n_tokens=pa.array(n_tokens, pa.int64()),
                over_limit=pa.array([n > limit for n in n_tokens], pa.bool_()),
            )

    return docs.mapInArrow(
        count, schema_with(docs, n_bytes=T.LongType(), n_tokens=T.LongType(), over_limit=T.BooleanType())
    )
