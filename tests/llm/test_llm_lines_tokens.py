"""Line de-duplication, token counts and token files against their libraries and plain loops."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR
from llm_helpers import LONG, awkward, documents, empty
from tokenizers import Tokenizer

from quotemill.llm import token_files
from quotemill.llm.line_dedup import dedupe_lines
from quotemill.llm.queries import QUERIES
from quotemill.llm.token_counts import WordCounter, count_tokens, whole_tokens
from quotemill.llm.token_files import ChunkEncoder, TokenFile, encoder_of, read_token_files, write_token_files
from quotemill.session import work_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    "", " ", "a", "two  spaces", "three   spaces  ", " leading", "trailing \n", "\n\n a\t b", "don't we'll I'M",
    "é́ ﬁ Ω ß İ ΑΣ ΑΣ.", "x y   z　 w", "a\x1cb \x1d c", "12 345 6789", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c",
    "日本語 テキスト 🎉🎉", "!!!??? ...---", "éé ́x", "  \u0085 q", "word " * 500,
]


def brute_lines(rows):
    parts = {i: [x for x in (text or "").split("\n")] for i, text in rows.items()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, lines in parts.items():
        for x in lines:
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = {}
    for i, lines in parts.items():
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_against_a_loop(spark):
    rows = {r["doc_id"]: r["text"] for r in documents(SF_DIR)}
    found = QUERIES["op1_line_dedup"](spark, SF_DIR).collect()
    expected = {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for i, (a, b, c) in brute_lines(rows).items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in found} == expected
    assert any(r.n_dropped for r in found)


def test_lines_of_awkward_rows(spark):
    found = dedupe_lines(awkward(spark))
    assert set(found.columns) == {*awkward(spark).columns, "n_lines", "n_dropped"}
    rows = defaultdict(list)
    for r in found.collect():
        rows[r.doc_id].append((r.text, r.n_lines, r.n_dropped))
    assert rows[1] == [("first words here\nlast words here", 3, 1)]
    assert rows[2] == [("other words there\n", 3, 1)]
    assert len(rows[3]) == 2 and rows[3][0][1:] == (2, 0)  # the largest id keeps its lines
    assert rows[4] == rows[5] == [("", 1, 0)]
    assert rows[7] == [(LONG, 1, 0)]
    assert len(rows[None]) == 2 and len(rows[11]) == 2
    assert dedupe_lines(empty(spark)).count() == 0


def test_whole_tokens_are_single():
    tokenizer = Tokenizer.from_file(WORDS)
    whole = whole_tokens(tokenizer)
    assert 10_000 < len(whole) < 49_408
    for piece in sorted(whole)[:2000]:
        assert len(tokenizer.model.tokenize(piece)) == 1


@pytest.mark.parametrize("text", TRICKY)
def test_word_counts_and_chunks_follow_the_libraries(text):
    tokenizer = Tokenizer.from_file(WORDS)
    counter = WordCounter(WORDS, whole_tokens(tokenizer))
    assert counter.text(text.encode()) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    expected = Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids
    assert ChunkEncoder(BYTES, "<u2").encode(text).tolist() == expected


def test_one_vocabulary_for_all_files_of_a_worker():
    first = encoder_of(BYTES, "<u2")
    ids = first.encode("some text, twice").tolist()
    assert first.known
    # The next file has the same vocabulary, and none of the pieces that the one before has cached.
    again = encoder_of(BYTES, "<u2")
    assert again.tokenizer is first.tokenizer and not again.known and not again.others
    assert again.encode("some text, twice").tolist() == ids
    # Another width of ids is another encoder.
    assert encoder_of(BYTES, "<u4").encode("some text, twice").dtype == np.dtype("<u4")


def test_token_counts_of_the_table(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    for r, d in zip(
        QUERIES["op2_token_counts"](spark, SF_DIR).orderBy("doc_id").collect(),
        sorted(documents(SF_DIR), key=lambda d: d["doc_id"]),
        strict=True,
    ):
        n = len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (d["doc_id"], len((d["text"] or "").encode()), n, n > 2048)


def test_token_counts_of_awkward_rows(spark):
    found = count_tokens(awkward(spark), WORDS).collect()
    assert len(found) == 15
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in found if not r.text} == {(0, 0, False)}
    assert all(r.over_limit for r in found if r.text == LONG)
    assert count_tokens(empty(spark), WORDS).count() == 0


def encoded(rows):
    """Digest of the table in ascending order, straight from the library."""
    tokenizer, start, out = Tokenizer.from_file(BYTES), 0, []
    for name, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_table(spark):
    found = QUERIES["op6_token_files"](spark, SF_DIR).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == encoded(sorted((d["doc_id"], d["text"]) for d in documents(SF_DIR)))


def test_token_files_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEQUENCES_PER_BATCH", 4)
    docs = awkward(spark).filter("doc_id is null or doc_id not in (3, 11)")
    files = write_token_files(docs, work_path(spark, "tokens"), BYTES, end_id=2, length=16)
    found = sorted((tuple(r) for r in read_token_files(files).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = [r for r in found if r[0] is not None]
    skipped = len(found) - len(known)
    assert skipped == 2 and [r[0] for r in found[:2]] == [None, None]  # rows without an id come first
    base = known[0][1]
    expected = encoded(sorted(r for r in rows if r[0] is not None))
    assert [(a, b - base, c, d) for a, b, c, d in known] == expected
    # Sequences: equal length, ids as a view, padding masked.
    for f in files.collect():
        file = TokenFile(f.path)
        assert file.length == 16
        total = 0
        for k in range(-(-f.n_tokens // 16)):
            ids, mask = file.sequence(k)
            assert len(ids) == 16 and not ids.flags.owndata and not ids[~mask].any()
            total += mask.sum()
        assert total == f.n_tokens
    assert read_token_files(write_token_files(empty(spark), work_path(spark, "tokens"), BYTES, end_id=2)).count() == 0


def test_repeated_rows_get_places_of_their_own(spark):
    docs = awkward(spark).filter("doc_id in (3, 11)")
    found = read_token_files(write_token_files(docs, work_path(spark, "tokens"), BYTES, end_id=2)).collect()
    assert len(found) == 4 and len({r.start for r in found}) == 4
    assert sorted(r.doc_id for r in found) == [3, 3, 11, 11]


@pytest.mark.parametrize("length", [1, 3, 4])
def test_documents_end_anywhere_in_a_batch(spark, monkeypatch, length):
    monkeypatch.setattr(token_files, "SEQUENCES_PER_BATCH", 2)
    rows = [(i, "a b c d e f g"[: 2 * (i * 7 % 5)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = write_token_files(docs, work_path(spark, "tokens"), BYTES, end_id=2, length=length)
    assert sorted(tuple(r) for r in read_token_files(files).collect()) == encoded(rows)
