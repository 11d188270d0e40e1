"""Each stage of the pipeline against a loop over its own input."""

import math
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR
from llm_helpers import awkward, empty
from test_llm_dedup import brute_components
from test_llm_models import plain_contamination, plain_stats
from tokenizers import Tokenizer

from quotemill.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows that go into each stage, and those of the last."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), f"test-{name}")
        if name != "token_files":
            assert docs.columns == COLUMNS
        kept.append(docs.collect())
    return kept


def test_quality_stage(spark, stages):
    before, after = stages[0], {r.doc_id: r for r in stages[1]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    for r in before:
        n, _, symbols, _, repeat, _ = plain_stats(r.text)
        if n < 10 or 100 * repeat > 20 * n or symbols > 0.3 * n:
            assert r.doc_id not in after
        elif labels.get(r.doc_id) == 1 or symbols == 0:
            assert after[r.doc_id] == r
    assert 0 < len(after) < len(before)


def test_jaccard_stage(stages):
    found = brute_components([(r.doc_id, r.text) for r in stages[1]])
    assert sorted(r.doc_id for r in stages[2]) == sorted(name for name, (_, c) in found.items() if name == c)
    assert {r.doc_id: r for r in stages[1]}.items() >= {r.doc_id: r for r in stages[2]}.items()


def test_decontamination_stage(spark, stages):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    after = {r.doc_id: r for r in stages[3]}
    hits = 0
    for r in stages[2]:
        n, hit, _ = plain_contamination(r.text, items, 10)
        if not hit:
            assert after[r.doc_id] == r
        elif hit > 0.5 * n:
            assert r.doc_id not in after
        else:
            hits += 1
            assert plain_contamination(after[r.doc_id].text, items, 10)[:2] == (n - hit, 0)
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
    assert hits


def test_mixing_stage(stages):
    before, after = {r.doc_id: r for r in stages[3]}, Counter(r.doc_id for r in stages[4])
    assert set(after) == set(before) and all(before[r.doc_id] == r for r in stages[4])
    tokens = Counter()
    for r in before.values():
        tokens[r.source] += len((r.text or "").encode().split())
    most, least = max(tokens.values()), min(tokens.values())
    limit = corpus_pipeline.MAX_REPEATS
    alpha = 1 - math.log(limit) / math.log(most / least) if most / least > limit else 0.0
    for s, n in tokens.items():
        repeats = (most / n) ** (1 - alpha)
        for r in before.values():
            if r.source == s:
                assert math.floor(repeats + 1e-6) <= after[r.doc_id] <= math.floor(repeats) + 1


def test_mixing_stage_reads_small_sources_up_to_four_times(spark):
    # Sources of 100 to 1 tokens: the exponent is 1 - log(4) / log(100), whatever the pipeline's constant says.
    rows = [(i, "w " * 50, "en", "large", 100) for i in range(64)] + [(i, "w w", "en", "small", 3) for i in range(64, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    read = Counter(r.doc_id for r in corpus_pipeline.source_mixing(spark, docs, SF_DIR).collect())
    most, least = 64 * 50, 16 * 2
    repeats = (most / least) ** (math.log(4) / math.log(most / least))
    assert all(read[i] == 1 for i in range(64))
    assert all(math.floor(repeats - 1e-3) <= read[i] <= 4 for i in range(64, 80))


def test_token_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    out = sorted(stages[5], key=lambda r: r.start)
    rows = sorted(stages[4], key=lambda r: r.doc_id)
    assert len(out) == len(rows)
    for r, d in zip(out, rows, strict=True):
        ids = [*tokenizer.encode(d.text, add_special_tokens=False).ids, 2]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_stages_take_awkward_rows(spark):
    for make in (awkward, empty):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF_DIR), "test-awkward")
        rows = docs.collect()
        assert bool(rows) == (make is awkward)


def test_run_equals_its_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, stages[5]))
