"""The compression classifier against plain loops, and its accuracy on labels it never saw."""

import math
import random

import numpy as np
import pytest
import zstandard
from conftest import LARGER_DIR
from llm_helpers import LONG, awkward, empty

from quotemill.llm import compression_classifier as cc
from quotemill.llm.compression_classifier import Packer, blocks, build_dictionary, fit_logistic, is_held_out, score_quality
from quotemill.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"
BENCH_DIR = "/root/testdata/sf0.1"


def corpus(n=600, seed=2):
    """Good texts of words, bad ones of marks; ids are not in the order of anything."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = " ".join(r.choice(words) + ("" if good else r.choice(["###", "$$$"])) for _ in range(r.randint(20, 200)))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_sizes_are_those_of_whole_texts(spark):
    rows, labels = corpus()
    rows.append((5000, LONG + "#" * 999))
    found = by_id(score_quality(*frames(spark, rows, labels)))
    label = {i: q for i, q, _ in labels}
    texts = {0: [], 1: []}
    held = lambda i: is_held_out(i)
    import zlib

    draw = lambda i: zlib.crc32(f"dictionary:{i}".encode()) / 2**32
    for i, t in sorted(rows, key=lambda r: draw(r[0])):
        if i in label and not held(i) and draw(i) < 0.5:
            texts[label[i]].append(t.encode())
    packers = [Packer(*build_dictionary(texts[q])) for q in (1, 0)]
    for i, t in rows:
        r = found[i]
        assert (r.n_bytes, r.good_bytes, r.bad_bytes) == (len(t), *(p.size(t.encode()) for p in packers))
    gain = sum(found[i].bad_bytes - found[i].good_bytes for i in label if not held(i) and draw(i) >= 0.5)
    usual = gain / sum(found[i].n_bytes for i in label if not held(i) and draw(i) >= 0.5)
    value = lambda r: (r.bad_bytes - r.good_bytes + cc.PRIOR_BYTES * usual) / (r.n_bytes + cc.PRIOR_BYTES)
    counts = {}
    for i, q in label.items():
        if not held(i) and draw(i) >= 0.5:
            counts.setdefault(round(value(found[i]) / cc.STEP), [0, 0])[q] += 1
    a, b = fit_logistic([(v * cc.STEP, *n) for v, n in sorted(counts.items())])
    for r in found.values():
        assert r.score == pytest.approx(1 / (1 + math.exp(-(a + b * value(r)))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id)


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus()
    turned = [(i, 1 - q if is_held_out(i) else q, t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (by_id(score_quality(docs, spark.createDataFrame(x, LABELS))) for x in (labels, turned))
    assert one == two
    right = [r.predicted == q for i, q, _ in labels if (r := one[i]).held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.97


def test_only_the_text_counts(spark):
    rows, labels = corpus()
    rows += [(7001, "same words here and there"), (7002, "same words here and there"), (None, "same words here and there")]
    found = score_quality(*frames(spark, rows, labels)).collect()
    scores = {r.score for r in found if r.doc_id in (7001, 7002, None)}
    assert len(scores) == 1 and next(r for r in found if r.doc_id is None).held_out


def test_accuracy_on_held_out_rows_of_the_table(spark):
    found = QUERIES["op13_quality_classifier"](spark, BENCH_DIR).toPandas()
    labels = spark.read.parquet(f"{BENCH_DIR}/labels.parquet").toPandas().merge(found, on="doc_id")
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    held = labels[labels.held_out]
    good, bad = (held[held.quality == q] for q in (1, 0))
    assert (good.predicted == 1).mean() > 0.98
    assert (bad.predicted == 0).mean() > 0.85
    ranks = held.score.rank()
    area = (ranks[held.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert area > 0.97
    # Calibrated: what is said is what is found.
    assert abs(held.score.mean() - held.quality.mean()) < 0.03


def test_awkward_and_empty_tables(spark):
    _, labels = corpus(60)
    for known in (labels, [], [(1, None, 0), (None, 1, 0), (2, 5, 0), (3, 1, 1), (3, 0, 0)]):
        known = spark.createDataFrame(known, LABELS)
        found = score_quality(awkward(spark), known)
        assert found.columns == ["doc_id", "held_out", "score", "predicted", "n_bytes", "good_bytes", "bad_bytes"]
        rows = found.collect()
        assert len(rows) == 15 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert score_quality(empty(spark), known).count() == 0


def test_one_label_only_gives_its_smoothed_share(spark):
    rows, labels = corpus(200)
    docs, known = frames(spark, rows, [(i, 1, 0) for i, _, _ in labels])
    scores = {r.score for r in score_quality(docs, known).collect()}
    assert len(scores) == 1 and 0.97 < scores.pop() < 1


def test_repeated_rows_and_labels_change_nothing_for_the_dictionaries(spark):
    rows, labels = corpus(200)
    docs, known = frames(spark, rows, labels)
    twice = score_quality(docs.union(docs), known.union(known)).collect()
    once = by_id(score_quality(docs, known))
    assert len(twice) == 400
    assert all((r.good_bytes, r.bad_bytes) == (once[r.doc_id].good_bytes, once[r.doc_id].bad_bytes) for r in twice)


def test_samples_stay_within_their_bound(spark):
    rows, labels = corpus(2000)
    docs, known = frames(spark, rows, labels)
    docs = docs.withColumnRenamed("doc_id", "id")
    usable = cc.usable_labels(known, "doc_id", "quality")
    chosen = cc.sampled_texts(docs, usable, 30_000)
    assert all(10_000 < sum(map(len, t)) < 60_000 for t in chosen.values())


def test_dictionaries_of_few_texts():
    data, trained = build_dictionary([b"one short text"])
    assert not trained and data == b"one short text"
    size = Packer(data, trained).size(b"one short text")
    assert size < Packer(*build_dictionary([b"something else"])).size(b"one short text")
    assert Packer(b"", False).size(b"") == 0


def test_blocks_hold_all_bytes():
    text = bytes(range(256)) * 9
    assert b"".join(blocks(text)) == text and max(map(len, blocks(text))) == cc.BLOCK
    # A block unpacks to itself with the same dictionary.
    r = random.Random(1)
    texts = [" ".join(r.choice(["red", "green", "blue", "black"]) + str(r.randint(0, 99)) for _ in range(200)).encode() for _ in range(200)]
    data, trained = build_dictionary(texts)
    assert trained
    packer = Packer(data, trained)
    back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    for block in blocks(texts[0]):
        assert back.decompress(packer.compressor.compress(block), max_output_size=cc.BLOCK) == block


def test_logistic_curve():
    x = np.linspace(-2, 2, 41)
    p = 1 / (1 + np.exp(-(0.4 + 1.7 * x)))
    a, b = fit_logistic([(v, 1e5 * (1 - q), 1e5 * q) for v, q in zip(x, p, strict=True)])
    assert (a, b) == (pytest.approx(0.4, abs=0.01), pytest.approx(1.7, abs=0.01))
    a, b = fit_logistic([(-1.0, 50, 0), (1.0, 0, 50)])  # parted completely: finite all the same
    assert 0 < b < 100


def test_small_folders_have_scores(spark):
    rows = QUERIES["op13_quality_classifier"](spark, LARGER_DIR).collect()
    assert len(rows) == 1000 and len({r.doc_id for r in rows}) == 1000
