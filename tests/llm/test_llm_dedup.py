"""Jaccard join, components and suffix de-duplication against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR
from llm_helpers import awkward, documents, empty

from quotemill.llm import components as link_groups
from quotemill.llm import jaccard_join, suffix_dedup
from quotemill.llm.components import connected_components, joined_components
from quotemill.llm.jaccard_join import (
    folded,
    keep_one_of_each,
    least_overlap,
    near_duplicates,
    parity_bits,
    prefix_size,
    spanning_forest,
)
from quotemill.llm.suffix_dedup import remove_repeats


def brute_components(rows):
    sets = {}
    for name, text in rows:
        w = (text or "").encode().lower().split()
        sets[name] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    holders = defaultdict(list)
    for name, s in sets.items():
        for x in s:
            holders[x].append(name)
    common = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    root = {name: name for name in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {name: (len(s), find(name)) for name, s in sets.items()}


def components(spark, rows):
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def near_copies(seed):
    """Chains, stars and crowds of near copies, a passage in many documents, and strangers."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(12, 60))]
        for _ in range(rng.choice([1, 2, 9])):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 14))]) for _ in range(40)]
    rows += ["a b c", "a b c", "A B C", "a b", "", None, " ", "a b c d e", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [1024, 5])
def test_components_of_near_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = near_copies(tile)
    assert components(spark, rows) == brute_components(rows)


@pytest.mark.parametrize("forests", [0, 1, 3])
def test_families_near_the_limit(spark, monkeypatch, forests):
    """Copies of one text with one to three other words: about half of all pairs link."""
    monkeypatch.setattr(jaccard_join, "FORESTS", forests)
    given, stage = [], jaccard_join.stage

    def counting(df, name):
        out = stage(df, name)
        if name == "jaccard-pairs":
            given.append(out.filter("b is not null").count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", counting)
    rng = random.Random(5)
    rows = []
    for family in range(3):
        text = [f"f{family}x{rng.randrange(10_000)}" for _ in range(120)]
        for k in range(100):
            copy = list(text)
            for place in rng.sample(range(120), 1 + k % 3):
                copy[place] = f"o{rng.randrange(10_000)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert components(spark, rows) == brute_components(rows)
    if forests == 3:
        assert sum(given) < 4 * len(rows)


def test_spanning_forest():
    rng = np.random.default_rng(4)
    for _ in range(200):
        count = int(rng.integers(1, 40))
        ends = rng.integers(-20, 20, (2, count))
        ends = ends[:, ends[0] != ends[1]]
        weight = rng.integers(0, 3, ends.shape[1]).astype(float)
        tree = spanning_forest(ends, weight)

        def parts(pairs):
            label = {n: n for n in ends.flat}
            for a, b in pairs.T.tolist():
                old, new = label[a], label[b]
                label = {n: new if x == old else x for n, x in label.items()}
            return label

        whole, chosen = parts(ends), parts(ends[:, tree])
        together = lambda x: {frozenset(n for n in x if x[n] == v) for v in x.values()}
        assert together(whole) == together(chosen)
        assert tree.sum() == len(whole) - len(together(whole))
    heavy = spanning_forest(np.array([[1, 2, 1], [2, 3, 3]]), np.array([1.0, 1.5, 1.2]))
    assert heavy.tolist() == [False, True, True]


def test_components_of_the_table(spark):
    rows = [(d["doc_id"], d["text"]) for d in documents(SF_DIR)]
    assert components(spark, rows) == brute_components(rows)


def test_components_of_awkward_rows(spark):
    found = defaultdict(list)
    for r in near_duplicates(awkward(spark)).collect():
        found[r.doc_id].append((r.n_shingles, r.component_id))
    assert found[3] == [found[3][0]] * 2 and found[3][0][1] == 3
    assert found[4] == [(0, 4)] and found[5] == [(0, 5)] and found[6] == [(0, 6)]
    assert found[7][0][1] == found[8][0][1] == 7
    assert sorted(found[None], key=str) == [(0, None), (1, None)]
    assert found[11] == [(1, 11), (1, 11)]
    kept = keep_one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 3, 4, 5, 6, 7, 9, 10, 11, 11]
    assert near_duplicates(empty(spark)).count() == 0 and keep_one_of_each(empty(spark)).count() == 0


def test_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    # Each links with the next, the first and the last only over the one between them.
    chain = [" ".join(words[k : k + 40]) for k in (0, 4, 8)]
    copy, near = " ".join(f"v{i}" for i in range(50)), " ".join([*(f"v{i}" for i in range(49)), "x"])
    lone, other = " ".join(f"u{i}" for i in range(50)), " ".join([*(f"u{i}" for i in range(49)), "x"])
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[1]), (2, chain[2]), (3, copy), (None, near), (None, copy)]
    rows += [(None, lone), (None, lone.upper()), (None, other), (None, lone), (None, None), (None, "")]
    rows += [(4, "one a b c d e"), (4, "one a b c d e"), (5, "f g h i j k"), (1, "f g h i j k"), (4, copy)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id, r.n_shingles) for r in near_duplicates(df).collect()}
    assert found == {
        (1, 1, 36), (None, 1, 36), (2, 1, 36), (3, 3, 46), (None, 3, 46), (4, 3, 46), (None, None, 46), (None, None, 0),
        (4, 4, 2), (5, 1, 2), (1, 1, 2),
    }
    kept = Counter((r.doc_id, r.text) for r in keep_one_of_each(df).collect())
    single = [(name, text) for name, text in kept if name is None and text]
    assert len(single) == 1 and kept.pop(single[0]) == 1 and single[0][1].lower() in (lone, other)
    assert kept == {
        (1, chain[0]): 1, (3, copy): 1, (4, "one a b c d e"): 2, (1, "f g h i j k"): 1, (None, None): 1, (None, ""): 1,
    }


def test_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    for _ in range(300):
        m = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, m).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, m // 8).astype(np.uint64)]))
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        small = min(map(len, map(parity_bits, (a, b))))
        differ = int(np.bitwise_count(folded(parity_bits(a), small) ^ folded(parity_bits(b), small)).sum())
        assert differ <= len(a) + len(b) - 2 * common
        if 4 * common >= 3 * (len(a) + len(b) - common):
            assert common >= least_overlap(len(a), len(b))
            assert set(a[: prefix_size(len(a))].tolist()) & set(b[: prefix_size(len(b))].tolist())


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    links += [(7, i) for i in range(2000, 2300)] + [(5, 5), (None, 3)]
    root = {n: n for link in links for n in link if n is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: find(n) for n in root if n not in (5, 3)}


def test_components_are_written_in_few_files(spark, monkeypatch):
    written = []

    def counted(df, name):
        out = staged(df, name)
        written.append(len(out.inputFiles()))
        return out

    staged = link_groups.staged
    monkeypatch.setattr(link_groups, "staged", counted)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    pairs = lambda df: sorted((r.node, r.component) for r in df.collect())
    # Links that are stars take no round.
    stars = [(1, n) for n in range(2, 40)] + [(n, 50) for n in range(51, 90)]
    assert pairs(connected_components(frame(stars))) == [(n, 1) for n in range(1, 40)] + [(n, 50) for n in range(50, 90)]
    assert len(written) == 1
    assert pairs(connected_components(frame([]))) == [] and len(written) == 2
    # Few links are one file in every round, whatever the number of shuffle partitions.
    written.clear()
    partitions, adaptive = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (partitions, adaptive)}
    try:
        spark.conf.set(partitions, 16)
        spark.conf.set(adaptive, "false")
        assert pairs(connected_components(frame([(n, n + 1) for n in range(100)]))) == [(n, 0) for n in range(101)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written) > 2 and set(written[1:]) == {1}


def test_joined_components(spark):
    rng = random.Random(6)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    pairs = lambda df: sorted((r.node, r.component) for r in df.collect())
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)]
    # Between groups, inside one, between nodes that are in none, and with a smaller node than all.
    more = [(rng.randrange(200), rng.randrange(200)) for _ in range(30)] + [links[0], (300, 301), (302, 300), (-1, links[1][0])]
    for some in (more, []):
        found = joined_components(connected_components(frame(links)), frame(some))
        assert pairs(found) == pairs(connected_components(frame(links + some)))
    assert pairs(joined_components(connected_components(frame([])), frame(more))) == pairs(connected_components(frame(more)))


def brute_repeats(rows, length):
    texts = [(name, (text or "").encode()) for name, text in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for name, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        runs = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        out.append((name, len(t), sum(gone), runs, kept))
    return sorted(out, key=str)


def repeats(spark, rows, length):
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()), key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(rng.randint(1, 5))]
        rows.append((i, " ".join(parts)))
    rows += [(60, "ab" * 150), (61, "a" * 300), (62, "a" * 64), (63, None), (64, ""), (65, rows[0][1]), (None, shared[0] * 2)]
    return [*rows, rows[3], (66, "x" + "a" * 64)]


@pytest.mark.parametrize("largest", [4096, 1])
def test_repeats_of_passages(spark, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup, "LARGEST", largest)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 150)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 7)
    rows = passages(largest)
    assert repeats(spark, rows, 64) == brute_repeats(rows, 64)


def test_repeats_of_the_table(spark):
    rows = [(d["doc_id"], d["text"]) for d in documents(SF_DIR)]
    assert repeats(spark, rows, 400) == brute_repeats(rows, 400)


def test_repeats_of_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    found = {r.doc_id: r for r in remove_repeats(awkward(spark)).collect()}
    assert len(found) == 12 and remove_repeats(awkward(spark)).count() == len(rows)
    assert found[7].n_removed == found[7].n_bytes == len(rows[7][1]) and found[7].n_spans == 1 and found[7].kept == b""
    assert found[4].n_bytes == 0 and found[1].n_removed == 0
    assert remove_repeats(empty(spark)).count() == 0


def test_sorted_columns_are_suffix_order():
    rng = random.Random(1)
    for _ in range(20):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        slices = {base[a:b] for a, b in ((rng.randrange(0, 20), rng.randrange(40, 60)) for _ in range(9))}
        data, leads = zip(*[(s, base.index(s)) for s in slices], strict=True)
        leads = np.array([20 - lead for lead in leads])
        found = suffix_dedup.sort_columns(list(data), leads, np.zeros(len(data), np.int64), 16)
        at = Counter()
        for s, lead in zip(data, leads, strict=True):
            at.update((k - lead, s[k : k + 16]) for k in range(len(s) - 15))
        for s, lead, places in zip(data, leads, found, strict=True):
            assert places.tolist() == [k for k in range(len(s) - 15) if at[k - lead, s[k : k + 16]] > 1]


def test_digest_of_the_query(spark):
    from quotemill.llm.queries import QUERIES

    rows = brute_repeats([(d["doc_id"], d["text"]) for d in documents(SF_DIR)], 400)
    found = {r.doc_id: r.kept_sha256 for r in QUERIES["op10_suffix_dedup"](spark, SF_DIR).collect()}
    assert found == {r[0]: hashlib.sha256(r[4]).hexdigest() for r in rows}
