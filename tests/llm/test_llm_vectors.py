"""Clustering and whitening against plain loops over whole numbers and fractions."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import LARGER_DIR
from pyspark.sql import functions as F

from quotemill.llm import centroids, vectors
from quotemill.llm.centroids import Rotation, cluster_vectors, nearest
from quotemill.llm.queries import QUERIES
from quotemill.llm.whitening import clusters_of, eigenvectors, whiten

VECTORS = "vec_id long, embedding array<float>, cluster string, ID int, x int"
NAN, INF = float("nan"), float("inf")


def rows_with_gaps(dim=4, n=60, seed=3):
    """Vectors with ties and copies next to rows that hold no whole vector."""
    r = random.Random(seed)
    rows = [(i, [r.randint(-6, 6) / 16 for _ in range(dim)]) for i in range(n)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (None, [0.5] * dim), (900, [0.5] * dim), (901, [-0.0] * dim)]
    bad = [None, [], [0.1] * (dim + 1), [0.1] * (dim - 1) + [None], [NAN] + [0.1] * (dim - 1), [0.1] * (dim - 1) + [-INF]]
    rows += [(100 + i, v) for i, v in enumerate(bad)]
    return [(*row, "c", 1, 2) for row in rows], rows[: -len(bad)]


def brute_clusters(rows, k, rounds):
    data = [(i, tuple(math.floor(64 * float(np.float32(e))) for e in v)) for i, v in rows]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in data)
    centres = [x for _, x in named[:k]]

    def owner(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, x in data:
            mine[owner(x)[1]].append(x)
        centres = [tuple(sum(e) // len(e) for e in zip(*mine[j], strict=True)) if j in mine else c for j, c in enumerate(centres)]
    found = [(i, *owner(x)[::-1]) for i, x in data]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("lead", [0, 1, 4])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_clusters_equal_brute_force(spark, k, lead):
    rows, good = rows_with_gaps()
    for parts in (1, 7):
        df = spark.createDataFrame(rows, VECTORS).repartition(parts)
        found, _ = cluster_vectors(df, dim=4, k=k, lead=lead)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert ordered(found.collect()) == ordered(brute_clusters(good, k, 3))


def test_clusters_of_the_table_equal_brute_force(spark):
    df = spark.read.parquet(f"{LARGER_DIR}/embeddings.parquet")
    found = QUERIES["op11_centroid_clustering"](spark, LARGER_DIR).collect()
    assert ordered(found) == ordered(brute_clusters([(r.vec_id, r.embedding) for r in df.collect()], 16, 3))


@pytest.mark.parametrize("offset, spread", [(0, 30), (10**6, 3), (2**27 - 50, 40), (0, 2**27)])
def test_bounds_lose_no_centroid(offset, spread):
    r = np.random.default_rng(5)
    x, c = (r.integers(-spread, spread + 1, (n, 8)) + offset for n in (500, 20))
    c[7], x[3] = c[2], c[2]
    axes = np.linalg.qr(r.normal(size=(8, 8)))[0]
    for lead in (0, 3, 8):
        rotation = Rotation(x.mean(axis=0), axes, lead)
        owner, best = nearest(x, *rotation.apply(x.astype(float)), c, rotation)
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (best == full.min(axis=1)).all() and (owner == full.argmin(axis=1)).all()


def test_few_centroids_are_verified():
    # Two far groups: the bounds leave out the other group's centroids.
    r = np.random.default_rng(6)
    x = np.concatenate([r.integers(0, 20, (300, 16)), r.integers(1000, 1020, (300, 16))])
    c = np.concatenate([x[:8], x[-8:]])
    rotation = Rotation(x.mean(axis=0), np.linalg.eigh(np.cov(x.T))[1][:, ::-1], 2)
    lead, rest = rotation.apply(x.astype(float))
    c_lead, c_rest = rotation.apply(c.astype(float))
    bound = ((lead[:, None] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (bound <= full + 1e-6).all()
    assert (bound <= full.min(axis=1)[:, None]).mean() < 0.5


def test_empty_and_useless_tables_have_no_clusters(spark):
    empty = spark.createDataFrame([], VECTORS)
    useless = spark.createDataFrame([(1, None, "c", 1, 2), (2, [NAN] * 4, "c", 1, 2)], VECTORS)
    for df in (empty, useless):
        found, centres = cluster_vectors(df, dim=4)
        assert found.count() == 0 and len(centres) == 0 and len(found.columns) == 6
        white, fit = whiten(df, dim=None if df is empty else 4)
        assert white.count() == 0 and fit is None and len(white.columns) == 7


def test_names_and_types_of_columns(spark):
    df = spark.createDataFrame([("a b", [1, 2], 0), ("c", [3, 5], 0), (None, [3, 4], 0)], "`my id` string, vec array<int>, distance int")
    found, _ = cluster_vectors(df, "my id", "vec", dim=2, k=1)
    assert {r["my id"] for r in found.collect()} == {"a b", "c", None}
    white, _ = whiten(df, "my id", "vec")
    assert {r["my id"] for r in white.collect()} == {"a b", "c", None}


def test_shares_of_hashes_grow_until_there_are_enough(spark):
    # Three ids for 3,000 rows: few hashes, so the first share may hold none.
    df = spark.createDataFrame([(i % 3, [i / 100.0, 0.0]) for i in range(3000)], "vec_id long, embedding array<double>")
    found, centres = cluster_vectors(df, dim=2, k=4)
    assert found.count() == 3000 and len(centres) == 4


def test_gram_is_exact():
    r = random.Random(8)
    for most in (5, 2**20, 2**40, 2**60):
        rows = [[r.randint(-most, most) for _ in range(3)] for _ in range(40)]
        expected = [[sum(x[i] * x[j] for x in rows) for j in range(3)] for i in range(3)]
        assert vectors.gram(np.array(rows, dtype=np.int64)).tolist() == expected


# --- whitening -------------------------------------------------------------------------------------------


def with_spectrum(values, seed=1):
    """A symmetric matrix with about these eigenvalues, in wide precision."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):  # closer to orthogonal than doubles are
        q = q @ (1.5 * np.eye(len(values)) - 0.5 * (q.T @ q))
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        [9, 5, 3, 2, 1, 0.5],
        [7, 7 - 1e-7, 7 - 2e-7, 3, 1, 1],
        [1, 1 - 1e-11, 1 - 3e-11, 1 - 5e-11, 0.3, 0],
        [2, 2, 2, 2, 2, 2],
        [1e30, 1e29, 1e10, 1e10, 1, 0],
        [0, 0, 0, 0, 0, 0],
    ],
)
def test_eigenvectors_to_double_precision(values):
    a = with_spectrum(values)
    found, x = eigenvectors(a)
    size = np.abs(a).max() or 1
    assert (np.diff(found) <= 0).all()
    assert np.abs(found - np.array(values)).max() <= 1e-15 * size
    assert np.abs(x.T @ x - np.eye(6)).max() <= 1e-15
    assert np.abs(a @ x - x * found).max() <= 2e-16 * 6 * size


def test_close_eigenvalues_are_told_apart():
    # Single precision sees one eigenvalue three times; the vectors are right all the same.
    values = [5, 5 - 1e-8, 5 - 3e-8, 2, 1, 0.5]
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(6) - 0.5 * (q.T @ q))
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    _, x = eigenvectors((a + a.T) / 2)
    assert np.abs(np.abs((q * x).sum(axis=0)) - 1).max() < 1e-9
    assert np.abs(np.abs(q.T @ x) - np.eye(6)).max() < 1e-9


def test_chains_of_close_values():
    assert [sorted(c.tolist()) for c in clusters_of(np.array([1.0, 5.0, 1.1, 9.0, 1.2, 5.05]), 0.15)] == [[0, 2, 4], [1, 5]]


def plain_whitening(rows, k):
    x = [(i, [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, dim = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(dim)]
    cov = [[sum((Fraction(v[i]) - Fraction(s[i], n)) * (Fraction(v[j]) - Fraction(s[j], n)) for v in fit) / n for j in range(dim)] for i in range(dim)]
    values, axes = np.linalg.eigh(np.array(cov, dtype=float))
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(sum(cov[i][i] for i in range(dim)))
    out = {}
    for i, v in x:
        centred = np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(v, s, strict=True)])
        for c in range(min(k, dim)):
            deviation = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
            out[i, tuple(v), c + 1] = (n, deviation, centred @ axes[:, c] / math.sqrt(values[c]), values[c] / trace)
    return out


def check_whitening(found, rows, k):
    expected = plain_whitening(rows, k)
    names = {i: tuple(math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v) for i, v in rows}
    signs = {}
    assert len(found) == len(rows) * min(k, len(rows[0][1]))
    for r in sorted(found, key=lambda r: -abs(r.whitened)):
        n, deviation, white, share = expected[r.vec_id, names[r.vec_id], r.component]
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened) * math.copysign(1, white))
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(sign * white, abs=1e-8)
        assert r.explained == pytest.approx(share, rel=1e-9)
        assert r.identity_error <= 1e-9


def test_whitening_equals_brute_force(spark):
    rows, _ = rows_with_gaps(dim=5, n=40)
    kept = list({r[0]: r for r in rows if r[0] is not None}.values())
    good = [(r[0], r[1]) for r in kept if r[0] < 100 or r[0] >= 900]
    for parts, k in ((1, 3), (6, 16)):
        found, _ = whiten(spark.createDataFrame(kept, VECTORS).repartition(parts), components=k)
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        check_whitening(found.collect(), good, k)


def test_whitening_of_the_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{LARGER_DIR}/embeddings.parquet")
    found = QUERIES["op12_embedding_whitening"](spark, LARGER_DIR).collect()
    check_whitening(found, [(r.vec_id, r.embedding) for r in df.collect()], 16)


def test_copies_count_once(spark):
    rows = [(i, [i % 7 / 8, i % 5 / 8, (i * i) % 11 / 8]) for i in range(300)]
    hot = rows + [(1000 + i, rows[0][1]) for i in range(400)]
    one, two = (whiten(spark.createDataFrame(r, "vec_id long, embedding array<double>"))[0] for r in (rows, hot))
    keep = lambda df: ordered(df.filter("vec_id < 300").collect())
    assert keep(one) == keep(two) and two.count() == 700 * 3


def test_components_without_variance(spark):
    flat = [(i, [i / 4, 2 * i / 4, 1.0]) for i in range(9)]
    found, fit = whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>"))
    assert fit.live.tolist() == [True, False, False]
    rows = found.collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-12 for r in rows)
    assert all(r.explained == pytest.approx(1.0 if r.component == 1 else 0.0) for r in rows)
    single, _ = whiten(spark.createDataFrame(flat[:1] * 3, "vec_id long, embedding array<double>"))
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single.collect()} == {(1, 0, None, None, None)}


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**30 * (i % 3), 2.0**24 * i, float(i)]) for i in range(12)]
    found, fit = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[math.floor(64 * e) for e in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in found.filter("component = 1").collect():
        expected = sum((12 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert r.deviation == (expected if expected < 2**63 else None)
    assert any(r.deviation is None for r in found.collect())
    assert found.agg(F.max("identity_error")).first()[0] < 1e-6


def test_usual_length_decides(spark):
    rows = [(0, [1.0]), (1, [2.0, 3.0]), (2, [5.0, 3.0]), (3, [2.0, 4.0]), (4, None)]
    found, _ = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id for r in found.collect()} == {1, 2, 3}


def test_rotation_does_not_depend_on_partitions_for_results(spark):
    df = spark.read.parquet(f"{LARGER_DIR}/embeddings.parquet")
    results = [ordered(cluster_vectors(df.repartition(p), lead=m)[0].collect()) for p, m in ((1, 24), (5, 8))]
    assert results[0] == results[1]
    assert centroids.LEAD < 64
