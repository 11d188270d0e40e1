"""Embedding whitening: exact covariance over all tasks, eigenvectors refined from single precision."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.text import stage
from quotemill.llm.vectors import as_lists, gram, rows_of, summed, whole_entries

SCALE = 64.0
COMPONENTS = 16
MOST = 2**60
# Carries more digits than a double where the platform has such a type.
WIDE = np.longdouble


def wide(value: Fraction) -> np.longdouble:
    """A fraction with twice the digits of a double, as far as the type holds them."""
    high = float(value)
    return WIDE(high) + WIDE(float(value - Fraction(high)))


def refined_once(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.longdouble, np.longdouble]:
    """One Ogita-Aishima step: better eigenvectors, their eigenvalues, the distance below which two of those are
    not told apart, and the size of the correction.

    Only matrix products are needed: ``x.T x`` says how far the vectors are from unit length and right angles,
    ``x.T a x`` how far they mix. Pairs with close eigenvalues are made orthogonal, but not separated.
    """
    lack = np.eye(len(a), dtype=WIDE) - x.T @ x
    turned = x.T @ (a @ x)
    turned = (turned + turned.T) / 2
    values = np.diag(turned) / (1 - np.diag(lack))
    off = turned - np.diag(values)
    close = 2 * (np.sqrt((off**2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((lack**2).sum()))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > close
    change = np.where(apart, (turned + values[None, :] * lack) / np.where(apart, gaps, 1), lack / 2)
    return x + x @ change, values, close, np.abs(change).max()


def clusters_of(values: np.ndarray, close: np.longdouble) -> list[np.ndarray]:
    """Positions of eigenvalues that chains of close neighbours tie together, two or more each."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > close) + 1
    return [part for part in np.split(order, breaks) if len(part) > 1]


def eigenvectors(a: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in wide precision.

    Single-precision eigenvectors are corrected by matrix products. Where eigenvalues lie so close that a step cannot
    separate them, the matrix less their mean is projected on their vectors; that small problem sees their differences
    at full size, and its solution turns the vectors. Multiples of one eigenvalue get some orthonormal basis.
    """
    a = np.asarray(a, dtype=WIDE)
    scale = np.abs(a).max() if a.size else WIDE(0)
    if not scale > 0:
        return np.zeros(len(a), dtype=WIDE), np.eye(len(a), dtype=WIDE)
    b = a / scale
    x = np.linalg.eigh(b.astype(np.float32))[1].astype(WIDE)
    last = np.inf
    for _ in range(steps):
        x, values, close, change = refined_once(b, x)
        groups = clusters_of(values, close)
        for group in groups:
            inner = x[:, group]
            centre = values[group].mean()
            small = inner.T @ (b @ inner - centre * inner)
            size = np.abs(small).max()
            if size > 0:
                x[:, group] = inner @ np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(WIDE)
        if change < 1e-18 or (change >= last and change < 1e-15):
            break
        last = change
    for _ in range(2):
        # Noise over a small gap turns vectors within their cluster; what it does to their angles is taken back.
        x = x + x @ (np.eye(len(a), dtype=WIDE) - x.T @ x) / 2
    values = np.diag(x.T @ (b @ x))
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    # The largest entry of a vector is positive, so that runs agree.
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return values[order] * scale, x


class Fit:
    """Exact mean and covariance of the distinct vectors, and what whitens by them.

    ``centre`` holds whole numbers next to the means; ``sums`` are those of the vectors less ``centre``.
    """

    def __init__(self, n: int, centre: np.ndarray, sums: list[int], products: list[list[int]], components: int):
        self.n, self.centre, self.sums = n, centre, sums
        dim = len(sums)
        v = np.zeros((dim, dim), dtype=WIDE)
        for i in range(dim):
            for j in range(i, dim):
                v[i, j] = v[j, i] = wide(Fraction(n * products[i][j] - sums[i] * sums[j], n * n))
        trace = Fraction(sum(n * products[i][i] - sums[i] ** 2 for i in range(dim)), n * n)
        values, vectors = eigenvectors(v)
        self.values, self.vectors = values[:components].astype(np.float64), vectors[:, :components].astype(np.float64)
        # Eigenvalues within rounding of zero have no direction to be scaled along.
        self.live = values[:components] > (values[0] if dim else 0) * dim * np.finfo(np.float64).eps
        roots = np.sqrt(np.where(self.live, values[:components], 1))
        self.whitener = (vectors[:, :components] / roots).astype(np.float64)
        share = [float(e / wide(trace)) if trace else None for e in np.maximum(values[:components], 0)]
        self.explained = share
        self.offset = np.array([float(Fraction(s, n)) for s in sums])

    def whitened(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.centre).astype(np.float64) - self.offset) @ self.whitener

    def deviations(self, vectors: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n * x - S)^2``; null where a long cannot hold one."""
        z = vectors - self.centre
        if z.size and max(int(np.abs(z).max()), 1) * max([self.n, int(np.abs(z).max()), *map(abs, self.sums)]) * z.shape[1] >= 2**62:
            z = z.astype(object)
        squares = (z * z).sum(axis=1).astype(object)
        across = (z * np.array(self.sums, dtype=z.dtype)).sum(axis=1).astype(object)
        own = sum(s * s for s in self.sums)
        found = (self.n * self.n * a - 2 * self.n * b + own for a, b in zip(squares, across, strict=True))
        return [int(d) if d < 2**63 else None for d in found]


def fit_whitening(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Fit | None:
    """Mean, covariance and eigenvectors of a table of distinct vectors ``x``; none for an empty table.

    The first pass sums the entries. The second subtracts whole numbers next to the means before it multiplies;
    sums of whole products are exact, so the covariance is the same fraction for any number of tasks.
    """

    def totals(batches):
        count, sums = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            x = rows_of(batch, "x", dim)
            count, sums = count + len(x), sums + x.astype(object if np.abs(x).max(initial=0) > 2**40 else np.int64).sum(axis=0)
        return [count, *sums.tolist()]

    found = summed(distinct, totals, exact=True)
    n = found.get(0, 0)
    if not n:
        return None
    sums = [found[1 + j] for j in range(dim)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    around, upper = np.array(centre, dtype=np.int64), np.triu_indices(dim)

    def products(batches):
        total = np.zeros((dim, dim), dtype=object)
        for batch in batches:
            total += gram(rows_of(batch, "x", dim) - around)
        return total[upper].tolist()

    found = summed(distinct, products, exact=True)
    table = [[0] * dim for _ in range(dim)]
    for place, (i, j) in enumerate(zip(*upper, strict=True)):
        table[i][j] = table[j][i] = found[place]
    return Fit(n, around, [s - n * c for s, c in zip(sums, centre, strict=True)], table, components)


def identity_error(distinct: DataFrame, fit: Fit) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over the distinct vectors."""
    live = np.flatnonzero(fit.live)
    dim, k = len(fit.sums), len(live)
    if not k:
        return None

    def moments(batches):
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            white = fit.whitened(rows_of(batch, "x", dim))[:, live]
            sums, products = sums + white.sum(axis=0), products + white.T @ white
        return [*sums.tolist(), *products.ravel().tolist()]

    found = summed(distinct, moments)
    values = np.array([found[i] for i in range(k + k * k)]) / fit.n
    # The vectors are centred before they are multiplied; what is left of their means is subtracted here.
    return float(np.abs(values[k:].reshape(k, k) - np.outer(values[:k], values[:k]) - np.eye(k)).max())


def usual_length(vectors: DataFrame) -> int:
    """The length that most vectors have, the longer one on ties; 0 without vectors."""
    lengths = vectors.filter("vector IS NOT NULL").groupBy(F.size("vector").alias("dim")).count()
    top = lengths.agg(F.max(F.struct("count", "dim")).alias("top")).first().top
    return top.dim if top else 0


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    dim: int | None = None,
    scale: float = SCALE,
) -> tuple[DataFrame, Fit | None]:
    """Whitened coordinates of all vectors, in long form, and the fit.

    One row for every valid vector and component: the id under its own name, ``component, n, deviation, whitened,
    explained, identity_error``. Entries count as ``x = floor(scale * entry)``; the fit is over the
    distinct x-vectors, in number ``n``. All results are about differences, so a whole number added to every x changes
    none of them. ``deviation`` is the exact sum of ``(n * x - S)^2``, null beyond a long.
    ``whitened`` is ``x - S / n`` on the unit eigenvector, over the root of the eigenvalue; components are numbered by
    falling eigenvalue. ``identity_error`` is measured on the whitened fit list.

    Rows whose vector is null, has null or non-finite entries or another length than ``dim`` (if not given, that of most
    vectors) are left out, as are other columns. Rows that repeat an id or a vector are all returned. Components
    without variance have a null ``whitened`` and are not part of ``identity_error``, which is null if there is no other;
    ``explained`` is null if nothing varies. Whole entries beyond 2^60 count as 2^60. Without valid vectors there are
    no rows.

    Copies of a vector are reduced inside the tasks before the shuffle. Only sums whose number depends on ``dim``
    reach the driver.
    """
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = vectors.schema["vector"].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        vectors = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    if dim is None:
        dim = usual_length(vectors)
    id_kind = vectors.schema["id"].dataType.simpleString()
    schema = f"id {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def entries(batches):
        for batch in batches:
            whole = whole_entries(batch, dim, scale, MOST)[1]
            yield pa.RecordBatch.from_arrays([as_lists(whole)], names=["x"])

    distinct = fit = None
    if dim:
        distinct = stage(vectors.mapInArrow(entries, "x array<long>").distinct(), "whitening-fit")
        fit = fit_whitening(distinct, dim, components)
    if fit is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col), None
    error = identity_error(distinct, fit)
    k = len(fit.values)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches):
        for batch in batches:
            ids, whole = whole_entries(batch, dim, scale, MOST)
            white, rows = fit.whitened(whole), len(whole)
            each = np.repeat(np.arange(rows), k)
            live = np.tile(fit.live, rows)
            columns = [
                ids.take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, fit.n)),
                pa.array(fit.deviations(whole), pa.int64()).take(pa.array(each)),
                pa.array(white.ravel(), mask=~live),
                pa.array(fit.explained * rows, pa.float64()),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.mapInArrow(project, schema).withColumnRenamed("id", id_col), fit
