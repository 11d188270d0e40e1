"""Centroid clustering of vectors: filter centroids in rotated coordinates, verify in whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.text import stage
from quotemill.llm.vectors import as_lists, rows_of, summed, whole_entries

SCALE = 64.0
LEAD = 24
# Whole numbers up to here have squared distances that fit a long in up to 64 dimensions.
MOST = 2**27
# Rounding of rotated coordinates, as a part of the numbers that they are made from.
ROUNDING = 1e-13


class Rotation:
    """Principal axes of the vectors. A vector becomes its leading coordinates and the norm of the others."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, lead: int):
        self.mean, self.axes, self.lead = mean, axes, lead

    def apply(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (vectors - self.mean) @ self.axes
        return turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))


def principal_rotation(vectors: DataFrame, dim: int, lead: int, scale: float = SCALE) -> tuple[int, Rotation]:
    """Number of valid vectors, and the rotation onto the axes of their covariance.

    Any rotation gives right results: sums of doubles in any order will do.
    """
    upper = np.triu_indices(dim)

    def moments(batches):
        count, sums, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            whole = whole_entries(batch, dim, scale, MOST)[1].astype(np.float64)
            count, sums, products = count + len(whole), sums + whole.sum(axis=0), products + whole.T @ whole
        return [float(count), *sums.tolist(), *products[upper].tolist()]

    found = summed(vectors, moments)
    values = np.array([found.get(i, 0.0) for i in range(1 + dim + len(upper[0]))])
    n = int(values[0])
    mean, second = values[1 : dim + 1] / max(n, 1), np.zeros((dim, dim))
    second[upper] = values[dim + 1 :] / max(n, 1)
    spread = np.triu(second) + np.triu(second, 1).T - np.outer(mean, mean)
    return n, Rotation(mean, np.linalg.eigh(spread)[1][:, ::-1], min(lead, dim))


def nearest(
    vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties) and squared distance of every vector, in whole numbers.

    The squared distance of the leading coordinates plus the squared difference of the remaining norms is never
    above the squared distance. Only centroids whose bound, less its rounding, reaches the best distance so far are
    compared.
    """
    c_lead, c_rest = rotation.apply(centroids.astype(np.float64))
    size = np.sqrt((lead**2).sum(axis=1) + rest**2)[:, None]
    c_size = np.sqrt((c_lead**2).sum(axis=1) + c_rest**2)[None, :]
    error = ROUNDING * (size + c_size + np.linalg.norm(rotation.mean))
    bound = (rest[:, None] - c_rest[None, :]) ** 2
    for j in range(lead.shape[1]):
        bound += (lead[:, j, None] - c_lead[None, :, j]) ** 2
    bound -= 4 * error * (size + c_size) + error**2
    owner = bound.argmin(axis=1)
    best = ((vectors - centroids[owner]) ** 2).sum(axis=1)
    first = owner.copy()
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] <= best) & (first != k))
        if not len(rows):
            continue
        distance = ((vectors[rows] - centroids[k]) ** 2).sum(axis=1)
        closer = (distance < best[rows]) | ((distance == best[rows]) & (k < owner[rows]))
        owner[rows[closer]], best[rows[closer]] = k, distance[closer]
    return owner, best


def first_centroids(stored: DataFrame, n: int, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``<seed>:<id>``, in that order; equal ids by their entries.

    Only hashes below a share that should hold several times ``k`` rows are ordered, more if that was too little.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    named = stored.select(F.sha2(name, 256).alias("hash"), "x")
    place = F.conv(F.substring("hash", 1, 13), 16, 10).cast("double") / float(16**13)
    share = min(1.0, 8 * k / max(n, 1))
    while True:
        rows = named.filter(place <= share).orderBy("hash", "x").limit(k).collect()
        if len(rows) == min(k, n) or share >= 1.0:
            return np.array([r.x for r in rows], dtype=np.int64)
        share = min(1.0, share * 16)


def moved(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Centroids after one round: exact componentwise ``floor(sum / count)``; those without vectors stay."""
    k, dim = centroids.shape

    def totals(batches):
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=object)
        for batch in batches:
            x = rows_of(batch, "x", dim).astype(np.int64)
            owner, _ = nearest(x, rows_of(batch, "lead", rotation.lead), batch.column("rest").to_numpy(), centroids, rotation)
            here = np.zeros((k, dim), dtype=np.int64)
            np.add.at(here, owner, x)
            counts, sums = counts + np.bincount(owner, minlength=k), sums + here.astype(object)
        return [*counts.tolist(), *sums.ravel().tolist()]

    found = summed(stored.select("x", "lead", "rest"), totals, exact=True)
    out = centroids.copy()
    for c in range(k):
        if found.get(c):
            out[c] = [found[k + c * dim + j] // found[c] for j in range(dim)]
    return out


def cluster_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dim: int = 64,
    k: int = 16,
    rounds: int = 3,
    seed: int = 1,
    scale: float = SCALE,
    lead: int = LEAD,
) -> tuple[DataFrame, np.ndarray]:
    """Clusters of the vectors, and the final centroids.

    The rows are the id under its own name, ``cluster, distance, cluster_inertia, inertia, centroid_sha256``, one for every row whose vector
    has ``dim`` entries, none null or non-finite; entries count as ``floor(scale * entry)``. Other rows and other
    columns are left out; join them by the id. Assignments, means and distances are exact whole numbers, whatever the
    partitions. Every vector is stored with ``lead`` coordinates on the principal axes and the norm of the rest, so a
    round reads one table and compares whole vectors with few centroids. Of a round, only counts and sums by cluster
    leave the tasks.

    A null id is the id "", for the draw of the first centroids. Rows that repeat an id or a vector are vectors of
    their own. With fewer than ``k`` vectors there are as many centroids. Whole entries beyond 2^27 count as 2^27,
    so that distances fit; inertias beyond a long are null. Without valid vectors there are no rows.
    """
    # Names of any case and kind may be around: only these two are read.
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = vectors.schema["vector"].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        vectors = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    n, rotation = principal_rotation(vectors, dim, lead, scale)

    def store(batches):
        for batch in batches:
            ids, whole = whole_entries(batch, dim, scale, MOST)
            coordinates, rest = rotation.apply(whole.astype(np.float64))
            columns = [ids, as_lists(whole.astype(np.int32)), as_lists(coordinates), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "lead", "rest"])

    id_kind = vectors.schema["id"].dataType.simpleString()
    stored = stage(vectors.mapInArrow(store, f"id {id_kind}, x array<int>, lead array<double>, rest double"), "centroid-vectors")
    centroids = first_centroids(stored, n, k, seed) if n else np.zeros((1, dim), dtype=np.int64)
    for _ in range(rounds if n else 0):
        centroids = moved(stored, centroids, rotation)

    def assign(batches):
        for batch in batches:
            x, leading = rows_of(batch, "x", dim).astype(np.int64), rows_of(batch, "lead", rotation.lead)
            owner, best = nearest(x, leading, batch.column("rest").to_numpy(), centroids, rotation)
            columns = [batch.column("id"), pa.array(owner.astype(np.int32)), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    assigned = stage(stored.mapInArrow(assign, f"id {id_kind}, cluster int, distance long"), "centroid-clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(exact.alias("total")).collect()}

    def long_or_none(value):
        return int(value) if value < 2**63 else None

    # One row for each of the k centroids.
    rows = [
        (c, long_or_none(sums[c]), long_or_none(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c in sums
    ]
    facts = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(facts), "cluster")
    out = out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return out, centroids if n else np.zeros((0, dim), dtype=np.int64)
