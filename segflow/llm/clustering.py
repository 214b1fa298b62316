"""Centroid clustering of integer vectors, with centroids filtered by an n-simplex projection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.shared import cut

#: Components are held within these bounds, so that every squared distance of up to 1024 of them fits in 64 bits.
LARGEST = 1 << 25
#: Squared bounds are widened by this share of the squared lengths that went into them: far more than doubles lose.
SLACK = 1e-9
#: Vectors compared at a time.
ROWS = 2_000


def quantize(vectors: DataFrame, id_col: str, vector_col: str, dims: int, factor: float) -> DataFrame:
    """(id, ints): floor(factor * x) of the vectors with exactly ``dims`` finite components; others are left out.

    Components beyond ``LARGEST`` count as ``LARGEST``.
    """
    x = F.col(vector_col)
    usable = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.least(F.greatest(F.floor(F.lit(float(factor)) * v.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    return vectors.where(x.isNotNull() & usable).select(id_col, F.transform(x, whole).alias("ints"))


def first_centroids(ints: DataFrame, id_col: str, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ``seed:id`` has the smallest sha256 (a null id is written as nothing); equal hashes by components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = ints.select(hashed.alias("h"), "ints").orderBy("h", "ints").limit(k).collect()  # k rows
    return np.array([r["ints"] for r in rows], dtype=np.int64)


class Simplex:
    """Distances to pivots as coordinates.

    The pivots' own distances give a simplex: pivot j has j coordinates. A
    point's distances to n pivots give n - 1 coordinates in that simplex and its
    height above it, the apex. Two points lie at least as far apart as their
    apexes and at most as far as one apex and the other's mirror image.
    Pivots that lie in the simplex of those before them are left out.
    """

    def __init__(self, candidates: np.ndarray, n: int) -> None:
        pivots, base = [], np.zeros((0, 0))
        for c in candidates.astype(np.float64):
            if len(pivots) == n:
                break
            if pivots:
                d2 = ((np.array(pivots) - c) ** 2).sum(1)[None]
                apex = self._apex(d2, base)[0]
                if apex[-1] ** 2 <= 1e-6 * d2.max():
                    continue
            else:
                apex = np.zeros(0)
            size = len(pivots) + 1
            grown = np.zeros((size, size - 1))
            grown[:-1, : base.shape[1]], grown[-1] = base, apex
            pivots, base = [*pivots, c], grown
        self.pivots, self.base = np.array(pivots).astype(np.int64).reshape(len(pivots), candidates.shape[1] if candidates.ndim == 2 else 0), base

    @staticmethod
    def _apex(squared: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Coordinates of points with these squared distances to the pivots at ``base`` (pivot 0 at the origin): n - 1 in the simplex, then the height."""
        n = len(base)
        if n > 1:
            right = (squared[:, :1] - squared[:, 1:] + (base[1:] ** 2).sum(1)) / 2
            inside = np.linalg.solve(base[1:], right.T).T  # base[1:] is triangular with heights of pivots on its diagonal
        else:
            inside = np.zeros((len(squared), 0))
        height = np.sqrt(np.maximum(squared[:, 0] - (inside**2).sum(1), 0))
        return np.hstack([inside, height[:, None]])

    def apexes(self, ints: np.ndarray) -> np.ndarray:
        squared = np.stack([((ints - p) ** 2).sum(1) for p in self.pivots], 1) if len(self.pivots) else np.zeros((len(ints), 0))
        return self._apex(squared.astype(np.float64), self.base)


def nearest(ints: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number among equals, and how many were compared exactly.

    A centroid whose lower bound exceeds another's upper bound is left out;
    only the rest are compared, in whole numbers.
    """
    own, theirs = (apexes**2).sum(1)[:, None], (peaks**2).sum(1)[None]
    slack = SLACK * (own + theirs) + 1e-6
    lower = own + theirs - 2 * apexes @ peaks.T
    upper = lower + 4 * apexes[:, -1:] * peaks[:, -1][None]
    row, col = np.nonzero(lower - slack <= (upper + slack).min(1)[:, None])
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    for at in range(0, len(row), 1 << 16):
        r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
        exact[r, c] = ((ints[r] - centroids[c]) ** 2).sum(1)
    cluster = exact.argmin(1)  # the first of equal ones
    return cluster, exact[np.arange(len(ints)), cluster], len(row)


def _lists(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def with_apexes(ints: DataFrame, id_col: str, simplex: Simplex) -> DataFrame:
    """(id, ints, apex): the cached distances to the pivots, as apex coordinates."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apexes = simplex.apexes(_lists(batch.column("ints"), np.int64))
                offsets = pa.array(np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(apexes.ravel()))], names=[*batch.schema.names, "apex"])

    kind = dict(ints.dtypes)[id_col]
    return ints.mapInArrow(project, f"`{id_col}` {kind}, ints array<int>, apex array<double>")


def _blocks(batch: pa.RecordBatch, centroids: np.ndarray, peaks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        ints = _lists(part.column("ints"), np.int64)
        yield ints, *nearest(ints, _lists(part.column("apex"), np.float64), centroids, peaks)[:2]


def move_centroids(projected: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid becomes floor(sum / count) of its vectors; tasks send one row for each centroid and component."""
    peaks, k, dims = simplex.apexes(centroids), *centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for ints, cluster, _ in _blocks(batch, centroids, peaks):
                np.add.at(total, cluster, ints)
                count += np.bincount(cluster, minlength=k)
        held = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, dims)), pa.array(np.tile(np.arange(dims), len(held))), pa.array(total[held].ravel()), pa.array(np.repeat(count[held], dims))], names=["cluster", "dim", "total", "count"])

    each = projected.select("ints", "apex").mapInArrow(sums, "cluster long, dim long, total long, count long")
    moved = centroids.copy()
    mean = F.expr("(sum(total) - pmod(sum(total), sum(count))) div sum(count)")  # exact floor
    for r in each.groupBy("cluster", "dim").agg(mean.alias("mean")).collect():  # k * dims rows
        moved[r["cluster"], r["dim"]] = r["mean"]
    return moved


def assign(projected: DataFrame, id_col: str, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    peaks = simplex.apexes(centroids)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c, d) for _, c, d in _blocks(batch, centroids, peaks)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([c for c, _ in found]).astype(np.int32)), pa.array(np.concatenate([d for _, d in found]))], names=[id_col, "cluster", "distance"])

    return projected.mapInArrow(name, f"`{id_col}` {dict(projected.dtypes)[id_col]}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, pivots: int = 12, factor: float = 256.0, seed: str = "2") -> DataFrame:
    """Lloyd's rounds over whole-number vectors: the nearest of ``k`` centroids for each vector, exactly.

    Vectors become floor(factor * x). Their distances to ``pivots`` of the first
    centroids are computed once and stored as apex coordinates of a simplex; in
    every round those of a centroid bound its distance from below and above, and
    only centroids that the bounds leave are compared, in integers. Ties go to
    the smaller number; an empty centroid stays. The driver holds ``k`` vectors.

    Returns (id, cluster, distance, cluster_inertia, inertia, centroid_sha256),
    a row for each vector with exactly ``dims`` finite components; others are
    left out. Null ids are kept; repeated rows are further vectors; fewer than
    ``k`` vectors are all centroids; other columns are ignored; an empty table
    gives none. Components are held within ``LARGEST``.
    """
    ints = cut(quantize(vectors, id_col, vector_col, dims, factor))
    centroids = first_centroids(ints, id_col, k, seed)
    if not len(centroids):
        return ints.select(id_col, *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    simplex = Simplex(centroids, pivots)
    projected = cut(with_apexes(ints, id_col, simplex))
    for _ in range(rounds):
        centroids = move_centroids(projected, simplex, centroids)
    assigned = cut(assign(projected, id_col, simplex, centroids))
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    named = [(i, int(sums[i]), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i in sums]
    told = F.broadcast(assigned.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string"))
    return assigned.join(told, "cluster").select(id_col, "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")
