"""Exact Lloyd rounds over whole-number vectors. Bounds leave out most distances, and planar geometry keeps them tight.

Every vector carries its cluster, its squared distance to that centroid and a lower bound of its distance to all others.
When centroids move, the bound is loosened by the most that any vector of the cluster can come nearer to any other
centroid. Full drift is safe for that but far too much: the vectors of a cluster lie in a sphere around the centroid they
were assigned to, and `loosening` bounds the loss over that sphere. A vector whose own moved centroid is nearer than its
bound stays without further distances; the others are compared with all centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.llm.store import Steps

#: Components beyond this, after scaling, would not let squared distances fit in 64 bits.
LARGEST = 1 << 27
#: Where components are within EXACT / dims, every term of a squared distance is exact in double precision.
EXACT = 1 << 21
#: Share by which bounds are widened against rounding.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors with `dims` finite components of at most LARGEST."""
    value = F.col("embedding")
    fine = (F.size(value) == dims) & F.forall(value, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST / scale))
    return vectors.where(fine).select("vec_id", F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def squared_distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(vectors, centres) of exact squared distances."""
    if max(np.abs(v).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT // v.shape[1]:
        x, c = v.astype(np.float64), centres.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    v = v.astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centres], axis=1)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster (the smallest number on ties), squared distance to it, distance to the next nearest centroid."""
    d = squared_distances(v, centres)
    own = d.argmin(axis=1)
    rows = np.arange(len(v))
    least = d[rows, own]
    if len(centres) == 1:
        return own, least, np.full(len(v), np.inf)
    d[rows, own] = np.iinfo(np.int64).max
    return own, least, np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, the most by which a vector within `radius` of its old centroid can come nearer to another one.

    A vector comes nearer by at least s to a centroid that moves from a to b where it lies inside one branch of the
    hyperbola with foci a and b. The branch lies within its asymptotes, which cross in the midpoint of a and b at an angle
    whose sine is s / |ab|. Rotation about the line ab makes this a matter of the plane through the sphere's centre: the
    sphere is seen from the midpoint at a height `arcsin(along / away)` over the plane between a and b and under the
    half-angle `arcsin(radius / away)`, so none of it passes the asymptote at the sum of both angles."""
    k = len(old)
    a, b = old.astype(np.float64), new.astype(np.float64)
    drift = np.sqrt(((b - a) ** 2).sum(axis=1))
    toward = (b - a) / np.where(drift > 0, drift, 1.0)[:, None]
    middle = (a + b) / 2
    offset = a[:, None, :] - middle[None, :, :]  # (cluster, moved centroid, dims)
    away = np.sqrt((offset**2).sum(axis=2))
    along = np.einsum("ijd,jd->ij", offset, toward)
    outside = away > radius[:, None] * (1 + SLACK)
    far = np.where(outside, away, 1.0)
    angle = np.arcsin(np.clip(along / far, -1, 1)) + np.arcsin(np.clip(radius[:, None] / far, 0, 1))
    share = np.where(outside, np.sin(np.clip(angle, 0, np.pi / 2)), 1.0)
    loss = np.minimum(share + SLACK, 1.0) * drift[None, :] * (1 + SLACK)
    loss[np.arange(k), np.arange(k)] = 0
    return loss.max(axis=1)


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assign(rows: DataFrame, centres: np.ndarray, loosen: np.ndarray | None = None) -> DataFrame:
    """(vec_id, v, cluster, distance, bound) of each row; rows that carry a bound are compared only where it is not enough."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch, dims)
            if loosen is None:
                own, least, bound = nearest(v, centres)
            else:
                own, bound = (batch.column(batch.schema.get_field_index(c)).to_numpy().copy() for c in ("cluster", "bound"))
                bound -= loosen[own]
                least = np.empty(len(v), dtype=np.int64)
                for c in np.unique(own):
                    at = own == c
                    least[at] = squared_distances(v[at], centres[c : c + 1])[:, 0]
                open_ = np.sqrt(least.astype(np.float64)) * (1 + SLACK) >= bound
                if open_.any():
                    own[open_], least[open_], bound[open_] = nearest(v[open_], centres)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(least, pa.int64()), pa.array(bound, pa.float64())],
                names=["vec_id", "v", "cluster", "distance", "bound"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, distance long, bound double")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each kept row, final centroids) of `vectors` with columns vec_id and embedding.

    Kept are vectors with exactly `dims` components, none null, NaN, infinite or beyond LARGEST / scale in size (their
    squared distances do not fit in 64 bits); the others have no row. Centroids start as the k kept rows whose id has the
    smallest sha256 with `seed` (null ids last, then by components); with fewer rows there are fewer centroids. Equal
    distances go to the smaller number. Repeated rows and ids count as often as they are there. An empty table, or one
    without a kept vector, gives an empty table and no centroids. Other columns are not looked at.

    Each round reads the table of the round before, sums it per cluster (partial sums leave each task, k rows reach the
    driver) and writes the next; vectors are never shuffled."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dims, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", drawn.alias("drawn")).orderBy(F.col("drawn").asc_nulls_last(), "v").limit(k).collect()
    centres = np.array([r.v for r in first], dtype=np.int64).reshape(-1, dims)
    if not first:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centres
    steps = Steps(spark)
    state = steps.put(assign(rows, centres))
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    for _ in range(rounds):
        moved, radius = centres.copy(), np.zeros(len(centres))
        for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
            radius[r.cluster] = np.sqrt(float(r.far)) * (1 + SLACK)
        state = steps.put(assign(state, moved, loosening(centres, moved, radius)))
        centres = moved
    return state.select("vec_id", "cluster", "distance"), centres
