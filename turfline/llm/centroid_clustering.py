"""Exact k-means on integer vectors with ns-bounds.

Every vector keeps the round of its last full scan, its distance then to its centroid and to all others.  The history of all centroids
is kept, so those bounds are loosened by the norm of a centroid's total displacement since that round, not by the sum of its moves.  A vector
keeps its cluster if every other centroid's lower bound stays above its upper bound, or above its exact distance; the rest are scanned again
in full.  Distances are exact integers, bounds are rounded to the safe side, so the result equals the plain algorithm's.

Each round is one pass over the vectors in the shared folder and one sum by cluster, combined before the shuffle.  The driver holds the
history: rounds x k centroids.

Kept are vectors of exactly ``dim`` components, none of them null or non-finite; a component becomes floor(scale * x).  Other rows are not in the
result.  A component beyond ``LARGEST`` after scaling is an error, as squared distances would not fit a long.  Repeated rows
are vectors of their own.  A row without an id is assigned, but is never a first centroid.  Fewer vectors than ``k`` make fewer centroids; an
empty table gives an empty result.  Ties go to the smaller number.  Extra columns are ignored by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import by_value
from turfline.session import stage

by_value(__name__)

CLUSTERS = 40
ROUNDS = 5
DIM = 64
SCALE = 256.0
SEED = "2"
#: Of scaled components: dim * (2 * LARGEST)**2 stays below 2**63.
LARGEST = 1 << 27
#: Rows of a plain integer distance block.
BLOCK = 512
_SLACK = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, at int, near long, others binary"


def scaled(vectors: DataFrame, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """(vec_id, v array<int>) of the kept vectors."""
    x = F.col("embedding")
    good = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.floor(batch.column(1).flatten().cast(pa.float64()).to_numpy() * scale)
            if len(rows) and np.abs(rows).max() > LARGEST:
                raise ValueError(f"a component is larger than {LARGEST} after scaling")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), _lists(rows.astype(np.int32), dim)], ["vec_id", "v"])

    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", "embedding").mapInArrow(run, "vec_id long, v array<int>")


def _lists(flat: np.ndarray, dim: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat, pa.int32()))


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    most = int(max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)))
    if rows.shape[1] * (2 * most) ** 2 < 1 << 53:  # every product and sum is a whole number that a double holds
        a, c = rows.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.empty((len(rows), len(centroids)), np.int64)
    for low in range(0, len(rows), BLOCK):
        for j, c in enumerate(centroids):
            out[low:low + BLOCK, j] = ((rows[low:low + BLOCK] - c) ** 2).sum(axis=1)
    return out


def scan(rows: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, lower bounds of the distances to all centroids) by full comparison."""
    all_ = distances(rows, now)
    cluster = all_.argmin(axis=1)
    lower = np.nextafter((np.sqrt(all_.astype(np.float64)) * (1 - _SLACK)).astype(np.float32), np.float32(-1))
    return cluster, all_[np.arange(len(rows)), cluster], lower


def settled(rows: np.ndarray, cluster: np.ndarray, at: np.ndarray, near: np.ndarray, others: np.ndarray, history: np.ndarray) -> np.ndarray:
    """True where the bounds prove that the nearest of the newest centroids is still ``cluster``."""
    now, each = history[-1], np.arange(len(rows))
    moved = np.sqrt(((history - now).astype(np.float64) ** 2).sum(axis=2)) * (1 + _SLACK)  # by round and centroid
    lower = others.astype(np.float64) - moved[at]
    lower[each, cluster] = np.inf
    least = lower.min(axis=1, initial=np.inf)
    upper = np.sqrt(near.astype(np.float64)) * (1 + _SLACK) + moved[at, cluster]
    good = least > upper
    open_ = np.flatnonzero(~good)
    exact = np.sqrt(((rows[open_] - now[cluster[open_]]) ** 2).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
    good[open_] = least[open_] > exact
    return good


def assign(state: DataFrame, history: np.ndarray) -> DataFrame:
    """``state`` with every vector at the nearest of the newest centroids of ``history`` (round, centroid, component)."""
    k, dim, turn, first = history.shape[1], history.shape[2], len(history) - 1, "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy()
            rows = flat.astype(np.int64).reshape(-1, dim)
            if first:
                cluster, near, others = scan(rows, history[-1])
                at = np.full(len(rows), turn)
            else:
                cluster, at, near = (batch.column(i).to_numpy().copy() for i in (2, 3, 4))
                others = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.float32).reshape(-1, k).copy()
                again = np.flatnonzero(~settled(rows, cluster, at, near, others, history))
                cluster[again], near[again], others[again] = scan(rows[again], history[-1])
                at[again] = turn
            bounds = np.arange(0, (len(rows) + 1) * k * 4, k * 4, dtype=np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(others))])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(flat, dim), pa.array(cluster, pa.int32()), pa.array(at, pa.int32()), pa.array(near, pa.int64()), raw],
                                             ["vec_id", "v", "cluster", "at", "near", "others"])

    return state.mapInArrow(run, _STATE)


def _measured(state: DataFrame, now: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) with the exact squared distance to the newest centroids."""
    dim = now.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cluster = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dim), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(((rows - now[cluster]) ** 2).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def _means(state: DataFrame, last: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; an empty cluster keeps its centroid."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(last.shape[1])))
    now = last.copy()
    for row in sums.collect():  # one row for each cluster
        now[row[0]] = [total // row[1] for total in row[2:]]
    return now


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: float = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``vectors`` (vec_id, embedding).

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``.
    """
    spark = vectors.sparkSession
    state = stage(scaled(vectors, dim, scale), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.where("vec_id IS NOT NULL").select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    history = np.array([[r.v for r in first]], np.int64)
    for _ in range(rounds):
        state = stage(assign(state, history), "assigned")
        history = np.concatenate([history, _means(state, history[-1])[None]])
    found = stage(_measured(assign(state, history), history[-1]), "clusters")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    about = [(j, sums.get(j, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(history[-1].tolist())]
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
