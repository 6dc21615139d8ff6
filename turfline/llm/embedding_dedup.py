"""Near-duplicate vectors by quantised tile products with rigorous error bounds.

Every unit vector u is stored as int8 numbers q with a scale s; e = |u - s q| is its own quantisation error.  For two of
them |u.v - s_u s_v q_u.q_v| <= e_u + e_v + e_u e_v.  All vectors meet all others in tiles of q products (sums of int8
products below 2**24 are exact in float32, so the products run in BLAS).  A pair whose estimate plus bound stays under the threshold is
done, one whose estimate minus bound reaches it is linked, and only what lies between is recomputed in doubles.

Vectors are dealt by hash of their id into groups of bounded bytes and every two groups meet in one task, so no
task depends on how alike the vectors are.  A task answers link counts and a spanning forest, two numbers for each
vector, never the pairs.  The work is quadratic in the number of vectors by the nature of an exact comparison of all.

Vectors that are null, empty, zero, or hold null or non-finite components, and null ids, link with nothing.  Vectors link only with vectors
of their own length.  Rows that repeat an id are one vector (see ``vectors.one_per_id``); each row gets its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import by_value
from turfline.llm.components import components, local_roots
from turfline.llm.vectors import matrix, one_per_id, unit
from turfline.session import stage

by_value(__name__)

THRESHOLD = 0.9
#: Vectors of a group at most; every vector is shuffled once for each group, so groups are as large as a task's memory allows.
GROUP = 1 << 17
#: Bytes of a group's doubles at most; a task holds two groups, and about four times as much while it works.
GROUP_BYTES = 32 << 20
LEAST_GROUPS = 6
TILE = 1024
#: Margin for the rounding of float32 scales and of sums in doubles.
SLACK = 1e-5
_EXACT_DIMS = 1 << 10  # 127 * 127 * 1024 < 2**24


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 numbers, scale, error) of unit rows."""
    scale = np.abs(rows).max(axis=1) / 127
    q = np.rint(rows / scale[:, None]).astype(np.int8)
    error = np.sqrt(((rows - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    return q, scale, error


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    if a.shape[1] <= _EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((product(a[:, i:i + _EXACT_DIMS], b[:, i:i + _EXACT_DIMS]).astype(np.float64) for i in range(0, a.shape[1], _EXACT_DIMS)),
               np.zeros((len(a), len(b))))


def tile_links(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (in a, in b) of the pairs with cosine >= threshold; a and b are (unit rows, q, scale, error)."""
    (u, qu, su, eu), (v, qv, sv, ev) = a, b
    estimate = product(qu, qv)
    estimate *= su[:, None].astype(np.float32)
    estimate *= sv[None, :].astype(np.float32)
    most = eu.max() + ev.max() + eu.max() * ev.max() + SLACK
    i, j = np.nonzero(estimate >= threshold - most)
    if not len(i):
        return i, j
    value, bound = estimate[i, j].astype(np.float64), eu[i] + ev[j] + eu[i] * ev[j] + SLACK
    linked = value - bound >= threshold
    for part in np.array_split(np.flatnonzero(~linked & (value + bound >= threshold)), max(1, len(i) // 65_536)):
        linked[part] = (u[i[part]] * v[j[part]]).sum(axis=1) >= threshold
    return i[linked], j[linked]


def _meet(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, link counts, smallest id reached) of the vectors of one dimension in two groups, or in one with itself."""
    ids, side = table["vec_id"].to_numpy(), table["grp"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, side = ids[order], side[order]
    rows = unit(matrix(table, table["dim"][0].as_py())[order])
    q, scale, error = quantised(rows)
    sides = [np.flatnonzero(side == s) for s in np.unique(side)]
    tiles = [[part for part in np.array_split(s, -(-len(s) // TILE))] for s in sides]
    count, roots = np.zeros(len(ids), np.int64), np.arange(len(ids))
    take = lambda part: (rows[part], q[part], scale[part], error[part])
    alone = table["lo"][0].as_py() == table["hi"][0].as_py()
    pairs = [(x, y) for k, x in enumerate(tiles[0]) for y in tiles[0][k:]] if alone else [(x, y) for x in tiles[0] for y in (tiles[1] if len(tiles) > 1 else [])]
    for x, y in pairs:
        i, j = tile_links(take(x), take(y), threshold)
        if x is y:
            i, j = i[i < j], j[i < j]
        i, j = x[i], y[j]
        count += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        roots = local_roots(len(ids), i, j, roots)
    return ids, count, ids[roots]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    usable = stage(one_per_id(vectors), "vectors")
    size = usable.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    rows = min(GROUP, max(TILE, GROUP_BYTES // (8 * (size.dim or 1))))
    groups = max(LEAST_GROUPS, -(-size.n // rows))
    dealt = usable.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).select(
        F.least("grp", "other").alias("lo"), F.greatest("grp", "other").alias("hi"), "grp", "dim", "vec_id", "raw")

    def compare(table: pa.Table) -> pa.Table:
        ids, count, root = _meet(table, threshold)
        own = count > 0
        return pa.table({"vec_id": ids[own], "n": count[own], "root": root[own]})

    found = stage(met.groupBy("lo", "hi", "dim").applyInArrow(compare, "vec_id long, n long, root long"), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("vec_id"), "root")
    linked = counts.join(roots, "vec_id", "left")
    return vectors.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"))
