"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a hash string of 64 bits, the signs of 64 random projections, and keeps the strings in a sorted
array.  A query descends to the longest prefix that it shares with some string of each tree, then all trees ascend
together, one bit a step, until the strings under the common prefixes name ``LEAST_CANDIDATES`` different vectors.  The k-th best angle among them tells
how far to go on: a vector at that angle or nearer shares d first bits of a tree with probability (1 - angle / pi) ** d at least, so the trees ascend until
one of them shows it with probability ``RECALL``.  The candidates are compared with the query by exact cosines in doubles.

The index holds every row: rows are dealt by hash of their id into shards, each a forest of its own, and a query visits every
shard in blocks of queries; the shards' best are merged.  Clustered vectors stop after few candidates.  Isotropic ones, whose nearest are hardly
nearer than the rest, have no such stop; for them a query is content with ``SHARE`` of a shard, which gives a recall over 0.9.
Strings that many vectors share come in together, whatever their number.  Equal scores are ranked by the smaller id.

Vectors that are null, empty, zero, or hold null or non-finite components, and null ids, take no part, as query or candidate.  Only
vectors of a query's own length are candidates.  Rows that repeat an id are one vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import by_value
from turfline.llm.vectors import matrix, one_per_id, scaled
from turfline.session import stage

by_value(__name__)

TREES = 32
BITS = 64
#: Part of a shard that a query asks for where no angle stops it.
SHARE = 0.5
#: Probability with which a vector as near as the k-th found shows in some tree.
RECALL = 0.97
#: Candidates that a query asks of a shard at least (all of a smaller one).
LEAST_CANDIDATES = 256
SHARD_ROWS = 8192
QUERY_BLOCK = 4096


def strings(rows: np.ndarray, trees: int) -> np.ndarray:
    """The hash strings of rows, one column for each tree; the projections follow from the tree's number alone."""
    out = np.empty((len(rows), trees), np.uint64)
    for tree in range(trees):
        planes = np.random.default_rng([tree, rows.shape[1]]).standard_normal((rows.shape[1], BITS)).astype(np.float32)
        out[:, tree] = np.packbits(rows.astype(np.float32) @ planes > 0, axis=1).view(">u8")[:, 0]
    return out


def _prefix_ranges(ordered: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to)[prefix length, query] of the strings that share so many first bits with a query's string."""
    tails = np.array([(1 << (BITS - x)) - 1 for x in range(BITS + 1)], np.uint64)[:, None]
    return np.searchsorted(ordered, own & ~tails, side="left"), np.searchsorted(ordered, own | tails, side="right")


def shown(depth: np.ndarray, angle: float, trees: int) -> np.ndarray:
    """Least probability that some tree shows a vector at this angle or nearer among the strings that share ``depth`` bits."""
    return 1 - (1 - (1 - angle / np.pi) ** depth) ** trees


class Shard:
    """One shard's forest and the queries that visit it."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, order: np.ndarray, ordered: np.ndarray, queries: np.ndarray):
        self.rows, self.ids, self.order, self.queries = rows, ids, order, queries
        own = strings(queries, len(order))
        self.spans = [_prefix_ranges(ordered[t], own[:, t]) for t in range(len(order))]
        self.reach = sum(high - low for low, high in self.spans)
        self.square = np.sqrt((rows * rows).sum(axis=1))

    def _under(self, q: int, depth: int) -> np.ndarray:
        seen = np.zeros(len(self.ids), bool)
        for t, (low, high) in enumerate(self.spans):
            seen[self.order[t, low[depth, q]:high[depth, q]]] = True
        return seen

    def _ascend(self, q: int, want: int, least: int = 0) -> tuple[int, np.ndarray]:
        """The greatest depth, ``least`` at least, whose strings name ``want`` vectors in all trees together, and those vectors."""
        depth = max(least, int(np.flatnonzero(self.reach[:, q] >= want)[-1]))  # all trees together reach too few below
        while True:
            seen = self._under(q, depth)
            if depth <= least or np.count_nonzero(seen) >= want:
                return depth, seen
            depth -= 1

    def rough(self, q: int, near: np.ndarray) -> np.ndarray:
        return (self.rows[near] @ self.queries[q]) / self.square[near]

    def candidates(self, q: int, query_id: int, k: int, share: float) -> np.ndarray:
        """Rows that query number ``q`` is compared with."""
        n, trees = len(self.ids), len(self.order)
        first = min(n, max(LEAST_CANDIDATES, k + 1))
        depth, seen = self._ascend(q, first)
        near = np.flatnonzero(seen & (self.ids != query_id))
        if depth and len(near) >= k:
            cosine = np.partition(self.rough(q, near), len(near) - k)[len(near) - k] / max(np.sqrt((self.queries[q] ** 2).sum()), 1e-300)
            angle = float(np.arccos(np.clip(cosine, -1.0, 1.0)))
            enough = int(np.flatnonzero(shown(np.arange(BITS + 1), angle, trees) >= RECALL)[-1])  # depth 0 shows all
            if enough < depth:
                seen = self._ascend(q, min(n, max(first, int(np.ceil(share * n)))), enough)[1]
        elif depth:
            seen = self._ascend(q, n)[1]
        return np.flatnonzero(seen & (self.ids != query_id))


def search(shard: Shard, query_ids: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the best k found in one shard."""
    rows, ids, queries = shard.rows, shard.ids, shard.queries
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(len(queries)):
        near = shard.candidates(q, query_ids[q], k, share)
        rough = shard.rough(q, near)
        if len(near) > k:
            least = np.partition(rough, len(near) - k)[len(near) - k]
            near = near[rough >= least - 1e-9 * abs(least) - 1e-300]
        length = np.sqrt((queries[q] * queries[q]).sum())
        cosine = (rows[near] * queries[q]).sum(axis=1) / (shard.square[near] * length)
        best = np.lexsort((ids[near], -cosine))[:k]
        found.append((np.full(len(best), query_ids[q]), ids[near][best], cosine[best]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def index(usable: DataFrame, shards: int, trees: int = TREES) -> DataFrame:
    """The forest over all of ``usable`` (vec_id, dim, raw): a row for each shard and vector length."""

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        ids = table["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        rows = scaled(matrix(table, dim)[by_id])
        hashed = strings(rows, trees)
        order = np.argsort(hashed, axis=0, kind="stable").T
        ordered = np.take_along_axis(hashed.T, order, axis=1)
        blobs = {"ids": ids[by_id], "rows": rows, "order": order.astype(np.int32), "ordered": ordered}
        return pa.table({"shard": table["shard"][:1], "dim": table["dim"][:1], **{n: pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for n, b in blobs.items()}})

    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return dealt.groupBy("shard", "dim").applyInArrow(build, "shard long, dim long, ids binary, rows binary, order binary, ordered binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of ``vectors`` for each of ``queries``, never the query itself."""
    usable = stage(one_per_id(vectors), "vectors")
    shards = max(1, -(-usable.count() // SHARD_ROWS))
    forest = stage(index(usable, shards, trees), "forest")
    asked = stage(one_per_id(queries), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", every(shards))
    visited = forest.withColumn("block", every(blocks))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dim = left["dim"][0].as_py()
        get = lambda name, kind: np.frombuffer(left[name][0].as_buffer(), kind)
        ids = get("ids", np.int64)
        shard = Shard(get("rows", np.float64).reshape(-1, dim), ids, get("order", np.int32).reshape(-1, len(ids)), get("ordered", np.uint64).reshape(-1, len(ids)), scaled(matrix(right, dim)))
        found = search(shard, right["vec_id"].to_numpy(), k, share)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ("shard", "dim", "block")
    best = visited.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(visit, "query_id long, vec_id long, score double")
    ranked = best.selectExpr("query_id", "int(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)) AS rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
