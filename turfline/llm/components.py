"""Connected components of link tables, on Spark and inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.llm import by_value
from turfline.session import stage

by_value(__name__)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The smallest number that each of ``0 .. n-1`` reaches by links a-b; ``roots`` goes on from an earlier result."""
    roots = np.arange(n) if roots is None else roots
    while True:
        low, high = np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])
        open_ = low != high
        if not open_.any():
            return roots
        np.minimum.at(roots, high[open_], low[open_])
        a, b = a[open_], b[open_]
        while True:
            up = roots[roots]
            if np.array_equal(up, roots):
                break
            roots = up


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b; longs): root is the smallest node that it reaches.

    Large-star and small-star steps in turn: every node points its larger neighbours, then its smaller ones, to the
    smallest neighbour, until nothing changes.  Each step is a grouped minimum, which combines before the shuffle, and
    an equi-join, whose hot keys the adaptive skew join splits; no neighbourhood is gathered.  Every round is written
    to the shared folder, so a lost executor costs one round at most.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs, "links")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(lower.select("u", F.col("m").alias("v"))).distinct())
        pairs = stage(small, "small-star")
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _mark(pairs: DataFrame) -> tuple:
    """Row count and two order-free checksums: equal when a round has changed nothing."""
    h, k = F.xxhash64("u", "v"), F.hash("v", "u").cast("long")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(k)).first())
