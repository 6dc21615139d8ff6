"""Positions and running totals inside groups of any size.

A window over ``partitionBy(group)`` sorts a whole group in one task.  Here the rows are range
partitioned by group and order, so a group that holds a third of the table is spread over many
tasks; every task numbers its own part, and the few per-part totals give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.session import stage


def _direction(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def in_group_order(df: DataFrame, keys: list[str], order: list, amount: str | None = None) -> DataFrame:
    """Add ``position`` (1-based), ``group_size`` and, with ``amount``, ``before``: the sum of earlier rows."""
    order = _direction(order)
    rows = stage(df, "rows")  # a range partitioning reads its input twice, once for the bounds
    ranged = stage(
        rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ordered")
    value = F.col(amount) if amount else F.lit(0.0)
    parts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.withColumn("_n0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_v0", F.coalesce(F.sum("_v").over(earlier), F.lit(0.0)))
        .withColumn("group_size", F.sum("_n").over(Window.partitionBy(*keys)))
        .drop("_n", "_v")
    )
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    out = (
        ranged.join(offsets, [*keys, "_part"])
        .withColumn("position", F.col("_n0") + F.row_number().over(local))
    )
    if amount:
        running = local.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_v0") + F.coalesce(F.sum(value).over(running), F.lit(0.0)))
    return out.drop("_part", "_n0", "_v0")


def first_in_group(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows per group; the limit is applied before the shuffle as well."""
    ranked = Window.partitionBy(*keys).orderBy(*_direction(order))
    return df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)
