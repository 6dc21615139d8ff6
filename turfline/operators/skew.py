"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted(left: DataFrame, right: DataFrame, keys: list[str], rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``, so that no key and salt has more than about ``rows_per_task`` left rows.

    Left rows are counted per key (combined map-side).  Only keys above the limit get salts: their left rows
    are spread over the salts and their right rows repeated once per salt.  All other rows have salt 0.
    """
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task).select(
        *keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    columns = [F.xxhash64(*left.columns)]
    spread = left.join(hot, keys, "left").withColumn("_salt", F.pmod(*columns, salts).cast("int")).drop("_salts")
    repeated = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return spread, repeated


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """Inner join in which no task gets more than about ``rows_per_task`` left rows of one key; the result is that of a plain join."""
    spread, repeated = salted(left, right, keys, rows_per_task)
    return spread.join(repeated, [*keys, "_salt"]).drop("_salt")
