"""Work that must not be done twice, or by one task."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from turfline.functions import text as X
from turfline.operators.ordering import in_group_order
from turfline.sources import field_tables as ft


def test_ordering_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(k):
        seen.add(1)
        return k

    rows = spark.range(0, 500, 1, 4).select((F.col("id") % 3).alias("g"), F.udf(tell, "long")("id").alias("k"))
    got = in_group_order(rows, ["g"], ["k"]).collect()
    assert seen.value == 500
    assert sorted((r.g, r.k, r.position, r.group_size) for r in got) == sorted((k % 3, k, k // 3 + 1, 167 - (k % 3 == 2)) for k in range(500))


def _printed(column) -> str:
    return column._jc.toString() if hasattr(column, "_jc") else str(column)


def test_folds_test_no_ranges_and_keep_their_results(spark):
    assert "a-z" not in _printed(X.basic("s")) and "u2000-" not in _printed(X.quote_fold("s"))
    random.seed(3)
    given = ["".join(random.choice(" \t\n\x0b\f\r\x1c\x85\xa0   　﻿aZ9-_.,'\"`é中") for _ in range(random.randrange(12))) for _ in range(3000)]
    white = "[ \t\n\x0b\f\r\xa0  -     　﻿]+"
    rows = spark.createDataFrame([(g,) for g in given], "s string").select("s", X.squeeze("s").alias("q"), X.basic("s").alias("b")).collect()
    for r in rows:
        assert r.q == re.sub(white, " ", r.s).strip(" ")
        plain = re.sub("[.,'\"`]", "", r.s.replace("é", "e")).lower()
        plain = plain.replace("\xa0", " ").replace(" ", " ").replace("　", " ")
        assert r.b == re.sub("[^a-z0-9-]+", " ", plain).strip(" ")


def test_reconcile_deals_its_captures(spark, tmp_path):
    d = str(tmp_path)
    spark.range(0, 400, 1, 1).select(
        F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("click").alias("event_type"),
        F.lit(0.5).alias("value")).coalesce(1).write.parquet(f"{d}/events.parquet")
    spark.range(40).select(F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey"), F.lit("AUTOMOBILE").alias("c_mktsegment")).write.parquet(f"{d}/customer.parquet")
    spark.range(1).select(F.lit(0).alias("n_nationkey"), F.lit("A").alias("n_name"), F.lit(0).alias("n_regionkey")).write.parquet(f"{d}/nation.parquet")
    assert ft.captures(spark, d, spread=True).rdd.getNumPartitions() > 1
    assert sorted(map(tuple, ft.captures(spark, d, spread=True).collect())) == sorted(map(tuple, ft.captures(spark, d).collect()))
    assert queries()["reconcile"](spark, d).count() == 400
