"""Tile indexes kept in step by a stream of changes.

A change is (tile, id, op, changed_at, change_no, record fields): ``upsert`` with the whole record or ``remove``.  The newest change of an id, by
(changed_at, change_no), is the truth whatever the order of arrival, so a change that comes late never undoes a newer one and a change that comes twice
counts once.  Each micro-batch writes what arrived under a folder of its own, which a replay replaces, and after it one pointer row
per tile that it touched; readers only see batches up to a pointer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from turfline.session import stage

KEY = ["tile", "id"]
ORDER = ["changed_at", "change_no"]


def start_index_sync(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in a stream of changes; of several changes of an id in a micro-batch only the newest is written."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(*KEY).agg(F.max_by(F.struct(*batch.columns), F.struct(*ORDER)).alias("c")).select("c.*")
        newest.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        written = batch.sparkSession.read.parquet(f"{path}/changes/batch={batch_id}")
        written.groupBy("tile").agg(F.count(F.lit(1)).alias("changes")).write.mode("overwrite").parquet(f"{path}/pointers/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """(tile, version): the newest batch that changed each tile; a batch without its pointers is not there yet."""
    return spark.read.parquet(f"{path}/pointers").groupBy("tile").agg(F.max("batch").cast("long").alias("version"))


def _newest(changes: DataFrame) -> DataFrame:
    winner = F.max_by(F.struct(*(c for c in changes.columns if c not in KEY)), F.struct(*ORDER)).alias("c")
    return changes.groupBy(*KEY).agg(winner).select(*KEY, "c.*")


def index_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The records of all tiles after batch ``version`` (None: after the newest)."""
    changes = spark.read.parquet(f"{path}/changes").join(spark.read.parquet(f"{path}/pointers").select("tile", "batch"), ["tile", "batch"], "left_semi")
    if version is not None:
        changes = changes.where(F.col("batch") <= version)
    return _newest(changes).where("op = 'upsert'").drop("op", "batch", *ORDER)


def pull(spark: SparkSession, path: str, held: DataFrame) -> DataFrame:
    """(device_id, tile, version, op, id, record fields): what every device has to load to reach the newest version of its tiles.

    ``held``: device_id, tile, version (null: nothing yet).  Tiles at their pointer give nothing, a new device gets no removals.  Devices that
    hold the same version of a tile share the search; only its answer is repeated for them.
    """
    asked = held.join(pointers(spark, path).withColumnRenamed("version", "current"), "tile").where("version IS NULL OR version < current")
    asked = stage(asked, "asked")
    changes = spark.read.parquet(f"{path}/changes").join(asked.select("tile").distinct(), "tile", "left_semi")
    newest = stage(_newest(changes), "newest")
    since = asked.select("tile", "version", "current").distinct()
    answer = since.join(newest, "tile").where("version IS NULL AND op = 'upsert' OR batch > version")
    same = asked.withColumnRenamed("tile", "_tile").withColumnRenamed("version", "_version").select("device_id", "_tile", "_version")
    joined = answer.join(same, (F.col("tile") == F.col("_tile")) & F.col("version").eqNullSafe(F.col("_version")))
    return joined.select("device_id", "tile", F.col("current").alias("version"), "op", "id", *(c for c in newest.columns if c not in (*KEY, "op", "batch", *ORDER)))
