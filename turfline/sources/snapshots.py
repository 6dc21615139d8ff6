"""Stores kept as plain parquet folders: versioned roll snapshots and cross-drive yield counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.operators.sync import current_versions
from turfline.operators.yields import merge_counts

_POINTER = "campaign_id string, version string, voter_count long, built_at string, jurisdiction string"
_COUNTS = "dim string, key string, valid long, total long, stamp string, drive string"


class SnapshotStore:
    """Snapshots under campaign_id / version folders, and a pointer table that names the current one.

    A version is written before its pointer row, so a failed write never becomes current.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, campaign_id: str, version: str, built_at: str, voters: DataFrame, jurisdiction: str = "") -> None:
        target = f"{self.path}/voters/campaign_id={campaign_id}/version={version}"
        voters.write.mode("overwrite").parquet(target)
        count = self.spark.read.parquet(target).agg(F.count(F.lit(1)).alias("voter_count"))
        count.select(
            F.lit(campaign_id).alias("campaign_id"), F.lit(version).alias("version"), "voter_count",
            F.lit(built_at).alias("built_at"), F.lit(jurisdiction).alias("jurisdiction"),
        ).write.mode("append").parquet(f"{self.path}/pointers")

    def pointers(self) -> DataFrame:
        return self.spark.read.schema(_POINTER).parquet(f"{self.path}/pointers")

    def version(self, campaign_id: str, version: str) -> DataFrame:
        """One stored version; only its folder is listed and read."""
        stored = self.spark.read.parquet(f"{self.path}/voters/campaign_id={campaign_id}/version={version}")
        return stored.withColumns({"campaign_id": F.lit(campaign_id), "version": F.lit(version)})

    def current(self, campaign_id: str) -> DataFrame:
        """The version the pointer names (a pointer lookup is one small row)."""
        row = current_versions(self.pointers().where(F.col("campaign_id") == campaign_id)).first()
        if row is None:
            raise LookupError(f"no snapshot of {campaign_id}")
        return self.version(campaign_id, row["version"])


class YieldStore:
    """Additive (dim, key, valid, total) counts; every drive has its own folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COUNTS).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COUNTS)

    def load(self) -> DataFrame:
        return merge_counts(self._rows())

    def drives(self) -> int:
        return self._rows().agg(F.count_distinct("drive")).first()[0]

    def save(self, counts: DataFrame, drive: str, stamp: str) -> None:
        """Store the counts of the drive that the caller names; saving a drive again replaces its counts."""
        counts.select("dim", "key", "valid", "total", F.lit(stamp).alias("stamp")).write.mode("overwrite").parquet(
            f"{self.path}/drive={drive}")
