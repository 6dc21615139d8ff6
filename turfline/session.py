"""Session helpers: local session for tests and bench, shared scratch folder, scale settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "turfline") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few cores, compute-heavy rows
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.turfline.scanPartitions", "" if cpus == "*" else str(cpus))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    existing = getattr(shared_dir, "_local", None)
    if existing is None or not os.path.isdir(existing):
        existing = shared_dir._local = tempfile.mkdtemp(prefix="turfline-")
    return existing


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def file_system_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of the file system that a path names; ``None`` where only Hadoop's clients reach it."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toUri()
    return full.getPath() if full.getScheme() == "file" else None


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where several joins read the same reduced table: it is computed once, survives lost executors,
    gives the planner real sizes for its broadcast decisions, and cuts the lineage.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Session setting: into how many partitions compute-heavy scans are dealt.  A local session sets it to its cores, because small
#: tables are single row groups; where it is unset, files fewer than cores are dealt, because a row group is read by one task
#: however many splits its file has.
SCAN_PARTITIONS = "spark.turfline.scanPartitions"


def enough_tasks(spark: SparkSession) -> int:
    """A number of partitions that keeps every core busy and grows with the session's setting."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame) -> DataFrame:
    """The scan in as many partitions as the session asks for, or in enough for every core."""
    spark = df.sparkSession
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    if wanted:
        return df.repartition(int(wanted))
    return df if len(df.inputFiles()) >= spark.sparkContext.defaultParallelism else df.repartition(enough_tasks(spark))
