"""Tiles as files: one folder per tile, named as Spark names partition folders, with the rows in tile order.

A tile can be a few rows, so that what a file costs is what the job costs.  Hadoop's local file system starts a process for the
permissions of each file, each checksum beside it and each folder, and Spark's reader lists the folders through the driver.  Where
the tiles go to a folder of the file system, the tasks write and read the Parquet files with Arrow; other stores have Spark's writer
and reader.
"""

from __future__ import annotations

import itertools
import os
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline.session import enough_tasks, file_system_folder

# Workers get these functions by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Spark's name for the partition of a null or empty value.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: The characters that Spark escapes in the name of a partition folder.
_ESCAPED = r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""
#: Where the manifest of a folder of tiles lies; Spark's readers skip names with an underscore in front.
_MANIFEST, _MANIFEST_SCHEMA = "_manifest", "tile string, file string"
#: Rows handed on at once.
_ROWS = 10_000


def _folder_name(tile: str | None) -> str:
    return "tile=" + (re.sub(_ESCAPED, lambda c: f"%{ord(c[0]):02X}", tile) if tile else _NO_VALUE)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """Consecutive rows of one tile; a tile that goes on in the next batch has more than one piece."""
    for batch in batches:
        runs, rows, start = pc.run_end_encode(batch.column("tile")), batch.select([c for c in batch.schema.names if c != "tile"]), 0
        for end, tile in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
            yield tile, rows.slice(start, end - start)
            start = end


def _named(tiles: list, files: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tiles, pa.string()), pa.array(files, pa.string())], ["tile", "file"])


def _writes(folder: str, job: str, about: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write the tiles of a task's rows, which are sorted by tile, and name their files.

    A file gets its name when it is complete, and the same name whichever attempt of the task writes it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{job}.snappy.parquet"
        tiles, files = [], []
        for tile, pieces in itertools.groupby(_pieces(batches), lambda piece: piece[0]):
            at = f"{folder}/{_folder_name(tile)}"
            os.makedirs(at, exist_ok=True)
            (_, first), part = next(pieces), f"{at}/.{name}.{task.taskAttemptId()}"
            with pa.OSFile(part, "wb") as out, pq.ParquetWriter(
                    out, first.schema.with_metadata(about), compression="snappy", store_schema=False, write_page_checksum=True) as writer:
                writer.write_batch(first)
                for _, more in pieces:
                    writer.write_batch(more)
            os.replace(part, f"{at}/{name}")
            tiles.append(tile)
            files.append(f"{_folder_name(tile)}/{name}")
            if len(tiles) >= _ROWS:
                yield _named(tiles, files)
                tiles, files = [], []
        yield _named(tiles, files)

    return run


def write(tiles: DataFrame, path: str) -> None:
    """Write ``tiles`` (tile, position, other columns) below ``path``, a path that is not there yet."""
    spark, folder = tiles.sparkSession, file_system_folder(tiles.sparkSession, path)
    rows = tiles.repartition(enough_tasks(spark), "tile").sortWithinPartitions("tile", "position")  # counted tasks, not merged by bytes
    if folder is None:
        rows.write.partitionBy("tile").parquet(path)
        return
    if os.path.exists(folder):
        raise FileExistsError(f"there are files in {folder}")
    about = {"org.apache.spark.version": spark.version, "org.apache.spark.sql.parquet.row.metadata": tiles.drop("tile").schema.json()}
    named = rows.withColumn("tile", F.nullif(F.col("tile").cast("string"), F.lit("")))
    written = named.mapInArrow(_writes(folder, uuid.uuid4().hex, about), _MANIFEST_SCHEMA)
    written.write.json(f"{path}/{_MANIFEST}")


def _reads(folder: str, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of the files that a task is given; batches of many small tiles."""
    own = [c for c in columns if c != "tile"]

    def tile_rows(manifest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in manifest:
            for tile, file in zip(batch.column("tile").to_pylist(), batch.column("file").to_pylist()):
                with pq.ParquetFile(f"{folder}/{file}") as found:
                    for rows in found.iter_batches(columns=own, use_threads=False):
                        tiles = pa.repeat(pa.scalar(tile, pa.string()), len(rows))
                        yield pa.RecordBatch.from_arrays([tiles if c == "tile" else rows.column(c) for c in columns], columns)

    def run(manifest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for rows in tile_rows(manifest):
            some.append(rows)
            n += len(rows)
            if n >= _ROWS:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some, n = [], 0
        if some:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    return run


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` of all tiles below ``path``, every tile from its folder.

    The manifest of :func:`write` names the files; it is published last, so of a write that was broken off nothing is there.
    """
    folder = file_system_folder(spark, path)
    if folder is None:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    files = spark.read.schema(_MANIFEST_SCHEMA).json(f"{path}/{_MANIFEST}")
    return files.repartition(enough_tasks(spark)).mapInArrow(_reads(folder, schema.names), schema)
