"""Roll files: spec-driven batch and streaming scans, scoped scans, and export."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import fixed
from turfline.functions.dates import iso_date, layout_date
from turfline.functions.text import join_present, text
from turfline.session import stage
from turfline.sources.adapters import Layout

CANONICAL = ["id", "name", "address", "status", "registered_on", "county", "district", "tile_cell"]
_SCHEME = "^([a-z0-9]+):/+"  # Spark writes one path with one slash or three
# Bytes 0x80-0x9F of the Western single-byte charset; elsewhere it equals ISO-8859-1.
_HIGH = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def _reader_options(layout: Layout) -> dict[str, str]:
    return {
        "sep": layout.delimiter, "encoding": layout.charset, "header": str(layout.header).lower(),
        "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        "mode": "PERMISSIVE", "enforceSchema": "true", "nullValue": "\u0000",
    }


def positional_schema(layout: Layout) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(layout.width)])


def _resolver(layout: Layout, columns: list[str]):
    """Map a canonical field to its source columns, header names compared without case."""
    by_name = {c.strip().lower(): c for c in columns}

    def resolve(name: str) -> Column:
        found = [
            columns[r - 1] if isinstance(r, int) else by_name.get(r.lower())
            for r in layout.refs(name) if not isinstance(r, int) or r <= len(columns)
        ]
        parts = [_western(F.col(f"`{c}`"), layout) for c in found if c]
        return F.trim(join_present(" ", *parts)) if parts else F.lit("")

    return resolve


def _western(column: Column, layout: Layout) -> Column:
    if layout.charset == "UTF-8":
        return column
    return F.translate(column, _HIGH.decode("latin-1"), _HIGH.decode("cp1252"))


def status_of(raw: Column, layout: Layout) -> Column:
    """active / inactive / cancelled from a state's own vocabulary, with a wording backstop."""
    value = F.lower(F.trim(text(raw)))
    return (
        F.when(value.isin(*[s.lower() for s in layout.active]), "active")
        .when(value.isin(*[s.lower() for s in layout.cancelled]) if layout.cancelled else F.lit(False), "cancelled")
        .when(value.rlike(fixed.CANCELLED_WORDS), "cancelled")
        .otherwise("inactive")
    )


def canonical(raw: DataFrame, layout: Layout, *extra: str) -> DataFrame:
    """Canonical voter columns; only columns named by the layout (and ``extra``) are read."""
    get = _resolver(layout, [c for c in raw.columns if c not in extra])
    name = F.coalesce(
        F.nullif(get("full_name"), F.lit("")),
        join_present(" ", get("first_name"), get("middle_name"), get("last_name"), get("suffix")))
    street = F.coalesce(
        F.nullif(get("street_address"), F.lit("")), join_present(" ", get("house"), get("street_name")))
    unit = get("unit")
    first_line = join_present(" ", street, F.when(unit != "", F.concat(F.lit("#"), unit)).otherwise(""))
    last_line = join_present(" ", get("city"), get("state"), get("zip"))
    blank = F.lit("")
    fallback = F.concat_ws(":", F.lit(layout.jurisdiction), get("last_name"), get("zip"))
    return raw.select(
        F.coalesce(F.nullif(get("voter_id"), blank), fallback).alias("id"),
        name.alias("name"),
        join_present(", ", first_line, last_line).alias("address"),
        status_of(get("status"), layout).alias("status"),
        F.nullif(iso_date(get("registered"), layout.date_format), blank).alias("registered_on"),
        F.nullif(get("county"), blank).alias("county"),
        F.nullif(get("district"), blank).alias("district"),
        F.nullif(get("tile_cell"), blank).alias("tile_cell"),
        F.lit(layout.jurisdiction).alias("jurisdiction"),
        *extra,
    )


def _not_blank(raw: DataFrame) -> DataFrame:
    return raw.dropna(how="all")


def header_of(spark: SparkSession, path: str, layout: Layout) -> T.StructType:
    """All-string schema from the header line; a positional layout has its own."""
    if not layout.header:
        return positional_schema(layout)
    names = spark.read.options(**_reader_options(layout)).option("inferSchema", "false").csv(path).columns
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan(spark: SparkSession, path: str, layout: Layout, with_position: bool = False) -> DataFrame:
    """Batch scan of a roll file or folder into canonical rows.

    ``with_position`` adds ``row_pos``: files in order of their names, rows in the order of a file, whatever the split size.  A row's
    place is the byte where its split starts plus its number in the split, so numbers grow but are not consecutive.
    """
    raw = spark.read.options(**_reader_options(layout)).schema(header_of(spark, path, layout)).csv(path)
    if not with_position:
        return canonical(_not_blank(raw), layout)
    where = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    files = sorted(re.sub(_SCHEME, r"\1:/", f) for f in raw.inputFiles())
    ranks = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "_name string, _rank long")
    within = Window.partitionBy("_file", "_start").orderBy("_seen")
    placed = (
        _not_blank(where).withColumn("_seen", F.monotonically_increasing_id())
        .withColumn("_n", F.row_number().over(within))
        .withColumn("_name", F.regexp_replace("_file", _SCHEME, "$1:/"))
        .join(ranks, "_name")
        .withColumn("row_pos", F.shiftleft("_rank", 44) + F.col("_start") + F.col("_n"))
    )
    return canonical(placed, layout, "row_pos")


def first_matching(spark: SparkSession, path: str, layout: Layout, keep: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows in file order that pass ``keep``, with ``row_pos``; files after them are not read.

    Files are read in the order of their names, one, then two, four and so on, until enough rows are found, so at most twice as many are read as needed.
    """
    header = header_of(spark, path, layout)
    listed = sorted(spark.read.options(**_reader_options(layout)).schema(header).csv(path).inputFiles())
    parts, at, size, left = [], 0, 1, limit
    while at < len(listed) and left > 0:
        own = scan(spark, listed[at:at + size], layout, with_position=True).where(keep)
        part = stage(own.withColumn("row_pos", F.col("row_pos") + (at << 44)).orderBy("row_pos").limit(left), "first")
        parts.append(part)
        left -= part.count()
        at, size = at + size, 2 * size
    return union(parts) if parts else scan(spark, path, layout, with_position=True).limit(0)


def scan_stream(
    spark: SparkSession, folder: str, layout: Layout, schema: T.StructType, files_per_trigger: int = 4
) -> DataFrame:
    """The same canonical rows from a growing folder; the memory needed is one micro-batch."""
    raw = (
        spark.readStream.options(**_reader_options(layout)).option("maxFilesPerTrigger", files_per_trigger)
        .schema(schema).csv(folder)
    )
    return canonical(_not_blank(raw), layout)


def scoped(df: DataFrame, keep: Column, limit: int | None = None, order: str = "row_pos") -> DataFrame:
    """Rows passing ``keep``, capped in file order when the caller asks for a cap."""
    kept = df.where(keep)
    return kept.orderBy(order).limit(limit) if limit else kept


def export(people: DataFrame, layout: Layout) -> DataFrame:
    """The columns of a state's file, in layout order, from a roll with separate name and address columns.

    ``people`` has voter_id, first_name, middle_name, last_name, suffix, house, street_name,
    unit_text, city, state, zip, status, registered_on, county, district, tile_cell.
    """
    active, cancelled = layout.active[0], (layout.cancelled or ("CANCELLED",))[0]
    values = {
        "voter_id": F.col("voter_id"), "first_name": F.col("first_name"), "middle_name": F.col("middle_name"),
        "last_name": F.col("last_name"), "suffix": F.col("suffix"),
        "full_name": F.concat_ws(" ", "first_name", "last_name"),
        "street_address": join_present(" ", "house", "street_name"),
        "house": F.col("house"), "street_name": F.col("street_name"), "unit": F.col("unit_text"),
        "city": F.col("city"), "state": F.col("state"), "zip": F.col("zip"),
        "status": F.when(F.col("status") == "active", active).when(F.col("status") == "cancelled", cancelled)
        .otherwise("INACTIVE"),
        "registered": layout_date("registered_on", layout.date_format),
        "county": F.col("county"), "district": F.col("district"), "tile_cell": F.col("tile_cell"),
    }
    if layout.header:
        return people.select(*[values[f].alias(str(layout.columns[f])) for f in layout.columns])
    at = {layout.refs(f)[0]: values[f] for f in layout.columns}
    return people.select(*[at.get(i + 1, F.lit("")).alias(f"_c{i}") for i in range(layout.width)])


def write(people: DataFrame, layout: Layout, path: str) -> None:
    """Write a roll in a state's own format."""
    (
        export(people, layout).write.option("sep", layout.delimiter).option("encoding", layout.charset)
        .option("header", str(layout.header).lower()).option("quote", '"').option("escape", '"')
        .option("emptyValue", "").option("nullValue", "").csv(path)
    )


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
