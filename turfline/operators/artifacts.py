"""What is built from a roll for the field: scoped indexes, tiles, ZIP shards, membership filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import fixed
from turfline.functions.people import member_key, search_tokens, standardize
from turfline.functions.text import slug, text, zip_trailing, zip_trailing_loose
from turfline.operators.ordering import in_group_order
from turfline.session import stage
from turfline.sources import tile_folders

RECORD = ["id", "name", "address", "status", "registered_on", "county", "district"]


# --- scope and version ---------------------------------------------------------------
def in_zips(zips: list[str]) -> Column:
    """Trailing ZIP of the address is one of a campaign's ZIPs."""
    return zip_trailing("address").isin(*zips)


def scope_by_campaign(roll: DataFrame, campaign_zips: DataFrame) -> DataFrame:
    """Roll rows of every campaign whose ZIP set holds the trailing ZIP; (campaign_id, zip5) table."""
    return roll.withColumn("zip5", zip_trailing("address")).join(
        campaign_zips.select("campaign_id", "zip5").distinct(), "zip5")


def row_fingerprint(columns: list[str]) -> Column:
    return F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def content_version(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Twelve hex digits per group that change with any record of the group, and with nothing else.

    Each row is hashed and the hashes are added up, so the version is an ordinary combinable sum; no group is ever
    collected.  ``columns`` may hold a position inside the group, never one in the whole roll.
    """
    digest = F.sha1(row_fingerprint(columns))
    half = lambda start: F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("voter_count"),
        F.substring(F.sha1(F.concat_ws("|", F.sum(half(1)), F.sum(half(13)), F.count(F.lit(1)))), 1, 12).alias("version"),
    )


def campaign_index(roll: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Minimized voter rows per campaign; ``campaigns`` has campaign_id, jurisdiction, zip5."""
    return scope_by_campaign(roll, campaigns).select("campaign_id", "row_pos", *RECORD)


def index_manifest(index: DataFrame, campaigns: DataFrame, built_at: str) -> DataFrame:
    scope = campaigns.groupBy("campaign_id").agg(
        F.max("jurisdiction").alias("jurisdiction"), F.array_sort(F.collect_set("zip5")).alias("scoped_zips"))
    return content_version(index, ["campaign_id"], RECORD).join(scope, "campaign_id").withColumn(
        "built_at", F.lit(built_at))


def write_campaign_index(index: DataFrame, campaigns: DataFrame, path: str, built_at: str, source: str, rows_per_file: int = 100_000) -> None:
    """Write ``path/index``, one folder per campaign in files of about ``rows_per_file``, and then ``path/manifest`` with version and source."""
    files = index.groupBy("campaign_id").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    dealt = index.join(files, "campaign_id").withColumn("_file", F.pmod(F.xxhash64("id", "row_pos"), "_files"))
    dealt.repartition("campaign_id", "_file").drop("_file", "_files").write.partitionBy("campaign_id").parquet(f"{path}/index")
    written = read_index_rows(index.sparkSession, path, index.schema)
    index_manifest(written, campaigns, built_at).withColumn("source", F.lit(source)).write.parquet(f"{path}/manifest")


def read_index_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/index")


def read_campaign_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, index rows) of the campaigns in ``path``; an index without its manifest row is not there yet."""
    manifest = spark.read.parquet(f"{path}/manifest")
    fields = T.StructType([T.StructField("campaign_id", T.StringType()), *spark.read.parquet(f"{path}/index").drop("campaign_id").schema.fields])
    return manifest, read_index_rows(spark, path, fields).join(manifest.select("campaign_id"), "campaign_id", "left_semi")


# --- tiles -----------------------------------------------------------------------------
def cell_of(use_cell: bool = True) -> Column:
    """The tile cell of a standardized row: county and precinct, or ZIP and street."""
    if use_cell:
        county = slug(F.coalesce(F.nullif(text("county"), F.lit("")), F.lit("x")))
        return F.concat_ws("__", county, F.when(text("tile_cell") == "", "nocell").otherwise(slug("tile_cell")))
    return F.concat_ws("__", F.coalesce(F.nullif(F.col("zip5"), F.lit("")), F.lit("00000")), slug("street"))


def tile_rows(roll: DataFrame, use_cell: bool = True) -> DataFrame:
    """Roll rows with their cell, search tokens ``t`` and house number ``h``.

    Cells are ``county__precinct`` (``county__nocell`` when a row lacks one) or ``zip__street``.
    """
    return standardize(roll).select(
        "row_pos", *RECORD, cell_of(use_cell).alias("cell"), search_tokens().alias("t"), F.col("number").alias("h"))


def tile_bands(rows: DataFrame, cap: int = fixed.TILE_CAP) -> DataFrame:
    """Split cells above ``cap`` into bands by house number and name; adds ``tile``."""
    house = F.coalesce(F.try_to_number("h", F.lit("9999999999")).cast("long"), F.lit(0))
    placed = in_group_order(rows.withColumn("_house", house), ["cell"], ["_house", "name", "row_pos"])
    band = F.floor((F.col("position") - 1) / cap)
    tile = F.when(F.col("group_size") <= cap, F.col("cell")).otherwise(F.concat_ws("__b", "cell", band))
    return placed.withColumn("tile", tile).drop("_house", "group_size")


def modal(df: DataFrame, keys: list[str], value: Column, order: str) -> DataFrame:
    """Most frequent non-empty value per group; the value seen first wins a tie."""
    counted = df.withColumn("_v", value).where("_v <> ''").groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(
        F.max_by("_v", F.struct("_n", (-F.col("_first")).alias("f"))).alias("modal"))


def tile_manifest(tiles: DataFrame) -> DataFrame:
    """One row per tile: voter_count, version and modal ZIP."""
    zips = modal(tiles, ["tile"], zip_trailing_loose("address"), "position")
    versions = content_version(tiles, ["tile"], [*RECORD, "h", "position"])
    return versions.join(zips, "tile", "left").select(
        "tile", "voter_count", "version", F.coalesce("modal", F.lit("")).alias("zip"))


def tile_stats(manifest: DataFrame) -> DataFrame:
    """Smallest, (upper) median and largest tile."""
    return manifest.agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("voter_count").alias("voters"),
        F.min("voter_count").alias("smallest"),
        F.max("voter_count").alias("largest"),
    ).crossJoin(_upper_median(manifest, "voter_count"))


def _upper_median(df: DataFrame, column: str) -> DataFrame:
    """Value at index floor(n/2) of the sorted column, from a histogram of distinct values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    placed = in_group_order(counts, ["_all"], [column], amount="n")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    hit = (F.col("before") <= F.floor(F.col("total") / 2)) & (F.floor(F.col("total") / 2) < F.col("before") + F.col("n"))
    return placed.crossJoin(total).where(hit).agg(F.max(column).alias("median"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """One folder per tile, rows inside in tile order."""
    tile_folders.write(tiles, path)


def read_tiles(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` of all tiles that :func:`write_tiles` wrote."""
    return tile_folders.read(spark, path, schema)


# --- ZIP shards --------------------------------------------------------------------------
def shard_rows(roll: DataFrame) -> DataFrame:
    """Active voters with the ZIP that names their shard."""
    return roll.where("status = 'active'").withColumn("zip5", zip_trailing("address")).select("zip5", "row_pos", *RECORD)


def shard_manifest(shards: DataFrame) -> DataFrame:
    return content_version(shards, ["zip5"], RECORD)


def write_shards(shards: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """One folder per ZIP; a ZIP with many voters takes as many files as it needs."""
    files = shards.groupBy("zip5").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    dealt = shards.join(files, "zip5").withColumn("_file", F.pmod(F.xxhash64("id"), "_files")).drop("_files")
    dealt.repartition("zip5", "_file").drop("_file").write.partitionBy("zip5").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The shards, or one of them after a filter on ``zip5``; the schema keeps a ZIP's leading zeros."""
    return spark.read.schema(schema).parquet(path)


# --- membership ----------------------------------------------------------------------------
def filter_size(expected: int, fpr: float = fixed.BLOOM_FPR) -> tuple[int, int]:
    """Bits and hash count for an expected number of members."""
    bits = max(8, math.ceil(-expected * math.log(fpr) / math.log(2) ** 2))
    return bits, max(1, round(bits / expected * math.log(2)))


def member_keys(people: DataFrame) -> DataFrame:
    return standardize(people).withColumn("member_key", member_key())


def bit_positions(bits: int, hashes: int, key: str = "member_key") -> Column:
    """Double hashing: k positions from two independent hashes of the key."""
    a = F.pmod(F.xxhash64(key), F.lit(bits))
    b = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))


def _positions(keys: DataFrame, bits: int, hashes: int, *keep: str) -> DataFrame:
    """One row per (key, position), addressed as a 4 KB chunk and a bit inside it."""
    flat = keys.select(*keep, F.explode(bit_positions(bits, hashes)).alias("pos"))
    return flat.select(
        *keep, F.bitmap_bucket_number(F.col("pos") + 1).alias("chunk"),
        F.bitmap_bit_position(F.col("pos") + 1).alias("bit"))


def membership_filter(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The Bloom filter as 4 KB chunks: (chunk, bits).  Chunks combine by OR before the shuffle."""
    return _positions(keys, bits, hashes).groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge_filters(*filters: DataFrame) -> DataFrame:
    """Union of filters of the same size."""
    merged = filters[0]
    for other in filters[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def probe_filter(keys: DataFrame, chunks: DataFrame, bits: int, hashes: int, row_key: str) -> DataFrame:
    """(row_key, maybe_member) for every key row.  No false negatives."""
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return (
        _positions(keys, bits, hashes, row_key).join(chunks, "chunk", "left")
        .groupBy(row_key).agg(F.bool_and(is_set).alias("maybe_member"))
    )


def member_sizes(members: DataFrame, fpr: float = fixed.BLOOM_FPR) -> DataFrame:
    """(campaign_id, members, bits, hashes): a filter size for each campaign from its own number of members."""
    n = members.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("members"))
    bits = F.greatest(F.lit(8), F.ceil(-F.col("members") * math.log(fpr) / math.log(2) ** 2)).cast("long")
    return n.withColumn("bits", bits).withColumn("hashes", F.greatest(F.lit(1), F.round(F.col("bits") / F.col("members") * math.log(2))).cast("int"))


def _campaign_positions(keys: DataFrame, sizes: DataFrame, *keep: str) -> DataFrame:
    """One row per (campaign, key, position), addressed as in the filter of that campaign."""
    a, b = F.xxhash64("member_key"), F.xxhash64("member_key", F.lit(1))
    at = F.transform(F.sequence(F.lit(0), F.col("hashes") - 1), lambda i: F.pmod(F.pmod(a, "bits") + i * F.pmod(b, "bits"), F.col("bits")))
    flat = keys.join(sizes.select("campaign_id", "bits", "hashes"), "campaign_id").select("campaign_id", *keep, F.explode(at).alias("pos"))
    return flat.select("campaign_id", *keep, F.bitmap_bucket_number(F.col("pos") + 1).alias("chunk"), F.bitmap_bit_position(F.col("pos") + 1).alias("bit"))


def write_membership(keys: DataFrame, path: str, fpr: float = fixed.BLOOM_FPR) -> None:
    """Write one Bloom filter per campaign; ``keys``: campaign_id, member_key (repeats count once).

    ``path/chunks`` has the set bits by campaign and 4 KB chunk, combined before the shuffle; ``path/manifest``, written last, the size, the number of
    set bits and a version of each filter that changes with its bits only.  A campaign that holds a third of all members has more chunks
    than others, no larger ones.
    """
    spark = keys.sparkSession
    members = stage(keys.where("campaign_id IS NOT NULL AND member_key IS NOT NULL").select("campaign_id", "member_key").distinct(), "members")
    sizes = member_sizes(members, fpr)
    chunks = _campaign_positions(members, sizes).groupBy("campaign_id", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
    chunks.write.parquet(f"{path}/chunks")
    written = spark.read.parquet(f"{path}/chunks")
    versions = content_version(written.withColumn("bits", F.hex("bits")), ["campaign_id"], ["chunk", "bits"]).drop("voter_count")
    counts = written.groupBy("campaign_id").agg(F.sum(F.bitmap_count("bits")).alias("bits_set"))
    sizes.join(counts, "campaign_id").join(versions, "campaign_id").write.parquet(f"{path}/manifest")


def read_membership(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, chunks) of the filters in ``path``."""
    return spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/chunks")


def probe_membership(keys: DataFrame, manifest: DataFrame, chunks: DataFrame, row_key: str) -> DataFrame:
    """(campaign_id, row_key, maybe_member) for every row of ``keys`` (campaign_id, row_key, member_key) whose campaign has a filter; no false negatives."""
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return _campaign_positions(keys, manifest, row_key).join(chunks, ["campaign_id", "chunk"], "left").groupBy("campaign_id", row_key).agg(
        F.bool_and(is_set).alias("maybe_member"))


def exact_members(signers: DataFrame, roll: DataFrame) -> DataFrame:
    """Signers whose member key is on the active roll."""
    members = member_keys(roll.where("status = 'active'")).select("member_key").distinct()
    return member_keys(signers).join(members, "member_key", "left_semi")
