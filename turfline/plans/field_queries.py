"""Queries: roll sources, artifacts, sync, yields."""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions.dates import iso_date
from turfline.functions.text import zip_trailing
from turfline.operators import artifacts, sync, yields
from turfline.operators.validity import StateContext, validate_rows
from turfline.plans import oracle_parts as O
from turfline.plans.registry import query
from turfline.session import dealt, scratch, stage
from turfline.functions import people as P
from turfline.sources import field_tables as ft
from turfline.sources import rolls, snapshots
from turfline.sources.adapters import LAYOUTS

CONTEXT = StateContext("Ohio")
R = f"WITH {O.roll()} "
STD_R = f"WITH {O.roll()}, {O.std('roll', 'r')} "
CAP = f"WITH {O.captures()} "

# --- sources ------------------------------------------------------------------------


def _canonical_sql(name: str) -> str:
    """What a customer row looks like after a round trip through one layout."""
    lay = LAYOUTS[name]
    has = lay.columns.__contains__
    date = "NULL" if lay.date_format == "unknown" else "registered_on"
    unit = "CASE WHEN unit_text <> '' THEN '#' || unit_text END" if has("unit") else "NULL"
    state = "'NC'" if has("state") else "NULL"
    status = "CASE status WHEN 'active' THEN 'active' WHEN 'inactive' THEN 'inactive' ELSE 'cancelled' END"
    col = lambda c: f"nullif({c}, '')" if has(c) else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{name}' AS jurisdiction, voter_id AS id,
 concat_ws(' ', first_name, nullif(middle_name, ''), last_name, nullif(suffix, '')) AS name,
 concat_ws(', ', concat_ws(' ', nullif(house, ''), street_name, {unit}), concat_ws(' ', 'Springfield', {state}, zip)) AS address,
 {status} AS status, {date} AS registered_on, {col('county')} AS county, {col('district')} AS district, {col('tile_cell')} AS tile_cell FROM layout"""


def _written(spark, d, names):
    people = stage(ft.roll_layout(spark, d).withColumn("state", F.lit("NC")), "people")
    paths = {}
    for name in names:
        paths[name] = scratch(spark, name.replace(" ", "_"))
        rolls.write(people, LAYOUTS[name], paths[name])
    return paths


def _scanned(spark, d, names):
    paths = _written(spark, d, names)
    columns = ["jurisdiction", *rolls.CANONICAL]
    return rolls.union([rolls.scan(spark, paths[n], LAYOUTS[n]).select(*columns) for n in names])


@query("roll_scan", f"WITH {O.layout()} " + " UNION ALL ".join(_canonical_sql(n) for n in LAYOUTS))
def roll_scan(spark, d):
    """Export the roll into all seven layouts and read every file back through its layout."""
    return _scanned(spark, d, list(LAYOUTS))


@query("roll_scan_positional", f"WITH {O.layout()} " + _canonical_sql("Florida"))
def roll_scan_positional(spark, d):
    return _scanned(spark, d, ["Florida"])


@query("roll_roundtrip", f"WITH {O.layout()}, one AS ({_canonical_sql('Vermont')}), two AS ({_canonical_sql('North Carolina')}), both2 AS (SELECT * FROM one UNION ALL SELECT * FROM two) "
       "SELECT jurisdiction, status, count(*) AS voters, count(registered_on) AS dated, min(registered_on) AS first_date, max(registered_on) AS last_date FROM both2 GROUP BY ALL")
def roll_roundtrip(spark, d):
    return _scanned(spark, d, ["Vermont", "North Carolina"]).groupBy("jurisdiction", "status").agg(
        F.count(F.lit(1)).alias("voters"), F.count("registered_on").alias("dated"),
        F.min("registered_on").alias("first_date"), F.max("registered_on").alias("last_date"))


@query("roll_stream", f"WITH {O.layout()} " + _canonical_sql("Washington"))
def roll_stream(spark, d):
    """The same rows from a streaming scan of the exported folder."""
    from turfline.streaming.captures import start_roll_ingest

    lay = LAYOUTS["Washington"]
    folder = _written(spark, d, ["Washington"])["Washington"]
    rows = rolls.scan_stream(spark, folder, lay, rolls.header_of(spark, folder, lay))
    out = scratch(spark, "ingested")
    start_roll_ingest(rows, out, scratch(spark, "ingest-log")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("jurisdiction", *rolls.CANONICAL)


@query("roll_scoped_limit", R + "SELECT id, name, address FROM roll WHERE regexp_extract(address, '\\b([0-9]{5})\\b\\s*$', 1) IN ('62705', '62706', '62707') ORDER BY row_pos LIMIT 40")
def roll_scoped_limit(spark, d):
    keep = artifacts.in_zips(["62705", "62706", "62707"])
    return rolls.scoped(ft.roll(spark, d), keep, limit=40).select("id", "name", "address")


@query("roll_first_matching", f"WITH {O.layout()} " + _canonical_sql("Vermont") + " WHERE zip IN ('62705', '62706', '62707') ORDER BY row_pos LIMIT 40")
def roll_first_matching(spark, d):
    """The roll written in eight files in its order; the first rows of three ZIPs, without the files after them."""
    path, people = scratch(spark, "roll"), ft.roll_layout(spark, d).withColumn("state", F.lit("NC"))
    rolls.write(people.repartitionByRange(8, "row_pos").sortWithinPartitions("row_pos"), LAYOUTS["Vermont"], path)
    found = rolls.first_matching(spark, path, LAYOUTS["Vermont"], artifacts.in_zips(["62705", "62706", "62707"]), 40)
    return found.select("jurisdiction", *rolls.CANONICAL)


@query("synth_roll", R + "SELECT id, name, address, status, registered_on, county, district, tile_cell FROM roll")
def synth_roll(spark, d):
    return ft.roll(spark, d).select("id", "name", "address", "status", "registered_on", "county", "district", "tile_cell")


@query("std_status", """SELECT o_orderkey, CASE WHEN lower(trim(code)) IN ('active') THEN 'active' WHEN lower(trim(code)) IN ('purged', 'canceled') THEN 'cancelled'
 WHEN regexp_matches(lower(code), 'cancel|remov|denied|purg') THEN 'cancelled' ELSE 'inactive' END AS status
 FROM (SELECT o_orderkey, (['ACTIVE', ' Active ', 'PURGED', 'CANCELED', 'CHALLENGED', 'Removed by county', 'REQUEST DENIED', ''])[o_orderkey % 8 + 1] AS code FROM orders)""")
def std_status(spark, d):
    codes = ("ACTIVE", " Active ", "PURGED", "CANCELED", "CHALLENGED", "Removed by county", "REQUEST DENIED", "")
    o = F.col("o_orderkey")
    return ft.read(spark, d, "orders").select(o, rolls.status_of(ft.pick(codes, o % 8), LAYOUTS["Vermont"]).alias("status"))


@query("std_date", """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS us, strftime(l_shipdate, '%Y-%m-%d') AS compact, strftime(l_shipdate, '%Y-%m-%d') AS iso,
 CASE WHEN l_linenumber % 2 = 0 THEN '2020-' || lpad(CAST(10 + l_linenumber AS VARCHAR), 2, '0') || '-45' ELSE '' END AS unchecked FROM lineitem""")
def std_date(spark, d):
    n, day = F.col("l_linenumber"), F.col("l_shipdate")
    odd = F.when(n % 2 == 0, F.concat((n + 10).cast("string"), F.lit("/45/2020"))).otherwise("n/a")
    return ft.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", iso_date(F.date_format(day, "M/d/yyyy"), "MM/DD/YYYY").alias("us"),
        iso_date(F.date_format(day, "yyyyMMdd"), "YYYYMMDD").alias("compact"),
        iso_date(F.date_format(day, "yyyy-MM-dd HH:mm"), "YYYY-MM-DD").alias("iso"), iso_date(odd, "MM/DD/YYYY").alias("unchecked"))


@query("compose_record", f"WITH {O.layout()}, raw AS (SELECT CASE WHEN row_pos % 4 = 0 THEN '' ELSE voter_id END AS vid, last_name, zip, house, street_name, unit_text FROM layout) "
       "SELECT coalesce(nullif(vid, ''), 'Oklahoma:' || last_name || ':' || zip) AS id, concat_ws(', ', concat_ws(' ', nullif(house, ''), street_name, CASE WHEN unit_text <> '' THEN '#' || unit_text END), 'Springfield ' || zip) AS address FROM raw")
def compose_record(spark, d):
    people = ft.roll_layout(spark, d).withColumn("state", F.lit("NC")).withColumn(
        "voter_id", F.when(F.col("row_pos") % 4 == 0, "").otherwise(F.col("voter_id")))
    lay = LAYOUTS["Oklahoma"]
    return rolls.canonical(rolls.export(people, lay), lay).select("id", "address")


# --- scope and artifacts -----------------------------------------------------------------
def _campaign_zips(spark, d):
    """Coverage ZIPs per campaign: five ZIPs for every nation."""
    n = ft.read(spark, d, "nation")
    return n.select(
        F.concat(F.lit("c"), "n_nationkey").alias("campaign_id"), F.col("n_name").alias("jurisdiction"),
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), "n_nationkey").select(
        "campaign_id", "jurisdiction", ((F.col("n_nationkey") * 3 + F.col("i")) % 40 + 62700).cast("string").alias("zip5"))


ZIPS = "campaign_zips AS (SELECT 'c' || n_nationkey AS campaign_id, n_name AS jurisdiction, CAST(62700 + (n_nationkey * 3 + i) % 40 AS VARCHAR) AS zip5 FROM nation CROSS JOIN (SELECT unnest(range(0, 5)) AS i))"
SCOPED = f"WITH {O.roll()}, {ZIPS}, scoped AS (SELECT campaign_id, roll.* FROM roll JOIN campaign_zips ON zip5 = regexp_extract(address, '\\b([0-9]{{5}})\\b\\s*$', 1)) "


@query("zip_scope", SCOPED + "SELECT campaign_id, id FROM scoped")
def zip_scope(spark, d):
    return artifacts.scope_by_campaign(ft.roll(spark, d), _campaign_zips(spark, d)).select("campaign_id", "id")


@query("campaign_index", SCOPED + ", n AS (SELECT campaign_id, count(*) AS voter_count FROM scoped GROUP BY 1) SELECT campaign_id, max(jurisdiction) AS jurisdiction, max(voter_count) AS voter_count, string_agg(zip5, ' ' ORDER BY zip5) AS scoped_zips, '2026-06-07' AS built_at FROM campaign_zips JOIN n USING (campaign_id) GROUP BY 1")
def campaign_index(spark, d):
    zips = _campaign_zips(spark, d)
    index = artifacts.campaign_index(ft.roll(spark, d), zips)
    manifest = artifacts.index_manifest(index, zips, "2026-06-07")
    return manifest.select("campaign_id", "jurisdiction", "voter_count", F.array_join("scoped_zips", " ").alias("scoped_zips"), "built_at")


@query("campaign_index_files", SCOPED + "SELECT campaign_id, count(*) AS voter_count, count(*) AS read_back, true AS same_version, 'customer' AS source, '2026-06-07' AS built_at FROM scoped GROUP BY 1")
def campaign_index_files(spark, d):
    """Every campaign's index written with its provenance and read back; the version of what is read is that of the manifest."""
    zips, path = _campaign_zips(spark, d), scratch(spark, "indexes")
    artifacts.write_campaign_index(artifacts.campaign_index(ft.roll(spark, d), zips), zips, path, "2026-06-07", "customer")
    manifest, index = artifacts.read_campaign_index(spark, path)
    back = artifacts.content_version(index, ["campaign_id"], artifacts.RECORD).withColumnsRenamed({"voter_count": "read_back", "version": "_version"})
    return manifest.join(back, "campaign_id").select(
        "campaign_id", "voter_count", "read_back", (F.col("version") == F.col("_version")).alias("same_version"), "source", "built_at")


@query("content_version", SCOPED + "SELECT campaign_id, count(*) AS voter_count, true AS stable, true AS sensitive FROM scoped GROUP BY 1")
def content_version(spark, d):
    """A version must not depend on partitioning or on where the records stand in the roll, and must change with any record."""
    index = artifacts.campaign_index(ft.roll(spark, d), _campaign_zips(spark, d))
    v = lambda df, name: artifacts.content_version(df, ["campaign_id"], artifacts.RECORD).withColumnRenamed("version", name)
    base, again = v(index, "a"), v(index.repartition(13, "id").withColumn("row_pos", F.col("row_pos") + 1), "b").drop("voter_count")
    touched = v(index.withColumn("status", F.concat("status", F.lit("!"))), "c").drop("voter_count")
    return base.join(again, "campaign_id").join(touched, "campaign_id").select(
        "campaign_id", "voter_count", (F.col("a") == F.col("b")).alias("stable"), (F.col("a") != F.col("c")).alias("sensitive"))


CELL = f"{O.slug('county')} || '__' || CASE WHEN tile_cell = '' THEN 'nocell' ELSE {O.slug('tile_cell')} END"


@query("tile_key", STD_R + f"SELECT id, {CELL} AS cell, coalesce(nullif(zip5, ''), '00000') || '__' || {O.slug('street')} AS street_cell FROM r")
def tile_key(spark, d):
    return P.standardize(ft.roll(spark, d)).select("id", artifacts.cell_of().alias("cell"), artifacts.cell_of(use_cell=False).alias("street_cell"))


CAP_ROWS = 6
TILES = STD_R + f""", cells AS (SELECT *, {CELL} AS cell FROM r),
placed AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY coalesce(TRY_CAST(number AS BIGINT), 0), name, row_pos) AS position, count(*) OVER (PARTITION BY cell) AS n FROM cells),
tiles AS (SELECT *, CASE WHEN n <= {CAP_ROWS} THEN cell ELSE cell || '__b' || ((position - 1) // {CAP_ROWS}) END AS tile FROM placed) """


def _tiles(spark, d):
    return artifacts.tile_bands(artifacts.tile_rows(ft.roll(spark, d)), cap=CAP_ROWS)


@query("tile_bands", TILES + "SELECT id, cell, tile, position FROM tiles")
def tile_bands(spark, d):
    return _tiles(spark, d).select("id", "cell", "tile", "position")


MANIFEST = TILES + """, zc AS (SELECT tile, regexp_extract(address, '([0-9]{5})\\s*$', 1) AS z, count(*) AS n, min(position) AS p FROM tiles GROUP BY 1, 2),
modal AS (SELECT tile, z AS zip FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n DESC, p) AS rn FROM zc WHERE z <> '') WHERE rn = 1),
manifest AS (SELECT tile, count(*) AS voter_count, coalesce(max(zip), '') AS zip FROM tiles LEFT JOIN modal USING (tile) GROUP BY tile) """


@query("tile_manifest", MANIFEST + "SELECT tile, voter_count, zip FROM manifest")
def tile_manifest(spark, d):
    return artifacts.tile_manifest(_tiles(spark, d)).drop("version")


@query("tile_stats", MANIFEST + "SELECT count(*) AS tiles, CAST(sum(voter_count) AS BIGINT) AS voters, min(voter_count) AS smallest, max(voter_count) AS largest, (list_sort(list(voter_count)))[count(*) // 2 + 1] AS median FROM manifest")
def tile_stats(spark, d):
    return artifacts.tile_stats(stage(artifacts.tile_manifest(_tiles(spark, d)), "manifest"))


@query("tile_files", MANIFEST + "SELECT tile, count(*) AS voters, string_agg(id, ' ' ORDER BY position) AS ids FROM tiles GROUP BY tile")
def tile_files(spark, d):
    """Write the tile artifacts and read them back by folder."""
    out = scratch(spark, "tiles")
    tiles = _tiles(spark, d)
    artifacts.write_tiles(tiles, out)
    back = artifacts.read_tiles(spark, out, tiles.select("tile", "id", "position").schema)
    return back.groupBy("tile").agg(
        F.count(F.lit(1)).alias("voters"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda s: s["id"]), " ").alias("ids"))


@query("zip_shard_files", R + "SELECT id, regexp_extract(address, '\\b([0-9]{5})\\b\\s*$', 1) AS zip5 FROM roll WHERE status = 'active'")
def zip_shard_files(spark, d):
    """Every shard written and read back."""
    shards = artifacts.shard_rows(ft.roll(spark, d))
    path = scratch(spark, "shards")
    artifacts.write_shards(shards, path)
    return artifacts.read_shards(spark, path, shards.schema).select("id", "zip5")


@query("zip_shard_manifest", R + "SELECT regexp_extract(address, '\\b([0-9]{5})\\b\\s*$', 1) AS zip5, count(*) AS voter_count FROM roll WHERE status = 'active' GROUP BY 1")
def zip_shard_manifest(spark, d):
    return artifacts.shard_manifest(artifacts.shard_rows(ft.roll(spark, d))).drop("version")


def _sized(spark, d):
    """Filter size from the customer count in the file footers."""
    return artifacts.filter_size(max(1, ft.read(spark, d, "customer").count()))


@query("membership_build")
def membership_build(spark, d):
    bits, hashes = _sized(spark, d)
    keys = artifacts.member_keys(ft.roll(spark, d).where("status = 'active'"))
    return artifacts.membership_filter(keys, bits, hashes).select("chunk", F.bitmap_count("bits").alias("bits_set"))


@query("member_semi", f"WITH {O.roll()}, {O.signers()}, {O.std('roll', 'r')}, {O.std('signers', 's')} SELECT id FROM s WHERE first || ' ' || last || '|' || number || ' ' || street || ' ' || zip5 IN (SELECT first || ' ' || last || '|' || number || ' ' || street || ' ' || zip5 FROM r WHERE status = 'active')")
def member_semi(spark, d):
    return artifacts.exact_members(ft.signers(spark, d), ft.roll(spark, d)).select("id")


def _probed(spark, d, keys, row_key):
    bits, hashes = _sized(spark, d)
    members = artifacts.member_keys(ft.roll(spark, d).where("status = 'active'"))
    chunks = stage(artifacts.membership_filter(members, bits, hashes), "filter")
    return artifacts.probe_filter(keys, chunks, bits, hashes, row_key)


@query("member_bloom", R + "SELECT count(*) AS members, count(*) AS found FROM roll WHERE status = 'active'")
def member_bloom(spark, d):
    """No member may be missed."""
    keys = artifacts.member_keys(ft.roll(spark, d).where("status = 'active'"))
    return _probed(spark, d, keys, "id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if("maybe_member").alias("found"))


def _absent(spark, d):
    """One person that no roll has for every order: its customer with the last name read backwards."""
    k = F.col("o_custkey")
    address = F.concat(ft.house(k), F.lit(" "), ft.street_line(k), F.lit(", Springfield "), ft.zip5(k))
    return dealt(ft.read(spark, d, "orders").select("o_orderkey", "o_custkey")).select(
        F.col("o_orderkey").alias("id"), F.concat(ft.first_name(k), F.lit(" "), F.reverse(ft.last_name(k))).alias("name"), address.alias("address"))


ABSENT = f"""absent AS (SELECT o_orderkey AS id, {O.first_name('o_custkey')} || ' ' || reverse({O.last_name('o_custkey')}) AS name,
 {O.house('o_custkey')} || ' ' || {O.street_line('o_custkey')} || ', Springfield ' || {O.zip5('o_custkey')} AS address FROM orders)"""
_KEY = "first || ' ' || last || '|' || number || ' ' || street || ' ' || zip5"


@query("membership_fpr", f"""WITH {O.roll()}, {ABSENT}, {O.std('roll', 'r')}, {O.std('absent', 'a')}
SELECT count(*) AS probes, true AS within_target FROM a WHERE {_KEY} NOT IN (SELECT {_KEY} FROM r WHERE status = 'active')""")
def membership_fpr(spark, d):
    """One non-member per order; the false-positive rate must stay near its target."""
    members = artifacts.member_keys(ft.roll(spark, d).where("status = 'active'")).select("member_key").distinct()
    probes = artifacts.member_keys(_absent(spark, d)).join(members, "member_key", "left_anti")
    return _probed(spark, d, probes, "id").agg(
        F.count(F.lit(1)).alias("probes"), (F.avg(F.col("maybe_member").cast("int")) <= 2 * fixed.BLOOM_FPR).alias("within_target"))


def _campaign_members(spark, d):
    """A voter is standardized once, whatever the number of campaigns that hold the ZIP."""
    people = artifacts.member_keys(ft.roll(spark, d).where("status = 'active'")).drop("zip5")
    return artifacts.scope_by_campaign(people, _campaign_zips(spark, d)).select("campaign_id", "id", "member_key")


@query("membership_artifact", f"""WITH {O.roll()}, {ZIPS}, {O.std('roll', 'r')},
m AS (SELECT DISTINCT campaign_id, {_KEY.replace('zip5', 'r.zip5')} AS member_key FROM r JOIN campaign_zips z ON z.zip5 = regexp_extract(address, '\\b([0-9]{{5}})\\b\\s*$', 1) WHERE status = 'active'),
n AS (SELECT campaign_id, count(*) AS members, greatest(8, ceil(-count(*) * ln({fixed.BLOOM_FPR}::DOUBLE) / ln(2::DOUBLE) ** 2))::BIGINT AS bits FROM m GROUP BY 1)
SELECT campaign_id, members, bits, greatest(1, round(bits / members::DOUBLE * ln(2::DOUBLE)))::INT AS hashes, 0::BIGINT AS missed FROM n""")
def membership_artifact(spark, d):
    """A filter for every campaign, written, read back and probed with all its own members."""
    keys, path = _campaign_members(spark, d), scratch(spark, "membership")
    artifacts.write_membership(keys, path)
    manifest, chunks = artifacts.read_membership(spark, path)
    hits = artifacts.probe_membership(keys, manifest, chunks, "id").groupBy("campaign_id").agg(F.count_if(~F.col("maybe_member")).alias("missed"))
    return manifest.join(hits, "campaign_id").select("campaign_id", "members", "bits", "hashes", "missed")


@query("membership_rates")
def membership_rates(spark, d):
    """For every campaign the set bits, the version and the measured false-positive rate over the non-members of all orders."""
    keys, path = _campaign_members(spark, d), scratch(spark, "membership")
    artifacts.write_membership(keys, path)
    manifest, chunks = artifacts.read_membership(spark, path)
    probes = artifacts.member_keys(_absent(spark, d)).select("id", "member_key").join(keys.select("member_key").distinct(), "member_key", "left_anti")
    each = probes.withColumn("campaign_id", F.concat(F.lit("c"), F.col("id") % 25))  # every campaign gets its share of the orders
    rates = artifacts.probe_membership(each, manifest, chunks, "id").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("probes"), F.count_if("maybe_member").alias("false_positives"))
    return manifest.join(rates, "campaign_id").select(
        "campaign_id", "members", "bits", "hashes", "bits_set", "version", "probes", "false_positives", (F.col("false_positives") / F.col("probes")).alias("rate"))


# --- captures -----------------------------------------------------------------------------------
STATUS = CAP + """, claims AS (SELECT seq, row_number() OVER (PARTITION BY campaign_id, matched_voter_id ORDER BY captured_at, seq) AS rn FROM captures WHERE verdict = 'VALID' AND matched_voter_id IS NOT NULL),
statuses AS (SELECT c.*, CASE WHEN rn IS NULL THEN 'recorded' WHEN rn = 1 THEN 'accepted' ELSE 'duplicate' END AS status FROM captures c LEFT JOIN claims USING (seq)) """


@query("capture_source", CAP + "SELECT campaign_id, gatherer_id, seq, verdict, matched_voter_id, epoch_us(captured_at) // 1000 AS captured_ms FROM captures")
def capture_source(spark, d):
    """Captures posted as JSON batches, taken in by a stream and read back flat."""
    from turfline.streaming.captures import read_capture_batches

    c = ft.captures(spark, d)
    posted = c.groupBy("campaign_id", "gatherer_id", F.floor(F.col("seq") / 500).alias("post")).agg(F.collect_list(F.struct(
        "seq", "name", "address", "verdict", F.col("matched_voter_id").alias("matchedVoterId"), "score",
        F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("captured_at"))
        .alias("capturedAt"))).alias("captures"))
    path = scratch(spark, "posts")
    posted.select(F.col("campaign_id").alias("campaignId"), F.col("gatherer_id").alias("gathererId"), "captures").write.json(path)
    taken, out = read_capture_batches(spark, path), scratch(spark, "taken")
    taken.writeStream.option("checkpointLocation", scratch(spark, "log")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(taken.schema).parquet(out).select(
        "campaign_id", "gatherer_id", "seq", "verdict", "matched_voter_id", F.unix_millis("captured_at").alias("captured_ms"))


@query("capture_dedup", STATUS + "SELECT campaign_id, seq, status FROM statuses")
def capture_dedup(spark, d):
    return sync.capture_status(ft.captures(spark, d)).select("campaign_id", "seq", "status")


@query("movement", STATUS + "SELECT campaign_id, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'recorded') AS recorded FROM statuses GROUP BY 1")
def movement(spark, d):
    return sync.movement(sync.capture_status(ft.captures(spark, d)))


@query("queue_status", STATUS + "SELECT campaign_id, gatherer_id, seq, CASE WHEN captured_at >= TIMESTAMP '2024-01-20' THEN 'pending' ELSE 'synced' END AS sync, CASE WHEN status = 'duplicate' AND captured_at < TIMESTAMP '2024-01-20' THEN 'server: duplicate' END AS server_note FROM statuses")
def queue_status(spark, d):
    done = sync.capture_status(ft.captures(spark, d))
    acknowledged = done.where(F.col("captured_at") < F.to_timestamp(F.lit("2024-01-20")))
    return sync.queue_status(ft.captures(spark, d), acknowledged)


@query("capture_ready", CAP + "SELECT gatherer_id, seq, length(trim(coalesce(name, ''))) > 1 AND length(trim(coalesce(address, ''))) > 3 AS ready FROM captures")
def capture_ready(spark, d):
    c = ft.captures(spark, d)
    return c.select("gatherer_id", "seq", sync.capture_ready(F.col("name"), F.col("address")).alias("ready"))


@query("capture_log", CAP + "SELECT gatherer_id, seq, row_number() OVER (PARTITION BY gatherer_id ORDER BY seq DESC) AS back, max(seq) OVER (PARTITION BY gatherer_id) AS last_seq FROM captures")
def capture_log(spark, d):
    """Captures appended to a log by two writers and read back as each device shows them."""
    path = scratch(spark, "log")
    rows = ft.captures(spark, d)
    for part in (0, 1):
        rows.where(F.col("seq") % 2 == part).write.mode("append").parquet(path)
    log = spark.read.schema(rows.schema).parquet(path)
    return sync.hydrate(log, ["gatherer_id"]).select("gatherer_id", "seq", "back", "last_seq")


@query("velocity_flag", CAP + "SELECT gatherer_id AS token, seq AS call_id, calls, calls > 2 AS flagged FROM (SELECT gatherer_id, seq, count(*) OVER (PARTITION BY gatherer_id ORDER BY captured_at RANGE BETWEEN INTERVAL '7199999999 microseconds' PRECEDING AND CURRENT ROW) AS calls FROM captures)")
def velocity_flag(spark, d):
    calls = ft.captures(spark, d).select(F.col("gatherer_id").alias("token"), F.col("seq").alias("call_id"), F.col("captured_at").alias("called_at"))
    return sync.velocity_flags(calls, seconds=7200, limit=2).select("token", "call_id", "calls", "flagged")


# --- snapshots ------------------------------------------------------------------------------------
OLD = "old AS (SELECT * FROM roll WHERE row_pos % 10 <> 0)"
NEW = "new AS (SELECT * REPLACE (CASE WHEN row_pos % 7 = 0 THEN address || ' rev' ELSE address END AS address) FROM roll WHERE row_pos % 10 <> 1)"


def _snapshots(spark, d):
    roll, p = ft.roll(spark, d), F.col("row_pos")
    return roll.where(p % 10 != 0), roll.where(p % 10 != 1).withColumn(
        "address", F.when(p % 7 == 0, F.concat("address", F.lit(" rev"))).otherwise(F.col("address")))


@query("snapshot_diff", R + f", {OLD}, {NEW} SELECT CASE WHEN n.id IS NULL THEN 'remove' ELSE 'upsert' END AS op, coalesce(n.id, o.id) AS id, n.name, n.address, n.status, n.registered_on, n.county, n.district FROM old o FULL JOIN new n ON o.id = n.id WHERE n.id IS NULL OR o.id IS NULL OR o.address <> n.address")
def snapshot_diff(spark, d):
    return sync.snapshot_diff(*_snapshots(spark, d))


@query("delta_apply", R + f", {NEW} SELECT id, name, address, status, registered_on, county, district FROM new")
def delta_apply(spark, d):
    """Old snapshot plus the difference is the new snapshot."""
    old, new = _snapshots(spark, d)
    return sync.delta_apply(old, sync.snapshot_diff(old, new))


SNAPS = "snaps AS (SELECT 'cmp-' || (o_custkey % 50) AS campaign_id, 'v' || o_orderkey AS version, CAST(o_totalprice AS BIGINT) AS voter_count, strftime(o_orderdate, '%Y-%m-%d') AS built_at FROM orders), cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY built_at DESC, version DESC) AS rn FROM snaps) WHERE rn = 1)"


def _history(spark, d):
    return ft.read(spark, d, "orders").select(
        F.concat(F.lit("cmp-"), F.col("o_custkey") % 50).alias("campaign_id"), F.concat(F.lit("v"), "o_orderkey").alias("version"),
        F.round("o_totalprice").cast("long").alias("voter_count"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("built_at"))


@query("index_current", f"WITH {SNAPS} SELECT campaign_id, version, built_at FROM cur")
def index_current(spark, d):
    return sync.current_versions(_history(spark, d)).select("campaign_id", "version", "built_at")


REQUESTS = "requests AS (SELECT 'd' || o_custkey AS device_id, 'cmp-' || (o_custkey % 50) AS campaign_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' || o_orderkey ELSE 'v' || o_orderkey END AS since FROM orders)"


@query("index_since", f"WITH {SNAPS}, {REQUESTS} SELECT device_id, r.campaign_id, since, c.version AS current_version, CASE WHEN since = c.version THEN 'current' WHEN since IN (SELECT version FROM snaps s WHERE s.campaign_id = r.campaign_id) THEN 'delta' ELSE 'snapshot' END AS mode FROM requests r JOIN cur c ON c.campaign_id = r.campaign_id")
def index_since(spark, d):
    o = F.col("o_orderkey")
    requests = ft.read(spark, d, "orders").select(
        F.concat(F.lit("d"), "o_custkey").alias("device_id"), F.concat(F.lit("cmp-"), F.col("o_custkey") % 50).alias("campaign_id"),
        F.concat(F.when(o % 3 == 0, "old").otherwise("v"), o).alias("since"))
    return sync.sync_mode(requests, _history(spark, d))


@query("snapshot_store", R + f", {OLD}, {NEW} SELECT 'statewide' AS campaign_id, id, address FROM new")
def snapshot_store(spark, d):
    """Two versions written to the store; reading the current one follows the pointer."""
    old, new = _snapshots(spark, d)
    store = snapshots.SnapshotStore(spark, scratch(spark, "store"))
    keep = ["id", "address"]
    store.put("statewide", "v1", "2026-01-01", old.select(*keep))
    store.put("statewide", "v2", "2026-02-01", new.select(*keep))
    return store.current("statewide").select("campaign_id", *keep)


DELTA = R + f""", {OLD}, {NEW}, v AS (SELECT 'c' || r.row_pos % 5 AS campaign_id, 'v1' AS version, id, address FROM old r UNION ALL SELECT 'c' || r.row_pos % 5, 'v2', id, address FROM new r),
req AS (SELECT campaign_id, unnest(['v1', 'v2', 'v0']) AS since FROM (SELECT DISTINCT campaign_id FROM v)) """


@query("index_delta", DELTA + """SELECT req.campaign_id, since, CASE WHEN since = 'v0' THEN 'snapshot' ELSE 'upsert' END AS op, n.id, n.address FROM req JOIN v n ON n.campaign_id = req.campaign_id AND n.version = 'v2'
 LEFT JOIN v o ON o.campaign_id = req.campaign_id AND o.version = req.since AND o.id = n.id WHERE since = 'v0' OR (since = 'v1' AND (o.id IS NULL OR o.address <> n.address))
UNION ALL SELECT o.campaign_id, 'v1', 'remove', o.id, NULL FROM v o WHERE o.version = 'v1' AND NOT EXISTS (SELECT 1 FROM v n WHERE n.version = 'v2' AND n.campaign_id = o.campaign_id AND n.id = o.id)""")
def index_delta(spark, d):
    """Devices at the current, the earlier and an unknown version of five campaigns."""
    keep = ["campaign_id", "id", "address"]
    campaign = F.concat(F.lit("c"), F.col("row_pos") % 5)
    old, new = (part.withColumn("campaign_id", campaign).select(*keep) for part in _snapshots(spark, d))
    versions = old.withColumn("version", F.lit("v1")).unionByName(new.withColumn("version", F.lit("v2")))
    built = F.when(F.col("version") == "v1", "2026-01-01").otherwise("2026-02-01")
    pointers = versions.groupBy("campaign_id", "version").agg(F.count(F.lit(1)).alias("voter_count")).withColumn("built_at", built)
    devices = pointers.select("campaign_id").distinct().select(
        "campaign_id", F.explode(F.array(F.lit("v1"), F.lit("v2"), F.lit("v0"), F.lit("v1"))).alias("since")).withColumn("device_id", F.col("since"))
    return sync.changes_since(sync.sync_mode(devices, pointers), versions, ["id", "address"])


@query("stale_index", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN true ELSE coalesce(epoch(TIMESTAMP '1998-01-01 00:00:00') - epoch(max(o_orderdate)) > 3600, true) END AS stale FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1")
def stale_index(spark, d):
    """Every customer's device at a given hour; one that never synced is stale."""
    now = F.to_timestamp(F.lit("1998-01-01 00:00:00"))
    seen = ft.read(spark, d, "orders").where(F.col("o_orderdate") < now).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    devices = ft.read(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left")
    at = F.when(F.col("c_custkey") % 9 != 0, F.col("at")).cast("timestamp")
    return devices.select("c_custkey", sync.stale(at, now).alias("stale"))


@query("union_state", MANIFEST + ", loaded AS (SELECT split_part(tile, '__', 1) AS campaign_id, tile, voter_count, zip, TIMESTAMP '2026-01-01' + voter_count * INTERVAL 1 MINUTE AS synced_at FROM manifest) SELECT campaign_id, min(synced_at) AS synced_at, CAST(sum(voter_count) AS BIGINT) AS voter_count, string_agg(zip, '|' ORDER BY tile) AS version FROM loaded GROUP BY 1")
def union_state(spark, d):
    loaded = artifacts.tile_manifest(_tiles(spark, d)).select(
        F.split_part("tile", F.lit("__"), F.lit(1)).alias("campaign_id"), "tile", "voter_count", F.col("zip").alias("version"),
        (F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("voter_count").cast("int"))).alias("synced_at"))
    return sync.union_state(loaded)


NATION_OF = "coalesce(lower(n_name), split_part({0}, '__', 1))"
OF_NATION = "LEFT JOIN nation ON 'nation-' || n_nationkey = split_part({0}, '__', 1)"


def _turf(spark, d, tiles):
    """One campaign for each nation, over all its tiles; a county that is no nation is a campaign of its own."""
    county = F.split_part("tile", F.lit("__"), F.lit(1))
    nations = ft.read(spark, d, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("_county"), F.lower("n_name").alias("_nation"))
    return tiles.select("tile").distinct().withColumn("_county", county).join(nations, "_county", "left").select(
        F.coalesce("_nation", "_county").alias("campaign_id"), "tile")


@query("tile_union_nations", TILES + f"SELECT {NATION_OF.format('cell')} AS campaign_id, cell AS assignment, count(*) AS voters FROM tiles {OF_NATION.format('cell')} GROUP BY 1, 2")
def tile_union_nations(spark, d):
    """The rolls of all nations' turfs."""
    tiles = stage(_tiles(spark, d), "tiles")
    rows = sync.tile_union(tiles, _turf(spark, d, tiles))
    return rows.groupBy("campaign_id", F.col("cell").alias("assignment")).agg(F.count(F.lit(1)).alias("voters"))


@query("turf_coverage_nations", MANIFEST + f"SELECT {NATION_OF.format('tile')} AS campaign_id, tile FROM manifest {OF_NATION.format('tile')}")
def turf_coverage_nations(spark, d):
    """All nations' turfs, each tile beside one that is gone."""
    manifest = stage(artifacts.tile_manifest(_tiles(spark, d)), "manifest")
    turf = F.array("tile", F.concat("tile", F.lit("__gone")))
    return sync.turf_coverage(_turf(spark, d, manifest).select("campaign_id", turf.alias("turf")), manifest)


# --- lookups ---------------------------------------------------------------------------------------
SHARDED = f"""s0 AS (SELECT * REPLACE (NULL::VARCHAR AS signed_on, NULL::VARCHAR AS county), regexp_extract(address, '([0-9]{{5}})(?:-[0-9]{{4}})?\\s*$', 1) AS z FROM s), r0 AS (SELECT * REPLACE (block || '@' || regexp_extract(address, '\\b([0-9]{{5}})\\b\\s*$', 1) AS block) FROM r WHERE status = 'active'),
shard_zips AS (SELECT DISTINCT regexp_extract(address, '\\b([0-9]{{5}})\\b\\s*$', 1) AS z FROM r WHERE status = 'active' AND z <> ''),
rr AS (SELECT * FROM r0 UNION ALL SELECT * FROM r), ss AS (SELECT * EXCLUDE (z) REPLACE (CASE WHEN z IN (SELECT z FROM shard_zips) THEN block || '@' || z ELSE block END AS block) FROM s0)"""
VERIFY = f"WITH {O.roll()}, {O.signers()}, {O.std('roll', 'r')}, {O.std('signers', 's')}, {SHARDED}, {O.matched('ss', 'rr').replace('LEFT JOIN rr v ON', 'LEFT JOIN r v ON')}, {O.judged()}"


@query("verify_lookup", VERIFY + " SELECT id, verdict, band, matched_voter_id, CASE WHEN contains(block, '@') THEN 'shard' ELSE 'campaign' END AS source FROM judged")
def verify_lookup(spark, d):
    roll = ft.roll(spark, d)
    return sync.verify_lookup(ft.signers(spark, d), roll, roll, CONTEXT).drop("score")


def _step(roll: str) -> str:
    return f"WITH {O.std(roll, 'r')}, {O.std('signers', 's')}, {O.matched()}, {O.judged()}"


LADDER = f"""WITH {O.roll()}, {O.signers()}, turf_roll AS (SELECT * FROM roll WHERE regexp_extract(address, '\\b([0-9]{{5}})\\b\\s*$', 1) < '62720'),
near AS ({_step('turf_roll')} SELECT id, verdict, band, matched_voter_id FROM judged), whole AS ({_step('roll')} SELECT id, verdict, matched_voter_id FROM judged),
members AS (WITH {O.std('roll', 'r')}, {O.std('signers', 's')} SELECT id FROM s WHERE first || ' ' || last || '|' || number || ' ' || street || ' ' || zip5 IN (SELECT first || ' ' || last || '|' || number || ' ' || street || ' ' || zip5 FROM r WHERE status = 'active')),
tiers AS (SELECT n.*, w.matched_voter_id AS full_id, CASE WHEN n.band <> 'NO_MATCH' THEN 'turf' WHEN w.verdict = 'VALID' THEN 'full_roll' WHEN n.id IN (SELECT id FROM members) THEN 'membership' ELSE 'none' END AS tier
 FROM near n LEFT JOIN whole w ON w.id = n.id)
SELECT id, tier, CASE tier WHEN 'full_roll' THEN 'VALID' WHEN 'membership' THEN 'APPEARS_REGISTERED' ELSE verdict END AS verdict, CASE tier WHEN 'full_roll' THEN full_id WHEN 'turf' THEN matched_voter_id END AS voter_id FROM tiers"""


@query("validation_ladder", LADDER)
def validation_ladder(spark, d):
    """Turf (half the ZIPs); lines without a match there go to the full roll, then to membership."""
    roll, signers = ft.roll(spark, d), ft.signers(spark, d)
    turf = roll.where(zip_trailing("address") < "62720")
    keep = ["id", "verdict", "band", "score", "matched_voter_id"]
    local = stage(validate_rows(signers, turf, CONTEXT).select(*keep), "turf-answers")
    waiting = signers.join(local.where("band = 'NO_MATCH'").select("id"), "id", "left_semi")
    full = validate_rows(waiting, roll, CONTEXT).select(*keep)
    return sync.validation_ladder(local, full, artifacts.exact_members(waiting, roll).select("id"))


# --- yields ----------------------------------------------------------------------------------------
def _history_counts(spark, d):
    li = ft.read(spark, d, "lineitem")
    return li.groupBy(F.lit("gatherer").alias("dim"), F.concat(F.lit("g"), "l_suppkey").alias("key")).agg(
        F.count_if(F.col("l_returnflag") != "R").alias("valid"), F.count(F.lit(1)).alias("total"))


def _live_counts(spark, d):
    c = ft.captures(spark, d)
    return c.groupBy(F.lit("gatherer").alias("dim"), F.col("gatherer_id").alias("key")).agg(
        F.count_if(F.col("verdict") == "VALID").alias("valid"), F.count(F.lit(1)).alias("total"))


STORE = CAP + """, hist AS (SELECT 'gatherer' AS dim, 'g' || l_suppkey AS key, count(*) FILTER (l_returnflag <> 'R') AS valid, count(*) AS total FROM lineitem GROUP BY 2),
live AS (SELECT 'gatherer' AS dim, gatherer_id AS key, count(*) FILTER (verdict = 'VALID') AS valid, count(*) AS total FROM captures GROUP BY 2),
store AS (SELECT dim, key, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(total) AS BIGINT) AS total FROM (SELECT * FROM hist UNION ALL SELECT * FROM live) GROUP BY ALL) """


@query("yield_store_merge", STORE + "SELECT dim, key, valid, total, CAST(2 AS BIGINT) AS drives FROM store")
def yield_store_merge(spark, d):
    """Two drives saved one after the other; the store keeps the running sums."""
    store = snapshots.YieldStore(spark, scratch(spark, "yields"))
    store.save(_history_counts(spark, d), "history", "2026-01-01")
    store.save(_live_counts(spark, d), "live", "2026-02-01")
    store.save(_live_counts(spark, d), "live", "2026-02-01")  # a retry changes nothing
    return store.load().withColumn("drives", F.lit(store.drives()))


POSTERIOR = STORE + """, dims AS (SELECT dim, key, valid, total, CAST(0.8 AS DOUBLE) AS p, CAST(8 AS DOUBLE) AS st FROM store UNION ALL
 SELECT 'location', z, count(*) FILTER (verdict = 'VALID'), count(*), CAST(0.8 AS DOUBLE), CAST(8 AS DOUBLE) FROM (SELECT *, regexp_extract(address, '\\b([0-9]{5})\\b\\s*$', 1) AS z FROM captures) WHERE z <> '' GROUP BY 2
 UNION ALL SELECT 'capture', o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT'), count(*), CAST(0.75 AS DOUBLE), CAST(25 AS DOUBLE) FROM orders WHERE o_orderstatus <> 'O' GROUP BY 2
 UNION ALL SELECT 'capture', 'digital', count(*) FILTER (o_orderpriority = '1-URGENT'), count(*), CAST(0.97 AS DOUBLE), CAST(30 AS DOUBLE) FROM orders WHERE o_orderstatus = 'O'),
post AS (SELECT dim, key, total AS n, st AS strength, p AS prior_rate, (p * st + valid) / (st + total) AS rate, CASE WHEN total = 0 THEN 'prior' WHEN total < 2 * st THEN 'blended' ELSE 'observed' END AS source FROM dims) """


def _all_counts(spark, d):
    z = yields.zip_counts(ft.captures(spark, d)).groupBy(F.lit("location").alias("dim"), F.col("zip").alias("key")).agg(
        F.sum("valid").alias("valid"), F.sum("total").alias("total"))
    status = F.when(F.col("o_orderstatus") == "O", "digital").otherwise(F.col("o_orderstatus"))
    cap = ft.read(spark, d, "orders").groupBy(F.lit("capture").alias("dim"), status.alias("key")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("valid"), F.count(F.lit(1)).alias("total"))
    return yields.merge_counts(_history_counts(spark, d), _live_counts(spark, d), z, cap)


@query("yield_posterior", POSTERIOR + "SELECT dim, key, n, strength, prior_rate, round(rate, 6) AS rate, source FROM post")
def yield_posterior(spark, d):
    return yields.yield_posterior(_all_counts(spark, d)).withColumn("rate", F.round("rate", 6))


@query("gatherer_value", POSTERIOR + "SELECT key, CAST(12 AS DOUBLE) * prior_rate AS cold_per_hour, round(12 * rate, 6) AS valid_per_hour, CASE WHEN 12 * rate >= 10 THEN 'route' WHEN 12 * rate >= 7 THEN 'ok' ELSE 'retrain' END AS signal, round(12 * rate * (CAST(4000 AS DOUBLE) / 30), 4) AS value_per_hour FROM post WHERE dim = 'gatherer'")
def gatherer_value(spark, d):
    out = yields.gatherer_value(yields.yield_posterior(_all_counts(spark, d)), 12.0, 4000.0, 30.0)
    return out.withColumn("valid_per_hour", F.round("valid_per_hour", 6)).withColumn("value_per_hour", F.round("value_per_hour", 4))


ZIPC = CAP + ", zc AS (SELECT campaign_id, zip, count(*) FILTER (verdict = 'VALID') AS valid, count(*) AS total FROM (SELECT *, regexp_extract(address, '\\b([0-9]{5})\\b\\s*$', 1) AS zip FROM captures) WHERE zip <> '' GROUP BY 1, 2) "


@query("zip_yield", ZIPC + "SELECT campaign_id, zip, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(total) AS BIGINT) AS total, round((sum(valid) + 7) / CAST(sum(total) + 10 AS DOUBLE), 6) AS rate FROM zc GROUP BY GROUPING SETS ((campaign_id, zip), (campaign_id))")
def zip_yield(spark, d):
    return yields.zip_yield(yields.zip_counts(ft.captures(spark, d))).withColumn("rate", F.round("rate", 6))


@query("shift_impact", CAP + """, shift AS (SELECT campaign_id, gatherer_id, count(*) FILTER (verdict = 'VALID') AS valid, count(*) FILTER (verdict <> 'VALID') AS not_earning, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(captured_at))) / 1000000.0::DOUBLE / 3600 AS hours FROM captures GROUP BY ALL),
pay AS (SELECT DISTINCT 'cmp-' || event_type AS campaign_id, CASE WHEN event_type IN ('click', 'view') THEN 'hourly' WHEN event_type = 'signup' THEN 'volunteer' ELSE 'per-valid-signature' END AS basis, length(event_type) * 2.5::DOUBLE AS rate FROM events)
SELECT campaign_id, gatherer_id, valid, not_earning, round(hours, 4) AS hours, round(CASE WHEN hours > 0.05 THEN valid / hours ELSE 0 END, 6) AS per_hour, round(CASE WHEN basis = 'hourly' THEN hours * rate ELSE valid * rate END, 4) AS earned, greatest(0, 50 - valid) AS to_goal, round(valid / 4000.0::DOUBLE * 100, 6) AS ballot_pct FROM shift JOIN pay USING (campaign_id)""")
def shift_impact(spark, d):
    kind = F.col("event_type")
    pay = ft.read(spark, d, "events").select("event_type").distinct().select(
        F.concat(F.lit("cmp-"), kind).alias("campaign_id"),
        F.when(kind.isin("click", "view"), "hourly").when(kind == "signup", "volunteer").otherwise("per-valid-signature").alias("basis"),
        (F.length(kind) * 2.5).alias("rate"), F.lit(50).alias("shift_target"), F.lit(4000.0).alias("statewide_required"))
    c = ft.captures(spark, d).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    out = yields.shift_impact(c, pay, F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    for name, digits in (("hours", 4), ("per_hour", 6), ("earned", 4), ("ballot_pct", 6)):
        out = out.withColumn(name, F.round(name, digits))
    return out


@query("pace_risk", CAP + """, daily AS (SELECT campaign_id, CAST(captured_at AS DATE) AS day, count(*) FILTER (verdict = 'VALID') AS valid FROM captures GROUP BY ALL),
paced AS (SELECT *, sum(valid) OVER (PARTITION BY campaign_id ORDER BY day) AS collected, sum(valid) OVER (PARTITION BY campaign_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) / 7.0::DOUBLE AS actual FROM daily),
need AS (SELECT *, greatest(0, 1000 - collected) / CAST(greatest(1, DATE '2024-02-15' - day) AS DOUBLE) AS required FROM paced)
SELECT campaign_id, day, CAST(collected AS BIGINT) AS collected, round(required, 6) AS required_rate, round(actual, 6) AS actual_rate, round(CASE WHEN collected >= 1000 THEN 0 ELSE required / greatest(actual, 0.000001::DOUBLE) END, 6) AS risk FROM need""")
def pace_risk(spark, d):
    daily = ft.captures(spark, d).groupBy("campaign_id", F.to_date("captured_at").alias("day")).agg(F.count_if(F.col("verdict") == "VALID").alias("valid"))
    goals = daily.select("campaign_id").distinct().select("campaign_id", F.lit(1000).alias("goal"), F.to_date(F.lit("2024-02-15")).alias("deadline"))
    out = yields.pace_risk(daily, goals)
    for name in ("required_rate", "actual_rate", "risk"):
        out = out.withColumn(name, F.round(name, 6))
    return out
