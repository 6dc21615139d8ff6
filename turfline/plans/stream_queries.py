"""Queries that run a stream over the event table to its end and return what it wrote.

Each check query is the plain batch definition, so a match means stream == batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from turfline.plans.field_queries import CAP, STATUS, ZIPC, _history_counts
from turfline.plans.registry import query
from turfline.session import scratch, stage
from turfline.sources import field_tables as ft
from turfline.operators import sync
from turfline.streaming import captures as SC
from turfline.streaming import index_sync


ARRIVALS, ROWS_PER_FILE = 4, 250_000
#: Files of one micro-batch where the order of arrival does not matter, so that a task's groups do not grow with an arrival.
FILES_AT_ONCE = 12


def _arrivals(spark, d):
    """The events by the arrival that brings them: quarters of the time, events without one in the first."""
    events = ft.read(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    total, cuts = events.agg(F.count("*"), F.percentile_approx(at, [i / ARRIVALS for i in range(1, ARRIVALS)])).first()
    arrival = F.lit(0)
    for cut in cuts or []:
        arrival = arrival + F.coalesce(at > cut, F.lit(False)).cast("int")
    files = max(1, -(-total // (ARRIVALS * ROWS_PER_FILE)))
    dealt = events.withColumn("_arrival", arrival).repartition(ARRIVALS * files, "_arrival", F.pmod(F.xxhash64("event_id"), F.lit(files)))
    path = scratch(spark, "arrivals")
    dealt.write.partitionBy("_arrival").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)  # one pass over the events, several files for each arrival
    return spark.read.schema(dealt.schema).parquet(path)


def _deliver(spark, d, start, files_at_once=None):
    """Let the events arrive one quarter after the other; ``start(events)`` runs the stream over what is new, from its checkpoint.

    A quarter is one micro-batch, or with ``files_at_once`` as many as its files take.
    """
    arrivals, inbox = _arrivals(spark, d), scratch(spark, "inbox")
    events = arrivals.drop("_arrival")
    for i in range(ARRIVALS):
        arrivals.where(F.col("_arrival") == i).drop("_arrival").write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(inbox)  # reads that arrival's files only
        source = spark.readStream.schema(events.schema)
        start((source.option("maxFilesPerTrigger", files_at_once) if files_at_once else source).parquet(inbox)).awaitTermination()


def _captures(spark, d, start, files_at_once=None):
    _deliver(spark, d, lambda events: start(ft.capture_columns(events)), files_at_once)


@query("stream_capture_dedup", STATUS + "SELECT campaign_id, seq, status FROM statuses")
def stream_capture_dedup(spark, d):
    out, log = scratch(spark, "statuses"), scratch(spark, "log")
    _captures(spark, d, lambda sent: SC.start_dedup(sent, out, log))
    return spark.read.parquet(out).select("campaign_id", "seq", "status")


@query("stream_zip_yield", ZIPC + "SELECT campaign_id, zip, valid, total FROM zc")
def stream_zip_yield(spark, d):
    out, log = scratch(spark, "yield"), scratch(spark, "log")
    _captures(spark, d, lambda sent: SC.start_zip_counts(sent, out, log))
    schema = "campaign_id string, zip string, valid long, total long"
    return SC.latest(spark, out, spark.createDataFrame([], schema).schema, ["campaign_id", "zip"])


@query("stream_movement", STATUS + "SELECT campaign_id, count(*) AS accepted FROM statuses WHERE status = 'accepted' GROUP BY 1")
def stream_movement(spark, d):
    out, log = scratch(spark, "movement"), scratch(spark, "log")
    _captures(spark, d, lambda sent: SC.start_movement(sent, out, log))
    parts = spark.read.schema("campaign_id string, accepted long, batch long").parquet(out)
    return parts.groupBy("campaign_id").agg(F.sum("accepted").alias("accepted"))


@query("stream_posterior", CAP + """, c AS (SELECT 'g' || l_suppkey AS key, count(*) FILTER (l_returnflag <> 'R') AS valid, count(*) AS total FROM lineitem GROUP BY 1
 UNION ALL SELECT gatherer_id, count(*) FILTER (verdict = 'VALID'), count(*) FROM captures GROUP BY 1)
SELECT key, CAST(sum(total) AS BIGINT) AS n, round((0.8::DOUBLE * 8 + sum(valid)) / (8 + sum(total)), 6) AS rate FROM c GROUP BY 1""")
def stream_posterior(spark, d):
    out, log, history = scratch(spark, "posterior"), scratch(spark, "log"), stage(_history_counts(spark, d), "history")
    _captures(spark, d, lambda sent: SC.start_posterior(sent, history, out, log))
    schema = "dim string, key string, n long, strength double, prior_rate double, rate double, source string"
    latest = SC.latest(spark, out, spark.createDataFrame([], schema).schema, ["dim", "key"])
    return latest.select("key", "n", F.round("rate", 6).alias("rate"))


VELOCITY = CAP + """, w AS (SELECT gatherer_id, epoch_us(captured_at) // 900000000 - unnest([0, 1, 2, 3]) AS slot FROM captures)
SELECT gatherer_id, slot * 900 AS started, count(*) AS captures FROM w GROUP BY ALL"""


@query("capture_velocity", VELOCITY)
def capture_velocity(spark, d):
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return SC.capture_velocity(ft.captures(spark, d)).select(
        "gatherer_id", F.timestamp_diff("SECOND", epoch, F.col("window.start")).alias("started"), "captures")


@query("stream_velocity", VELOCITY)
def stream_velocity(spark, d):
    """The same windows from a stream without a watermark, which never drops a capture, however late."""
    out, log = scratch(spark, "velocity"), scratch(spark, "log")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, "captured_at"))
    _captures(spark, d, lambda sent: SC.start_velocity(sent.withColumn("captured_at", at), out, log), FILES_AT_ONCE)
    rows = SC.latest(spark, out, spark.createDataFrame([], "gatherer_id string, started timestamp, captures long").schema, ["gatherer_id", "started"])
    return rows.select("gatherer_id", F.unix_seconds("started").alias("started"), "captures")


LIMITED = """WITH RECURSIVE calls AS (SELECT 'g' || user_id AS token, ts AS called_at, event_id AS call_id, epoch_us(ts) / 1e6::DOUBLE AS at,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
run AS (SELECT token, 0::BIGINT AS rn, NULL::DOUBLE AS older, NULL::DOUBLE AS newer, false AS allowed FROM calls WHERE rn = 1
 UNION ALL SELECT c.token, c.rn, CASE WHEN ok THEN r.newer ELSE r.older END, CASE WHEN ok THEN c.at ELSE r.newer END, ok
 FROM run r JOIN calls c ON c.token = r.token AND c.rn = r.rn + 1, LATERAL (SELECT coalesce(c.at - r.older >= 7200, true) AS ok))
SELECT token, called_at, call_id, allowed FROM run JOIN calls USING (token, rn)"""


@query("stream_call_limit", LIMITED)
def stream_call_limit(spark, d):
    """At most two passed calls per gatherer in two hours."""
    out, log = scratch(spark, "limited"), scratch(spark, "log")
    call = (F.concat(F.lit("g"), "user_id").alias("token"), F.col("ts").cast("timestamp").alias("called_at"), F.col("event_id").alias("call_id"))
    _deliver(spark, d, lambda events: SC.start_limiter(events.select(*call), out, log, seconds=7200.0, limit=2))
    return spark.read.schema(SC._LIMITED).parquet(out)


@query("capture_once", CAP + "SELECT campaign_id, gatherer_id, seq FROM captures")
def capture_once(spark, d):
    """Every capture delivered once or twice, as a stream; each is taken once."""
    out, log = scratch(spark, "once"), scratch(spark, "log")

    def start(sent):
        again = sent.unionByName(sent.where("seq % 5 = 0"))
        return SC.once(again).writeStream.option("checkpointLocation", log).trigger(availableNow=True).format("parquet").start(out)
    _captures(spark, d, start)
    return spark.read.schema("campaign_id string, gatherer_id string, seq long").parquet(out)


def _pushes(spark, d):
    """Captures and acknowledgements by push; a push fails for the gatherers whose turn it is, and is repeated with the next one."""
    c = sync.capture_status(ft.captures(spark, d)).select("campaign_id", "gatherer_id", "seq", "status", (F.col("seq") % ARRIVALS).alias("_arrival"))
    fails = F.substring("gatherer_id", 2, 20).cast("long") % ARRIVALS == F.col("_arrival")
    again = F.when(fails, F.col("_arrival") + 1).otherwise(F.col("_arrival"))
    acks = c.withColumn("_arrival", F.explode(F.array(again, again + 1)))  # every answer comes twice
    return stage(c, "captured"), stage(acks, "acknowledged")


@query("stream_queue", STATUS + f"""SELECT campaign_id, gatherer_id, seq, CASE WHEN late THEN 'pending' ELSE 'synced' END AS sync, CASE WHEN NOT late AND status = 'duplicate' THEN 'server: duplicate' END AS server_note
 FROM (SELECT *, seq % {ARRIVALS} = {ARRIVALS - 1} AND CAST(substr(gatherer_id, 2) AS BIGINT) % {ARRIVALS} = {ARRIVALS - 1} AS late FROM statuses)""")
def stream_queue(spark, d):
    """Captures and acknowledgements as two streams; the last failed push is not repeated and its rows stay pending."""
    parts = dict(zip(("captured", "acknowledged"), _pushes(spark, d)))
    inbox = {name: scratch(spark, name) for name in parts}
    out, log = scratch(spark, "queue"), scratch(spark, "log")
    for i in range(ARRIVALS):
        for name, rows in parts.items():
            rows.where(F.col("_arrival") == i).drop("_arrival").write.mode("append").parquet(inbox[name])
        sent, known = (spark.readStream.schema(rows.drop("_arrival").schema).parquet(inbox[name]) for name, rows in parts.items())
        SC.start_queue(sent, known, out, log).awaitTermination()
    return SC.queue(spark, out)


@query("stream_capture_log", CAP + "SELECT gatherer_id, seq, row_number() OVER (PARTITION BY gatherer_id ORDER BY seq DESC) AS back, max(seq) OVER (PARTITION BY gatherer_id) AS last_seq FROM captures")
def stream_capture_log(spark, d):
    """Captures appended to the log by a stream and read back as each device shows them."""
    out, log = scratch(spark, "captured"), scratch(spark, "log")
    _captures(spark, d, lambda sent: sent.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out))
    return sync.hydrate(spark.read.schema("gatherer_id string, seq long").parquet(out), ["gatherer_id"]).select("gatherer_id", "seq", "back", "last_seq")


CHANGES = """WITH changes AS (SELECT 't' || o_custkey % 97 AS tile, o_custkey AS id, o_orderstatus, o_orderdate, o_orderkey, o_orderpriority, o_orderkey % 4 AS arrival FROM orders)"""


def _synced(spark, d):
    """Every order is a change of its customer's record, which a pending one removes; the changes arrive out of their order."""
    o = ft.read(spark, d, "orders")
    changes = stage(o.select(
        F.concat(F.lit("t"), F.col("o_custkey") % 97).alias("tile"), F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "remove").otherwise("upsert").alias("op"),
        F.col("o_orderdate").alias("changed_at"), F.col("o_orderkey").alias("change_no"), F.col("o_orderpriority").alias("address"),
        (F.col("o_orderkey") % ARRIVALS).alias("_arrival")), "changes")
    inbox, out, log = (scratch(spark, name) for name in ("inbox", "index", "log"))
    for i in range(ARRIVALS):
        changes.where(F.col("_arrival") == i).drop("_arrival").write.mode("append").parquet(inbox)
        index_sync.start_index_sync(spark.readStream.schema(changes.drop("_arrival").schema).parquet(inbox), out, log).awaitTermination()
    return out


@query("stream_index_sync", CHANGES + f""", newest AS (SELECT v, tile, id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS address
 FROM changes JOIN (SELECT unnest(range({ARRIVALS})) AS v) ON arrival <= v GROUP BY ALL) SELECT v AS version, tile, id, address FROM newest WHERE status <> 'P'""")
def stream_index_sync(spark, d):
    """The index after each of the arrivals."""
    path, out = _synced(spark, d), None
    for version in range(ARRIVALS):
        part = index_sync.index_at(spark, path, version).select(F.lit(version).cast("long").alias("version"), "tile", "id", "address")
        out = part if out is None else out.unionByName(part)
    return out


@query("index_pull", CHANGES + f""", newest AS (SELECT tile, id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(arrival, (o_orderdate, o_orderkey)) AS arrival, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS address FROM changes GROUP BY ALL),
pointers AS (SELECT tile, max(arrival) AS version FROM changes GROUP BY 1), devices AS (SELECT 'd' || v AS device_id, tile, version AS current, CASE WHEN v >= 0 THEN v END AS version FROM pointers, (SELECT unnest(range(-1, {ARRIVALS})) AS v))
SELECT device_id, d.tile, current AS version, CASE WHEN status = 'P' THEN 'remove' ELSE 'upsert' END AS op, id, address FROM devices d JOIN newest n ON n.tile = d.tile
 WHERE CASE WHEN d.version IS NULL THEN status <> 'P' ELSE d.version < current AND arrival > d.version END""")
def index_pull(spark, d):
    """One device at each version of every tile, and one without any."""
    path = _synced(spark, d)
    version = F.explode(F.sequence(F.lit(-1), F.lit(ARRIVALS - 1)))
    held = index_sync.pointers(spark, path).select("tile", version.alias("v")).select(
        F.concat(F.lit("d"), "v").alias("device_id"), "tile", F.when(F.col("v") >= 0, F.col("v").cast("long")).alias("version"))
    return index_sync.pull(spark, path, held)
