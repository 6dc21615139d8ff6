"""Capture streams: dedup with status, running yields and movement, call limiting, velocity windows.

Arrival order between micro-batches defines who signed first; inside a micro-batch it is
(captured_at, seq).  Late captures are always accepted: nothing here drops rows by watermark, unless a watermark is
asked for (``late`` of the velocity windows).
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turfline import fixed
from turfline.operators.sync import capture_status
from turfline.operators.yields import merge_counts, yield_posterior, zip_counts
from turfline.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])
_LIMIT = fixed.CALLS_PER_MINUTE

CAPTURE_BATCH = T.StructType([
    T.StructField("campaignId", T.StringType()), T.StructField("gathererId", T.StringType()),
    T.StructField("captures", T.ArrayType(T.StructType([
        T.StructField("seq", T.LongType()), T.StructField("name", T.StringType()), T.StructField("address", T.StringType()),
        T.StructField("verdict", T.StringType()), T.StructField("matchedVoterId", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("capturedAt", T.LongType())]))),
])


def flatten_batches(batches: DataFrame) -> DataFrame:
    """One row per capture from posted batches (works on batch and stream alike)."""
    flat = batches.select(
        F.col("campaignId").alias("campaign_id"), F.col("gathererId").alias("gatherer_id"), F.explode("captures").alias("c"))
    return flat.select(
        "campaign_id", "gatherer_id", "c.seq", "c.name", "c.address", "c.verdict",
        F.col("c.matchedVoterId").alias("matched_voter_id"), "c.score",
        F.timestamp_millis("c.capturedAt").alias("captured_at"))


def read_capture_batches(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Posted JSON batches as a stream; a message queue source has the same schema."""
    raw = spark.readStream.schema(CAPTURE_BATCH).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return flatten_batches(raw)


def once(retries: DataFrame) -> DataFrame:
    """Idempotent option: the first delivery of (campaign, gatherer, seq) only."""
    return retries.dropDuplicates(["campaign_id", "gatherer_id", "seq"])


#: State store of the running queries: on local disk with change logs in the checkpoint, so state may exceed memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _stateful(start: Callable[..., StreamingQuery]) -> Callable[..., StreamingQuery]:
    """Start a query with its state on disk, unless the session names a store itself; the session's own setting stays as it was."""
    @functools.wraps(start)
    def started(stream: DataFrame, *args, **kwargs) -> StreamingQuery:
        conf = stream.sparkSession.conf
        if _STORE in conf.getAll:
            return start(stream, *args, **kwargs)
        conf.set(_STORE, STATE_STORE)
        try:
            return start(stream, *args, **kwargs)  # the query keeps the setting that it was started with
        finally:
            conf.unset(_STORE)
    return started


@_stateful
def start_dedup(captures: DataFrame, statuses: str, checkpoint: str) -> StreamingQuery:
    """Cross-volunteer dedup: writes one status row per capture.

    Streaming deduplication lets the key of a voter pass in the one micro-batch that first claims it; the batch's captures
    travel beside these keys.  So a batch is judged by itself plus its new keys: the state is looked up by key and the
    cost does not grow with the history.  A batch's folder is replaced when it is replayed, which makes the result exactly-once.
    """
    key = ["campaign_id", "matched_voter_id"]
    fresh = captures.where("verdict = 'VALID' AND matched_voter_id IS NOT NULL").select(*key).dropDuplicates(key)
    arrivals = captures.withColumn("_fresh", F.lit(None).cast("boolean")).unionByName(
        fresh.withColumn("_fresh", F.lit(True)), allowMissingColumns=True)

    def judge(batch: DataFrame, batch_id: int) -> None:
        arrived = stage(batch, "arrivals")  # the state is read once
        judged = capture_status(arrived.where("_fresh IS NULL").drop("_fresh")).join(
            arrived.where("_fresh").select(*key, "_fresh"), key, "left")
        status = F.when((F.col("status") == "accepted") & F.col("_fresh").isNull(), "duplicate").otherwise(F.col("status"))
        judged.withColumn("status", status).drop("_fresh").write.mode("overwrite").parquet(f"{statuses}/batch={batch_id}")

    return (
        arrivals.writeStream.outputMode("append").foreachBatch(judge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _changes(path: str):
    """Sink for update-mode aggregates: each batch writes the rows that it changed under a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest row of every key that an update-mode sink wrote."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [f.name for f in schema.fields if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*[F.col(f"_r.{n}").alias(n) if n in rest else F.col(n) for n in schema.names])


@_stateful
def start_zip_counts(captures: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running (campaign, zip) counts; a micro-batch writes the ZIPs that it changed."""
    return (
        zip_counts(captures).writeStream.outputMode("update").foreachBatch(_changes(path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


@_stateful
def start_queue(captures: DataFrame, acknowledged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Device queues as a stream: a capture is pending until an acknowledgement of it arrives, before or after the capture itself.

    Both streams (campaign_id, gatherer_id, seq; acknowledgements also status) are joined by keyed state, so nothing is ever too late.  A failed push
    acknowledges nothing and its rows stay pending; a push that is repeated acknowledges again and changes nothing.  An
    acknowledgement without its capture is kept and not shown.  ``queue`` reads the result.
    """
    key = ["campaign_id", "gatherer_id", "seq"]
    both = captures.select(*key, F.lit(True).alias("captured"), F.lit(None).cast("string").alias("status")).unionByName(
        acknowledged.select(*key, F.lit(False).alias("captured"), F.coalesce("status", F.lit("recorded")).alias("status")))
    state = both.groupBy(*key).agg(F.max("captured").alias("captured"), F.min("status").alias("status"))
    return (
        state.writeStream.outputMode("update").foreachBatch(_changes(path)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def queue(spark: SparkSession, path: str) -> DataFrame:
    """(campaign_id, gatherer_id, seq, sync, server_note) as ``start_queue`` has written it."""
    schema = spark.createDataFrame([], "campaign_id string, gatherer_id string, seq long, captured boolean, status string").schema
    rows = latest(spark, path, schema, ["campaign_id", "gatherer_id", "seq"]).where("captured")
    return rows.select("campaign_id", "gatherer_id", "seq", F.when(F.col("status").isNull(), "pending").otherwise("synced").alias("sync"),
                       F.when(F.col("status") == "duplicate", "server: duplicate").alias("server_note"))


@_stateful
def start_posterior(captures: DataFrame, history: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running posterior per gatherer: stream counts added to the stored history.

    The history's own posterior is the state before the first micro-batch (batch -1); from there a micro-batch writes
    the gatherers that it changed.
    """
    history = stage(merge_counts(history), "history")
    yield_posterior(history).write.mode("overwrite").parquet(f"{path}/batch=-1")
    counts = captures.groupBy(F.lit("gatherer").alias("dim"), F.col("gatherer_id").alias("key")).agg(
        F.count_if(F.col("verdict") == "VALID").alias("valid"), F.count(F.lit(1)).alias("total"))

    def write(batch: DataFrame, batch_id: int) -> None:
        known = history.join(batch.select("dim", "key"), ["dim", "key"], "left_semi")
        yield_posterior(merge_counts(known, batch)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


@_stateful
def start_movement(captures: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running count of accepted signatures: streaming deduplication on (campaign, voter), then a count."""
    accepted = captures.where("verdict = 'VALID' and matched_voter_id is not null").dropDuplicates(
        ["campaign_id", "matched_voter_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("accepted")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}")

    return (
        accepted.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def capture_velocity(captures: DataFrame, width: str = "60 minutes", slide: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Sliding-window captures per gatherer, for impossible velocities (batch or stream).

    A capture counts however late it arrives.  With ``late``, a stream forgets windows that are so much older than the newest capture, and
    leaves out captures that come for them.
    """
    source = captures.withWatermark("captured_at", late) if late and captures.isStreaming else captures
    return source.groupBy("gatherer_id", F.window("captured_at", width, slide)).agg(F.count(F.lit(1)).alias("captures"))


@_stateful
def start_velocity(captures: DataFrame, path: str, checkpoint: str, width: str = "60 minutes", slide: str = "15 minutes",
                   late: str | None = None) -> StreamingQuery:
    """Running velocity windows; a micro-batch writes the windows that it changed."""
    windows = capture_velocity(captures, width, slide, late).select("gatherer_id", F.col("window.start").alias("started"), "captures")
    return (
        windows.writeStream.outputMode("update").foreachBatch(_changes(path)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


_LIMITED = "token string, called_at timestamp, call_id long, allowed boolean"


def limit_calls(calls: DataFrame, seconds: float = 60.0, limit: int = _LIMIT, forget_ms: int | None = None) -> DataFrame:
    """Exact limiter: a call passes while fewer than ``limit`` passed calls lie in the trailing interval.

    The decision depends on earlier decisions, so it keeps the passed times of the last interval per token
    as state (at most ``limit`` numbers).  ``calls``: token, called_at, call_id.  With ``forget_ms`` a token without calls
    for so long on the clock is forgotten; for live calls that is exact from the interval's length on, for replays leave it out.
    """
    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat([p for p in parts if len(p)]).sort_values(["called_at", "call_id"])
        allowed = []
        for at in (rows["called_at"] - pd.Timestamp(0)).dt.total_seconds():
            passed = [p for p in passed if at - p < seconds]
            allowed.append(len(passed) < limit)
            if allowed[-1]:
                passed.append(at)
        state.update((passed,))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({
            "token": key[0], "called_at": rows["called_at"], "call_id": rows["call_id"], "allowed": allowed})

    return calls.groupBy("token").applyInPandasWithState(
        decide, _LIMITED, "passed array<double>", "append",
        GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


@_stateful
def start_limiter(calls: DataFrame, path: str, checkpoint: str, seconds: float = 60.0, limit: int = _LIMIT,
                  forget_ms: int | None = None) -> StreamingQuery:
    return (
        limit_calls(calls, seconds, limit, forget_ms).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start_roll_ingest(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append canonical roll rows from a streaming scan."""
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
