from __future__ import annotations

import random

import pandas as pd
import pytest
from people_fixture import ROLL, roll
from pyspark.sql import functions as F

from turfline.operators import artifacts, routing, rulebook, sync, validity, yields
from turfline.operators.suggest import suggest_voters
from turfline.session import scratch
from turfline.sources.snapshots import SnapshotStore, YieldStore
from turfline.streaming import captures as SC

CAPTURES = ("campaign_id string, gatherer_id string, seq long, name string, address string, verdict string, matched_voter_id string, "
            "score double, captured_at timestamp")


def _captures(spark, rows):
    at = pd.Timestamp("2026-05-01")
    return spark.createDataFrame(
        [(c, "g", s, "n", a, v, m, 1.0, (at + pd.Timedelta(minutes=i)).to_pydatetime()) for i, (c, s, v, m, a) in enumerate(rows)], CAPTURES)


BATCH = [
    ("c1", 1, "VALID", "V1", "1 A St, T 28202"), ("c1", 2, "VALID", "V1", "2 A St, T 28202"), ("c2", 1, "VALID", "V1", "3 A St, T 28202"),
    ("c1", 3, "NEEDS_REVIEW", "V2", "4 A St, T 28203"), ("c1", 4, "VALID", "V2", "5 A St, T 28203"), ("c1", 5, "VALID", None, "6 A St, T"),
]


def test_capture_statuses_and_yield(spark):
    df = _captures(spark, BATCH)
    got = {(r["campaign_id"], r["seq"]): r["status"] for r in sync.capture_status(df).collect()}
    assert [got[(c, s)] for c, s, *_ in BATCH] == ["accepted", "duplicate", "accepted", "recorded", "accepted", "recorded"]
    rate = {(r["campaign_id"], r["zip"]): r["rate"] for r in yields.zip_yield(yields.zip_counts(df)).collect()}
    assert rate[("c1", "28202")] == 0.75 and rate[("c1", "28203")] == pytest.approx(8 / 12)


def test_stream_dedup_equals_sequential_replay(spark):
    """Many small micro-batches: the first arrival wins, whatever the boundaries."""
    rng = random.Random(3)
    rows = [("c%d" % rng.randrange(2), i, rng.choice(["VALID", "VALID", "INVALID"]), rng.choice(["V1", "V2", "V3", None]), "x") for i in range(60)]
    folder = scratch(spark, "feed")
    for i in range(0, 60, 10):
        _captures(spark, rows).where((F.col("seq") >= i) & (F.col("seq") < i + 10)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", 1).parquet(folder)
    out, log = scratch(spark, "out"), scratch(spark, "log")
    SC.start_dedup(stream, out, log).awaitTermination()
    got = {r["seq"]: r["status"] for r in spark.read.parquet(out).collect()}
    seen, want = set(), {}
    for c, s, v, m, _ in rows:
        if v == "VALID" and m:
            want[s] = "duplicate" if (c, m) in seen else "accepted"
            seen.add((c, m))
        else:
            want[s] = "recorded"
    assert got == want
    moved = scratch(spark, "moved")
    SC.start_movement(spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", 1).parquet(folder), moved, scratch(spark, "log")).awaitTermination()
    assert spark.read.parquet(moved).agg(F.sum("accepted")).first()[0] == sum(v == "accepted" for v in want.values())
    _captures(spark, [("c0", 100, "VALID", "V1", "x"), ("c0", 101, "VALID", "V9", "x")]).write.mode("append").parquet(folder)
    SC.start_dedup(spark.readStream.schema(CAPTURES).parquet(folder), out, log).awaitTermination()
    late = {r["seq"]: r["status"] for r in spark.read.parquet(out).where("seq >= 100").collect()}
    assert late == {100: "duplicate", 101: "accepted"}


def test_limiter_equals_replay_and_skips_rejected_calls(spark):
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 400) for _ in range(80))
    at = pd.Timestamp("2026-01-01")
    rows = [("t%d" % (i % 2), (at + pd.Timedelta(seconds=t)).to_pydatetime(), i) for i, t in enumerate(times)]
    folder = scratch(spark, "calls")
    schema = "token string, called_at timestamp, call_id long"
    for i in range(0, 80, 20):
        spark.createDataFrame(rows[i:i + 20], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = scratch(spark, "limited")
    SC.start_limiter(stream, out, scratch(spark, "log"), seconds=60.0, limit=3).awaitTermination()
    got = {r["call_id"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    passed: dict[str, list] = {}
    for token, when, i in rows:
        recent = [p for p in passed.get(token, []) if (when - p).total_seconds() < 60]
        assert got[i] == (len(recent) < 3)
        passed[token] = recent + [when] if got[i] else recent


def test_snapshots(spark):
    a = roll(spark)
    b = a.where("id <> 'R12'").withColumn("address", F.when(F.col("id") == "R11", "new").otherwise(F.col("address")))
    diff = sync.snapshot_diff(a, b)
    assert sorted((r["op"], r["id"]) for r in diff.collect()) == [("remove", "R12"), ("upsert", "R11")]
    assert sorted(sync.delta_apply(a, diff).collect()) == sorted(b.select(*artifacts.RECORD).collect())
    store = SnapshotStore(spark, scratch(spark, "store"))
    store.put("c", "v1", "2026-01-01", a)
    store.put("c", "v2", "2026-01-02", b)
    assert store.current("c").count() == 9 and store.version("c", "v1").count() == 10
    ask = spark.createDataFrame([("d1", "c", "v2"), ("d2", "c", "v1"), ("d3", "c", "zzz")], "device_id string, campaign_id string, since string")
    modes = {r["device_id"]: r["mode"] for r in sync.sync_mode(ask, store.pointers()).collect()}
    assert modes == {"d1": "current", "d2": "delta", "d3": "snapshot"}


def test_yield_store_compounds(spark):
    store = YieldStore(spark, scratch(spark, "yields"))
    schema = "dim string, key string, valid long, total long"
    want = [(0, 0, 0.8, "prior"), (4, 10, 0.5778, "blended"), (11, 30, 0.4579, "observed"), (36, 100, 0.3926, "observed"), (89, 250, 0.3698, "observed")]
    before = (0, 0)
    for valid, total, rate, source in want:
        store.save(spark.createDataFrame([("gatherer", "Cara", valid - before[0], total - before[1])], schema), f"d{total}", "2026-01-01")
        store.save(spark.createDataFrame([("gatherer", "Cara", valid - before[0], total - before[1])], schema), f"d{total}", "2026-01-02")
        before = (valid, total)
        row = yields.yield_posterior(store.load()).first()
        assert round(row["rate"], 4) == rate and row["source"] == source
    assert store.drives() == 5


def test_tiles_split_into_bands(spark):
    rows = spark.range(9001).select(
        F.col("id").alias("row_pos"), F.concat(F.lit("V"), "id").alias("id"), F.concat(F.lit("Ann Lee"), "id").alias("name"),
        F.concat(F.col("id") % 500, F.lit(" Oak St, Troy 43001")).alias("address"), F.lit("active").alias("status"), F.lit("").alias("registered_on"),
        F.lit("Essex").alias("county"), F.lit("1").alias("district"), F.lit("").alias("tile_cell"))
    tiles = artifacts.tile_bands(artifacts.tile_rows(rows))
    sizes = {r["tile"]: r["count"] for r in tiles.groupBy("tile").count().collect()}
    assert sizes == {"essex__nocell__b0": 4000, "essex__nocell__b1": 4000, "essex__nocell__b2": 1001}
    order = [r["h"] for r in tiles.orderBy("position").select("h").collect()]
    assert [int(h) for h in order] == sorted(int(h) for h in order)
    exact = artifacts.tile_bands(artifacts.tile_rows(rows.where("row_pos < 4000")))
    assert exact.select("tile").distinct().first()[0] == "essex__nocell"


def test_membership_has_no_false_negatives_and_merges(spark):
    people = artifacts.member_keys(roll(spark))
    bits, hashes = artifacts.filter_size(10)
    assert artifacts.filter_size(8_000_000) == (76680468, 7)
    parts = [artifacts.membership_filter(people.where(w), bits, hashes) for w in ("row_pos < 6", "row_pos >= 6")]
    merged = artifacts.merge_filters(*parts)
    probes = artifacts.probe_filter(people, merged, bits, hashes, "id")
    assert probes.where("maybe_member").count() == 10
    whole = artifacts.membership_filter(people, bits, hashes)
    assert sorted(r["bits"] for r in whole.collect()) == sorted(r["bits"] for r in merged.collect())


def test_suggestions(spark):
    asked = spark.createDataFrame([(1, "sam okafor juniper"), (2, "310 juniper"), (3, "st"), (4, "samuel 310"), (5, "310")], "query_id long, query string")
    got: dict[int, list] = {}
    for r in suggest_voters(asked, roll(spark)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got[1][0] == "R10" and got[2] == ["R10"] and got[4][0] == "R10" and 3 not in got and 5 not in got


def _day(gatherers, pace, hours):
    free, out = sorted(gatherers), {}
    for state in sorted(pace, key=lambda s: (-pace[s], s)):
        need = pace[state]
        for g in sorted(free, key=lambda g: (-gatherers[g][state], g)):
            if need <= 0:
                break
            out[g] = state
            need -= hours * gatherers[g][state]
        free = [g for g in free if g not in out]
    hottest = min(pace, key=lambda s: (-pace[s], s))
    return {**out, **{g: hottest for g in free}}


def test_day_assignment(spark):
    rng = random.Random(1)
    rows, states, want = [], [], {}
    for day in ("d1", "d2"):
        value = {f"g{i}": {s: (rng.randrange(5, 20), rng.random()) for s in "ABC"} for i in range(6)}
        pace = {s: rng.randrange(20, 300) for s in "ABC"}
        rows += [(day, g, s, float(raw), rate) for g, per in value.items() for s, (raw, rate) in per.items()]
        states += [(day, s, float(p)) for s, p in pace.items()]
        want |= {(day, g): s for g, s in _day({g: {s: r * q for s, (r, q) in per.items()} for g, per in value.items()}, pace, 8.0).items()}
    got = routing.assign_day(
        spark.createDataFrame(rows, "drive_day string, gatherer string, state string, raw double, rate double"),
        spark.createDataFrame(states, "drive_day string, state string, pace double"))
    assert {(r["drive_day"], r["gatherer"]): r["state"] for r in got.collect()} == want


def test_published_cost_cells(spark):
    needs = spark.createDataFrame([("all", 1008312)], "scope string, required long")
    cost = {(r["stack"], r["price"]): r["cost"] for r in routing.cost_scenarios(needs).collect()}
    assert round(cost[("mid", 7.0)]) == 2024817 and round(cost[("aggressive", 3.0)]) == 338793 and round(cost[("conservative", 12.0)]) == 6623400
    share = {r["price"]: r["volunteer_share"] for r in routing.breakeven_volunteers(needs, 1_000_000).collect()}
    assert [round(share[p], 2) for p in (3.0, 7.0, 12.0)] == [0.38, 0.68, 0.77]


def test_ladder(spark):
    local = spark.createDataFrame([("a", "VALID", "MATCH", "V1"), ("b", "INVALID", "NO_MATCH", None), ("c", "INVALID", "NO_MATCH", None), ("d", "INVALID", "NO_MATCH", None)],
                                  "id string, verdict string, band string, matched_voter_id string")
    full = spark.createDataFrame([("b", "VALID", 1.0, "V2"), ("c", "INVALID", 0.0, None)], "id string, verdict string, score double, matched_voter_id string")
    members = spark.createDataFrame([("c",)], "id string")
    got = {r["id"]: (r["tier"], r["verdict"], r["voter_id"]) for r in sync.validation_ladder(local, full, members).collect()}
    assert got == {"a": ("turf", "VALID", "V1"), "b": ("full_roll", "VALID", "V2"), "c": ("membership", "APPEARS_REGISTERED", None), "d": ("none", "INVALID", None)}


def test_shards_keep_leading_zeros_and_versions_ignore_the_roll_order(spark):
    rows = [(i, f"V{i}", f"Ann Lee{i}", f"{i} Elm St, Town {z}", "active", None, None, None) for i, z in enumerate(["07104", "02139", "02139", "62701", ""])]
    shards = artifacts.shard_rows(spark.createDataFrame(rows, ROLL).withColumn("address", F.trim("address")))
    path = scratch(spark, "shards")
    artifacts.write_shards(shards, path, rows_per_file=1)
    back = artifacts.read_shards(spark, path, shards.schema)
    assert sorted(r["id"] for r in back.where("zip5 = '02139'").collect()) == ["V1", "V2"]
    assert {r["zip5"] for r in back.where("zip5 <> '' and zip5 is not null").collect()} == {"07104", "02139", "62701"}
    moved = shards.withColumn("row_pos", F.col("row_pos") + 1)
    assert sorted(artifacts.shard_manifest(shards).collect()) == sorted(artifacts.shard_manifest(moved).collect())


def test_reconcile_is_per_campaign(spark):
    lines = [(i, c, "g", i, "Sam Okafor", "310 Juniper Way, Millbrook 30110", "VALID") for i, c in enumerate(["c1", "c2", "c1"])]
    captured = spark.createDataFrame(lines, "row_pos long, campaign_id string, gatherer_id string, seq int, name string, address string, verdict string")
    got = {r["seq"]: r["verdict"] for r in validity.reconcile(captured, roll(spark), validity.StateContext("Ohio")).collect()}
    assert got == {0: "VALID", 1: "VALID", 2: "INVALID"}


def test_freshness_of_bad_dates(spark):
    rows = [("a", ""), ("b", "2026-13-45"), ("c", None), ("d", "2026-06-01")]
    out = rulebook.freshness(spark.createDataFrame(rows, "label string, verified_as_of string").withColumn("window_days", F.lit(180)), "2026-06-07")
    assert {r["label"]: r["state"] for r in out.collect()} == {"a": "unknown", "b": "unknown", "c": "unknown", "d": "fresh"}


def test_turfs_of_all_nations_cover_every_tile(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.01"  # the smallest with second bands
    run = lambda name: queries()[name](spark, sf).collect()
    tiles = {r.tile for r in run("tile_bands")}
    asked = [r.tile for r in run("turf_coverage_nations")]
    assert sorted(asked) == sorted(tiles)
    assert any(t.endswith("__b1") for t in asked) and any(not t.startswith("nation-1") for t in asked)
    assert sum(r.voters for r in run("tile_union_nations")) == len(run("tile_bands"))
