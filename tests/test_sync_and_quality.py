"""Streams against replays, publishing, filters per campaign, opportunities and expectations against brute force."""

from __future__ import annotations

import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from turfline.operators import artifacts, expectations, opportunities, yields
from turfline.plans.registry import QUERIES
from turfline.plans.stream_queries import ARRIVALS
from turfline.session import SCAN_PARTITIONS, dealt, scratch
from turfline.sources import field_tables as ft
from turfline.sources import rule_records as RR
from turfline.streaming import captures as SC
from turfline.streaming import index_sync

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_streams_take_events_without_a_time(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", f"{tmp_path}/{name}")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts"))).write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    key = ["campaign_id", "zip", "valid", "total"]
    got, want = QUERIES["stream_zip_yield"](spark, d).select(*key), yields.zip_counts(ft.captures(spark, d)).select(*key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert QUERIES["stream_capture_dedup"](spark, d).count() == ft.captures(spark, d).count() == 1000


def test_late_captures_count_in_velocity_windows(spark):
    rows = [("g", f"2024-01-{day:02d} 10:00:00") for day in (20, 21, 22)] + [("g", "2024-01-01 10:00:00")] * 3
    inbox, out, log = (scratch(spark, n) for n in ("inbox", "velocity", "log"))
    schema = "gatherer_id string, captured_at timestamp"
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part, "gatherer_id string, at string").select("gatherer_id", F.to_timestamp("at").alias("captured_at")).write.mode("append").parquet(inbox)
        SC.start_velocity(spark.readStream.schema(schema).parquet(inbox), out, log).awaitTermination()
    got = SC.latest(spark, out, spark.createDataFrame([], "gatherer_id string, started timestamp, captures long").schema, ["gatherer_id", "started"])
    assert got.where("started < '2024-01-02'").agg(F.max("captures"), F.count("*")).first() == (3, 4)


CHANGE = "tile string, id long, op string, changed_at timestamp, change_no long, name string"


def test_index_sync_equals_a_replay_in_any_order(spark):
    rng = random.Random(5)
    changes = [(f"t{rng.randrange(3)}", rng.randrange(12), rng.choice(["upsert", "upsert", "remove"]), f"2024-01-{rng.randrange(1, 29):02d}", n, f"n{n}") for n in range(300)]
    arrived = changes + rng.sample(changes, 60)  # some come twice
    rng.shuffle(arrived)
    path, inbox, log = (scratch(spark, n) for n in ("index", "inbox", "log"))
    for i in range(5):
        part = spark.createDataFrame(arrived[i::5], CHANGE.replace("timestamp", "string")).withColumn("changed_at", F.to_timestamp("changed_at"))
        part.write.mode("append").parquet(inbox)
        index_sync.start_index_sync(spark.readStream.schema(CHANGE).parquet(inbox), path, log).awaitTermination()

    def replay(upto):
        newest = {}
        for b in range(upto + 1):
            for tile, i, op, at, n, name in arrived[b::5]:
                if (tile, i) not in newest or newest[tile, i][:2] <= (at, n):
                    known = newest.get((tile, i))
                    first = known[4] if known and known[:2] == (at, n) else b
                    newest[tile, i] = (at, n, op, name, first)
        return newest
    for version in (0, 2, 4):
        got = {(r.tile, r.id): r.name for r in index_sync.index_at(spark, path, version).collect()}
        assert got == {k: v[3] for k, v in replay(version).items() if v[2] == "upsert"}
    held = [("new", "t0", None), ("old", "t0", 1), ("old", "t1", 2), ("twin", "t1", 2), ("current", "t2", 4), ("x", "gone", 0)]
    state = {}
    got = index_sync.pull(spark, path, spark.createDataFrame(held, "device_id string, tile string, version long")).collect()
    assert {r.device_id for r in got} <= {"new", "old", "twin"} and {r.version for r in got} == {4}
    for device, tile, version in held[:4]:
        state = {i: v[3] for (t, i), v in (replay(version) if version is not None else {}).items() if t == tile and v[2] == "upsert"}
        for r in (r for r in got if (r.device_id, r.tile) == (device, tile)):
            state.pop(r.id, None) if r.op == "remove" else state.update({r.id: r.name})
        assert state == {i: v[3] for (t, i), v in replay(4).items() if t == tile and v[2] == "upsert"}
    # a batch whose pointers were not written is not there
    spark.createDataFrame([("t0", 1, "upsert", "2025-01-01", 999, "half")], CHANGE.replace("timestamp", "string")).withColumn("changed_at", F.to_timestamp("changed_at")).write.parquet(f"{path}/changes/batch=9")
    assert "half" not in {r.name for r in index_sync.index_at(spark, path).collect()}


def test_a_failed_push_stays_pending_and_its_retry_syncs_once(spark):
    sent, known, out, log = (scratch(spark, n) for n in ("sent", "known", "queue", "log"))
    c, a = "campaign_id string, gatherer_id string, seq long", "campaign_id string, gatherer_id string, seq long, status string"
    steps = [([("c", "g", 1), ("c", "g", 2)], [("c", "g", 1, "accepted")]),  # the push of 2 fails
             ([("c", "g", 3)], [("c", "g", 4, "duplicate")]),  # an answer before its capture
             ([("c", "g", 4)], [("c", "g", 2, "recorded"), ("c", "g", 2, "recorded"), ("c", "g", 9, None)])]
    seen = []
    for captured, answered in steps:
        spark.createDataFrame(captured, c).write.mode("append").parquet(sent)
        spark.createDataFrame(answered, a).write.mode("append").parquet(known)
        SC.start_queue(spark.readStream.schema(c).parquet(sent), spark.readStream.schema(a).parquet(known), out, log).awaitTermination()
        seen.append(sorted((r.seq, r.sync, r.server_note) for r in SC.queue(spark, out).collect()))
    assert seen == [[(1, "synced", None), (2, "pending", None)], [(1, "synced", None), (2, "pending", None), (3, "pending", None)],
                    [(1, "synced", None), (2, "synced", None), (3, "pending", None), (4, "synced", "server: duplicate")]]


def test_editions_are_ordered_and_appear_at_once(spark):
    rows = [(f"J{i % 7}", "b" if i % 2 else "a", f"id{i:03d}", "OH") for i in range(90)]
    records = spark.createDataFrame(rows, "jurisdiction string, petitionType string, id string, abbr string")
    for f in RR.RULE_RECORD.fields:
        if f.name not in records.columns:
            records = records.withColumn(f.name, F.lit(None).cast(f.dataType))
    path = scratch(spark, "editions")
    RR.publish(records.limit(5), path, 1)
    RR.publish(records, path, 2, rows_per_file=20)
    spark.createDataFrame([("{}",)], "value string").write.text(f"{path}/edition=3")
    told = RR.manifest(spark, path).first()
    assert (told.edition, told.records, told.jurisdictions) == (2, 90, 1) and told.files > 3
    read = RR.read_published(spark, path).select("jurisdiction", "petitionType", "id", F.col("_metadata.file_name").alias("file")).collect()
    files = {}
    for r in read:
        files.setdefault(r.file, []).append((r.jurisdiction, r.petitionType, r.id))
    assert sum((files[k] for k in sorted(files)), []) == sorted((j, p, i) for j, p, i, _ in rows)
    RR.publish(records.limit(10), path, 2)  # written again after a lost run
    assert RR.read_published(spark, path).count() == RR.manifest(spark, path).first().records == 10


def test_records_with_one_document_for_each_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"r{i}.json").write_text('{\n "id": "r%d",\n "signatures": {\n  "required": %d\n },\n "citations": [\n  {"url": "u"}\n ]\n}\n' % (i, i + 10))
    got = RR.scan_rules(spark, str(tmp_path)).select("id", "signatures.required", F.size("citations")).collect()
    assert sorted(map(tuple, got)) == [("r0", 10, 1), ("r1", 11, 1), ("r2", 12, 1)]


def test_filters_of_all_campaigns(spark):
    rows = [("hot" if i % 3 else f"c{i % 7}", f"k{i}", i) for i in range(6000)] + [("hot", "k1", 9999), (None, "k1", 9998), ("c1", None, 9997)]
    keys = spark.createDataFrame(rows, "campaign_id string, member_key string, id long")
    path = scratch(spark, "filters")
    artifacts.write_membership(keys, path)
    manifest, chunks = artifacts.read_membership(spark, path)
    told = {r.campaign_id: r for r in manifest.collect()}
    assert set(told) == {"hot", *(f"c{i}" for i in range(7))}
    for name, r in told.items():
        n = len({k for c, k, _ in rows if c == name and k is not None})
        assert (r.members, r.bits, r.hashes) == (n, *artifacts.filter_size(n)) and 0 < r.bits_set <= n * r.hashes
    own = artifacts.probe_membership(keys.where("member_key IS NOT NULL"), manifest, chunks, "id")
    assert own.count() == 6001 and own.where("NOT maybe_member").count() == 0
    strangers = spark.range(20_000).select(F.lit("hot").alias("campaign_id"), "id", F.concat(F.lit("x"), "id").alias("member_key"))
    rate = artifacts.probe_membership(strangers, manifest, chunks, "id").agg(F.avg(F.col("maybe_member").cast("int"))).first()[0]
    assert rate < 0.02
    again = scratch(spark, "filters")
    artifacts.write_membership(keys.repartition(5).unionByName(keys.limit(3)), again)
    assert {r.campaign_id: r.version for r in artifacts.read_membership(spark, again)[0].collect()} == {k: r.version for k, r in told.items()}


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * opportunities.haversine_km.__globals__["EARTH_KM"] * math.asin(math.sqrt(h))


def test_opportunities_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(opportunities, "VOLUNTEERS_PER_TASK", 9)
    rng = random.Random(2)
    spot = lambda: (rng.choice([-60.0, 0.0, 40.0, 64.0]) + rng.random(), rng.choice([-100.0, 0.0]) + rng.random())
    vol = [(i, *spot(), float(rng.randrange(1, 8)), rng.random() < 0.5, rng.sample("ABC", 2) + ["A"]) for i in range(120)] + [(900, None, 1.0, 1.0, True, ["A"]), (901, 40.5, -99.5, 2.0, None, None)]
    opp = [(i, rng.choice("ABC"), *spot(), float(rng.randrange(1, 5)), float(rng.randrange(0, 3)), float(rng.randrange(3)), float(rng.randrange(2)), rng.randrange(3), rng.choice([True, False, None]))
           for i in range(150)]
    got = opportunities.best_opportunities(
        spark.createDataFrame(vol, "volunteer_id long, lat double, lng double, hours double, trained boolean, jurisdictions array<string>"),
        spark.createDataFrame(opp, "opportunity_id long, jurisdiction string, lat double, lng double, valid_per_hour double, need_per_day double, setup_cost double, risk double, capacity int, needs_training boolean"),
        3, 30.0, 0.2).collect()
    want = []
    for v, a, b, hours, trained, places in vol:
        fits = [(-(r * hours * need - 0.2 * km(a, b, c, e) - setup - risk), o) for o, j, c, e, r, need, setup, risk, room, training in opp
                if a is not None and j in (places or []) and room > 0 and need > 0 and (trained or not training) and km(a, b, c, e) <= 30.0]
        want += [(v, n + 1, o) for n, (_, o) in enumerate(sorted(fits)[:3])]
    assert sorted((r.volunteer_id, r.rank, r.opportunity_id) for r in got) == sorted(want) and len(want) > 100


def test_expectations_on_documents(spark):
    wanted = [*expectations.of_schema(RR.RULE_RECORD), *expectations.RULE_EXPECTATIONS]
    docs = [(1, None), (2, "no json"), (3, "[]"), (4, '{"rules":{"a":1},"citations":[{"url":"u"},{"urls":1},null]}'), (5, '{"signatures":{"required":5.0},"rules":[{"field":1,"gate":"x","confidence":-1}]}')]
    got = {}
    for r in expectations.violations(spark.createDataFrame(docs, "id long, value string"), wanted).collect():
        got.setdefault(r.id, set()).add((r.path, r.problem))
    assert got[1] == got[2] == {("$", "json")} and got[3] == {("$", "type")}
    assert {("$.rules", "type"), ("$.citations[1].url", "required"), ("$.citations[1].urls", "additional"), ("$.citations[2]", "type"), ("$.id", "required")} <= got[4]
    assert not any(p.startswith("$.citations[0]") for p, _ in got[4])
    assert {("$.rules[0].field", "type"), ("$.rules[0].gate", "enum"), ("$.rules[0].confidence", "minimum")} <= got[5] and ("$.signatures.required", "type") not in got[5]


def test_a_missing_package_leaves_the_other_queries():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'validate_batch' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    count, there, corpus = out.stdout.split()[-3:]
    assert int(count) > 130 and there == "True" and corpus == "False", out.stderr[-500:]


def test_arrivals_hold_every_event_once(spark):
    from turfline.plans.stream_queries import _arrivals

    arrivals = _arrivals(spark, SF)
    assert arrivals.count() == spark.read.parquet(f"{SF}/events.parquet").count() and arrivals.select("_arrival").distinct().count() == ARRIVALS


def test_starting_a_stream_leaves_the_session_as_it_was(spark):
    inbox, out, log = (scratch(spark, n) for n in ("inbox", "yield", "log"))
    ft.captures(spark, SF).write.parquet(inbox)
    SC.start_zip_counts(spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox), out, log).awaitTermination()
    assert SC._STORE not in spark.conf.getAll
    state = [os.path.join(d, f) for d, _, names in os.walk(log) for f in names if "/state/" in d + "/"]
    assert any(f.endswith(".zip") or f.endswith(".changelog") for f in state)  # RocksDB's files


def test_expectations_inside_lists_of_lists(spark):
    wanted = [("$.a", "type", "array"), ("$.a[*].b", "type", "array"), ("$.a[*].b[*]", "required", "c"), ("$.a[*].b[*].c", "minimum", 0), ("$.d[0]", "enum", ("x",))]
    docs = [(1, '{"a":[{"b":[{"c":1},{"c":-1}]},{"b":[{}]},{"b":7}],"d":["y"]}'), (2, '{"a":[{"b":[{"c":1}]},{}],"d":["x"]}'), (3, '{"a":{"b":1}}'), (4, "[1]")]
    found = {tuple(r) for r in expectations.violations(spark.createDataFrame(docs, "id long, value string"), wanted).collect()}
    assert found == {
        (1, "$.a[0].b[1].c", "minimum"), (1, "$.a[1].b[0].c", "required"), (1, "$.a[2].b", "type"), (1, "$.d[0]", "enum"), (3, "$.a", "type")}


def test_scan_of_one_file_is_dealt_over_the_cores(spark, tmp_path):
    """A file of one row group is one task, whatever its size."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    asked = spark.conf.get(SCAN_PARTITIONS, None)
    spark.conf.unset(SCAN_PARTITIONS)
    try:
        rows = dealt(spark.read.parquet(str(tmp_path / "one"))).withColumn("part", F.spark_partition_id())
        assert rows.select("part").distinct().count() >= spark.sparkContext.defaultParallelism
        assert rows.selectExpr("count(DISTINCT id)").first()[0] == 1000
    finally:
        if asked is not None:
            spark.conf.set(SCAN_PARTITIONS, asked)


def test_tiles_are_written_by_every_core(spark):
    """Many small tiles are few bytes, which must not put all their files into one task."""
    out, tiles = scratch(spark, "tiles"), spark.range(200).selectExpr("CAST(id % 100 AS string) AS tile", "id", "id AS position")
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        artifacts.write_tiles(tiles, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    assert len(files) == 100 and len({f.split("-")[1] for f in files}) >= spark.sparkContext.defaultParallelism / 2
    back = spark.read.schema(tiles.schema).parquet(out)
    assert back.where("tile = '07'").count() == 0 and back.count() == 200


def _started() -> int:
    """Processes and threads started on this machine so far."""
    with open("/proc/stat") as stat:
        return next(int(line.split()[1]) for line in stat if line.startswith("processes "))


def test_tile_files_start_no_process_each(spark):
    """Hadoop's local file system starts several processes for every file; at 900,000 tiles that was the time of the job."""
    tiles = spark.range(6000).selectExpr("'t' || (id % 2000) AS tile", "id", "id AS position")
    out, before = scratch(spark, "tiles"), _started()
    artifacts.write_tiles(tiles, out)
    assert _started() - before < 2000
    back = artifacts.read_tiles(spark, out, tiles.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tiles.collect()))


def test_tile_folders_are_those_of_spark(spark):
    """Odd names, no name, odd values and a tile of several batches; both readers see what Spark's writer wrote."""
    names = ["a b", "a/b", "x%2F", 'q"#\'*:=?', "{[^]}\\", "\x01\x7f", "\u00e9", "007", "", None]
    few = [(n, i, p, None if p else ["u", None], bool(p)) for i, n in enumerate(names) for p in range(3)]
    many = [("large", i, 24_999 - i, [str(i)], None) for i in range(25_000)]
    tiles = spark.createDataFrame(few + many, "tile string, id long, position long, t array<string>, b boolean").repartition(3)
    out, by_spark = scratch(spark, "tiles"), scratch(spark, "tiles")
    artifacts.write_tiles(tiles, out)
    tiles.repartition(4, "tile").write.partitionBy("tile").parquet(by_spark)
    assert {n for n in os.listdir(out) if "=" in n} == {n for n in os.listdir(by_spark) if "=" in n}
    rows = lambda df: sorted((str(tuple(r)) for r in df.select(*tiles.columns).collect()))
    want = rows(spark.read.schema(tiles.schema).parquet(by_spark))
    assert rows(spark.read.schema(tiles.schema).parquet(out)) == want
    assert rows(artifacts.read_tiles(spark, out, tiles.schema)) == want
    assert spark.read.parquet(out).drop("tile").schema == tiles.drop("tile").schema
    (large,) = [f for f in os.listdir(f"{out}/tile=large") if f.startswith("part-")]
    assert [r.position for r in spark.read.parquet(f"{out}/tile=large/{large}").coalesce(1).collect()] == list(range(25_000))
    with pytest.raises(FileExistsError):
        artifacts.write_tiles(tiles, out)


def test_tiles_broken_off_are_not_there(spark):
    fails = spark.range(100).selectExpr("'t' || (id % 10) AS tile", "id", "id AS position", "IF(id = 99, raise_error('x'), 1) AS n")
    out = scratch(spark, "tiles")
    with pytest.raises(Exception):
        artifacts.write_tiles(fails, out)
    try:
        assert artifacts.read_tiles(spark, out, fails.schema).count() == 0
    except AnalysisException as error:
        assert error.getCondition() == "PATH_NOT_FOUND"


def test_tiles_of_other_stores_take_sparks_writer(spark, monkeypatch):
    from turfline.sources import tile_folders

    monkeypatch.setattr(tile_folders, "file_system_folder", lambda spark, path: None)
    out, tiles = scratch(spark, "tiles"), spark.range(60).selectExpr("CAST(id % 20 AS string) AS tile", "id", "id AS position")
    artifacts.write_tiles(tiles, out)
    assert sorted(map(tuple, artifacts.read_tiles(spark, out, tiles.schema).collect())) == sorted(map(tuple, tiles.collect()))


def test_non_members_are_made_by_every_core(spark):
    from turfline.plans import field_queries

    asked = spark.conf.get(SCAN_PARTITIONS, None)
    spark.conf.unset(SCAN_PARTITIONS)
    try:
        absent = field_queries._absent(spark, SF)
        assert absent.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
    finally:
        if asked is not None:
            spark.conf.set(SCAN_PARTITIONS, asked)
