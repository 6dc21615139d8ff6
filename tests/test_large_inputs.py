"""Operators that used to grow faster than their input: same results, and no step that holds or repeats all of it."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from turfline.operators import opportunities, routing, suggest, sync


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_opportunities_prune_inside_cells(spark, monkeypatch):
    """Ties, unknown scores and blocks smaller than a cell; no join sends one side whole or makes all pairs."""
    for name, size in (("VOLUNTEERS_PER_TASK", 50), ("BLOCK", 7), ("CHUNK", 16)):
        monkeypatch.setattr(opportunities, name, size)
    rng = random.Random(4)
    vol = [(i, 40 + rng.random(), -100 + rng.random(), rng.choice([None, 1, 2, 2, 7]), True, ["A", None]) for i in range(90)]
    opp = [(i, rng.choice(["A", "A", "B", None]), 40 + rng.choice([0.1, 0.5]), -100 + rng.choice([0.2, 0.6]), rng.choice([None, 3, 4]), rng.randrange(3), 1, rng.choice([None, 0, 1]), 1, False)
           for i in range(120)]
    got = opportunities.best_opportunities(
        spark.createDataFrame(vol, "volunteer_id long, lat double, lng double, hours long, trained boolean, jurisdictions array<string>"),
        spark.createDataFrame(opp, "opportunity_id long, jurisdiction string, lat double, lng double, valid_per_hour long, need_per_day long, setup_cost long, risk long, capacity int, needs_training boolean"),
        4, 60.0, 0.2)
    assert not any("Join" in line and "_salt" in line for line in _plan(got).splitlines())
    v = spark.createDataFrame(vol, "volunteer_id long, lat double, lng double, hours long, trained boolean, jurisdictions array<string>")
    o = spark.createDataFrame([r[:8] for r in opp if r[1] == "A" and r[5] > 0], "opportunity_id long, j string, o_lat double, o_lng double, rate long, need long, cost long, risk long")
    met = v.crossJoin(o).withColumn("km", opportunities.haversine_km(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng"))).where("km <= 60").withColumn(
        "score", F.expr("rate * hours * need - 0.2D * km - cost - risk"))
    want = opportunities.first_in_group(met, ["volunteer_id"], [F.desc("score"), F.col("opportunity_id")], 4)
    columns = ["volunteer_id", "rank", "opportunity_id", "score"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(got) == rows(want) and got.count() > 300


def test_union_state_names_every_tiles_version(spark):
    loaded = spark.sql("SELECT * FROM VALUES ('c', 't2', 'v2', 5, TIMESTAMP_NTZ '2026-01-02'), ('c', 't1', 'v1', 3, TIMESTAMP_NTZ '2026-01-01') t(campaign_id, tile, version, voter_count, synced_at)")
    (row,) = sync.union_state(loaded).collect()
    assert (row.version, row.voter_count, row.synced_at.day) == ("v1|v2", 8, 1)


def test_day_assignment_writes_only_offers_of_worth(spark, monkeypatch):
    """A gatherer with an offer in two of ten states; those without any worth go to a state only if it takes everybody left."""
    rng, written = random.Random(5), {}
    stage = routing.stage
    monkeypatch.setattr(routing, "stage", lambda df, name: written.setdefault(name, []).append(stage(df, name)) or written[name][-1])
    rows = [(day, f"g{g:02d}", f"s{s}", float(rng.choice([0, 1, 2, 5])), 1.0) for day in ("d1", "d2", "d3") for g in range(40) for s in rng.sample(range(10), 2)] + [("d1", None, "s1", 3.0, 1.0)]
    pace = {(day, f"s{s}"): float(rng.choice([10, 40, 90, 3000 if day == "d3" and s > 7 else 20])) for day in ("d1", "d2", "d3") for s in range(10)}
    states = [(day, s, p) for (day, s), p in pace.items()]
    got = routing.assign_day(
        spark.createDataFrame(rows, "drive_day string, gatherer string, state string, raw double, rate double"),
        spark.createDataFrame(states, "drive_day string, state string, pace double"))
    want = {}
    for day in ("d1", "d2", "d3"):
        worth = {(g, s): raw for d, g, s, raw, _ in rows if d == day and g}
        order = sorted((s for d, s in pace if d == day), key=lambda s: (-pace[day, s], s))
        free = sorted({g for g, _ in worth})
        for s in order:
            met = 0.0
            for g in sorted(free, key=lambda g: (-worth.get((g, s), 0.0), g)):
                if met >= pace[day, s]:
                    break
                want[day, g], met = s, met + 8.0 * worth.get((g, s), 0.0)
            free = [g for g in free if (day, g) not in want]
        want |= {(day, g): order[0] for g in free} | ({(day, None): order[0]} if day == "d1" else {})
    assert {(r.drive_day, r.gatherer): r.state for r in got.collect()} == want
    assert written["offers"][0].count() <= len(rows) < 3 * 40 * 10


def test_suggestions_meet_in_blocks(spark, monkeypatch):
    """Points are added up inside blocks of shapes; words that come twice, a query id that comes twice and frequent words change nothing."""
    monkeypatch.setattr(suggest, "SHAPES_PER_TASK", 4)
    monkeypatch.setattr(suggest, "QUERIES_PER_TASK", 2)
    people = [(i, f"V{i}", ("Ann", "Anna", "Joann")[i % 3], "Smith" if i % 2 else "Anders", 100 + i % 4, ("Oak", "Annex")[i % 2], "active" if i % 5 else "inactive") for i in range(40)]
    roll = spark.createDataFrame([(i, v, f"{a} {b}", f"{n} {s} St, Springfield 62701", st) for i, v, a, b, n, s, st in people], "row_pos long, id string, name string, address string, status string")
    asked = [(1, "ann smith 101 oak"), (2, "an an"), (3, "101"), (4, "smith"), (5, "101 annex"), (6, "oak"), (4, "smith")]
    got: dict[int, list] = {}
    for r in suggest.suggest_voters(spark.createDataFrame(asked, "query_id long, query string"), roll, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    hit = lambda w, words: max([3 if w == x else 2 if x.startswith(w) else 0 for x in words])
    for q, text in asked:
        scored = []
        for i, v, a, b, n, s, st in people:
            typed = [w for w in text.split() if not w.isdigit()]
            name, street = sum(hit(w, [a.lower(), b.lower()]) for w in typed), sum(hit(w, [s.lower()]) for w in typed)
            house = str(n) in text.split()
            if name or (house and street):
                scored.append((-(name + street + 4 * house + 0.5 * (st == "active")), i, v))
        assert got.get(q, []) == [(v, -p) for p, _, v in sorted(scored)[:5]]
    assert sorted(got) == [1, 2, 4, 5]


def test_velocity_takes_an_arrival_in_several_batches(spark, monkeypatch):
    """Small files, few at a time: more micro-batches than arrivals, and the windows of the batch query."""
    from turfline.plans import stream_queries
    from turfline.plans.registry import QUERIES

    sf, batches = "/root/testdata/sf0.001", set()
    monkeypatch.setattr(stream_queries, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(stream_queries, "FILES_AT_ONCE", 2)
    changes = stream_queries.SC._changes
    monkeypatch.setattr(stream_queries.SC, "_changes", lambda path: lambda batch, n: (batches.add(n), changes(path)(batch, n)))
    rows = lambda name: sorted(map(str, QUERIES[name](spark, sf).collect()))
    assert rows("stream_velocity") == rows("capture_velocity") and len(batches) > stream_queries.ARRIVALS
