from __future__ import annotations

import pytest
from people_fixture import signers
from pyspark.sql import functions as F

from turfline.operators.validity import StateContext, validate_batch
from turfline.session import scratch
from turfline.sources import rolls
from turfline.sources.adapters import LAYOUTS

PEOPLE = ("voter_id string, first_name string, middle_name string, last_name string, suffix string, house string, street_name string, "
          "unit_text string, city string, state string, zip string, status string, registered_on string, county string, district string, tile_cell string")
ROWS = [
    ("V1001", "Samuel", "T", "Nuñez", "", "310", "Juniper Way", "", "Millbrook", "NC", "62704", "active", "2019-03-01", "Mercer", "1", "P1"),
    ("V1002", "Rebecca", "", "Lindqvist", "", "9", "Harbor St", "", "Millbrook", "NC", "62704", "active", "2018-06-15", "Mercer", "1", "P1"),
    ("V1003", "Edward", "", "Castellanos", "", "61", "Quarry Rd", "7", "Millbrook", "NC", "62705", "active", "2021-11-02", "Mercer", "1", "P1"),
    ("V1004", "Deborah", "", "Naka'mura", "", "2204", "W Prospect Blvd", "", "Millbrook", "NC", "62704", "inactive", "2017-09-10", "Mercer", "1", "P1"),
    ("V1005", "Cynthia", "", "Moreau", "", "480", "Orchard Ct", "", "Millbrook", "NC", "62704", "cancelled", "2016-05-05", "Mercer", "1", "P1"),
]


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_round_trip(spark, name):
    layout, path = LAYOUTS[name], scratch(spark, "layout")
    rolls.write(spark.createDataFrame(ROWS, PEOPLE), layout, path)
    got = {r["id"]: r for r in rolls.scan(spark, path, layout).collect()}
    assert len(got) == 5
    assert got["V1001"]["name"] == "Samuel T Nuñez"
    assert {r["status"] for r in got.values()} == {"active", "inactive", "cancelled"}
    assert got["V1001"]["registered_on"] == (None if layout.date_format == "unknown" else "2019-03-01")
    stream = rolls.scan_stream(spark, path, layout, rolls.header_of(spark, path, layout), files_per_trigger=1)
    out = scratch(spark, "streamed")
    from turfline.streaming.captures import start_roll_ingest
    start_roll_ingest(stream, out, scratch(spark, "log")).awaitTermination()
    assert sorted(spark.read.schema(stream.schema).parquet(out).collect()) == sorted(got.values())


def test_raw_file_details(spark, tmp_path):
    """Quotes with the delimiter inside, doubled quotes, blank lines, short rows, high single-byte characters."""
    ohio = tmp_path / "ohio.csv"
    ohio.write_text('sos_voterid,FIRST_NAME,LAST_NAME,RESIDENTIAL_ADDRESS1,RESIDENTIAL_CITY,RESIDENTIAL_ZIP,VOTER_STATUS,REGISTRATION_DATE,BIRTH\n'
                    '\n1, Ann ,"O""Neil, Jr","1 Oak St",Troy,43001,active,1/2/2020,1970\n2,Bo\n', encoding="utf-8")
    got = rolls.scan(spark, str(ohio), LAYOUTS["Ohio"]).orderBy("id").collect()
    assert [r["id"] for r in got] == ["1", "2"]
    assert got[0]["name"] == 'Ann O"Neil, Jr' and got[0]["address"] == "1 Oak St, Troy 43001"
    assert got[0]["registered_on"] == "2020-01-02" and got[1]["status"] == "inactive" and got[1]["address"] == ""
    vermont = tmp_path / "vt.psv"
    vermont.write_bytes("Voter ID|First Name|Last Name|Status\n7|Zoë|D’Arcy|Canceled\n".encode("cp1252"))
    row = rolls.scan(spark, str(vermont), LAYOUTS["Vermont"]).first()
    assert row["name"] == "Zoë D’Arcy" and row["status"] == "cancelled"


def test_filter_and_limit_over_many_rows(spark):
    path, layout = scratch(spark, "big"), LAYOUTS["Washington"]
    base = spark.createDataFrame(ROWS, PEOPLE)
    big = spark.range(4000).crossJoin(base).withColumn("voter_id", F.concat_ws("-", "voter_id", "id")).drop("id")
    rolls.write(big, layout, path)
    scanned = rolls.scan(spark, path, layout, with_position=True)
    assert scanned.count() == 20000
    assert rolls.scoped(scanned, F.col("address").contains("62705")).count() == 4000
    assert rolls.scoped(scanned, F.lit(True), limit=10).count() == 10


def test_validate_against_a_loaded_file(spark):
    path, layout = scratch(spark, "wa"), LAYOUTS["Washington"]
    rolls.write(spark.createDataFrame(ROWS, PEOPLE).coalesce(1), layout, path)
    lines = [("S1", "Sam Nunez", "310 Juniper Way, Millbrook 62704", "2026-05-01", "Ava", "digital"),
             ("S2", "Becky Lindqvist", "9 Harbor Street, Millbrook 62704", "2026-05-01", "Ava", "wet"),
             ("S3", "Deb Naka'mura", "2204 West Prospect Boulevard, Millbrook 62704", "2026-05-02", "Ben", "wet"),
             ("S4", "Wendell Quist", "5 Unknown Pkwy, Millbrook 62704", "2026-05-03", "Ben", "wet")]
    ledger = validate_batch(signers(spark, lines), rolls.scan(spark, path, layout, with_position=True), StateContext("Washington"))
    assert {r["id"]: r["verdict"] for r in ledger.collect()} == {"S1": "VALID", "S2": "VALID", "S3": "INVALID", "S4": "INVALID"}


def test_position_is_file_order_whatever_the_split_size(spark, tmp_path):
    """Several files with a blank in the name, many splits: the order of rows is that of the files."""
    layout, folder = LAYOUTS["Washington"], tmp_path / "a roll"
    folder.mkdir()
    one = scratch(spark, "one")
    people = spark.range(60).crossJoin(spark.createDataFrame(ROWS, PEOPLE).limit(1)).withColumn("voter_id", F.concat(F.lit("N"), F.lpad(F.col("id").cast("string"), 3, "0"))).drop("id")
    rolls.write(people.coalesce(1).sortWithinPartitions("voter_id"), layout, one)
    import glob
    lines = open(glob.glob(f"{one}/part-*")[0], encoding="latin-1").read().splitlines(keepends=True)
    for name, rows in (("b 2.txt", lines[21:]), ("a+1.txt", lines[1:21])):
        (folder / name).write_text("".join([lines[0], *rows]), encoding="latin-1")
    seen = []
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            seen.append([r["id"] for r in rolls.scan(spark, str(folder), layout, with_position=True).orderBy("row_pos").collect()])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == [f"N{i:03d}" for i in range(60)]


def test_a_capped_scan_leaves_later_files_unread(spark, tmp_path):
    layout = LAYOUTS["Vermont"]
    people = spark.range(40).select(F.col("id").cast("string").alias("voter_id"), *(F.lit("x").alias(c) for c in (
        "first_name", "middle_name", "last_name", "suffix", "house", "street_name", "unit_text", "city", "state", "zip", "status", "county", "district", "tile_cell")), F.lit("2020-01-02").alias("registered_on"))
    path = str(tmp_path / "roll")
    rolls.write(people.repartitionByRange(4, F.col("voter_id").cast("int")).sortWithinPartitions(F.col("voter_id").cast("int")), layout, path)
    (tmp_path / "roll" / "zzz.csv.gz").write_bytes(b"no gzip at all")
    got = rolls.first_matching(spark, path, layout, F.col("id") % 2 == 1, 7).orderBy("row_pos").collect()
    assert [int(r.id) for r in got] == list(range(1, 15, 2))
    with pytest.raises(Exception):
        rolls.scan(spark, path, layout).count()
