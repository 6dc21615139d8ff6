"""Rolls, signers, captures and campaign tables derived from the driver's star-schema tables.

The source tables hold no people.  Names and addresses are generated from the key columns by fixed
formulas, so each derived table has as many rows as its source and can be derived in any SQL engine.
A third of the roll is called Smith on purpose: that block is the hot key of every linkage job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.session import dealt

FIRST = (
    "Robert", "William", "James", "Joseph", "Michael", "David", "Richard", "Thomas", "Stephen", "Christopher",
    "Matthew", "Daniel", "Anthony", "Edward", "Benjamin", "Samuel", "Elizabeth", "Katherine", "Margaret", "Susan",
)
SHORT = (
    "Bob", "Bill", "Jim", "Joe", "Mike", "Dave", "Rick", "Tom", "Steve", "Chris",
    "Matt", "Dan", "Tony", "Ed", "Ben", "Sam", "Liz", "Kate", "Peggy", "Sue",
)
LAST = (
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Wilson", "Taylor", "Nuñez",
    "O'Brien", "Gonzalez", "Nguyen", "Carter", "Baker", "Martinez", "Lee", "Van Dyke", "Wilkins", "Johansen",
    "Smythe", "Garner", "Milton",
)
ENDING = ("", "son", "ton", "ley", "man", "berg", "field", "wood")
STREET = (
    "Main St", "Oak Avenue", "Pine Road", "Maple Dr", "Cedar Ln", "Elm Street", "Park Ave", "Lake Rd",
    "N River Drive", "Sunset Blvd", "University Way NE", "Hill Rd",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at a position of a constant list."""
    return F.element_at(F.split(F.lit("|".join(values)), "[|]"), (index + 1).cast("int"))


def _div(column: Column, n: int) -> Column:
    return F.floor(column / n)


def first_name(k: Column) -> Column:
    return pick(FIRST, k % 20)


def last_name(k: Column) -> Column:
    varied = F.concat(pick(LAST, _div(k, 20) % 24), pick(ENDING, _div(k, 480) % 8))
    return F.when(k % 3 == 0, F.lit("Smith")).otherwise(varied)


def house(k: Column) -> Column:
    return (k * 7 % 900 + 100).cast("string")


def street_line(k: Column) -> Column:
    return pick(STREET, _div(k, 5) % 12)


def zip5(k: Column) -> Column:
    return (_div(k, 2) % 40 + 62700).cast("string")


def roll_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the separate columns a state roll file carries."""
    c = dealt(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    k = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        k.alias("row_pos"),
        F.concat(F.lit("V"), k).alias("voter_id"),
        first_name(k).alias("first_name"),
        F.when(k % 5 == 0, "A").otherwise("").alias("middle_name"),
        last_name(k).alias("last_name"),
        F.when(k % 11 == 0, "Jr").otherwise("").alias("suffix"),
        F.when(k % 101 == 0, "").otherwise(house(k)).alias("house"),
        street_line(k).alias("street_name"),
        F.when(k % 6 == 0, F.concat(F.lit("Apt "), k % 40 + 1)).otherwise("").alias("unit_text"),
        F.lit("Springfield").alias("city"),
        zip5(k).alias("zip"),
        F.when(F.col("c_mktsegment") == "BUILDING", "inactive")
        .when(F.col("c_mktsegment") == "MACHINERY", "cancelled").otherwise("active").alias("status"),
        F.date_format(F.date_add(F.lit("1994-01-01").cast("date"), (k * 13 % 3000).cast("int")), "yyyy-MM-dd")
        .alias("registered_on"),
        F.col("n_name").alias("county"),
        F.concat(F.lit("CD-"), F.col("n_regionkey")).alias("district"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("P"), k % 7)).alias("tile_cell"),
    )


def roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical voter roll over ``customer``."""
    r = roll_layout(spark, sf_dir)
    k = F.col("row_pos")
    name = F.when(k % 7 == 0, F.concat("last_name", F.lit(", "), "first_name")).otherwise(
        F.concat_ws(
            " ", "first_name", F.nullif("middle_name", F.lit("")), "last_name", F.nullif("suffix", F.lit("")))
    )
    address = F.concat(
        F.concat_ws(
            " ", F.nullif("house", F.lit("")), "street_name", F.nullif("unit_text", F.lit(""))),
        F.lit(", Springfield "), "zip",
    )
    return r.select(
        "row_pos", F.col("voter_id").alias("id"), name.alias("name"), address.alias("address"),
        "status", "registered_on", "county", "district", "tile_cell",
    )


def signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Petition lines over ``orders``: ten kinds of spelling, from exact to unknown people."""
    s = dealt(read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    kind = o % 10
    full = F.concat(first_name(k), F.lit(" "), last_name(k))
    name = (
        F.when(o % 89 == 0, "Madonna")
        .when(kind == 1, F.concat(pick(SHORT, k % 20), F.lit(" "), last_name(k)))
        .when(kind == 2, F.concat(last_name(k), F.lit(", "), first_name(k)))
        .when(kind == 3, F.concat(F.upper(full), F.lit(" JR.")))
        .when(kind == 5, F.concat(full, F.lit("e")))
        .when(kind == 7, F.concat(pick(SHORT, (k + 7) % 20), F.lit(" "), last_name(k)))
        .when(kind == 8, F.concat(F.substring(first_name(k), 1, 1), F.lit(". "), last_name(k)))
        .when(kind == 9, F.concat(first_name(k), F.lit(" "), F.reverse(last_name(k))))
        .otherwise(full)
    )
    number = F.when(kind == 6, (k * 7 % 900 + 102).cast("string")).otherwise(house(k))
    known = F.concat(
        F.when(o % 97 == 0, "").otherwise(F.concat(number, F.lit(" "))), street_line(k),
        F.when((k % 6 == 0) & (kind != 4), F.concat(F.lit(" #"), k % 40 + 1)).otherwise(""),
        F.lit(", Springfield "), zip5(k), F.when(o % 4 == 0, "-1234").otherwise(""),
    )
    other = k + 1  # nobody of that name lives at the next customer's address
    address = F.when(kind == 9, F.concat(
        house(other), F.lit(" "), street_line(other), F.lit(", Springfield "), zip5(other))).otherwise(known)
    return s.select(
        o.alias("row_pos"), F.concat(F.lit("S"), o).alias("id"), name.alias("name"), address.alias("address"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("signed_on"),
        F.concat(F.lit("NATION_"), o % 25).alias("county"),
        F.col("o_orderpriority").alias("gatherer"),
        F.when(F.col("o_orderstatus") == "O", "digital").when(F.col("o_orderstatus") == "F", "wet").alias("capture"),
        (o % 2 == 0).alias("attested_resident"),
    )


def captures(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Field captures over ``events``; a third of the VALID ones name the same voter per campaign.

    ``spread`` deals the scan over all cores, for work that costs far more per row than the shuffle.
    """
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return capture_columns(dealt(e) if spread else e)


def capture_columns(e: DataFrame) -> DataFrame:
    """The capture columns of an ``events`` batch or stream."""
    i, u = F.col("event_id"), F.col("user_id")
    verdict = F.when(i % 10 < 7, "VALID").when(i % 10 < 9, "NEEDS_REVIEW").otherwise("INVALID")
    voter = F.when(i % 23 == 0, None).when(i % 3 == 0, F.lit("V0")).otherwise(
        F.concat(F.lit("V"), (i * 31 + u) % 2000))
    ending = F.when(i % 19 == 0, ", Springfield").when(i % 13 == 0, F.concat(F.lit(", Springfield "), zip5(u), F.lit("-0001"))) \
        .otherwise(F.concat(F.lit(", Springfield "), zip5(u)))
    return e.select(
        F.concat(F.lit("cmp-"), F.col("event_type")).alias("campaign_id"),
        F.concat(F.lit("g"), u).alias("gatherer_id"),
        i.alias("seq"),
        F.concat(first_name(i), F.lit(" "), last_name(i)).alias("name"),
        F.concat(house(i), F.lit(" "), street_line(i), ending).alias("address"),
        verdict.alias("verdict"),
        voter.alias("matched_voter_id"),
        F.col("value").alias("score"),
        F.col("ts").alias("captured_at"),
    )
