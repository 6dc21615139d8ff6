"""Made-up people of a made-up town: a small roll and a petition batch that reach every branch of the law."""

from __future__ import annotations

ROLL = "row_pos long, id string, name string, address string, status string, registered_on string, county string, district string"
SIGNER = ("row_pos long, id string, name string, address string, signed_on string, county string, gatherer string, "
          "capture string, attested_resident boolean")

_VOTERS = [
    ("R10", "Samuel Okafor", "310 Juniper Way, Millbrook 30110", "active", "2017-02-11", "D-4"),
    ("R11", "Rebecca Lindqvist", "9 Harbor Street, Millbrook 30111", "active", "2020-10-05", "D-4"),
    ("R12", "Deborah Nakamura", "2204 W Prospect Boulevard, Millbrook 30110", "inactive", "2012-01-30", "D-5"),
    ("R13", "Edward Castellanos", "61 Quarry Rd Unit 7, Millbrook 30112", "active", "2016-07-19", "D-4"),
    ("R14", "Cynthia Moreau", "480 Orchard Ct, Millbrook 30110", "cancelled", "2011-11-11", "D-5"),
    ("R15", "Anthony Petrov", "1 Ferry Ln, Millbrook 30112", "active", "2026-07-04", "D-4"),
    ("R16", "Jennifer Abernathy", "733 Foundry Ave, Millbrook 30111", "active", "2019-03-03", "D-5"),
    ("R17", "Benjamin Sörensen", "58 Mill Pond Dr, Millbrook 30110", "active", "2021-08-08", "D-4"),
    ("R18", "Margaret Ibarra", "12 Canal St, Millbrook 30112", "active", "2018-12-24", "D-4"),
    ("R19", "Nguyễn Trần Hậu", "5 Depot Sq, Millbrook 30111", "active", "2015-05-15", "D-5"),
]
_SIGNERS = [
    ("L1", "Sam Okafor", "310 Juniper Way, Millbrook 30110", "2026-04-02", "Ines", "wet"),
    ("L2", "Becky Lindqvist", "9 Harbor St, Millbrook 30111", "2026-04-02", "Ines", "digital"),
    ("L3", "Deb Nakamura", "2204 West Prospect Blvd, Millbrook 30110", "2026-04-02", "Jo", "wet"),
    ("L4", "Ed Castellano", "61 Quarry Road #7, Millbrook 30112", "2026-04-03", "Jo", "digital"),
    ("L5", "Cindy Moreau", "480 Orchard Court, Millbrook 30110", "2026-04-03", "Kim", "wet"),
    ("L6", "Tony Petrov", "1 Ferry Lane, Millbrook 30112", "2026-04-05", "Kim", "wet"),
    ("L7", "Samuel Okafor", "310 Juniper Way, Millbrook 30110", "2026-04-09", "Kim", "wet"),
    ("L8", "Wendell Quist", "5 Unknown Pkwy, Millbrook 30110", "2026-04-09", "Ines", "wet"),
    ("L9", "Paul Abernathy", "733 Foundry Avenue, Millbrook 30111", "2026-04-10", "Jo", "wet"),
    ("L10", "Ben Sorensen", "58 Mill Pond Drive, Millbrook 30110", "2026-04-10", "Ines", "digital"),
    ("L11", "Peggy Ibarra", "12 Canal St, Millbrook 30112", "2026-04-11", "Jo", "wet"),
    ("L12", "Meg Ibarra", "12 Canal Street, Millbrook 30112", "2026-04-12", "Kim", "wet"),
    ("L13", "Nguyen Tran Hau", "5 Depot Square, Millbrook 30111", "2026-04-12", "Ines", "wet"),
]


def roll(spark, voters=_VOTERS, county="Mercer"):
    rows = [(i, v, n, a, s, r, county, d) for i, (v, n, a, s, r, d) in enumerate(voters)]
    return spark.createDataFrame(rows, ROLL)


def signers(spark, lines=_SIGNERS, county=None, attested=None):
    rows = [(i, s, n, a, on, county, g, c, attested) for i, (s, n, a, on, g, c) in enumerate(lines)]
    return spark.createDataFrame(rows, SIGNER)
