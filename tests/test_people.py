from __future__ import annotations

import random
import re
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from people_fixture import ROLL, SIGNER, roll, signers
from pyspark.sql import functions as F
from slow_reference import best_match, jaro_winkler

from turfline.functions import people
from turfline.functions.similarity import jaro_winkler_batch
from turfline.functions.text import basic, page_text, quote_fold
from turfline.operators import linkage, validity

words = st.text(alphabet="abcde ", max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=30))
def test_jaro_winkler_batch_equals_definition(pairs):
    left, right = (pd.Series([p[i] for p in pairs]) for i in (0, 1))
    got = jaro_winkler_batch(left, right)
    for (a, b), score in zip(pairs, got):
        assert score == pytest.approx(jaro_winkler(a, b), abs=1e-12), (a, b)


def test_jaro_winkler_bounds():
    got = jaro_winkler_batch(pd.Series(["gonzalez", "smith", "smith", ""]), pd.Series(["gonzales", "smyth", "jones", ""]))
    assert got[0] > 0.9 and got[1] > 0.8 and got[2] < 0.5 and got[3] == 1.0


@pytest.mark.parametrize("name, first, middle, last", [
    ("Smith, Robert A.", "robert", "a", "smith"), ("Smith, Jr., Bob", "smith", "", ""), ("Madonna", "madonna", "", ""),
    ("Dr. Liam O'Neil III", "dr", "liam", "oneil"), ("Mary-Jane Van Der Berg", "mary-jane", "van der", "berg"),
    ("Bob Nuñez", "robert", "", "nunez"), ("", "", "", ""), (None, "", "", ""),
])
def test_names(spark, name, first, middle, last):
    row = people.with_name_parts(spark.createDataFrame([(name,)], "name string")).first()
    assert (row["first"], row["middle"], row["last"]) == (first, middle, last)


@pytest.mark.parametrize("address, number, street, unit, zip5", [
    ("12 Pier Ave, X 11111", "12", "ve", "A", "11111"), ("5 Key West Dr", "5", "est dr", "W", ""),
    ("9 No Name Rd", "9", "ame rd", "N", ""), ("12345 Oak St", "12345", "oak st", "", "12345"),
    ("4500 University Way NE", "4500", "university way ne", "", ""), ("42b N. Main Street Apt 3, Springfield 62704-1234", "42", "n main st", "3", "62704"),
    ("River Road", "", "riv rd", "", ""), (None, "", "", "", ""),
])
def test_addresses(spark, address, number, street, unit, zip5):
    row = people.with_address_parts(spark.createDataFrame([(address,)], "address string")).first()
    assert (row["number"], row["street"], row["unit"], row["zip5"]) == (number, street, unit, zip5)


def test_text_folds(spark):
    row = spark.range(1).select(quote_fold(F.lit("“A” ‘b’ — c… d\u00a0 \u00a0ﬁn")).alias("q")).first()
    assert row["q"] == "\"a\" 'b' - c... d fin"


def test_fold_of_every_character(spark):
    """The same as decomposing, dropping marks and keeping ASCII words, for the whole Basic Multilingual Plane."""
    def plain(text):
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F).lower()
        text = re.sub("[^a-z0-9-]+", " ", re.sub("[.,'\"`]", "", text))
        return text.strip()

    texts = [f"a{chr(c)}b" for c in (*range(1, 0xD800), *range(0xE000, 0x10000))] + ["Nguyễn Trần Hậu", "José Muñoz", "ǅorđe"]
    got = [r["f"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", basic("t").alias("f")).orderBy("i").collect()]
    assert [x for x in zip(texts, got) if plain(x[0]) != x[1]] == []


def test_one_bad_entity_is_kept(spark):
    page = "x &#99999999; &#1114112; &#xD800; &#0; &#99999999999999999999999; &#xFFFFFFFFFFFFFFFFFFFF; &#233;&#x00e9; y"
    got = spark.range(1).select(page_text(F.lit(page)).alias("t")).first()["t"]
    assert got == page.replace("&#233;&#x00e9;", "éé")


GOLDEN = {  # id: (verdict, reason, duplicate of)
    "L1": ("VALID", "ok", None), "L2": ("VALID", "ok", None), "L3": ("INVALID", "not_active", None), "L4": ("VALID", "ok", None),
    "L5": ("INVALID", "not_active", None), "L6": ("INVALID", "registered_after_signing", None), "L7": ("INVALID", "ok", "L1"),
    "L8": ("INVALID", "not_found", None), "L9": ("NEEDS_REVIEW", "probable_match", None), "L10": ("VALID", "ok", None),
    "L11": ("VALID", "ok", None), "L12": ("INVALID", "ok", "L11"), "L13": ("VALID", "ok", None),
}


def test_golden_batch(spark):
    ledger = validity.validate_batch(signers(spark), roll(spark), validity.StateContext("Ohio")).persist()
    got = {r["id"]: (r["verdict"], r["reason"], r["duplicate_of"]) for r in ledger.collect()}
    assert got == GOLDEN
    voters = [r.asDict() for r in people.standardize(roll(spark)).orderBy("row_pos").collect()]
    scores = {r["id"]: r["score"] for r in ledger.collect()}
    for row in people.standardize(signers(spark)).collect():
        assert scores[row["id"]] == pytest.approx(best_match(row.asDict(), voters)[0], abs=1e-9)
    counts = validity.verdict_counts(ledger)
    assert counts.first()[:5] == (13, 6, 6, 1, 2)
    slices = {(r["dim"], r["key"]): (r["valid"], r["total"]) for r in validity.yield_slices(ledger).collect()}
    assert slices[("gatherer", "Ines")] == (4, 5) and slices[("gatherer", "Kim")] == (0, 4)
    assert slices[("location", "30110")] == (2, 6) and slices[("capture", "digital")] == (3, 3)
    plan = validity.projection(counts, 10).first()
    assert (plan["target_raw"], plan["safe_to_submit"], plan["more_raw_needed"], plan["on_track"]) == (13, 6, 9, False)
    assert ledger.select(validity.reason_text()).first()[0]


def test_law_of_other_modes(spark):
    people_ = [("N1", "Signe Aaberg", "77 Coulee Ct, Minot 58701", "2026-04-01", "Ines", "wet")]
    out = validity.validate_rows(signers(spark, people_, attested=True), roll(spark), validity.StateContext("North Dakota"))
    assert out.first()["verdict"] == "NEEDS_REVIEW"
    voters = [("H1", "Thomas Quigley", "88 Passaic Ter, Nutley 07110", "active", "2019-02-02", None)]
    line = [("J1", "Tom Quigley", "88 Passaic Terrace, Nutley 07110", "2026-04-01", "Ines", "wet")]
    context = validity.StateContext("New Jersey", loaded_counties=("Essex",))
    for county, verdict in (("Essex", "VALID"), ("Bergen", "NEEDS_REVIEW"), (None, "NEEDS_REVIEW")):
        assert validity.validate_rows(signers(spark, line, county=county), roll(spark, voters, "Essex"), context).first()["verdict"] == verdict
    wrong = validity.validate_rows(signers(spark), roll(spark), validity.StateContext("Ohio", required_district="D-5"))
    assert {r["id"]: r["reason"] for r in wrong.collect()}["L1"] == "wrong_district"


def test_review_line_claims_the_voter(spark):
    lines = [("A", "Paul Abernathy", "733 Foundry Ave, Millbrook 30111", "2026-04-01", "x", "wet"),
             ("B", "Jennifer Abernathy", "733 Foundry Ave, Millbrook 30111", "2026-04-02", "x", "wet")]
    out = validity.validate_batch(signers(spark, lines), roll(spark), validity.StateContext("Ohio"))
    assert {r["id"]: (r["verdict"], r["duplicate_of"]) for r in out.collect()} == {"A": ("NEEDS_REVIEW", None), "B": ("INVALID", "A")}


def _random_people(rng: random.Random, n: int, prefix: str):
    first = ["Robert", "Roberta", "Bob", "R.", "Mary", "Maria", "Jon", "John", ""]
    last = ["Smith", "Smithe", "Smitt", "Smithson", "Smi", "Lee", "Leeds", ""]
    street = ["Main St", "Maine Street", "Oak Ave", "Oak Avenue N", ""]
    out = []
    for i in range(n):
        house = rng.choice(["1 ", "2 ", "17 ", ""])
        zip_ = rng.choice([" 62701", " 62702", ""])
        name = f"{rng.choice(first)} {rng.choice(last)}".strip()
        out.append((i, f"{prefix}{rng.randrange(n) if prefix == 'V' else i}", name, f"{house}{rng.choice(street)}, Town{zip_}"))
    return out


@pytest.mark.parametrize("seed, partitions, salted", [(1, "7", False), (2, "1", True)])
def test_staged_linkage_equals_brute_force(spark, monkeypatch, seed, partitions, salted):
    """Missing numbers, ZIPs and names, repeated ids, ties: the staged joins must find the same voter."""
    if salted:  # every key counts as hot
        monkeypatch.setattr(linkage, "NAMES_PER_TASK", 2)
    rng = random.Random(seed)
    voters = [(*v, "active", None, None, None) for v in _random_people(rng, 120, "V")]
    lines = [(*s, None, None, None, None, None) for s in _random_people(rng, 150, "S")]
    v, s = spark.createDataFrame(voters, ROLL), spark.createDataFrame(lines, SIGNER)
    roll_rows = [r.asDict() for r in people.standardize(v).orderBy("row_pos").collect()]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        weak = {r["id"]: r for r in linkage.link(s, v, weak_scores=True).collect()}
        plain = {r["id"]: r for r in linkage.link(s, v).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for row in people.standardize(s).collect():
        score, voter, candidates = best_match(row.asDict(), roll_rows)
        got = weak[row["id"]]
        assert got["score"] == pytest.approx(score, abs=1e-9), row
        assert got["best_voter_id"] == voter, row
        assert got["candidates_considered"] == candidates
        banded = score >= 0.7
        assert (plain[row["id"]]["voter"] is not None) == banded
        assert plain[row["id"]]["best_voter_id"] == (voter if banded else None)


def test_tie_at_the_bound_of_a_class_goes_to_the_first_row(spark):
    """A voter without a house number and one with the number only score alike; the first in the roll is taken."""
    voters = [(0, "B", "Ann Smith", "Main St, T 62701", "active", None, None, None), (1, "A", "Ann Smith", "12 Main St, T", "active", None, None, None)]
    line = [(0, "S", "Ann Smith", "12 Main St, T 62701", None, None, None, None, None)]
    got = linkage.link(spark.createDataFrame(line, SIGNER), spark.createDataFrame(voters, ROLL)).first()
    rows = [r.asDict() for r in people.standardize(spark.createDataFrame(voters, ROLL)).orderBy("row_pos").collect()]
    want = best_match(people.standardize(spark.createDataFrame(line, SIGNER)).first().asDict(), rows)
    assert (got["best_voter_id"], round(got["score"], 9)) == (want[1], round(want[0], 9))


def test_met_pairs_of_all_classes(spark):
    from turfline.operators import linkage

    person = lambda *rows: spark.createDataFrame([("smi", *r) for r in rows], ", ".join(f"{c} string" for c in linkage.PERSON))
    probes = person(("smith", "ann", "1", "elm st", "11111"), ("smith", "bo", "", "oak st", "22222"), ("", "cy", "1", "fir st", "11111"))
    people = person(("smith", "ann", "2", "elm st", "11111"), ("smith", "ann", "3", "ash st", "33333"), ("smith", "bo", "4", "bay st", "44444"),
                    ("smirnov", "zed", "1", "yew st", "55555"))
    names = {(r.met, r.a_first, r.b_first) for r in linkage.met_names(probes, people).collect()}
    assert names == {("same_number", "ann", "zed"), ("same_zip", "ann", "ann"), ("any_zip", "ann", "ann"), ("any_zip", "bo", "bo"), ("missing", "bo", "bo")}
    streets = {(r.met, r.a_street, r.b_street) for r in linkage.met_streets(probes, people).collect()}
    assert streets == {("same_number", "elm st", "yew st"), ("same_zip", "elm st", "elm st"), ("any_zip", "elm st", "elm st"), ("any_zip", "elm st", "ash st"),
                       ("any_zip", "oak st", "bay st"), ("missing", "oak st", "bay st")}
