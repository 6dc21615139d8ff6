"""Record linkage of petition lines to a voter roll.

Every signer has to be compared with all voters that share the first three letters of the last name.
Such a block can hold a third of the roll, so the pairs of a block are never enumerated.  The score
is a weighted sum, which gives an exact upper bound for every class of pair and with it the classes
that can reach the review band at all:

* same house number                 - equi-join on (block, number);
* same ZIP, other house number      - names must score at least 0.807;  equi-join on (name, ZIP);
* other ZIP and other house number  - names must score at least 0.888;  equi-join on the name,
  against the distinct streets of that name;
* number or ZIP missing on one side - names must score at least 0.673;  equi-join on the name, only
  for the incomplete rows of either side.

The name joins go through the distinct names of a block (names repeat far more often than people) and
only serve signers whose best same-number pair does not already beat the bound of the class.  A class
may underrate a pair that also belongs to a better class; the maximum over all classes is exact.
Both sides are reduced to distinct standardized people first, keeping the earliest roll position,
which is also how ties are broken.  Hot keys: the joins on people are large on their input side, so the
adaptive skew join splits them; the join of distinct names has a small input and a quadratic output, which
no size statistic shows, so it is salted explicitly (``salted_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions.people import standardize
from turfline.functions.similarity import jaro_winkler
from turfline.functions.text import zip_trailing, zip_trailing_plus4
from turfline.operators.skew import salted_join
from turfline.session import stage

PERSON = ["block", "last", "first", "number", "street", "zip5"]
PLACE = ["block", "last", "first", "street", "zip5", "numbered"]
NAME = ["block", "last", "first"]
PAYLOAD = ["id", "status", "registered_on", "county", "district"]
_SLACK = 1e-9
NAMES_PER_TASK = 500  # signer names of one block that a single task compares with the block


def _reach(number: float, zip_: float) -> float:
    """Highest score with perfect names and street."""
    address = fixed.NUMBER_WEIGHT * number + fixed.STREET_WEIGHT + fixed.ZIP_WEIGHT * zip_
    return fixed.NAME_WEIGHT + fixed.ADDRESS_WEIGHT * address


def _name_floor(number: float, zip_: float) -> float:
    """Lowest name score that can still reach the review band."""
    return (fixed.REVIEW_AT - (_reach(number, zip_) - fixed.NAME_WEIGHT)) / fixed.NAME_WEIGHT - _SLACK


# --- scores ---------------------------------------------------------------------
def name_score(a: str = "a_", b: str = "b_") -> Column:
    """0.6 last + 0.4 first; an initial against a full first name counts 0.85."""
    last_a, last_b, first_a, first_b = (F.col(x) for x in (a + "last", b + "last", a + "first", b + "first"))
    initial = (
        (first_a != "") & (first_b != "") & (F.substring(first_a, 1, 1) == F.substring(first_b, 1, 1))
        & ((F.length(first_a) == 1) | (F.length(first_b) == 1))
    )
    first = (
        F.when((first_a != "") & (first_a == first_b), 1.0)
        .when(initial, fixed.INITIAL_SCORE)
        .otherwise(jaro_winkler(first_a, first_b))
    )
    whole = F.lit(fixed.LAST_WEIGHT) * jaro_winkler(last_a, last_b) + F.lit(fixed.FIRST_WEIGHT) * first
    return F.when((last_a == "") | (last_b == ""), F.lit(0.0)).otherwise(whole)


def _equality(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), F.lit(fixed.MISSING_PART)).when(a == b, 1.0).otherwise(0.0)


def zip_score(a: str = "a_", b: str = "b_") -> Column:
    return _equality(F.col(a + "zip5"), F.col(b + "zip5"))


def number_score(a: str = "a_", b: str = "b_") -> Column:
    return _equality(F.col(a + "number"), F.col(b + "number"))


def street_score(a: str = "a_", b: str = "b_") -> Column:
    left, right = F.col(a + "street"), F.col(b + "street")
    return F.when((left == "") | (right == ""), F.lit(fixed.MISSING_PART)).otherwise(jaro_winkler(left, right))


def address_score(number: Column, street: Column, zip_: Column) -> Column:
    return (
        F.lit(fixed.NUMBER_WEIGHT) * number + F.lit(fixed.STREET_WEIGHT) * street + F.lit(fixed.ZIP_WEIGHT) * zip_
    )


def total_score(name: Column, address: Column) -> Column:
    return F.lit(fixed.NAME_WEIGHT) * name + F.lit(fixed.ADDRESS_WEIGHT) * address


def band(score: Column) -> Column:
    return (
        F.when(score >= fixed.MATCH_AT, "MATCH").when(score >= fixed.REVIEW_AT, "REVIEW").otherwise("NO_MATCH")
    )


# --- sides ------------------------------------------------------------------------
def _prefixed(df: DataFrame, columns: list[str], prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns], *keep)


def roll_people(roll_std: DataFrame, payload: list[str] = PAYLOAD) -> DataFrame:
    """Distinct standardized people of a roll with their earliest row.

    Inside a block a repeated voter id counts once, at its first position.
    """
    voter = F.struct("row_pos", *payload).alias("voter")
    by_id = roll_std.groupBy("block", "id").agg(
        F.min_by(F.struct(*[c for c in PERSON if c != "block"], voter), "row_pos").alias("v")
    )
    return (
        by_id.select("block", "v.*")
        .groupBy(*PERSON).agg(F.min_by("voter", F.col("voter.row_pos")).alias("voter"))
    )


def block_sizes(roll_std: DataFrame) -> DataFrame:
    """Distinct voter ids per block: the number of candidates every signer of the block has."""
    ids = roll_std.select("block", "id").distinct()
    return ids.groupBy("block").agg(F.count(F.lit(1)).alias("candidates_considered"))


def candidate_counts(signers_std: DataFrame, roll_std: DataFrame) -> DataFrame:
    """Per signer: its block and how many voters it has to be compared with."""
    return signers_std.join(block_sizes(roll_std), "block", "left").select(
        F.col("id").alias("signer_id"), "block",
        F.coalesce("candidates_considered", F.lit(0)).cast("long").alias("candidates_considered"),
    )


# --- pairs --------------------------------------------------------------------------
def _scored(pairs: DataFrame, number: Column, name: Column | None = None) -> DataFrame:
    pairs = pairs.withColumn("name_score", name_score() if name is None else name)
    pairs = pairs.withColumn("addr_score", address_score(number, street_score(), zip_score()))
    return pairs.withColumn("score", total_score(F.col("name_score"), F.col("addr_score")))


def _best_of(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Highest score per key, earliest roll position on ties; combines map-side."""
    order = F.struct(F.col("score").alias("s"), (-F.col("voter.row_pos")).alias("p"))
    return pairs.groupBy(*key).agg(
        F.max_by(F.struct("score", "name_score", "addr_score", "voter"), order).alias("best"))


def same_number_pairs(probes: DataFrame, people: DataFrame) -> DataFrame:
    """All pairs of one block with the same house number, scored."""
    a = _prefixed(probes.where("number <> '' and last <> ''"), PERSON, "a_")
    b = _prefixed(people.where("number <> '' and last <> ''"), PERSON, "b_", ("voter",))
    pairs = a.join(b, (F.col("a_block") == F.col("b_block")) & (F.col("a_number") == F.col("b_number")))
    return _scored(pairs, F.lit(1.0))


def name_neighbours(probe_names: DataFrame, roll_names: DataFrame) -> DataFrame:
    """Distinct names of a block that are close enough to reach the review band."""
    a = _prefixed(probe_names, NAME, "a_")
    b = _prefixed(roll_names, NAME, "b_")
    pairs = salted_join(a.withColumn("b_block", F.col("a_block")), b, ["b_block"], NAMES_PER_TASK)
    pairs = pairs.withColumn("name_score", name_score())
    return pairs.where(F.col("name_score") >= _name_floor(fixed.MISSING_PART, 1.0))


def _earliest(people: DataFrame, key: list[str]) -> DataFrame:
    return people.groupBy(*key).agg(F.min_by("voter", F.col("voter.row_pos")).alias("voter"))


def near_name_pairs(open_probes: DataFrame, people: DataFrame) -> DataFrame:
    """Scored pairs without a shared house number that can still beat ``floor`` of the probe.

    ``open_probes`` has PLACE plus ``floor``.  Pairs come back per place of the probe.
    """
    seats = _earliest(people.where("last <> ''").withColumn("numbered", F.col("number") != ""), PLACE)
    neighbours = stage(
        name_neighbours(open_probes.select(*NAME).distinct(), seats.select(*NAME).distinct()), "neighbours")
    name_key = ["b_block", "b_last", "b_first"]
    zero, half = F.lit(0.0), F.lit(fixed.MISSING_PART)

    def meet(probes: DataFrame, names: DataFrame) -> DataFrame:
        return _prefixed(probes, PLACE, "a_", ("floor",)).join(names, ["a_block", "a_last", "a_first"])

    def near(number: float, zip_: float) -> DataFrame:
        return neighbours.where(F.col("name_score") >= _name_floor(number, zip_))

    def reachable(number: Column, zip_: Column) -> Column:
        bound = total_score(F.col("name_score"), address_score(number, F.lit(1.0), zip_))
        return bound >= F.greatest(F.col("floor"), F.lit(fixed.REVIEW_AT)) - _SLACK

    def scored(pairs: DataFrame, number: Column, zip_: Column) -> DataFrame:
        address = address_score(number, street_score(), zip_)
        return (
            pairs.withColumn("addr_score", address)
            .withColumn("score", total_score(F.col("name_score"), F.col("addr_score")))
            .where(F.col("score") >= fixed.REVIEW_AT)
            .select(*[f"a_{c}" for c in PLACE], "voter", "name_score", "addr_score", "score")
        )

    zip_seats = _prefixed(
        _earliest(seats.where("zip5 <> ''"), [*NAME, "zip5", "street"]), [*NAME, "zip5", "street"], "b_", ("voter",))
    same_zip = (
        meet(open_probes.where("zip5 <> ''"), near(0.0, 1.0)).where(reachable(zero, F.lit(1.0)))
        .withColumn("b_zip5", F.col("a_zip5")).join(zip_seats, [*name_key, "b_zip5"])
    )
    street_seats = _prefixed(_earliest(seats, [*NAME, "street"]), [*NAME, "street"], "b_", ("voter",))
    any_zip = meet(open_probes, near(0.0, 0.0)).where(reachable(zero, zero)).join(street_seats, name_key)
    incomplete = (F.col("zip5") == "") | ~F.col("numbered")
    b, partial_b = (_prefixed(df, PLACE, "b_", ("voter",)) for df in (seats, seats.where(incomplete)))
    number = F.when(F.col("a_numbered") & F.col("b_numbered"), zero).otherwise(half)
    missing = (
        meet(open_probes.where(incomplete), neighbours).join(b, name_key)
        .unionByName(
            meet(open_probes.where(~incomplete), neighbours.join(partial_b.select(*name_key).distinct(), name_key, "left_semi"))
            .join(partial_b, name_key))
        .where(reachable(number, zip_score()))
    )
    return (
        scored(same_zip, zero, F.lit(1.0))
        .unionByName(scored(any_zip, zero, zero))
        .unionByName(scored(missing, number, zip_score()))
    )


def _met(probes: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides by person with a last name, and the staged near names between them."""
    a = stage(probes.where("last <> ''").select(*PERSON).distinct(), "probes")
    b = stage(people.where("last <> ''").select(*PERSON).distinct(), "people")
    near = stage(name_neighbours(a.select(*NAME).distinct(), b.select(*NAME).distinct()), "neighbours")
    return a, b, near


def _meetings(a: DataFrame, b: DataFrame, near: DataFrame, columns: list[str]) -> DataFrame:
    """(met, a_ and b_ columns): the distinct values of ``columns`` that meet in each class of pairs, as ``link`` meets them without a floor.

    Every side is reduced to the columns and the keys of its class before it is joined.
    """
    name = lambda p: [f"{p}_{c}" for c in NAME]

    def side(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
        return _prefixed(df, list(dict.fromkeys([*keys, *columns])), f"{p}_").distinct()

    def meet(met: str, left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
        names = near.where(F.col("name_score") >= floor)
        keys = [*NAME, "zip5"] if met == "same_zip" else NAME
        pairs = side(left, "a", keys).join(names, name("a"))
        if met == "same_zip":
            return out(met, pairs.withColumn("b_zip5", F.col("a_zip5")).join(side(right, "b", keys), [*name("b"), "b_zip5"]))
        return out(met, pairs.join(side(right, "b", keys), name("b")))

    def out(met: str, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.lit(met).alias("met"), *[f"a_{c}" for c in columns], *[f"b_{c}" for c in columns])

    numbered = [side(df.where("number <> ''"), p, ["block", "number"]) for df, p in ((a, "a"), (b, "b"))]
    same = numbered[0].join(numbered[1], (F.col("a_block") == F.col("b_block")) & (F.col("a_number") == F.col("b_number")))
    incomplete = "number = '' OR zip5 = ''"
    missing = _name_floor(fixed.MISSING_PART, 1.0)
    return (
        out("same_number", same)
        .unionByName(meet("same_zip", a.where("zip5 <> ''"), b.where("zip5 <> ''"), _name_floor(0.0, 1.0)))
        .unionByName(meet("any_zip", a, b, _name_floor(0.0, 0.0)))
        .unionByName(meet("missing", a.where(incomplete), b, missing))
        .unionByName(meet("missing", a.where(f"NOT ({incomplete})"), b.where(incomplete), missing))
        .distinct()
    )


def met_names(probes: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct name pairs of all four classes of pairs with their score; PERSON columns on both sides."""
    a, b, near = _met(probes, people)
    pairs, key = stage(_meetings(a, b, near, NAME), "meetings"), [f"{p}_{c}" for p in "ab" for c in NAME]
    known = near.select(*key, "name_score")  # what brought names together is scored already; the rest shares a house number only
    return pairs.join(known, key).unionByName(pairs.join(known, key, "left_anti").withColumn("name_score", name_score()))


def met_streets(probes: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct street pairs of all four classes of pairs with their score; PERSON columns on both sides."""
    a, b, near = _met(probes, people)
    return _meetings(a, b, near, ["street"]).withColumn("street_score", street_score())


def _weak_pairs(probes: DataFrame, people: DataFrame) -> DataFrame:
    """Every pair of a block, for signers that have no pair in a band; reduced inside the join task."""
    a = _prefixed(probes, PERSON, "a_")
    b = _prefixed(people, PERSON, "b_", ("voter",))
    pairs = salted_join(a.withColumn("b_block", F.col("a_block")), b, ["b_block"], NAMES_PER_TASK)
    return _scored(pairs, number_score())


def best_matches(signers_std: DataFrame, roll_std: DataFrame, weak_scores: bool = False) -> DataFrame:
    """Best voter per distinct signer person: PERSON, score, name_score, addr_score, voter.

    People without a pair in the REVIEW or MATCH band are absent, unless ``weak_scores`` asks for their
    best (for the verdict meaningless) score as well.  The reduced roll and the same-number stage feed
    several joins, so each is staged once.
    """
    people = stage(roll_people(roll_std), "people")
    probes = signers_std.select(*PERSON).distinct()
    first = _best_of(
        same_number_pairs(probes, people).where(F.col("score") >= fixed.REVIEW_AT), [f"a_{c}" for c in PERSON])
    first = first.select(*[F.col(f"a_{c}").alias(c) for c in PERSON], "best")
    staged = stage(probes.join(first, PERSON, "left").withColumn("numbered", F.col("number") != ""), "probes")
    waiting = staged.where("last <> ''").where(
        F.col("best").isNull() | (F.col("best.score") <= _reach(fixed.MISSING_PART, 1.0) + _SLACK))
    open_probes = waiting.groupBy(*PLACE).agg(F.min(F.coalesce("best.score", F.lit(0.0))).alias("floor"))
    second = _best_of(near_name_pairs(open_probes, people), [f"a_{c}" for c in PLACE]).select(
        *[F.col(f"a_{c}").alias(c) for c in PLACE], F.col("best").alias("near"))

    both = staged.join(second, PLACE, "left")
    near_wins = F.col("near").isNotNull() & (
        F.col("best").isNull()
        | (F.col("near.score") > F.col("best.score"))
        | ((F.col("near.score") == F.col("best.score")) & (F.col("near.voter.row_pos") < F.col("best.voter.row_pos")))
    )
    best = both.withColumn("best", F.when(near_wins, F.col("near")).otherwise(F.col("best")))
    best = stage(best.select(*PERSON, "best"), "best")
    banded = best.where(F.col("best").isNotNull()).select(*PERSON, "best.*")
    if not weak_scores:
        return banded
    weak = _best_of(_weak_pairs(best.where(F.col("best").isNull()).select(*PERSON), people), [f"a_{c}" for c in PERSON])
    return banded.unionByName(weak.select(*[F.col(f"a_{c}").alias(c) for c in PERSON], "best.*"))


def link(
    signers: DataFrame, roll: DataFrame, weak_scores: bool = False, block_by_zip: bool = False
) -> DataFrame:
    """Match result per signer line; signers without a candidate are kept.

    ``block_by_zip`` confines every signer to the voters of its own ZIP shard: the trailing ZIP of the
    line against the ``zip5`` of the roll row.

    Adds band, score, name_score, addr_score, voter (struct, null unless banded), best_voter_id and
    candidates_considered to the signer columns.
    """
    signers_std, roll_std = standardize(signers), standardize(roll)
    if block_by_zip:
        shard = lambda zip_: F.concat_ws("@", "block", zip_)
        signers_std = signers_std.withColumn("block", shard(zip_trailing_plus4("address")))
        roll_std = roll_std.withColumn("block", shard(zip_trailing("address")))
    signers_std, roll_std = stage(signers_std, "signers"), stage(roll_std, "roll")
    best = best_matches(signers_std, roll_std, weak_scores)
    none = F.lit(0.0)
    return (
        signers_std.join(block_sizes(roll_std), "block", "left").join(best, PERSON, "left")
        .withColumn("candidates_considered", F.coalesce("candidates_considered", F.lit(0)).cast("long"))
        .withColumn("band", F.coalesce(band(F.col("score")), F.lit("NO_MATCH")))
        .withColumn("best_voter_id", F.col("voter.id"))
        .withColumn("voter", F.when(F.col("band") != "NO_MATCH", F.col("voter")))
        .withColumn("score", F.coalesce("score", none))
        .withColumn("name_score", F.coalesce("name_score", none))
        .withColumn("addr_score", F.coalesce("addr_score", none))
    )
