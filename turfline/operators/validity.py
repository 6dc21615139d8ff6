"""State law on top of a match, duplicate detection inside a batch, and the batch report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions.text import text, zip_bare
from turfline.operators.linkage import link
from turfline.operators.ordering import in_group_order


@dataclass(frozen=True)
class StateContext:
    """What the law of one jurisdiction needs; the mode follows from the jurisdiction unless given."""

    jurisdiction: str
    mode: str | None = None
    required_district: str | None = None
    loaded_counties: tuple[str, ...] = ()
    voter_file_tier: str | None = None

    def resolved_mode(self) -> str:
        return self.mode or verification_mode(self.jurisdiction)


def verification_mode(jurisdiction: str) -> str:
    if jurisdiction in fixed.NO_REGISTRATION:
        return "residency-only"
    return "county-fan-out" if jurisdiction in fixed.COUNTY_FAN_OUT else "voter-file-match"


def judge(matched: DataFrame, context: StateContext) -> DataFrame:
    """Add verdict, reason code, reason argument and matched_voter_id to the output of ``link``."""
    return judge_columns(
        matched, F.lit(context.resolved_mode()), F.lit(context.required_district or ""),
        F.coalesce(F.col("county"), F.lit("")).isin(*context.loaded_counties) if context.loaded_counties
        else F.lit(False),
    )


def judge_columns(matched: DataFrame, mode: Column, district: Column, county_loaded: Column) -> DataFrame:
    """The same law with the context in columns, so one batch may span jurisdictions."""
    voter = F.col("voter")
    status, registered, home = text("voter.status"), text("voter.registered_on"), text("voter.district")
    signed = text("signed_on")
    rules: list[tuple[Column, str, str, Column, bool]] = [
        ((mode == "residency-only") & F.coalesce("attested_resident", F.lit(False)),
         "NEEDS_REVIEW", "residency_attested", F.lit(""), False),
        (mode == "residency-only", "NEEDS_REVIEW", "residency_not_attested", F.lit(""), False),
        ((mode == "county-fan-out") & ((text("county") == "") | ~county_loaded),
         "NEEDS_REVIEW", "county_not_loaded", F.coalesce(F.nullif(text("county"), F.lit("")), F.lit("unknown")), False),
        (F.col("band") == "NO_MATCH", "INVALID", "not_found", F.lit(""), False),
        (F.col("band") == "REVIEW", "NEEDS_REVIEW", "probable_match", F.lit(""), True),
        (status != "active", "INVALID", "not_active", status, True),
        ((signed != "") & (registered != "") & (registered > signed),
         "INVALID", "registered_after_signing", registered, True),
        ((district != "") & (home != "") & (home != district), "NEEDS_REVIEW", "wrong_district", home, True),
    ]
    default = F.struct(
        F.lit("VALID").alias("verdict"), F.lit("ok").alias("reason"), F.lit("").alias("reason_arg"),
        voter["id"].alias("matched_voter_id"))
    outcome = reduce(
        lambda rest, rule: F.when(rule[0], F.struct(
            F.lit(rule[1]).alias("verdict"), F.lit(rule[2]).alias("reason"), rule[3].alias("reason_arg"),
            (voter["id"] if rule[4] else F.lit(None).cast("string")).alias("matched_voter_id"))).otherwise(rest),
        reversed(rules), default)
    return matched.withColumn("_o", outcome).select("*", "_o.*").drop("_o")


def validate_rows(signers: DataFrame, roll: DataFrame, context: StateContext, weak_scores: bool = False) -> DataFrame:
    """Verdict of every signature on its own (no duplicate detection)."""
    return judge(link(signers, roll, weak_scores), context)


def drop_batch_duplicates(judged: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """The first non-INVALID line of a voter keeps its verdict; later ones become INVALID duplicates.

    ``within`` names columns whose values are batches of their own: a voter may sign once in each.

    The first line comes from a grouped minimum, which combines before the shuffle, so a voter signed
    for by a third of all lines is no hot window.
    """
    claim = F.col("matched_voter_id").isNotNull() & (F.col("verdict") != "INVALID")
    keys = [*within, "matched_voter_id"]
    first = judged.where(claim).groupBy(*keys).agg(F.min(F.struct("row_pos", "id")).alias("_first"))
    joined = judged.join(first, keys, "left")
    repeated = claim & (F.col("row_pos") > F.col("_first.row_pos"))
    return (
        joined.withColumn("is_duplicate", F.coalesce(repeated, F.lit(False)))
        .withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("_first.id")))
        .withColumn("verdict", F.when(F.col("is_duplicate"), "INVALID").otherwise(F.col("verdict")))
        .withColumn("reasons", F.when(
            F.col("is_duplicate"), F.array(F.lit("duplicate"), "reason")).otherwise(F.array("reason")))
        .drop("_first")
    )


def validate_batch(signers: DataFrame, roll: DataFrame, context: StateContext, weak_scores: bool = False) -> DataFrame:
    """The ledger: one row per signature with its final verdict."""
    return drop_batch_duplicates(validate_rows(signers, roll, context, weak_scores))


def reason_text() -> Column:
    """Readable reason; kept out of comparisons, the code and its argument are what counts."""
    code, arg, voter = F.col("reason"), F.col("reason_arg"), F.col("matched_voter_id")
    return (
        F.when(code == "ok", F.format_string("matches active voter %s", voter))
        .when(code == "probable_match", F.format_string("close to voter %s (%.2f), look again", voter, F.col("score")))
        .when(code == "not_active", F.format_string("voter %s is %s", voter, arg))
        .when(code == "registered_after_signing", F.format_string("voter %s registered on %s, after signing", voter, arg))
        .when(code == "wrong_district", F.format_string("voter %s lives in %s", voter, arg))
        .when(code == "county_not_loaded", F.format_string("roll of county %s is not loaded", arg))
        .otherwise(F.translate(code, "_", " "))
    )


# --- report -----------------------------------------------------------------------
def verdict_counts(ledger: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    valid = F.count_if(F.col("verdict") == "VALID")
    return ledger.agg(
        total.alias("total"), valid.alias("valid"),
        F.count_if(F.col("verdict") == "INVALID").alias("invalid"),
        F.count_if(F.col("verdict") == "NEEDS_REVIEW").alias("review"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.coalesce(F.try_divide(valid, total), F.lit(0.0)).alias("validity_rate"),
    )


def yield_slices(ledger: DataFrame) -> DataFrame:
    """Validity by gatherer, signer ZIP and capture kind; blank keys drop out.

    ``first_seen`` breaks ties when the slices are ordered by size.
    """
    long = ledger.select(
        "row_pos", (F.col("verdict") == "VALID").alias("ok"),
        F.explode(F.array(
            F.struct(F.lit("gatherer").alias("dim"), text("gatherer").alias("key")),
            F.struct(F.lit("location").alias("dim"), zip_bare("address").alias("key")),
            F.struct(F.lit("capture").alias("dim"), text("capture").alias("key")),
        )).alias("s"),
    )
    return (
        long.where(F.col("s.key") != "").groupBy(F.col("s.dim").alias("dim"), F.col("s.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"), F.min("row_pos").alias("first_seen"))
        .withColumn("rate", F.col("valid") / F.col("total"))
    )


def ordered_slices(slices: DataFrame) -> DataFrame:
    """Slices with their ``position`` in a report: the largest first, then by first appearance."""
    return in_group_order(slices, ["dim"], [F.desc("total"), F.col("first_seen")]).drop("group_size")


def projection(counts: DataFrame, required_valid: int, buffer: float = fixed.BATCH_BUFFER) -> DataFrame:
    """What is still to be gathered for ``required_valid``."""
    rate = F.when(F.col("validity_rate") > 0, F.col("validity_rate")).otherwise(F.lit(fixed.FALLBACK_RATE))
    missing = F.greatest(F.lit(0), F.lit(required_valid) - F.col("valid"))
    return counts.select(
        F.lit(required_valid).cast("long").alias("required_valid"), F.lit(buffer).alias("buffer"),
        F.ceil(F.lit(required_valid) * F.lit(buffer)).alias("target_raw"),
        F.col("valid").alias("safe_to_submit"),
        F.ceil(missing / rate).alias("more_raw_needed"),
        (F.col("valid") >= required_valid).alias("on_track"),
    )


def session_stats(ledger: DataFrame, pending: Column) -> DataFrame:
    """Counts of a shift log; anything that is neither VALID nor NEEDS_REVIEW counts as invalid."""
    total = F.count(F.lit(1))
    valid = F.count_if(F.col("verdict") == "VALID")
    review = F.count_if(F.col("verdict") == "NEEDS_REVIEW")
    return ledger.agg(
        total.alias("total"), valid.alias("valid"), review.alias("review"),
        (total - valid - review).alias("invalid"), F.count_if(pending).alias("pending"),
        F.coalesce(F.try_divide(valid, total), F.lit(0.0)).alias("validity_rate"),
    )


def distribution_check(ledger: DataFrame, per_district: int, districts_needed: int) -> DataFrame:
    """Statewide count against the count of districts that reach their own threshold."""
    by_district = ledger.where("verdict = 'VALID'").groupBy("district").agg(F.count(F.lit(1)).alias("valid"))
    return by_district.agg(
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"),
        F.count(F.lit(1)).alias("districts"),
        F.count_if(F.col("valid") >= per_district).alias("districts_passing"),
        F.coalesce(F.bool_and(F.col("valid") >= per_district), F.lit(False)).alias("every_district_passes"),
        (F.count_if(F.col("valid") >= per_district) >= districts_needed).alias("distribution_met"),
    )


def reconcile(captured: DataFrame, roll: DataFrame, context: StateContext) -> DataFrame:
    """Validate stored captures again over the full roll and show which verdicts flip; each campaign is a batch.

    ``captured`` has campaign_id, gatherer_id, seq, name, address, verdict and row_pos.
    """
    keys = ["campaign_id", "gatherer_id", "seq"]
    lines = captured.select(
        "row_pos", *keys, "name", "address", F.col("verdict").alias("client_verdict"),
        F.to_json(F.struct(*keys)).alias("id"), F.lit(None).cast("string").alias("signed_on"),
        F.lit(None).cast("string").alias("county"), F.lit(None).cast("boolean").alias("attested_resident"),
    )
    checked = drop_batch_duplicates(judge(link(lines, roll), context), ("campaign_id",))
    return checked.select(
        *keys, "client_verdict", "verdict", "matched_voter_id", "is_duplicate",
        (F.col("client_verdict") != F.col("verdict")).alias("flipped"),
    )
