"""Queries over rule records, the risk board, quality checks, freshness, compliance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions.text import text
from turfline.sources.adapters import LAYOUTS


def rule_query(
    rules: DataFrame, petition_type: str | None = None, per_signature: str | None = None,
    file_tier: str | None = None, free_file: bool = False, gate: str | None = None,
    min_signatures: int | None = None, max_signatures: int | None = None,
    residency_required: bool | None = None, contains: str | None = None,
) -> DataFrame:
    """Rule records passing every given condition."""
    pay = F.col("compensation.perSignatureAllowed")
    tests: list[Column] = []
    if petition_type:
        tests.append(F.col("petitionType") == petition_type)
    if contains:
        tests.append(F.lower(F.concat_ws(" ", "jurisdiction", "abbr")).contains(contains.lower()))
    if per_signature == "go":
        tests.append(~pay.eqNullSafe(F.lit("no")))
    elif per_signature:
        tests.append(pay == per_signature)
    if file_tier:
        tests.append(F.col("voterFile.tier") == file_tier)
    if free_file:
        tests.append(F.col("voterFile.tier") == "FREE_DOWNLOAD")
    if gate:
        tests.append(F.col("verification.gate") == gate)
    if max_signatures is not None:
        tests.append(F.col("signatures.required") <= max_signatures)
    if min_signatures is not None:
        tests.append(F.col("signatures.required") >= min_signatures)
    if residency_required is not None:
        tests.append(residency_applies("compensation.circulatorResidency") == F.lit(residency_required))
    return rules.where(reduce(lambda a, b: a & b, tests)) if tests else rules


def residency_applies(value) -> Column:
    """Any wording counts as required unless it says not required, none or n/a."""
    wording = text(value)
    return (wording != "") & ~wording.rlike(fixed.NO_RESIDENCY)


def rule_lookup(rules: DataFrame, key: str) -> DataFrame:
    """One record by id, abbreviation or jurisdiction; the first in publishing order."""
    wanted = key.strip().lower()
    hit = (F.lower("id") == wanted) | (F.lower("abbr") == wanted) | (F.lower("jurisdiction") == wanted)
    return rules.where(hit).orderBy("jurisdiction", "id").limit(1)


def risk_board(rules: DataFrame, lens: str = "critical") -> DataFrame:
    """Gate tallies, status and rank per record; ``all`` looks at every field, ``critical`` at three."""
    critical = F.col("r.field").isin(*fixed.CRITICAL_FIELDS)
    blocked, held = F.col("r.gate") == "BLOCKED", F.col("r.gate") == "CONSERVATIVE-HOLD"
    tally = rules.select(
        "id", "jurisdiction", F.coalesce("verification.sosInquiries", F.lit(0)).alias("inquiries"),
        F.explode_outer("rules").alias("r"))
    board = tally.groupBy("id", "jurisdiction", "inquiries").agg(
        F.count_if(critical & held).alias("critical_hold"), F.count_if(critical & blocked).alias("critical_blocked"),
        F.count_if(~critical & held).alias("minor_hold"), F.count_if(~critical & blocked).alias("minor_blocked"))
    holds = F.col("critical_hold") + F.col("minor_hold")
    blocks = F.col("critical_blocked") + F.col("minor_blocked")
    if lens == "critical":
        status = F.when(F.col("critical_blocked") > 0, "red").when(F.col("critical_hold") > 0, "amber").otherwise("green")
        rank = F.when(F.col("critical_blocked") > 0, 0).when(F.col("critical_hold") > 0, 1).otherwise(3)
    else:
        status = F.when(blocks > 0, "red").when(holds > 0, "amber").otherwise("green")
        rank = F.when(blocks > 0, 0).when(F.col("critical_hold") > 0, 1).when(holds > 0, 2).otherwise(3)
    return board.withColumn("status", status).withColumn("rank", rank)


def board_totals(board: DataFrame) -> DataFrame:
    """Header of a board: records, how many are clear, in review and blocked, and all open inquiries."""
    return board.agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("green", "clear"), ("amber", "review"), ("red", "blocked"))],
        F.coalesce(F.sum("inquiries"), F.lit(0)).alias("inquiries"))


def filter_board(board: DataFrame, status: str = "all", contains: str = "", sort: str = "risk") -> DataFrame:
    kept = board if status == "all" else board.where(F.col("status") == status)
    if contains:
        kept = kept.where(F.lower("jurisdiction").contains(contains.lower()))
    orders = {"name": ["jurisdiction"], "sos": [F.desc("inquiries"), "jurisdiction"], "risk": ["rank", "jurisdiction"]}
    return kept.orderBy(*orders[sort])


def rules_coverage(rules: DataFrame) -> DataFrame:
    """Tallies by petition type, gate, file tier and pay rule, and whole-table totals, as (facet, key, n)."""
    facets = F.array(
        F.struct(F.lit("petition_type").alias("facet"), F.col("petitionType").alias("key"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("gate").alias("facet"), F.col("verification.gate").alias("key"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("file_tier").alias("facet"), F.coalesce("voterFile.tier", F.lit("UNKNOWN")).alias("key"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("per_signature").alias("facet"), F.coalesce("compensation.perSignatureAllowed", F.lit("unknown")).alias("key"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("total").alias("facet"), F.lit("records").alias("key"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("total").alias("facet"), F.lit("citations").alias("key"), F.size("citations").cast("long").alias("n")),
        F.struct(F.lit("total").alias("facet"), F.lit("inquiries").alias("key"), F.coalesce("verification.sosInquiries", F.lit(0).cast("long")).alias("n")),
    )
    tallies = rules.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.key").agg(F.sum("f.n").alias("n"))
    places = rules.agg(F.count_distinct("abbr").alias("n")).select(
        F.lit("total").alias("facet"), F.lit("jurisdictions").alias("key"), "n")
    return tallies.unionByName(places)


def rule_violations(rules: DataFrame) -> DataFrame:
    """One row per broken expectation: (id, path, problem)."""
    def missing(path: str) -> Column:
        return F.when(F.col(path).isNull(), F.struct(F.lit(path).alias("path"), F.lit("required").alias("problem")))

    def outside(path: str, allowed: tuple[str, ...]) -> Column:
        bad = F.col(path).isNotNull() & ~F.col(path).isin(*allowed)
        return F.when(bad, F.struct(F.lit(path).alias("path"), F.lit("enum").alias("problem")))

    def broken(path: str, bad: Column, problem: str) -> Column:
        return F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(problem).alias("problem")))

    def per_rule(bad, part: str, problem: str) -> Column:
        hits = F.filter(F.transform("rules", lambda r, i: F.struct(
            F.concat(F.lit("rules["), i, F.lit(f"].{part}")).alias("path"), F.lit(problem).alias("problem"),
            bad(r).alias("bad"))), lambda x: F.coalesce(x["bad"], F.lit(False)))
        return F.transform(hits, lambda x: F.struct(x["path"].alias("path"), x["problem"].alias("problem")))

    single = F.array(
        *[missing(p) for p in ("schemaVersion", "id", "jurisdiction", "abbr", "petitionType", "signatures", "deadline",
                               "verification", "provenance")],
        F.when(F.col("signatures").isNotNull(), missing("signatures.required")),
        F.when(F.col("verification").isNotNull(), missing("verification.gate")),
        outside("schemaVersion", (fixed.RULE_SCHEMA_VERSION,)),
        outside("petitionType", fixed.PETITION_TYPES), outside("compensation.perSignatureAllowed", fixed.PAY_RULES),
        outside("voterFile.tier", fixed.FILE_TIERS), outside("verification.gate", fixed.GATES),
        outside("compensation.gate", fixed.GATES), outside("circulator.gate", fixed.GATES),
        broken("abbr", ~F.col("abbr").rlike("^[A-Z]{2}$"), "pattern"),
        broken("signatures.required", F.col("signatures.required") < 0, "minimum"),
        broken("verification.sosInquiries", F.col("verification.sosInquiries") < 0, "minimum"),
    )
    listed = F.concat(
        per_rule(lambda r: r["field"].isNull(), "field", "required"),
        per_rule(lambda r: r["gate"].isNull(), "gate", "required"),
        per_rule(lambda r: r["gate"].isNotNull() & ~r["gate"].isin(*fixed.GATES), "gate", "enum"),
        per_rule(lambda r: (r["confidence"] < 0) | (r["confidence"] > 1), "confidence", "range"),
    )
    everything = F.concat(F.array_compact(single), F.coalesce(listed, F.array().cast("array<struct<path:string,problem:string>>")))
    return rules.select("id", F.explode(everything).alias("v")).select("id", "v.path", "v.problem")


def freshness(records: DataFrame, today: str) -> DataFrame:
    """Due date, days left and status per record; ``records`` has label, verified_as_of, window_days."""
    due = F.date_add(F.col("verified_as_of").try_cast("date"), F.col("window_days").cast("int"))
    left = F.datediff(due, F.lit(today).cast("date"))
    return records.withColumn("due", due).withColumn("days_left", left).withColumn(
        "state", F.when(F.col("due").isNull(), "unknown").when(F.col("days_left") < 0, "stale")
        .when(F.col("days_left") <= fixed.SOON_DAYS, "soon").otherwise("fresh"))


def layout_freshness(files: DataFrame, today: str, window_days: int = fixed.LAYOUT_DAYS) -> DataFrame:
    """Freshness of the layouts that roll files use (label, jurisdiction, verified_as_of), with a flag on doubtful ones."""
    low = [layout.jurisdiction for layout in LAYOUTS.values() if layout.confidence == "low"]
    flag = F.when(F.col("state") == "unknown", "no verification date").when(F.col("jurisdiction").isin(low), "low confidence")
    return freshness(files.withColumn("window_days", F.lit(window_days)), today).withColumn("flag", flag)


def freshness_summary(assessed: DataFrame) -> DataFrame:
    """Counts per state, the soonest due date and how many records share it, per group."""
    per_due = assessed.groupBy("group", "due").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("state") == s).alias(s) for s in ("fresh", "soon", "stale", "unknown")])
    return per_due.groupBy("group").agg(
        F.sum("n").alias("records"),
        *[F.sum(s).alias(s) for s in ("fresh", "soon", "stale", "unknown")],
        F.min("due").alias("next_due"), F.min_by("n", "due").alias("tied"))


def campaign_compliance(campaigns: DataFrame, rules: DataFrame) -> DataFrame:
    """Pay basis and residency rule of each campaign's (jurisdiction, petition type); strict when unknown."""
    law = rules.select(
        "jurisdiction", F.col("petitionType").alias("petition_type"),
        F.col("compensation.perSignatureAllowed").alias("pay"),
        residency_applies("compensation.circulatorResidency").alias("residency"),
        F.col("verification.gate").alias("gate"))
    joined = campaigns.join(law, ["jurisdiction", "petition_type"], "left")
    pays = (F.col("pay").isin("yes", "unaddressed")) & (F.col("gate") == "AUTO-LIVE")
    return joined.select(
        *campaigns.columns, F.coalesce("pay", F.lit("unknown")).alias("pay_rule"),
        F.when(pays, "per-valid-signature").otherwise("hourly").alias("basis"),
        F.coalesce("residency", F.lit(True)).alias("residency_required"),
        F.coalesce("gate", F.lit("BLOCKED")).alias("gate"))
