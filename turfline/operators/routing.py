"""Where the next hour is worth most, and what the rest costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline import fixed
from turfline.operators.ordering import first_in_group, in_group_order
from turfline.operators.yields import smoothed
from turfline.session import stage

def rows_of(columns: tuple[str, ...], rows: tuple[tuple, ...]) -> Column:
    """A small fixed table as an array of structs; exploding it needs no join."""
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows])


def required_signatures(jurisdiction: Column) -> Column:
    """Required count per jurisdiction from the fixed table, with its default."""
    table = ";".join(f"{k}:{v}" for k, v in fixed.REQUIRED_SIGNATURES.items())
    found = F.element_at(F.str_to_map(F.lit(table), F.lit(";"), F.lit(":")), jurisdiction)
    return F.coalesce(found.cast("long"), F.lit(fixed.REQUIRED_SIGNATURES_DEFAULT).cast("long"))


def shadow_prices(drives: DataFrame) -> DataFrame:
    """Deficit, needed valid per day and tier; ``drives``: state, target, collected, days_left."""
    deficit = F.greatest(F.lit(0), F.col("target") - F.col("collected"))
    priced = drives.withColumn("deficit", deficit).withColumn(
        "need_per_day", F.col("deficit") / F.greatest(F.col("days_left"), F.lit(1)))
    return priced.withColumn("tier", F.when(F.col("need_per_day") == 0, "done")
                             .when(F.col("need_per_day") > fixed.CRITICAL_ABOVE, "critical")
                             .when(F.col("need_per_day") > fixed.BEHIND_ABOVE, "behind").otherwise("on track"))


def drive_board(drives: DataFrame) -> DataFrame:
    """All jurisdictions by urgency, qualified ones last: ``position`` and the share of the required count as ``fill_pct``."""
    priced = shadow_prices(drives).withColumn("qualified", F.col("collected") >= F.col("required")).withColumn("_all", F.lit(1))
    placed = in_group_order(priced, ["_all"], [F.col("qualified"), F.desc("need_per_day"), F.col("state")])
    share = F.floor(F.lit(100.0) * F.col("collected") / F.col("required") + 0.5)
    return placed.withColumn("fill_pct", F.least(F.lit(100), share)).drop("_all", "group_size")


def value_board(drives: DataFrame, top: int = fixed.TURF_TOP) -> DataFrame:
    """The jurisdictions where an hour is worth most; finished ones have no value."""
    return shadow_prices(drives).where("deficit > 0").orderBy(F.desc("need_per_day"), "state").limit(top)


def valid_per_hour(raw: Column, validity: Column, digital: bool = False) -> Column:
    if digital:
        return raw * fixed.DIGITAL_VALIDITY
    return raw * F.least(F.lit(fixed.VALIDITY_CAP), validity + fixed.VALIDATION_BOOST)


def next_best(drives: DataFrame, hours: float) -> DataFrame:
    """Best kind of spot per jurisdiction for one volunteer, and a nudge when another needs far more."""
    priced = shadow_prices(drives)
    hottest = priced.where("deficit > 0").agg(
        F.max("need_per_day").alias("_top"), F.max_by("state", F.struct("need_per_day", "state")).alias("hottest"))
    spots = priced.withColumn("_o", F.explode(rows_of(("spot", "raw", "validity"), fixed.OPPORTUNITIES)))
    rate = valid_per_hour(F.col("_o.raw"), F.col("_o.validity"))
    expected = F.least(F.col("deficit").cast("double"), rate * F.lit(hours))
    scored = spots.withColumn("expected_valid", expected).withColumn(
        "value", F.col("expected_valid") * F.col("need_per_day"))
    best = scored.groupBy("state").agg(F.max_by(
        F.struct(F.col("_o.spot").alias("spot"), "expected_valid", "value", "need_per_day"),
        F.struct("value", F.col("_o.raw").alias("r"))).alias("b"))
    return best.select("state", "b.*").crossJoin(hottest).select(
        "state", "spot", "expected_valid", "value",
        F.when(F.col("need_per_day") < F.col("_top") * 0.5, F.col("hottest")).alias("nudge_to"))


def allocate_hours(claims: DataFrame, budget: Column, keys: list[str], order: list) -> DataFrame:
    """Give a budget to claims in order, each up to its cap; what is left over goes to the first.  ``claims`` has ``cap``."""
    placed = in_group_order(claims, keys, order, amount="cap").join(claims.groupBy(*keys).agg(F.sum("cap").alias("_wanted")), keys)
    given = F.least(F.col("cap"), F.greatest(F.lit(0.0), budget - F.col("before")))
    left = F.when(F.col("position") == 1, F.greatest(F.lit(0.0), budget - F.col("_wanted"))).otherwise(F.lit(0.0))
    return placed.withColumn("hours", given + left).drop("before", "group_size", "_wanted")


def on_pace_hours(priced: DataFrame) -> DataFrame:
    """Cap of a jurisdiction: hours that keep it on pace today."""
    return priced.withColumn("cap", F.col("need_per_day") / fixed.BLENDED_VALID_PER_HOUR)


def paid_gap(drives: DataFrame) -> DataFrame:
    """What closing every gap costs; the buffer is not bought."""
    gap = F.greatest(F.lit(0), F.col("target") - F.col("collected"))
    return drives.withColumn("_gap", gap).agg(
        F.count_if(F.col("_gap") > 0).alias("short_states"),
        F.sum(F.col("_gap") / fixed.DRIVE_BUFFER).alias("paid_signatures"),
        F.sum(F.col("_gap") / fixed.DRIVE_BUFFER * fixed.PRICE_PER_SIGNATURE).alias("paid"))


def paid_gap_rounded(drives: DataFrame) -> DataFrame:
    """Per drive the valid signatures that are short, the whole signatures to buy for them with the buffer, and their price."""
    short = F.greatest(F.lit(0), F.col("target") - F.col("collected"))
    bought = F.ceil(F.col("paid_valid") * fixed.DRIVE_BUFFER)
    return drives.withColumn("paid_valid", short).withColumn("paid_signatures", bought).withColumn("paid", F.col("paid_signatures") * fixed.PRICE_PER_SIGNATURE)


def drive_totals(drives: DataFrame) -> DataFrame:
    """Mission totals; ``drives`` also has required, per_signature, residency."""
    return drives.agg(
        F.count(F.lit(1)).alias("states"), F.sum("required").alias("required"), F.sum("collected").alias("collected"),
        F.sum("target").alias("target"), F.count_if(F.col("collected") >= F.col("required")).alias("qualified"),
        F.count_if(F.col("per_signature") != "no").alias("per_signature_go"),
        F.count_if(F.col("per_signature") == "no").alias("hourly_only"), F.count_if("residency").alias("residency"))


def turf_rank(manifest: DataFrame, zip_rates: DataFrame, top: int = fixed.TURF_TOP) -> DataFrame:
    """Tiles by voters x smoothed yield of their modal ZIP, best ``top`` per campaign.

    ``manifest``: campaign_id, tile, voter_count, zip.  ``zip_rates``: campaign_id, zip, rate.
    """
    rate = F.coalesce("rate", smoothed(F.lit(0), F.lit(0)))
    scored = manifest.join(zip_rates, ["campaign_id", "zip"], "left").withColumn("expected_valid", rate)
    scored = scored.withColumn("_score", F.col("voter_count") * F.col("expected_valid"))
    best = first_in_group(scored, ["campaign_id"], [F.desc("_score"), F.col("tile")], top)
    parts = F.split("tile", "__")
    precinct = F.array_join(F.slice(parts, 2, F.size(parts)), "-")
    percent = F.floor(F.col("expected_valid") * 100 + 0.5).cast("string")
    return best.select(
        F.concat(F.lit("opt-"), F.col("tile")).alias("id"), "campaign_id", "rank", "tile", "zip", "voter_count", "expected_valid",
        F.concat(F.lit("Precinct "), precinct, F.lit(" · "), F.col("zip")).alias("label"),
        F.concat(F.lit("Prec "), precinct, F.lit(" · "), F.col("zip")).alias("area_short"),
        F.concat(
            F.lit("~"), F.format_number("voter_count", 0), F.lit(" active registrations · "), percent, F.lit("% expected valid"),
            F.when(F.col("rank") == 1, " — your best turf right now.").otherwise(".")).alias("directive"))


def cost_concentration(costs: DataFrame) -> DataFrame:
    """Share of the total and running share, from the most expensive down; ``costs``: state, required."""
    priced = costs.withColumn("cost", F.col("required") * F.lit(fixed.PRICE_PER_SIGNATURE)).withColumn("_all", F.lit(1))
    total = priced.agg(F.sum("cost").alias("_total"))
    placed = in_group_order(priced, ["_all"], [F.desc("cost"), F.col("state")], amount="cost")
    return placed.crossJoin(total).select(
        "state", "required", "cost", F.col("position").alias("rank"),
        ((F.col("before") + F.col("cost")) / F.col("_total")).alias("cumulative_share"))


def cost_scenarios(needs: DataFrame) -> DataFrame:
    """Paid cost per lever stack and price; ``needs``: scope, required."""
    stacks = rows_of(("stack", "volunteer", "digital", "validation", "routing"), fixed.LEVER_STACKS)
    prices = F.array(*[F.lit(p) for p in fixed.PRICE_POINTS])
    grid = needs.withColumn("_s", F.explode(stacks)).withColumn("price", F.explode(prices))
    cost = (
        F.col("required") * F.col("price") * (F.lit(1.0) - F.col("_s.volunteer") - F.col("_s.digital"))
        * F.col("_s.validation") * F.col("_s.routing"))
    return grid.select("scope", F.col("_s.stack").alias("stack"), "price", cost.alias("cost"))


def breakeven_volunteers(needs: DataFrame, budget: float) -> DataFrame:
    """Volunteer share that meets a budget with the other levers at their mid values."""
    _, _, digital, validation, routing = fixed.LEVER_STACKS[1]
    prices = F.array(*[F.lit(p) for p in fixed.PRICE_POINTS])
    paid_part = F.lit(budget) / (F.col("required") * F.col("price") * validation * routing)
    return needs.withColumn("price", F.explode(prices)).select(
        "scope", "price", F.greatest(F.lit(0.0), F.lit(1.0) - digital - paid_part).alias("volunteer_share"))


def expected_valid(visits: DataFrame) -> DataFrame:
    """Footfall x approach x consent x eligible x hours x validity per (spot, volunteer) row."""
    factors = ("footfall", "approach_rate", "consent_rate", "eligible_share", "hours", "validity")
    product = F.col(factors[0])
    for name in factors[1:]:
        product = product * F.col(name)
    return visits.withColumn("expected_valid", product)


def assign_day(gatherers: DataFrame, states: DataFrame, hours: float = 8.0) -> DataFrame:
    """Gatherers to states for each drive-day: hottest state first, best fit until its pace is met.

    ``gatherers``: drive_day, gatherer, state, raw, rate (one row per gatherer and state).  ``states``: drive_day, state, pace.  A state takes free
    gatherers by falling worth (ties by name) until their worth times ``hours`` meets its pace; who is left at the end goes to the
    hottest state.

    Round k serves the k-th hottest state of all days at once, from the gatherers whom no hotter one took; an offer of worth nothing is never
    written, as it moves no sum: such gatherers go along only if the worth of all others leaves the pace unmet, and then the state takes everybody left and
    the day is done.  So every offer is looked at once, there are at most as many rounds as a day has states, and a window holds the offers
    to one state on one day.
    """
    pool = gatherers.join(states, ["drive_day", "state"])
    people = stage(pool.select("drive_day", "gatherer").distinct(), "gatherers")
    ranked = stage(states.join(people.select("drive_day").distinct(), "drive_day", "left_semi").withColumn(
        "k", F.row_number().over(Window.partitionBy("drive_day").orderBy(F.desc("pace"), "state"))).coalesce(1), "states")
    worth = pool.select("drive_day", "state", "gatherer", (F.col("raw") * F.col("rate")).alias("worth")).where("gatherer IS NOT NULL AND worth <> 0")
    # Sorted by state, so that a round reads little more than its own offers.
    offers = stage(worth.join(ranked, ["drive_day", "state"]).select("drive_day", "k", "pace", "gatherer", "worth").repartition(
        "drive_day", "k").sortWithinPartitions("k"), "offers")
    order = Window.partitionBy("drive_day").orderBy(F.desc("worth"), "gatherer")
    before = F.coalesce(F.sum("worth").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) * hours
    after = F.sum("worth").over(order.rowsBetween(Window.unboundedPreceding, 0)) * hours
    day = ["drive_day", "gatherer"]
    days, last = ranked.agg(F.count_if(F.col("k") == 1), F.max("k")).first()
    held, over = people.withColumn("k", F.lit(0)).where("false"), ranked.select("drive_day", "k").where("false")
    for k in range(1, (last or 0) + 1):
        done = over.select("drive_day")
        free = offers.where(F.col("k") == k).join(done, "drive_day", "left_anti").join(held.select(*day), day, "left_anti")
        met = stage(free.select(*day, "k", (before < F.col("pace")).alias("taken"), F.when(F.col("worth") > 0, after).alias("gained")), "met")
        held = held.unionByName(met.where("taken").select(*day, "k"))
        gained = met.groupBy("drive_day").agg(F.max("gained").alias("gained"))
        short = ranked.where(F.col("k") == k).join(done, "drive_day", "left_anti").join(gained, "drive_day", "left").where(
            F.coalesce("gained", F.lit(0.0)) < F.col("pace"))
        over = stage(over.unionByName(short.select("drive_day", "k")).coalesce(1), "over")
        if over.count() >= days:
            break
    held = held.distinct()
    rest = over.select("drive_day", F.col("k").alias("_rest"))
    left = people.join(held, day, "left").join(rest, "drive_day", "left").withColumn(
        "k", F.coalesce("k", F.when(F.col("gatherer").isNotNull(), F.col("_rest")), F.lit(1)))
    return left.join(ranked.select("drive_day", "k", "state"), ["drive_day", "k"]).select("drive_day", "gatherer", "state")
