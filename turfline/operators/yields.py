"""Yield estimates: additive counts, Beta-Binomial posteriors, smoothing, pace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions.text import zip_trailing


def _prior(dim: Column, key: Column, part: int) -> Column:
    rules = sorted(fixed.YIELD_PRIORS.items(), key=lambda kv: kv[0][1] is None)
    chain = [((dim == d) & (key == k) if k else dim == d, v[part]) for (d, k), v in rules]
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(chain), F.lit(None).cast("double"))


def merge_counts(*stores: DataFrame) -> DataFrame:
    """Add up (dim, key, valid, total) rows of any number of drives."""
    rows = reduce(DataFrame.unionByName, [s.select("dim", "key", "valid", "total") for s in stores])
    return rows.groupBy("dim", "key").agg(F.sum("valid").alias("valid"), F.sum("total").alias("total"))


def yield_posterior(counts: DataFrame) -> DataFrame:
    """Posterior mean and its source: prior (unseen), blended (below twice the strength) or observed."""
    rate, strength = _prior(F.col("dim"), F.col("key"), 0), _prior(F.col("dim"), F.col("key"), 1)
    base = counts.withColumn("prior_rate", rate).withColumn("strength", strength)
    return base.select(
        "dim", "key", F.col("total").alias("n"), "strength", "prior_rate",
        ((F.col("prior_rate") * F.col("strength") + F.col("valid")) / (F.col("strength") + F.col("total"))).alias("rate"),
        F.when(F.col("total") == 0, "prior").when(F.col("total") < 2 * F.col("strength"), "blended")
        .otherwise("observed").alias("source"),
    )


def smoothed(valid: Column, total: Column) -> Column:
    return (valid + fixed.PRIOR_VALID) / (total + fixed.PRIOR_VALID + fixed.PRIOR_INVALID)


def zip_counts(captures: DataFrame) -> DataFrame:
    """Captures with a trailing ZIP, counted per campaign and ZIP."""
    return (
        captures.withColumn("zip", zip_trailing("address")).where("zip <> ''").groupBy("campaign_id", "zip")
        .agg(F.count_if(F.col("verdict") == "VALID").alias("valid"), F.count(F.lit(1)).alias("total"))
    )


def zip_yield(counts: DataFrame) -> DataFrame:
    """Smoothed rate per ZIP plus one overall row (null ZIP) per campaign, in one pass."""
    both = counts.rollup("campaign_id", "zip").agg(
        F.sum("valid").alias("valid"), F.sum("total").alias("total"), F.grouping_id().alias("_level"))
    return both.where("_level < 3").drop("_level").withColumn("rate", smoothed(F.col("valid"), F.col("total")))


def gatherer_value(posterior: DataFrame, raw_per_hour: float, deficit: float, days: float) -> DataFrame:
    """Valid signatures per hour before and after learning, a routing signal, and value at the shadow price."""
    learned = F.lit(raw_per_hour) * F.col("rate")
    return posterior.where("dim = 'gatherer'").select(
        "key", (F.lit(raw_per_hour) * F.col("prior_rate")).alias("cold_per_hour"), learned.alias("valid_per_hour"),
        F.when(learned >= 10, "route").when(learned >= 7, "ok").otherwise("retrain").alias("signal"),
        (learned * F.lit(deficit / days)).alias("value_per_hour"),
    )


def pace_risk(daily: DataFrame, goals: DataFrame, days: int = 7, epsilon: float = 1e-6) -> DataFrame:
    """Required rate over trailing actual rate per day; at the goal the risk is zero.

    ``daily``: campaign_id, day, valid (one row per campaign and day).  ``goals``: campaign_id, goal, deadline.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    recent = Window.partitionBy("campaign_id").orderBy("_n").rangeBetween(-(days - 1), 0)
    sofar = Window.partitionBy("campaign_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    paced = (
        daily.withColumn("_n", number).withColumn("collected", F.sum("valid").over(sofar))
        .withColumn("actual_rate", F.sum("valid").over(recent) / F.lit(float(days))).join(goals, "campaign_id")
    )
    left = F.greatest(F.lit(1), F.datediff("deadline", "day"))
    required = F.greatest(F.lit(0), F.col("goal") - F.col("collected")) / left
    return paced.withColumn("required_rate", required).select(
        "campaign_id", "day", "collected", "required_rate", "actual_rate",
        F.when(F.col("collected") >= F.col("goal"), F.lit(0.0))
        .otherwise(F.col("required_rate") / F.greatest(F.col("actual_rate"), F.lit(epsilon))).alias("risk"),
    )


def shift_impact(captures: DataFrame, pay: DataFrame, now: Column) -> DataFrame:
    """Hours, valid per hour, earnings by pay basis, distance to the goal and share of the ballot need.

    ``pay``: campaign_id, basis, rate, shift_target, statewide_required.
    """
    shift = captures.groupBy("campaign_id", "gatherer_id").agg(
        F.count_if(F.col("verdict") == "VALID").alias("valid"),
        F.count_if(F.col("verdict") != "VALID").alias("not_earning"),
        F.min("captured_at").alias("started"))
    hours = (now.cast("double") - F.col("started").cast("double")) / 3600
    return shift.withColumn("hours", hours).join(pay, "campaign_id").select(
        "campaign_id", "gatherer_id", "valid", "not_earning", "hours",
        F.when(F.col("hours") > 0.05, F.col("valid") / F.col("hours")).otherwise(F.lit(0.0)).alias("per_hour"),
        F.when(F.col("basis") == "hourly", F.col("hours") * F.col("rate")).otherwise(F.col("valid") * F.col("rate")).alias("earned"),
        F.greatest(F.lit(0), F.col("shift_target") - F.col("valid")).alias("to_goal"),
        (F.col("valid") / F.col("statewide_required") * 100).alias("ballot_pct"),
    )
