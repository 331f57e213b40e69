"""Replay over many days in one plan, and the daily and weekly snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import percentile


def facts_by_day(ticks: DataFrame, threshold: float = 90.0) -> DataFrame:
    """day, asset, percentile: the last tick of each day up to its valuation hour (22:59:59 is past it), kept where it is extreme. One plan for all days: a day's cutoff only selects within the day."""
    known = percentile(ticks).withColumn("day", F.to_date("observed_at")).where(F.col("observed_at") <= F.to_date("observed_at").cast("timestamp") + F.expr("INTERVAL 22 HOURS"))
    last = known.groupBy("day", "asset").agg(F.max_by("percentile", F.struct("observed_at", "id")).alias("percentile"))
    return last.where(F.col("percentile") >= threshold)


def walk_forward(facts: DataFrame) -> DataFrame:
    """Facts with whether their family (asset) is seen for the first time: the earliest day of the family, no loop over days."""
    return facts.join(facts.groupBy("asset").agg(F.min("day").alias("_d")), "asset").withColumn("first_seen", F.col("day") == F.col("_d")).drop("_d")


def rollup(walked: DataFrame, days: DataFrame) -> DataFrame:
    """One row: days, days without a fact, facts, distinct families, repeats."""
    per = days.join(walked.groupBy("day").agg(F.count("*").alias("n")), "day", "left")
    a = per.agg(F.count("*").alias("n_days"), F.count_if(F.col("n").isNull()).alias("zero_days"))
    b = walked.agg(F.count("*").alias("n_facts"), F.count_distinct("asset").alias("n_families"))
    return a.crossJoin(b).withColumn("n_repeats", F.col("n_facts") - F.col("n_families"))  # one row each


def daily_funding(ticks: DataFrame, local_date: Column) -> DataFrame:
    """Ticks, mean and largest absolute rate by asset and local day, rounded to 8 places."""
    return ticks.groupBy("asset", local_date.alias("logical_date")).agg(F.count("*").alias("n_ticks"), F.round(F.avg("funding_rate"), 8).alias("mean_rate"), F.round(F.max(F.abs("funding_rate")), 8).alias("max_abs_rate"))


def replay_rollup(days: DataFrame) -> DataFrame:
    return days.agg(F.count_if(F.col("status") == "READY").alias("ready_days"), F.sum("n").cast("bigint").alias("total"))


def daily_snapshot(hypotheses: DataFrame) -> DataFrame:
    """Counts by novelty and disposition of each day."""
    names = ["NEW", "PREVIOUSLY_REJECTED", "PERSISTENT_REGIME", "RECURRENT", "ASSET_VARIANT"]
    return hypotheses.groupBy("as_of").agg(F.count("*").alias("n"), *(F.count_if(F.col("novelty") == x).alias(x.lower()) for x in names), F.count_if(F.col("disposition") == "REJECTED").alias("rejected"))


def weekly_snapshot(hypotheses: DataFrame, week: Column) -> DataFrame:
    """By week ending on Saturday: rows, days with one, days missing, recurrent families."""
    w = hypotheses.withColumn("week_ending", week)
    fam = w.groupBy("week_ending", "fingerprint").agg(F.count("*").alias("k")).groupBy("week_ending").agg(F.count_if(F.col("k") > 1).alias("recurrent"), F.count_if(F.col("k") == 1).alias("new"))
    days = w.groupBy("week_ending").agg(F.count("*").alias("n"), F.count_distinct("as_of").alias("n_days")).withColumn("missing_days", 7 - F.col("n_days"))
    return days.join(fam, "week_ending")
