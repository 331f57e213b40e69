"""Trailing metrics that never fill gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import hours, ranged, trailing


def percentile(ticks: DataFrame, value: str = "funding_rate", keys: list[str] | None = None, ts: str = "observed_at", tie: str = "id", window: int = 30, strict: bool = False) -> DataFrame:
    """100 * share of the last `window` values (the current one included) that are <= the current one (strict: <)."""
    keys = keys or ["asset"]
    got = trailing(ticks.where(F.col(value).isNotNull()), keys, [ts, tie], F.date_trunc("day", ts), window, {"_last": lambda w: F.collect_list(value).over(w)})
    below = F.size(F.filter("_last", lambda x: (x < F.col(value)) if strict else (x <= F.col(value))))
    return got.withColumn("percentile", 100.0 * below / F.size("_last")).drop("_last", "_rank")


def percentile_at(ticks: DataFrame, points: DataFrame, window: int = 30, value: str = "funding_rate") -> DataFrame:
    """The inclusive percentile of the latest tick at or before each point (asset, observed_at), null before the first: an as-of attach over the union of both."""
    known = percentile(ticks, value, window=window).select("asset", "observed_at", F.col("id").alias("tick_id"), "percentile", F.lit(0).alias("_kind"))
    asked = points.select("asset", "observed_at", F.lit(None).cast("bigint").alias("tick_id"), F.lit(None).cast("double").alias("percentile"), F.lit(1).alias("_kind"))
    from pyspark.sql import Window

    both = known.unionByName(asked).withColumn("_day", F.date_trunc("day", "observed_at"))
    within = Window.partitionBy("asset", "_day").orderBy("observed_at", "_kind", F.coalesce("tick_id", F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_p", F.last("percentile", ignorenulls=True).over(within))
    ends = both.where("_kind = 0").groupBy("asset", "_day").agg(F.max_by("percentile", F.struct("observed_at", "tick_id")).alias("_end"))
    days = both.select("asset", "_day").distinct().join(ends, ["asset", "_day"], "left")
    before = Window.partitionBy("asset").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("asset", "_day", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return held.where("_kind = 1").join(carried, ["asset", "_day"]).select("asset", "observed_at", F.coalesce("_p", "_carried").alias("percentile"))


def anchor_returns(candles: DataFrame, horizons: tuple[int, ...] = (1, 4, 24), log: bool = False, name: str = "return", price: str = "mark_price") -> DataFrame:
    """asset, observed_at, horizon, return against the exact anchor `horizon` hours before; null where the anchor is missing or unusable."""
    now = candles.select("asset", "observed_at", F.col(price).alias("p"), hours("observed_at").alias("_h"))
    steps = now.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("_at", F.col("_h") - F.col("horizon"))
    past = now.select("asset", F.col("_h").alias("_at"), F.col("p").alias("q"))
    value = F.when((F.col("p") > 0) & (F.col("q") > 0), F.ln(F.col("p") / F.col("q"))) if log else F.when(F.col("q") != 0, F.col("p") / F.col("q") - 1)
    return steps.join(past, ["asset", "_at"], "left").select("asset", "observed_at", "horizon", value.alias(name))


def complete_volatility(candles: DataFrame, window: int = 24, price: str = "mark_price") -> DataFrame:
    """Sample standard deviation of the hourly simple returns of the last `window` hours; null unless all window + 1 anchors exist and two returns are usable."""
    h = candles.select("asset", "observed_at", F.col(price).alias("p"), hours("observed_at").alias("_h"))
    past = h.select("asset", (F.col("_h") + 1).alias("_h"), F.col("p").alias("q"))
    steps = h.join(past, ["asset", "_h"], "left").withColumn("_r", F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") / F.col("q") - 1))
    # window returns need window + 1 anchors: every one of the last `window` hours and the one before them.
    got = ranged(steps, ["asset"], "_h", window, {"_n": lambda w: F.count("*").over(w), "_with_previous": lambda w: F.count("q").over(w), "_k": lambda w: F.count("_r").over(w), "_s": lambda w: F.stddev_samp("_r").over(w)})
    return got.select("asset", "observed_at", F.when((F.col("_n") == window) & (F.col("_with_previous") == window) & (F.col("_k") >= 2), F.col("_s")).alias("volatility"))


def recent_volatility(candles: DataFrame, window: int = 24, price: str = "mark_price") -> DataFrame:
    """Sample standard deviation of whichever of the last `window` hourly log returns exist, two at least."""
    h = candles.select("asset", "observed_at", F.col(price).alias("p"), hours("observed_at").alias("_h"))
    past = h.select("asset", (F.col("_h") + 1).alias("_h"), F.col("p").alias("q"))
    steps = h.join(past, ["asset", "_h"], "left").withColumn("_r", F.when((F.col("p") > 0) & (F.col("q") > 0), F.ln(F.col("p") / F.col("q"))))
    got = ranged(steps, ["asset"], "_h", window, {"_k": lambda w: F.count("_r").over(w), "_s": lambda w: F.stddev_samp("_r").over(w)})
    return got.select("asset", "observed_at", F.when(F.col("_k") >= 2, F.col("_s")).alias("volatility"))


def long_metrics(ticks: DataFrame, candles: DataFrame) -> DataFrame:
    """asset, observed_at, metric_name, metric_value of every candle: percentile, three returns, volatility. A metric without a value has no row."""
    returns = anchor_returns(candles).select("asset", "observed_at", F.concat(F.lit("return_"), F.col("horizon"), F.lit("h")).alias("metric_name"), F.col("return").alias("metric_value"))
    named = lambda df, col, name: df.select("asset", "observed_at", F.lit(name).alias("metric_name"), F.col(col).alias("metric_value"))
    parts = [returns, named(percentile_at(ticks, candles), "percentile", "funding_percentile"), named(complete_volatility(candles), "volatility", "volatility_24h")]
    return reduce(DataFrame.unionByName, parts).where("metric_value IS NOT NULL")


def extreme_facts(metrics: DataFrame, known: DataFrame, percentile_at_least: float = 90.0, move_at_least: float = 0.01) -> DataFrame:
    """One fact for each (asset, observed_at) with an extreme percentile and a 24-hour move, left out if `known` (fact_key) has it."""
    wide = metrics.groupBy("asset", "observed_at").agg(*(F.max(F.when(F.col("metric_name") == m, F.col("metric_value"))).alias(c) for m, c in (("funding_percentile", "p"), ("return_24h", "r"))))
    hit = wide.where((F.col("p") >= percentile_at_least) & (F.abs("r") >= move_at_least))
    return hit.withColumn("fact_key", F.concat_ws("|", "asset", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss"))).join(known, "fact_key", "left_anti").select("fact_key", "asset", "observed_at", F.col("p").alias("percentile"), F.col("r").alias("return_24h"))


def trusted(stored: DataFrame, fresh: DataFrame, cutoff: Column) -> DataFrame:
    """Stored metrics that equal their recomputation and carry the same cutoff."""
    again = fresh.select("asset", "observed_at", "metric_name", F.col("metric_value").alias("_fresh"))
    return stored.join(again, ["asset", "observed_at", "metric_name"]).where(F.col("metric_value").eqNullSafe(F.col("_fresh")) & (F.col("cutoff") == cutoff)).drop("_fresh")


def refreshed(stored: DataFrame, fresh: DataFrame, visible: DataFrame, cutoff: Column) -> DataFrame:
    """The metric store after a recomputation at `cutoff`, with `change`; stored: asset, observed_at, metric_name, metric_value, cutoff.

    A stored metric of this cutoff stays (skipped), as does one whose observation is not visible (asset, observed_at) at the cutoff (untouched). Any other is
    updated, or deleted where the recomputation has no value for it; fresh metrics without a stored one are inserted.
    """
    keys = ["asset", "observed_at", "metric_name"]
    old = stored.select(*keys, F.col("metric_value").alias("_old"), F.col("cutoff").alias("_cutoff"))
    new = fresh.select(*keys, F.col("metric_value").alias("_new"))
    seen = visible.select("asset", "observed_at", F.lit(True).alias("_seen")).distinct()
    both = old.join(new, keys, "full_outer").join(seen, keys[:2], "left")
    change = F.when(F.col("_cutoff").isNull(), "inserted").when(F.col("_cutoff") == cutoff, "skipped").when(F.col("_seen").isNull(), "untouched").when(F.col("_new").isNull(), "deleted").otherwise("updated")
    takes = F.col("change").isin("inserted", "updated")
    got = both.withColumn("change", change)
    return got.select(*keys, F.when(takes, F.col("_new")).otherwise(F.col("_old")).alias("metric_value"), F.when(takes, cutoff).otherwise(F.col("_cutoff")).alias("cutoff"), "change")
