"""Coverage, continuity and readiness audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import chunked, hours, numbered, trailing
from tidemark.session import staged


def _gaps(rows: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Adds _at and _before (the value of the row before, within the key)."""
    ranked = chunked(numbered(rows.withColumn("_at", at), keys, ["observed_at", "id"], F.date_trunc("day", "observed_at")), keys, 1)
    return ranked.withColumn("_before", F.lag("_at").over(Window.partitionBy(*keys, "_chunk").orderBy("_rank"))).where("_own").drop("_own", "_chunk", "_rank")


def gap_count(ticks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Steps of more than one hour between hour-truncated times; jitter inside an hour does not count."""
    keys = keys or ["asset"]
    return _gaps(ticks, keys, hours("observed_at")).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col("_at") - F.col("_before") > 1).alias("n_gaps"))


def funding_coverage(ticks: DataFrame, start: str, end: str, start_s: int = 60, end_s: int = 3660, abnormal_s: int = 3660) -> DataFrame:
    """Boundary deltas, interval range, missing and abnormal intervals and failure reasons by asset."""
    at = F.unix_micros("observed_at") / 1_000_000
    g = _gaps(ticks, ["asset"], at).withColumn("_gap", F.col("_at") - F.col("_before"))
    missing = F.when(F.col("_gap") > 3600, F.greatest(F.lit(0.0), F.bround(F.col("_gap") / 3600, 0) - 1)).otherwise(0.0)
    lo, hi = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (start, end))
    got = g.groupBy("asset").agg(F.count("*").alias("n_rows"), (F.min("_at") - lo).alias("start_delta"), (hi - F.max("_at")).alias("end_delta"), F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"), F.sum(missing).cast("bigint").alias("n_missing"), F.count_if(F.col("_gap") > abnormal_s).alias("n_abnormal"))
    reasons = F.array_compact(F.array(F.when(F.col("start_delta") > start_s, "late_start"), F.when(F.col("end_delta") > end_s, "early_end"), F.when(F.col("n_missing") > 0, "missing_intervals"), F.when(F.col("n_abnormal") > 0, "abnormal_gaps")))
    return got.withColumn("reasons", F.array_join(reasons, ","))


def spine(rows: DataFrame, key: str = "asset") -> DataFrame:
    """All hours between each key's first and last row."""
    ends = rows.groupBy(key).agg(F.min(hours("observed_at")).alias("_lo"), F.max(hours("observed_at")).alias("_hi"))
    return ends.select(key, F.explode(F.sequence("_lo", "_hi")).alias("_h"))


def market_quality(candles: DataFrame, samples: int = 20) -> DataFrame:
    """Rows, first and last hour, duplicates, missing hours and the first of them by asset."""
    base = candles.groupBy("asset").agg(F.count("*").alias("n_rows"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), (F.count("*") - F.count_distinct(hours("observed_at"))).alias("n_duplicates"))
    gone = spine(candles).join(candles.select("asset", hours("observed_at").alias("_h")).distinct(), ["asset", "_h"], "left_anti")
    ranked = gone.withColumn("_r", F.row_number().over(Window.partitionBy("asset").orderBy("_h")))
    text = F.date_format(F.timestamp_seconds(F.col("_h") * 3600), "yyyy-MM-dd HH:mm")
    first = ranked.groupBy("asset").agg(F.count("*").alias("n_missing"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, text))), ",").alias("missing_sample"))
    return base.join(first, "asset", "left").withColumns({"n_missing": F.coalesce("n_missing", F.lit(0)), "missing_sample": F.coalesce("missing_sample", F.lit(""))})


def metric_availability(metrics: DataFrame, candles: DataFrame, names: list[str]) -> DataFrame:
    """AVAILABLE or UNAVAILABLE for each asset and metric at the asset's latest candle."""
    latest = candles.groupBy("asset").agg(F.max("observed_at").alias("observed_at")).withColumn("metric_name", F.explode(F.array(*map(F.lit, names))))
    return latest.join(metrics, ["asset", "observed_at", "metric_name"], "left").select("asset", "metric_name", F.when(F.col("metric_value").isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("status"))


def readiness(coverage: DataFrame, availability: DataFrame) -> DataFrame:
    """Blockers of coverage and availability by asset; READY without any."""
    a = coverage.where("reasons <> ''").select("asset", F.explode(F.split("reasons", ",")).alias("blocker"))
    b = availability.where("status = 'UNAVAILABLE'").select("asset", F.concat(F.lit("metric:"), "metric_name").alias("blocker"))
    held = a.unionByName(b).groupBy("asset").agg(F.array_join(F.array_sort(F.collect_set("blocker")), ",").alias("blockers"))
    return coverage.select("asset").join(held, "asset", "left").select("asset", F.coalesce("blockers", F.lit("")).alias("blockers"), F.when(F.col("blockers").isNull(), "READY").otherwise("BLOCKED").alias("status"))


def watermark(candles: DataFrame, assets: list[str]) -> DataFrame:
    """The oldest of the assets' newest times; null if an asset has no row."""
    each = candles.where(F.col("asset").isin(assets)).groupBy("asset").agg(F.max("observed_at").alias("m"))
    return each.agg(F.count("*").alias("n_assets"), F.min("m").alias("m")).select("n_assets", F.when(F.col("n_assets") == len(assets), F.col("m")).alias("watermark"))


def missing_assets(candles: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(candles.select("asset").distinct(), "asset", "left_anti")


def study_coverage(events: DataFrame, outcomes: DataFrame, candles: DataFrame) -> DataFrame:
    """By asset: first and last event, events, treated, regimes, expected and present candle hours, missing outcomes by horizon."""
    e = events.groupBy("asset").agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count("*").alias("n_events"), F.count_if(F.col("treated")).alias("n_treated"), F.coalesce(F.max("regime"), F.lit(0)).alias("n_regimes"))
    c = candles.groupBy("asset").agg((F.max(hours("observed_at")) - F.min(hours("observed_at")) + 1).alias("expected_hours"), F.count_distinct(hours("observed_at")).alias("present_hours"))
    o = outcomes.groupBy("asset").agg(*(F.count_if((F.col("horizon") == h) & F.col("outcome").isNull()).alias(f"missing_{h}h") for h in (1, 4, 24)))
    return e.join(c, "asset", "left").join(o, "asset", "left")


def coverage_audit(coverage: DataFrame, least: int = 5) -> DataFrame:
    """One row: assets, total regimes, and whether they suffice (in total and for each asset)."""
    got = coverage.agg(F.count("*").alias("n_assets"), F.sum("n_regimes").cast("bigint").alias("total_regimes"), F.min("n_regimes").alias("least_regimes"))
    ready = (F.col("total_regimes") >= least) & (F.col("least_regimes") >= least)
    return got.withColumn("ready", ready).withColumn("recommendation", F.when(ready, "RUN_STUDY").otherwise("COLLECT_MORE"))


def qualified(observations: DataFrame, receipts: DataFrame, runs: DataFrame, start: Column, end: Column, mode: str) -> DataFrame:
    """asset, kind, observed_at, id, funding_rate, n_receipts: observations in [start, end] with a receipt of this mode, of a finished successful run, at exactly their native time."""
    native = F.when(F.col("observation_kind") == "candle", F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("observed_at"))
    done = runs.where("status = 'SUCCESS' AND ended_at IS NOT NULL").select(F.col("id").alias("collection_run_id"))
    good = receipts.where(F.col("analysis_mode") == mode).join(done, "collection_run_id", "left_semi")
    inside = observations.where((F.col("observed_at") >= start) & (F.col("observed_at") <= end)).withColumn("_native", native)
    held = inside.join(good.select(F.col("market_observation_id").alias("id"), F.col("source_native_timestamp").alias("_native")), ["id", "_native"])
    one = held.groupBy("asset", F.col("observation_kind").alias("kind"), "observed_at")
    return one.agg(F.min("id").alias("id"), F.min_by("funding_rate", "id").alias("funding_rate"), F.count("*").alias("n_receipts"))


def _recent(rows: DataFrame, seconds: int, stretch: int = 30 * 86400) -> DataFrame:
    """Adds _recent: earlier rows of the asset within so many seconds. Time is cut into stretches with a halo, so no task holds an asset."""
    at = F.floor(F.col("_us") / (stretch * 1_000_000))
    late = F.pmod(F.col("_us"), F.lit(stretch * 1_000_000)) >= (stretch - seconds) * 1_000_000
    halo = rows.withColumn("_chunk", F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_chunk") == at)
    frame = Window.partitionBy("asset", "_chunk").orderBy("_us").rangeBetween(-seconds * 1_000_000, -1)
    return halo.withColumn("_recent", F.count("*").over(frame)).where("_own").drop("_own", "_chunk")


def qualified_audit(rows: DataFrame, assets: list[str], horizons: tuple[int, ...] = (1, 4, 24), share: float = 0.9, window: int = 30) -> DataFrame:
    """What the receipt-qualified rows (of qualified()) of each asset hold: for funding and candles first, last, rows, gaps by the hour and duplicate receipts; extreme
    funding observations, their regimes, and extremes with both candles of a horizon.

    A funding row is extreme if it exceeds `share` of the values among the asset's last `window` rows, itself included; ties do not count as exceeded, rows without
    a rate keep their place in the window. An extreme more than an hour after the extreme before begins a regime. An asset without rows is listed with zeros.
    The qualified rows are judged once and staged; everything else is an aggregate of that table.
    """
    keys = ["asset", "kind"]
    day = F.date_trunc("day", "observed_at")
    last = Window.partitionBy(*keys, "_chunk").orderBy("_rank").rowsBetween(-1, -1)
    near = trailing(rows, keys, ["observed_at"], day, window, {"_last": lambda w: F.collect_list("funding_rate").over(w), "_before": lambda w: F.first(hours("observed_at")).over(last)})
    exceeded = F.size(F.filter("_last", lambda x: x < F.col("funding_rate"))) / F.size("_last") >= share
    extreme = (F.col("kind") == "funding") & F.col("funding_rate").isNotNull() & exceeded
    judged = staged(near.select(*keys, "observed_at", "n_receipts", (hours("observed_at") - F.col("_before") > 1).alias("gap"), F.coalesce(extreme, F.lit(False)).alias("extreme")), "audited")
    parts = {"start": F.min, "end": F.max}
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    plain = judged.groupBy("asset").agg(*(x.alias(f"{k}_{n}") for k in ("funding", "candle") for n, x in (
        *((n, f(of(k, F.col("observed_at")))) for n, f in parts.items()),
        ("rows", F.count(of(k, F.lit(1)))),
        ("gaps", F.count_if((F.col("kind") == k) & F.col("gap"))),
        ("duplicates", F.coalesce(F.sum(of(k, F.col("n_receipts") - 1)), F.lit(0))),
    )))
    hits = _recent(judged.where("extreme").select("asset", "observed_at", F.unix_micros("observed_at").alias("_us")), 3600)
    steps = hits.withColumn("_k", F.explode(F.array(*map(F.lit, (0, *horizons))))).withColumn("_h", hours("observed_at") - 1 + F.col("_k"))
    candles = judged.where((F.col("kind") == "candle") & (F.date_trunc("hour", "observed_at") == F.col("observed_at"))).select("asset", hours("observed_at").alias("_h"), F.lit(True).alias("_has"))
    has = steps.join(candles, ["asset", "_h"], "left").groupBy("asset", "_us", "_recent").agg(*(F.bool_or((F.col("_k") == k) & F.col("_has")).alias(f"_has{k}") for k in (0, *horizons)))
    counts = has.groupBy("asset").agg(F.count("*").alias("n_extreme"), F.count_if(F.col("_recent") == 0).alias("n_regimes"), *(F.count_if(F.col("_has0") & F.col(f"_has{h}")).alias(f"eligible_{h}h") for h in horizons))
    listed = rows.sparkSession.createDataFrame([(a,) for a in assets], "asset string").join(plain, "asset", "left").join(counts, "asset", "left")
    return listed.select("asset", *(c if c.endswith(("_start", "_end")) else F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in listed.columns if c != "asset"))


def audit_verdict(audit: DataFrame, least: int = 5, horizon: int = 24) -> DataFrame:
    """One row: whether regimes suffice in total and eligible outcomes of the horizon for every asset, and what to do with the history window."""
    got = audit.agg(F.count("*").alias("n_assets"), F.sum("n_regimes").alias("total_regimes"), F.min(f"eligible_{horizon}h").alias("least_eligible"))
    ready = (F.col("total_regimes") >= least) & (F.col("least_eligible") >= least)
    return got.withColumn("data_ready", F.when(ready, "YES").otherwise("NO")).withColumn("recommendation", F.when(ready, "HISTORY_WINDOW_SUFFICIENT").otherwise("EXTEND_TO_18_MONTHS"))
