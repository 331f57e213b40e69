"""Event study: receipt-qualified inputs, events and regimes, forward outcomes, effect sizes, resampling, controls, disposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import percentile
from tidemark.operators.resampling import digest_bootstrap, digest_permutation, ranked_values
from tidemark.operators.windows import chunked, hours, numbered, running
from tidemark.session import staged


def receipt_qualified(observations: DataFrame, receipts: DataFrame, runs: DataFrame) -> DataFrame:
    """Observations with a receipt of a successful run at exactly their native time (a candle's is its close); receipt_ids sorted."""
    known = F.when(F.col("observation_kind") == "candle", F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("observed_at"))
    good = receipts.join(runs.where("status = 'SUCCESS'").select(F.col("id").alias("collection_run_id")), "collection_run_id", "left_semi")
    ids = good.select(F.col("market_observation_id").alias("id"), F.col("source_native_timestamp").alias("_native"), F.col("id").alias("_rid"))
    return observations.withColumn("_native", known).join(ids, ["id", "_native"]).groupBy(*observations.columns).agg(F.sort_array(F.collect_set("_rid")).alias("receipt_ids"))


def treated(ticks: DataFrame, threshold: float = 90.0, window: int = 30) -> DataFrame:
    """Ticks with their strict percentile and whether it reaches the threshold."""
    return percentile(ticks, window=window, strict=True).withColumn("treated", F.col("percentile") >= threshold)


def regimes(events: DataFrame, gap_seconds: int = 3600, truncate: bool = False, id_col: str = "id") -> DataFrame:
    """Adds regime (1, 2, ... per asset; null if untreated): a treated row begins one if the row before is untreated or more than the gap away."""
    at = F.unix_micros(F.date_trunc("hour", "observed_at") if truncate else F.col("observed_at"))
    ranked = chunked(numbered(events.withColumn("_at", at), ["asset"], ["observed_at", id_col], F.date_trunc("day", "observed_at")), ["asset"], 1)
    w = Window.partitionBy("asset", "_chunk").orderBy("_rank")
    begins = F.col("treated") & (F.coalesce(~F.lag("treated").over(w), F.lit(True)) | (F.col("_at") - F.lag("_at").over(w) > gap_seconds * 1_000_000))
    flagged = ranked.withColumn("_begins", begins).where("_own").drop("_chunk", "_own")
    counted = running(flagged, ["asset"], ["_rank"], F.floor(F.col("_rank") / 4096), F.col("_begins").cast("bigint"), "_regime")
    return counted.withColumn("regime", F.when(F.col("treated"), F.col("_regime"))).withColumn("starts", F.col("_begins")).drop("_at", "_rank", "_begins", "_regime")


def forward_outcomes(events: DataFrame, candles: DataFrame, horizons: tuple[int, ...] = (1, 4, 24), price: str = "mark_price") -> DataFrame:
    """One row for each event and horizon: ln(p(a + h) / p(a)) with a = floor_hour(event) - 1 h, and its availability."""
    prices = candles.select("asset", hours("observed_at").alias("_h"), F.col(price).alias("_p"))
    steps = events.withColumn("_a", hours("observed_at") - 1).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    a, b = prices.select("asset", F.col("_h").alias("_a"), F.col("_p").alias("_p0")), prices.select("asset", F.col("_h").alias("_b"), F.col("_p").alias("_p1"))
    got = steps.join(a, ["asset", "_a"], "left").withColumn("_b", F.col("_a") + F.col("horizon")).join(b, ["asset", "_b"], "left")
    value = F.when((F.col("_p0") > 0) & (F.col("_p1") > 0), F.ln(F.col("_p1") / F.col("_p0")))
    return got.withColumn("outcome", value).withColumn("availability", F.when(value.isNull(), "OUTCOME_UNAVAILABLE").otherwise("AVAILABLE")).drop("_a", "_b", "_p0", "_p1")


def strata(events: DataFrame, candles: DataFrame, hours_back: int = 4, price: str = "mark_price") -> DataFrame:
    """Adds recent_return (log, over the hours before the anchor) and stratum: asset, direction (a null return counts as up), whether a 24 h volatility is known."""
    from tidemark.operators.metrics import recent_volatility

    prices = candles.select("asset", hours("observed_at").alias("_h"), F.col(price).alias("_p"))
    vol = recent_volatility(candles).select("asset", hours("observed_at").alias("_a"), F.col("volatility").alias("recent_vol"))
    got = events.withColumn("_a", hours("observed_at") - 1).join(prices.select("asset", F.col("_h").alias("_a"), F.col("_p").alias("_p1")), ["asset", "_a"], "left")
    got = got.withColumn("_b", F.col("_a") - hours_back).join(prices.select("asset", F.col("_h").alias("_b"), F.col("_p").alias("_p0")), ["asset", "_b"], "left").join(vol, ["asset", "_a"], "left")
    r = F.when((F.col("_p0") > 0) & (F.col("_p1") > 0), F.ln(F.col("_p1") / F.col("_p0")))
    label = F.concat(F.col("asset"), F.when(F.coalesce(F.col("recent_return"), F.lit(0.0)) >= 0, "|r=up").otherwise("|r=down"), F.when(F.col("recent_vol").isNotNull(), "|v=known").otherwise("|v=missing"))
    return got.withColumn("recent_return", r).withColumn("stratum", label).drop("_a", "_b", "_p0", "_p1")


def nearest_rank(values: str, p: float) -> Column:
    """sorted[round((n - 1) p)] with ties to even, from a sorted array column."""
    return F.element_at(values, F.bround((F.size(values) - 1) * F.lit(p), 0).cast("int") + 1)


def _grouped(outcomes: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The columns with the keys as one struct _g, which joins null keys too; written, since ranks read it several times."""
    return staged(outcomes.select(F.struct(F.lit(0).alias("_"), *keys).alias("_g"), *columns), "outcomes")


def outcome_summary(outcomes: DataFrame, keys: list[str], value: str = "outcome", points: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """n, missing, mean, median, stddev (0 for one value), min, max, nearest-rank percentiles, shares above and below 0. Median and percentiles are
    picked by rank from refined counts (see histogram_ranks), so no group is gathered or sorted in one task."""
    rows = _grouped(outcomes, keys, value)
    base = rows.groupBy("_g").agg(F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(value).alias("mean"), F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg((F.col(value) > 0).cast("double")).alias("p_positive"), F.avg((F.col(value) < 0).cast("double")).alias("p_negative"))
    base = staged(base, "summary")
    at = {f"p{p:02d}": F.bround((F.col("n") - 1) * F.lit(p / 100), 0) for p in points} | {"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.floor(F.col("n") / 2)}
    picks = ranked_values(rows.where(F.col(value).isNotNull()).select("_g", F.col(value).alias("_v")), base.where("n > 0").select("_g", *(c.alias(k) for k, c in at.items())), list(at))
    got = base.join(picks, "_g", "left")
    return got.select(*(F.col("_g")[k].alias(k) for k in keys), "n", "missing", "mean", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"), "stddev", "min", "max", "p_positive", "p_negative", *(f"p{p:02d}" for p in points))


def cubed(outcomes: DataFrame, key: str = "asset", pooled: str = "POOLED") -> DataFrame:
    """The rows once for their asset and once for all assets together."""
    return outcomes.withColumn("population", F.explode(F.array(F.col(key), F.lit(pooled))))


def effect_sizes(outcomes: DataFrame, keys: list[str], value: str = "outcome", flag: str = "treated") -> DataFrame:
    """Treated against ordinary rows: counts, mean, median and P(>0) differences, standardised difference; null unless both sides have two values.

    Rows of either side are counted and summed before the shuffle; medians are picked by rank from refined counts, so no group is gathered. Null values and
    rows of neither side (null flag) count for nothing, but their group has a row.
    """
    rows = _grouped(outcomes.withColumn("_v", F.when(F.col(flag).isNotNull(), F.col(value))).withColumn("_side", F.col(flag)), keys, "_side", "_v")
    t, o = F.when(F.col("_side"), F.col("_v")), F.when(~F.col("_side"), F.col("_v"))
    base = rows.groupBy("_g").agg(F.count(t).alias("n_treated"), F.count(o).alias("n_ordinary"), (F.avg(t) - F.avg(o)).alias("_mean"), (F.avg((t > 0).cast("double")) - F.avg((o > 0).cast("double"))).alias("_p"), ((F.var_pop(t) + F.var_pop(o)) / 2).alias("_v"))
    base = staged(base, "effects")
    enough = (F.col("n_treated") >= 2) & (F.col("n_ordinary") >= 2)
    sides = [(True, "n_treated"), (False, "n_ordinary")]
    ranks = base.where(enough).select(F.explode(F.array(*(F.struct(F.struct(F.col("_g").alias("of"), F.lit(s).alias("side")).alias("_g"), F.floor((F.col(n) - 1) / 2).alias("_lo"), F.floor(F.col(n) / 2).alias("_hi")) for s, n in sides))).alias("_r")).select("_r.*")
    picks = ranked_values(rows.where("_v IS NOT NULL").select(F.struct(F.col("_g").alias("of"), F.col("_side").alias("side")).alias("_g"), "_v"), ranks, ["_lo", "_hi"])
    middle = (F.col("_lo") + F.col("_hi")) / 2
    medians = picks.groupBy(F.col("_g.of").alias("_g")).agg((F.max(F.when(F.col("_g.side"), middle)) - F.max(F.when(~F.col("_g.side"), middle))).alias("_median"))
    got = base.join(medians, "_g", "left")
    return got.select(*(F.col("_g")[k].alias(k) for k in keys), "n_treated", "n_ordinary", F.when(enough, F.col("_mean")).alias("mean_diff"), F.when(enough, F.col("_median")).alias("median_diff"), F.when(enough, F.col("_p")).alias("p_positive_diff"), F.when(enough, F.col("_mean") / F.greatest(F.lit(1e-12), F.sqrt("_v"))).alias("standardized_diff"))


def matched_baseline(events: DataFrame, value: str = "outcome", order: tuple[str, ...] = ("observed_at", "id")) -> DataFrame:
    """The k-th treated event of a stratum with the k-th ordinary one; treated events without a partner stay, with nulls."""
    day = F.date_trunc("day", "observed_at")
    t = numbered(events.where("treated"), ["stratum"], list(order), day).select("stratum", "_rank", F.col("id").alias("treated_id"), F.col(value).alias("treated_outcome"))
    o = numbered(events.where("NOT treated"), ["stratum"], list(order), day).select("stratum", "_rank", F.col("id").alias("baseline_id"), F.col(value).alias("baseline_outcome"))
    return t.join(o, ["stratum", "_rank"], "left").withColumn("diff", F.col("treated_outcome") - F.col("baseline_outcome")).drop("_rank")


def draw(*parts: Column | int | str) -> Column:
    """A reproducible 32-bit number from the parts: the first eight hex digits of their MD5."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _sides(outcomes: DataFrame, keys: list[str], value: str, flag: str) -> DataFrame:
    known = outcomes.where(F.col(value).isNotNull())
    return numbered(known.withColumn("_side", F.col(flag).cast("int")), [*keys, "_side"], ["observed_at", "id"], F.date_trunc("day", "observed_at"), "_i")


def bootstrap_ci(outcomes: DataFrame, keys: list[str], replicates: int = 1000, seed: int = 20260901, value: str = "outcome", flag: str = "treated") -> DataFrame:
    """Percentile interval of the mean difference over resamples of each side, drawn by hash; bounds at int(.025 (B - 1)) and int(.975 (B - 1))."""
    rows = _sides(outcomes.withColumn("_g", F.struct(F.lit(0).alias("_"), *keys)), ["_g"], value, flag).select("_g", "_side", "_i", F.col(value).alias("_v"))
    return digest_bootstrap(rows, replicates, seed).select(*(F.col("_g")[k].alias(k) for k in keys), "ci_low", "ci_high")


#: Bits of a draw that tell its bucket where rows are ranked by their draws.
RANK_BITS = 10


def lowest(rows: DataFrame, sizes: DataFrame, keys: list[str], value: str = "_v") -> DataFrame:
    """sum of `value` over the `_k` rows of smallest (_u, id) of each key, and over all: keys, _low, _all, _n. sizes: keys, _k.

    Rows are counted by the first bits of their draw; only those in the bucket where the k-th falls are ranked, so no task holds a key. The places of these
    buckets are one row for each key (a study's cells and replicates), which Spark broadcasts where it is small.
    """
    cell = F.shiftright("_u", 32 - RANK_BITS)
    held = rows.groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_c"), F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*keys)
    placed = held.select(*keys, "_cell", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_below"), F.sum("_s").over(all_).alias("_all"), F.sum("_c").over(all_).alias("_n"))
    sized = placed.join(sizes.select(*keys_of(sizes, keys), "_k"), keys_of(sizes, keys))
    edge = sized.where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") >= F.col("_k")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_u", "id"))
    near = rows.withColumn("_cell", cell).join(edge.select(*keys, "_cell", "_before", "_k"), [*keys, "_cell"]).withColumn("_r", rank + F.col("_before"))
    part = near.groupBy(*keys).agg(F.sum(F.when(F.col("_r") <= F.col("_k"), F.col(value))).alias("_part"))
    return edge.join(part, keys).select(*keys, (F.col("_below") + F.col("_part")).alias("_low"), "_all", "_n", "_k")


def keys_of(sizes: DataFrame, keys: list[str]) -> list[str]:
    return [k for k in keys if k in sizes.columns]


def permutation_p(outcomes: DataFrame, keys: list[str], replicates: int = 1000, seed: int = 20260901, value: str = "outcome", flag: str = "treated") -> DataFrame:
    """(count(|diff*| >= |diff|) + 1) / (B + 1) over label permutations: in each replicate the rows of smallest hash play the treated ones."""
    cell = F.xxhash64(*(x for k in keys for x in (F.col(k), F.col(k).isNull())))
    known = outcomes.where(F.col(value).isNotNull()).select(*keys, cell.alias("_cell"), F.col("id").cast("bigint").alias("id"), F.col(flag).alias("_t"), F.col(value).cast("double").alias("_v"))
    side = F.when(F.col("_t"), F.col("_v"))
    real = staged(known.groupBy(*keys, "_cell").agg(F.count_if(F.col("_t")).alias("_k"), F.count("*").alias("_n"), F.sum("_v").alias("_s"), F.sum(side).alias("_st"), (F.avg(side) - F.avg(F.when(~F.col("_t"), F.col("_v")))).alias("diff")), "real")
    tests = real.where("_k > 0 AND _n > _k").select("_cell", *(F.col(f"_{c}").alias(c) for c in ("k", "n", "s", "st")))
    hits = digest_permutation(known.select("_cell", "id", "_v").join(F.broadcast(tests.select("_cell")), "_cell", "left_semi"), tests, replicates, seed)  # tests: one row for each cell
    return real.join(hits, "_cell", "left").select(*keys, "diff", ((F.coalesce("hits", F.lit(0)) + 1) / (replicates + 1)).alias("p_value"))


def role(level: str = "level", population: str = "population", horizon: str = "horizon", pooled: str = "POOLED", primary: int = 24) -> Column:
    return F.when(F.col(level) == "regime", "EXPLORATORY").when((F.col(population) == pooled) & (F.col(horizon) == primary), "PRIMARY").otherwise("SECONDARY")


def bh_adjust(tests: DataFrame, study: list[str], p: str = "p_value", role_col: str = "role") -> DataFrame:
    """Benjamini-Hochberg within each study over SECONDARY tests; the others have no adjusted value."""
    family = (F.col(role_col) == "SECONDARY") & F.col(p).isNotNull()
    w = Window.partitionBy(*study, family)
    up = w.orderBy(p, *[c for c in tests.columns if c not in (p, *study)])
    scaled = tests.withColumn("_r", F.row_number().over(up)).withColumn("_m", F.count("*").over(w)).withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    back = F.min("_q").over(w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("p_adjusted", F.when(family, F.least(F.lit(1.0), back))).drop("_r", "_m", "_q")


def control_sample(outcomes: DataFrame, keys: list[str], seed: int, value: str = "outcome", flag: str = "treated") -> DataFrame:
    """Mean of a hash-ordered sample of ordinary rows (as many as treated, at most) against all ordinary rows."""
    known = outcomes.where(F.col(value).isNotNull())
    size = known.groupBy(*keys).agg(F.least(F.count_if(F.col(flag)), F.count_if(~F.col(flag))).alias("_k"))
    rows = known.where(~F.col(flag)).select(*keys, "id", F.col(value).alias("_v"), draw(seed, F.col("id")).alias("_u"))
    got = lowest(rows, size.where("_k > 0"), keys)
    return size.select(*keys).join(got.select(*keys, (F.col("_low") / F.col("_k") - F.col("_all") / F.col("_n")).alias("control_diff")), keys, "left")


def control_shuffled(outcomes: DataFrame, keys: list[str], seed: int, value: str = "outcome", flag: str = "treated") -> DataFrame:
    """Mean difference under one permutation of the labels."""
    known = outcomes.where(F.col(value).isNotNull())
    size = known.groupBy(*keys).agg(F.count_if(F.col(flag)).alias("_k"))
    got = lowest(known.select(*keys, "id", F.col(value).alias("_v"), draw(seed, F.col("id")).alias("_u")), size.where("_k > 0"), keys)
    diff = F.col("_low") / F.col("_k") - F.try_divide(F.col("_all") - F.col("_low"), F.col("_n") - F.col("_k"))
    return size.select(*keys).join(got.select(*keys, diff.alias("shuffled_diff")), keys, "left")


def placebo(outcomes: DataFrame, keys: list[str], low: float = 45.0, high: float = 55.0, value: str = "outcome") -> DataFrame:
    """Mean of rows in a middle percentile band against all ordinary rows."""
    band = (F.col("percentile") >= low) & (F.col("percentile") < high)
    return outcomes.groupBy(*keys).agg((F.avg(F.when(band, F.col(value))) - F.avg(F.when(~F.col("treated"), F.col(value)))).alias("placebo_diff"))


def leakage_probe(ticks: DataFrame, cuts: list[str], label) -> DataFrame:
    """For each cut time: labels computed on the data up to it that differ from those on all data; PASS if there is none."""
    full = label(ticks)
    found = None
    for cut in cuts:
        at = F.lit(cut).cast("timestamp")
        part = label(ticks.where(F.col("observed_at") <= at)).exceptAll(full.where(F.col("observed_at") <= at)).agg(F.count("*").alias("n_changed"))
        row = part.select(F.lit(cut).alias("cut"), "n_changed", F.when(F.col("n_changed") == 0, "PASS").otherwise("FAIL").alias("status"))
        found = row if found is None else found.unionByName(row)
    return found


def temporal_stability(outcomes: DataFrame, keys: list[str], value: str = "outcome", least: int = 2) -> DataFrame:
    """Effect before and after the midpoint of the events: STABLE, SIGN_REVERSING or INSUFFICIENT_SAMPLE."""
    ends = outcomes.groupBy(*keys).agg(((F.min(F.unix_micros("observed_at")) + F.max(F.unix_micros("observed_at"))) / 2).alias("_mid"))
    side = F.unix_micros("observed_at") <= F.col("_mid")
    mean = lambda first, t: F.avg(F.when((side == first) & (F.col("treated") == t), F.col(value)))
    n = lambda first, t: F.count(F.when((side == first) & (F.col("treated") == t), F.col(value)))
    got = outcomes.join(ends, keys).groupBy(*keys).agg((mean(True, True) - mean(True, False)).alias("before"), (mean(False, True) - mean(False, False)).alias("after"), F.least(n(True, True), n(True, False), n(False, True), n(False, False)).alias("_n"))
    return got.select(*keys, "before", "after", F.when(F.col("_n") < least, "INSUFFICIENT_SAMPLE").when(F.col("before") * F.col("after") >= 0, "STABLE").otherwise("SIGN_REVERSING").alias("stability"))


def cross_asset(effects: DataFrame, value: str = "mean_diff") -> DataFrame:
    """Whether the assets' known effects share a sign."""
    e = F.col(value)
    same = F.bool_and(e >= 0) | F.bool_and(e <= 0)
    return effects.where(e.isNotNull()).agg(F.count("*").alias("n_assets"), same.alias("_same")).select("n_assets", F.when(F.col("n_assets") < 2, "INSUFFICIENT").when(F.col("_same"), "CONSISTENT").otherwise("MIXED").alias("consistency"))


def pseudo_replication(tests: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Significant by observation but not by regime."""
    one = tests.where("level = 'observation'").select(*keys, F.col("p_value").alias("p_observation"))
    two = tests.where("level = 'regime'").select(*keys, F.col("p_value").alias("p_regime"))
    return one.join(two, keys).withColumn("warning", (F.col("p_observation") < alpha) & (F.col("p_regime") >= alpha))


def disposition(results: DataFrame, alpha: float = 0.05, least: int = 12, least_regimes: int = 5) -> DataFrame:
    """One verdict for each result row: has_receipts, n_treated, n_regimes, pseudo, p_value, mean_diff, shuffled_diff, critic."""
    supported = (F.col("p_value") < alpha) & (F.abs("mean_diff") > 0) & (F.abs("shuffled_diff") < F.abs("mean_diff"))
    base = F.when(~F.col("has_receipts"), "DATA_INSUFFICIENT").when((F.col("n_treated") < least) | (F.col("n_regimes") < least_regimes), "DATA_INSUFFICIENT").when(F.col("pseudo"), "INCONCLUSIVE").when(F.col("p_value").isNull(), "DATA_INSUFFICIENT").when(supported & (F.col("critic") == "ACCEPT"), "SUPPORTED").when(supported, "INCONCLUSIVE").when(F.col("p_value") >= alpha, "REJECTED").otherwise("INCONCLUSIVE")
    return results.withColumn("disposition", base)


def event_dataset(ticks: DataFrame, candles: DataFrame, spec: str, horizons: tuple[int, ...] = (1, 4, 24), threshold: float = 90.0, window: int = 30) -> DataFrame:
    """The study's long table: one row for each tick and horizon with percentile, treatment, regime, stratum, outcome and a content-derived event id."""
    marked = regimes(treated(ticks, threshold, window))
    full = forward_outcomes(strata(marked, candles), candles, horizons)
    return full.withColumn("event_id", F.sha2(F.concat_ws("|", F.lit(spec), "asset", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256))


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a dataset: the count, and the exclusive or of the first 60 bits of the rows' MD5."""
    own = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return rows.agg(F.count("*").alias("n_rows"), F.bit_xor(own).alias("digest"))
