"""Idempotent ingestion, content-addressed archives, identities, backfill windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column, *attributes: Column) -> Column:
    """SHA-256 of the text and the attributes as JSON in a fixed field order; nulls are empty."""
    return F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), *(F.coalesce(a.cast("string"), F.lit("")) for a in attributes)).cast("binary"), 256)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. One aggregation: it pre-combines, so a frequent key costs no task more."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def insert_only(batch: DataFrame, store: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows to append: the first of each key in the batch, unless the store has the key."""
    return first_of(batch, keys, order).join(store.select(*keys).distinct(), keys, "left_anti")


def upsert(batch: DataFrame, store: DataFrame, keys: list[str], hash_col: str, order: list[str]) -> DataFrame:
    """The store after the batch: inserted, updated (hash differs) or kept, told by `change`."""
    new = first_of(batch, keys, order).alias("n")
    old = store.alias("o")
    both = old.join(new, keys, "full_outer")
    rest = [c for c in store.columns if c not in keys]
    change = F.when(F.col(f"o.{hash_col}").isNull(), "inserted").when(F.col(f"n.{hash_col}").isNull(), "untouched").when(F.col(f"n.{hash_col}") != F.col(f"o.{hash_col}"), "updated").otherwise("skipped")
    take = F.col(f"n.{hash_col}").isNotNull() & (F.col(f"o.{hash_col}").isNull() | (F.col(f"n.{hash_col}") != F.col(f"o.{hash_col}")))
    return both.select(*keys, *(F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest), change.alias("change"))


def media_type(payload: Column) -> Column:
    return F.when(payload.isNull(), "text/plain").when(F.ltrim(payload).startswith("<"), "application/xml").otherwise("application/json")


def archive(payloads: DataFrame, known: DataFrame, types: tuple[str, ...] = ("application/json", "application/xml", "text/plain"), most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(artifacts, rejected): one artifact for each new content hash; rejects with their reason. payloads: payload, media_type, retrieved_at, id."""
    reason = F.when(~F.col("media_type").isin(*types), "MEDIA_TYPE").when(F.octet_length("payload") > most, "TOO_LARGE")
    judged = payloads.withColumn("reason", reason).withColumn("sha", F.sha2(F.col("payload").cast("binary"), 256))
    fine = judged.where("reason IS NULL").groupBy("sha").agg(F.min("media_type").alias("media_type"), F.max(F.octet_length("payload")).alias("byte_size")).join(known.select("sha"), "sha", "left_anti")
    return fine.withColumn("uri", F.concat(F.lit("objects/"), F.substring("sha", 1, 2), F.lit("/"), "sha")), judged.where("reason IS NOT NULL").select("id", "reason")


def work_identity(doi: Column, title: Column) -> Column:
    """doi:... if there is one, else title:... of letters and digits in lower case."""
    plain = F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", " "))
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(F.nullif(doi, F.lit("")))), F.concat(F.lit("title:"), plain))


def works(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, locations): one work for each identity, its first record's title; one location for each (identity, source_name)."""
    w = records.groupBy("identity").agg(F.min_by("title", "id").alias("title"), F.min("id").alias("first_id"), F.count_distinct("source_name").alias("n_locations"))
    return w, records.select("identity", "source_name").distinct()


def fan_in(sources: dict[str, DataFrame], least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(records, status): the union of the sources, and READY or DEGRADED for each by its row count."""
    named = [df.withColumn("source", F.lit(name)) for name, df in sorted(sources.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    spark = named[0].sparkSession
    names = spark.createDataFrame([(n,) for n in sorted(sources)], "source string")
    counts = rows.groupBy("source").agg(F.count("*").alias("n_rows"))
    return rows, names.join(counts, "source", "left").select("source", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.coalesce("n_rows", F.lit(0)) >= least, "READY").otherwise("DEGRADED").alias("status"))


def source_dimension(records: DataFrame, registry: DataFrame, default: str = "UNKNOWN") -> DataFrame:
    """One row for each source: the first record's attribute, else the registry's, else the default."""
    seen = records.groupBy("source_name").agg(F.min_by("role", "id").alias("own"), F.count("*").alias("n_records"))
    return seen.join(registry.select("source_name", F.col("role").alias("registered")), "source_name", "left").select("source_name", "n_records", F.coalesce("own", "registered", F.lit(default)).alias("role"))


def backfill_windows(bounds: DataFrame, completed: DataFrame, days: int = 7) -> DataFrame:
    """Chunks of [start, end], the last one short, one microsecond apart; those completed are left out. bounds: asset, start, end; completed: asset, window_start."""
    steps = bounds.withColumn("window_start", F.explode(F.sequence("start", "end", F.expr(f"INTERVAL {days} DAYS"))))
    cut = F.least(F.col("end"), F.col("window_start") + F.expr(f"INTERVAL {days} DAYS") - F.expr("INTERVAL 0.000001 SECOND"))
    return steps.select("asset", "window_start", cut.alias("window_end")).join(completed, ["asset", "window_start"], "left_anti")


def one_year_back(ts: Column) -> Column:
    """The same time one year earlier, clamped to the month's length, at the full hour."""
    return F.date_trunc("hour", F.add_months(ts, -12).cast("timestamp") + (ts - F.date_trunc("day", ts)))


def resolve_run(runs: DataFrame, **equal) -> DataFrame:
    """The run with these values, if there is exactly one."""
    found = runs.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equal.items()], F.lit(True)))
    return found.agg(F.count("*").alias("_n"), F.any_value(F.struct(*runs.columns)).alias("_r")).where("_n = 1").select("_r.*")


def consolidate(ticks: DataFrame, start: Column, end: Column, cap: int) -> DataFrame:
    """Ticks within [start, end], the first of each (asset, time_ms), oldest first, `cap` for each asset at most (the cap is the provider's)."""
    inside = ticks.where((F.col("observed_at") >= start) & (F.col("observed_at") <= end)).withColumn("time_ms", F.unix_millis("observed_at"))
    one = first_of(inside, ["asset", "time_ms"], ["id"])
    return one.withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy("time_ms"))).where(F.col("rn") <= cap)


def diagnostics(ticks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Raw, malformed, eligible and duplicate counts by asset: of the ticks of one millisecond in range the first is eligible, the later ones are duplicates."""
    ok = F.col("funding_rate").isNotNull() & ~F.isnan("funding_rate")
    inside = ok & (F.col("observed_at") >= start) & (F.col("observed_at") <= end)
    each = ticks.groupBy("asset", F.when(inside, F.unix_millis("observed_at")).alias("_ms")).agg(F.count("*").alias("_raw"), F.count_if(~ok).alias("_bad"))
    first = F.col("_ms").isNotNull()
    return each.groupBy("asset").agg(F.sum("_raw").alias("raw"), F.sum("_bad").alias("malformed"), F.count_if(first).alias("eligible"), F.coalesce(F.sum(F.when(first, F.col("_raw") - 1)), F.lit(0)).alias("duplicate"))


def candle_normalize(candles: DataFrame, start: Column, end: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantine): aligned opens in range with their close, `limit` for each asset; unaligned opens apart."""
    aligned = F.date_trunc("hour", "open_at") == F.col("open_at")
    inside = candles.where((F.col("open_at") >= start) & (F.col("open_at") <= end))
    good = inside.where(aligned).withColumn("close_at", F.col("open_at") + F.expr("INTERVAL 1 HOUR"))
    ranked = good.withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy("open_at", "id")))
    return ranked.where(F.col("rn") <= limit), inside.where(~aligned).select("id", "asset", F.lit("UNALIGNED_OPEN").alias("reason"))
