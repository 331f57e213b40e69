"""Windows over few, long keys: rows are numbered in two levels and cut into chunks with a halo, so no task holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk of a bounded row frame.
CHUNK = 4096


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, name: str = "_rank") -> DataFrame:
    """0-based position of each row within its key. bucket must not decrease with the order; only counts per bucket cross buckets."""
    df = df.withColumn("_bucket", bucket)
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return df.withColumn("_local", local).join(base, [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.col("_local")).drop("_bucket", "_local", "_base")


def chunked(df: DataFrame, keys: list[str], halo: int, rank: str = "_rank", size: int = CHUNK) -> DataFrame:
    """Adds _chunk; a row within `halo` of its chunk's end is repeated in the next chunk with _own false."""
    at = F.floor(F.col(rank) / size)
    late = F.col(rank) % size >= size - halo
    return df.withColumn("_chunk", F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_chunk") == at)


def trailing(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, rows: int, columns: dict) -> DataFrame:
    """Adds columns computed over the trailing `rows` rows (the current one included) of each key: name -> function of the window."""
    halo = chunked(numbered(df, keys, order, bucket), keys, rows - 1)
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_rank").rowsBetween(-(rows - 1), 0)
    return halo.withColumns({k: f(frame) for k, f in columns.items()}).where("_own").drop("_chunk", "_own")


def running(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Running sum of `value` along the key: sums within a bucket plus the totals of the buckets before."""
    df = df.withColumn("_bucket", bucket).withColumn("_v", value)
    local = F.sum("_v").over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys, "_bucket").agg(F.sum("_v").alias("_t")).select(*keys, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    return df.withColumn("_local", local).join(base, [*keys, "_bucket"]).withColumn(name, F.col("_base") + F.col("_local")).drop("_bucket", "_v", "_local", "_base")


def hours(ts: Column | str) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts) / 3600)


def ranged(df: DataFrame, keys: list[str], hour: str, span: int, columns: dict, size: int = 720) -> DataFrame:
    """Adds columns over the range [hour - span + 1, hour]; keys are cut into stretches of `size` hours with a halo of `span`."""
    at = F.floor(F.col(hour) / size)
    late = F.pmod(F.col(hour), F.lit(size)) >= size - span
    halo = df.withColumn("_chunk", F.explode(F.when(late, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_chunk") == at)
    frame = Window.partitionBy(*keys, "_chunk").orderBy(hour).rangeBetween(-(span - 1), 0)
    return halo.withColumns({k: f(frame) for k, f in columns.items()}).where("_own").drop("_chunk", "_own")
