"""Structured Streaming forms of the batch semantics. Each takes a streaming DataFrame of ticks (id, asset, observed_at, funding_rate) and returns one, unless it says otherwise."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.session import shared_dir


def dedup(ticks: DataFrame, keys: list[str], late: str = "2 hours", ts: str = "observed_at") -> DataFrame:
    """Catch-up with overlap: rows of a key seen within the watermark are dropped."""
    return ticks.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def hourly(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """asset, observed_at (hour), mark_price (last value), n_ticks; in append mode an hour appears once the watermark has passed it, so only complete hours do."""
    w = ticks.withWatermark("observed_at", late).groupBy("asset", F.window("observed_at", "1 hour").alias("w"))
    return w.agg(F.max_by("funding_rate", F.struct("observed_at", "id")).alias("mark_price"), F.count("*").alias("n_ticks")).select("asset", F.col("w.start").alias("observed_at"), "mark_price", "n_ticks")


def as_received(ticks: DataFrame, cutoff: Column, received: str = "retrieved_at") -> DataFrame:
    """Rows received by the cutoff: later arrivals do not change a past result."""
    return ticks.where(F.col(received) <= cutoff)


def sessions(treated: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """asset, start_at, end_at, n_ticks of runs of qualifying ticks with at most the gap between them (an unqualified tick inside does not break a run)."""
    w = treated.withWatermark("observed_at", late).groupBy("asset", F.session_window("observed_at", gap).alias("w"))
    return w.agg(F.min("observed_at").alias("start_at"), F.max("observed_at").alias("end_at"), F.count("*").alias("n_ticks")).select("asset", "start_at", "end_at", "n_ticks")


def percentiles(ticks: DataFrame, window: int = 30) -> DataFrame:
    """id, asset, percentile (strict) of each tick against the trailing window of its asset, kept in state as a ring of values. Each batch is put in order of time before it is used; across batches the ticks of an asset must come in order of time."""

    def step(key, frames, state):
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["observed_at", "id"])
        out = []
        for v in rows["funding_rate"]:
            ring = [*ring, v][-window:]
            out.append(100.0 * sum(x < v for x in ring) / len(ring))
        state.update((ring,))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "asset": key[0], "percentile": out})

    return ticks.groupBy("asset").applyInPandasWithState(step, "id bigint, asset string, percentile double", "ring array<double>", "append", GroupStateTimeout.NoTimeout)


#: What an asset keeps between batches: ticks still waiting for the watermark, the last values, the last tick used and the number of regimes so far.
WAITING = "at array<bigint>, ids array<bigint>, values array<double>, ring array<double>, last bigint, was boolean, regime bigint"


def regimes(ticks: DataFrame, late: str = "1 hour", threshold: float = 90.0, window: int = 30, gap_seconds: int = 3600) -> DataFrame:
    """id, asset, percentile (strict, trailing), treated, regime, starts of each tick, used in order of event time whatever order files and batches bring.

    A tick waits in its asset's state until the watermark (latest time less `late`) has reached it; then all that may be used are put in order of (observed_at,
    id), so the rows are those of the batch forms over the same ticks. A timer wakes an asset that gets no more ticks. State is the ticks of the last `late` plus
    `window` values for each asset; ticks without a time or a value are dropped, late ones too unless they still come after the last tick used of their asset (Spark
    lets rows in by the watermark of the batch before); ticks after the last watermark stay in state.
    """

    def step(key, frames, state):
        at, ids, values, ring, last, was, regime = state.get if state.exists else ([], [], [], [], None, False, 0)
        new = [f for f in frames if len(f)]
        # Nanoseconds or microseconds, as pandas has it: state holds microseconds.
        at = np.concatenate([np.asarray(at, np.int64), *(f["observed_at"].to_numpy().astype("datetime64[us]").astype(np.int64) for f in new)])
        ids = np.concatenate([np.asarray(ids, np.int64), *(f["id"].to_numpy(np.int64) for f in new)])
        values = np.concatenate([np.asarray(values, float), *(f["funding_rate"].to_numpy(float) for f in new)])
        order = np.lexsort((ids, at))
        order = order if last is None else order[at[order] > last]
        at, ids, values = at[order], ids[order], values[order]
        mark = state.getCurrentWatermarkMs()
        n = int(np.searchsorted(at, mark * 1000, "right"))
        if n:
            known = np.concatenate([np.full(window - 1 - len(ring), np.nan), np.asarray(ring, float), values[:n]])
            views, now = np.lib.stride_tricks.sliding_window_view(known, window), values[:n, None]
            lower = ((views < now) | (np.isnan(now) & ~np.isnan(views))).sum(1)  # NaN is the largest value, as in Spark
            percentile = 100.0 * lower / np.minimum(window, len(ring) + 1 + np.arange(n))
            treated = percentile >= threshold
            before = np.concatenate([[was], treated[:-1]])
            gap = np.diff(at[:n], prepend=at[0] if last is None else last) > gap_seconds * 1_000_000
            starts = treated & (~before | gap)
            number = regime + np.cumsum(starts)
            ring, last, was, regime = [*ring, *values[:n].tolist()][-(window - 1):] if window > 1 else [], int(at[n - 1]), bool(treated[-1]), int(number[-1])
            yield pd.DataFrame({"id": ids[:n], "asset": key[0], "percentile": percentile, "treated": treated, "regime": pd.Series(number, dtype="Int64").where(treated), "starts": starts})
        state.update((at[n:].tolist(), ids[n:].tolist(), values[n:].tolist(), list(ring), last, was, regime))
        if n < len(at):
            state.setTimeoutTimestamp(max(mark + 1, -(-int(at[n]) // 1000) - 1))

    known = ticks.where("observed_at IS NOT NULL AND funding_rate IS NOT NULL").select("id", "asset", "observed_at", "funding_rate").withWatermark("observed_at", late)
    schema = "id bigint, asset string, percentile double, treated boolean, regime bigint, starts boolean"
    return known.groupBy("asset").applyInPandasWithState(step, schema, WAITING, "append", GroupStateTimeout.EventTimeTimeout)


def gate(assets: list[str], path: str, stale_hours: int = 30) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: after each batch one row with the watermark over all assets and whether it blocks, from all batches so far.

    Each batch leaves every asset's latest times (a row for each asset) under its id, so a repeated batch overwrites its own, and the gate takes the maxima over them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.where(F.col("asset").isin(assets)).groupBy("asset").agg(F.max("observed_at").alias("m"), F.max("retrieved_at").alias("r"))
        own.write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        seen = batch.sparkSession.read.schema("asset string, m timestamp, r timestamp, batch bigint").parquet(f"{path}/seen").where(F.col("batch") <= batch_id)
        each = seen.groupBy("asset").agg(F.max("m").alias("m"), F.max("r").alias("r"))
        one = each.agg(F.count("*").alias("n"), F.min("m").alias("watermark"), F.max("r").alias("now"))
        stale = F.col("now") - F.expr(f"INTERVAL {stale_hours} HOURS") > F.col("watermark")
        one.select(F.when(F.col("n") < len(assets), "MISSING_ASSET").when(stale, "STALE").otherwise("READY").alias("status"), "watermark").write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    return write


def events_stream(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """The events table as a stream of ticks."""
    batch = spark.read.parquet(path)
    parent, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_each)
    # A stream reads folders: where the table is one file, its folder with that name alone.
    e = reader.option("pathGlobFilter", name).parquet(parent) if [f.rsplit("/", 1)[1] for f in batch.inputFiles()] == [name] else reader.parquet(path)
    at = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("asset"), at.alias("observed_at"), F.col("value").alias("funding_rate"), F.timestamp_seconds(F.unix_micros(at) / 1_000_000 + F.col("event_id") % 7200).alias("retrieved_at"))


#: Ticks of a file of a replayed table, on average.
REPLAYED = 500_000


def replayed(spark: SparkSession, path: str, rows: int = REPLAYED, ts: str = "ts") -> str:
    """A folder with the table at `path` as files of some `rows` rows in order of time, the earliest file the oldest, as a collector would have left them.

    A stream that takes a file a batch then holds a bounded number of ticks at once, however large the table; one file with all of them would be one batch, whose
    ticks all wait in state together. Rows of one time are in one file.
    """
    table = spark.read.parquet(path)
    files = max(1, -(-table.count() // rows))
    home = f"{shared_dir(spark)}/tidemark/replayed-{uuid.uuid4().hex}"
    cut = table.repartitionByRange(files, ts).withColumn("_file", F.spark_partition_id())
    cut.write.partitionBy("_file").parquet(f"{home}/cut")
    parts = spark.read.schema(cut.schema).parquet(f"{home}/cut")
    for (k,) in parts.select("_file").distinct().orderBy("_file").collect():  # a row for each file
        parts.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(f"{home}/ticks")
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/cut")
    whole.getFileSystem(spark._jsc.hadoopConfiguration()).delete(whole, True)
    return f"{home}/ticks"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there and returns what it wrote; progress and output are in the shared folder, so a restart resumes."""
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/progress").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


class Paused(RuntimeError):
    """A run has done as many batches as it may."""


def continued(stream: DataFrame, home: str, most: int | None = None) -> DataFrame:
    """Runs the stream from where the folder `home` stands, through at most `most` batches, and returns all that this and earlier runs have written.

    `home` holds progress, state and output, so a run that ended for whatever reason (a lost driver, an error, `most`) is taken up by the next one with the same
    folder. Each batch overwrites the folder of its own number: one that was written but not yet committed when its run ended is written again, not twice.
    """
    spark, done = stream.sparkSession, []

    def write(batch: DataFrame, batch_id: int) -> None:
        if most is not None and len(done) >= most:
            raise Paused(f"{most} batches done")
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")
        done.append(batch_id)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except StreamingQueryException as stopped:
        if most is None or len(done) < most or Paused.__name__ not in str(stopped):
            raise
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(f"{home}/out").drop("batch") if done or _exists(spark, f"{home}/out") else spark.createDataFrame([], stream.schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def gated(stream: DataFrame, assets: list[str]) -> DataFrame:
    """The gate's row after the last batch."""
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/tidemark/gate-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(gate(assets, home)).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("status string, watermark timestamp, batch bigint").parquet(f"{home}/out")
    return rows.groupBy().agg(F.max_by(F.struct("status", "watermark"), "batch").alias("g")).select("g.*").where("status IS NOT NULL")
