"""Stores: keyed tables on disk of which a batch rewrites the touched partitions alone, with the run's counts taken while it writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import discard, staged

#: Changes of a row that make its partition be written again.
WRITES = ("inserted", "updated", "deleted")


def spread(keys: list[str], parts: int = 64) -> Column:
    """Partition number of a key, for stores without a natural range such as a day."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts))


def merged(batch: DataFrame, store: DataFrame, keys: list[str], hash_col: str, order: list[str]) -> DataFrame:
    """The store after the batch, with `change` and `copies` (the batch's rows under the key).

    The first row of a key in `order` counts: inserted (new key), updated (another hash), skipped (same hash) or untouched (not in the batch). A row with a
    null in its key is failed; failed rows of one key are one row here and never part of a store.
    """
    rest = [c for c in store.columns if c not in keys]
    new = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_new"), F.count("*").alias("copies"))
    both = store.select(*keys, F.struct(*rest).alias("_old")).join(new, keys, "full_outer")
    bad = F.col("_old").isNull() & ~F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)
    same = F.col(f"_new.{hash_col}").eqNullSafe(F.col(f"_old.{hash_col}"))
    change = F.when(bad, "failed").when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "untouched").when(same, "skipped").otherwise("updated")
    row = F.when(F.col("change").isin("inserted", "updated", "failed"), F.col("_new")).otherwise(F.col("_old"))
    held = both.withColumn("change", change).select(*keys, row.alias("_row"), "change", F.coalesce("copies", F.lit(0)).alias("copies"))
    return held.select(*keys, "_row.*", "change", "copies")


def rewrite(rows: DataFrame, path: str, part_col: str, observation: Observation | None = None) -> list:
    """Puts rows (with `change`; deleted and failed ones are left out) in place of the partitions in which one was inserted, updated or deleted; returns these.

    The rows are staged first, as they are usually made from the store itself; a run that dies before the end can simply be made again. The driver holds the
    names of the touched partitions only.
    """
    spark = rows.sparkSession
    counted = rows if observation is None else rows.observe(observation, F.coalesce(F.sum("copies"), F.lit(0)).alias("retrieved"), F.coalesce(F.sum(F.when(F.col("change") == "failed", F.col("copies"))), F.lit(0)).alias("failed"), *(F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "updated")))
    held = staged(counted, "store")
    each = held.groupBy(part_col).agg(F.bool_or(F.col("change").isin(*WRITES)).alias("touched"), F.count_if(~F.col("change").isin("deleted", "failed")).alias("left"))
    touched = each.where("touched").collect()
    full = [r[0] for r in touched if r["left"]]
    if full:
        fresh = held.where(F.col(part_col).isin(full) & ~F.col("change").isin("deleted", "failed")).drop("change", "copies")
        fresh.repartition(part_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path)
    for r in touched:
        if not r["left"]:  # an overwrite leaves a partition without a row as it was
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part_col}={r[0]}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    discard(held)
    return sorted(r[0] for r in touched)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store, or no row where there is none yet."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def collect(batch: DataFrame, path: str, keys: list[str], hash_col: str, order: list[str], part: Column, runs_path: str, source: str, requested: int) -> dict:
    """Merges a batch into the store at `path` and appends the run's row to `runs_path`: source, requested, retrieved, inserted, updated, duplicates, failed, status, started_at, ended_at.

    The batch is read once: the counts are observed in the last stage of the job that writes the merged rows, so a repeated task does not count twice.
    `part` (a column over the keys) names the partition; only partitions that the batch meets are read. SUCCESS; PARTIAL if rows have no key; FAILED, with the error
    raised again, if the job dies.
    """
    spark = batch.sparkSession
    began = spark.sql("SELECT now()").first()[0]
    row = {"source": source, "requested": requested, "retrieved": 0, "inserted": 0, "updated": 0, "duplicates": 0, "failed": 0, "status": "FAILED"}
    seen = Observation()
    try:
        placed = batch.withColumn("_part", part)
        store = read(spark, path, placed.schema)
        met = placed.select("_part").distinct().hint("broadcast")  # one row for each partition of the store at most: pruned while it runs
        rewrite(merged(placed, store.join(met, "_part", "left_semi").select(*placed.columns), keys, hash_col, order), path, "_part", seen)
        got = seen.get
        row |= {k: got[k] for k in ("retrieved", "inserted", "updated", "failed")}
        row["duplicates"] = row["retrieved"] - row["failed"] - row["inserted"] - row["updated"]
        row["status"] = "PARTIAL" if row["failed"] else "SUCCESS"
        return row
    finally:
        table = "source string, requested bigint, retrieved bigint, inserted bigint, updated bigint, duplicates bigint, failed bigint, status string"
        spark.createDataFrame([tuple(row.values())], table).select("*", F.lit(began).alias("started_at"), F.now().alias("ended_at")).coalesce(1).write.mode("append").parquet(runs_path)
