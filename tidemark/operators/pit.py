"""Point-in-time filters under the receipt clock and the source-native clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valuation_hour(as_of: Column | str) -> Column:
    """The last completed hour: floor to the hour, minus one hour."""
    return F.date_trunc("hour", as_of) - F.expr("INTERVAL 1 HOUR")


def native(as_of: Column, kind: str = "observation_kind", observed: str = "observed_at") -> Column:
    """A candle is known one hour after its opening stamp; anything else counts up to the valuation hour."""
    return (F.col(observed) <= valuation_hour(as_of)) & ((F.col(kind) != "candle") | (F.col(observed) + F.expr("INTERVAL 1 HOUR") <= as_of))


def visible_native(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where(native(as_of))


def visible_receipt(rows: DataFrame, as_of: Column, received: str = "retrieved_at") -> DataFrame:
    return rows.where((F.col(received) <= as_of) & native(as_of))


def records_as_of(rows: DataFrame, cutoff: Column, published: str = "published_at", keep_undated: bool = True) -> DataFrame:
    dated = F.col(published) <= cutoff
    return rows.where(F.col(published).isNull() | dated if keep_undated else dated)


def dispositions(items: DataFrame, receipts: DataFrame, as_of: Column, relevant: Column, receipt_clock: bool = True) -> DataFrame:
    """disposition and reason_code of each item: availability first, then relevance, then whether a raw receipt exists. receipts: source_item_id."""
    archived = receipts.select(F.col("source_item_id").alias("id"), F.lit(True).alias("_archived")).distinct()
    late = F.col("retrieved_at") > as_of if receipt_clock else F.lit(False)
    unpublished = F.col("published_at").isNull() | (F.col("published_at") > as_of)
    rules = [(unpublished, "REJECTED_AVAILABILITY", "PUBLISHED_AFTER_AS_OF"), (late, "REJECTED_AVAILABILITY", "RETRIEVED_AFTER_AS_OF"), (~relevant, "REJECTED_RELEVANCE", "STRICT_TOPIC_GATE"), (F.col("_archived").isNull(), "RETAINED_LEGACY_UNARCHIVED", "NO_RAW_ARCHIVE_RECEIPT")]
    what = why = None
    for test, d, r in rules:
        what, why = (F.when(test, d), F.when(test, r)) if what is None else (what.when(test, d), why.when(test, r))
    return items.join(archived, "id", "left").withColumn("disposition", what.otherwise("RETAINED")).withColumn("reason_code", why).drop("_archived")
