"""Tables of the research domain derived from the given tables, for Spark and as SQL views for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table; timestamps without a zone become UTC instants."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else f.name for f in df.schema))


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds doubles and drops the zone of timestamps, as the oracle's rows have them."""
    kinds = {f.name: f.dataType for f in df.schema}
    cast = lambda c, k: F.round(c, digits).alias(c) if isinstance(k, T.DoubleType) else F.col(c).cast("timestamp_ntz").alias(c) if isinstance(k, T.TimestampType) else F.col(c)
    return df.select(*(cast(c, k) for c, k in kinds.items()))


def funding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("asset"), F.col("ts").alias("observed_at"), F.col("value").alias("funding_rate"), F.timestamp_seconds(F.unix_micros("ts") / 1_000_000 + F.col("event_id") % 7200).alias("retrieved_at"))


def candle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("observed_at")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("mark_price"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of events with an even number of thousands are candle stamps: observation_kind tells."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("asset"), F.col("ts").alias("observed_at"), F.when(F.col("event_id") % 3 == 0, "candle").otherwise("funding").alias("observation_kind"), F.col("value").alias("value"), F.timestamp_seconds(F.unix_micros("ts") / 1_000_000 + F.col("event_id") % 7200).alias("retrieved_at"))


def receipts(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).where("id % 11 <> 0").withColumn("copy", F.explode(F.when(F.col("id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    native = F.when((F.col("observation_kind") == "candle") & (F.col("id") % 17 != 0), F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("observed_at"))
    return o.select((F.col("id") * 2 + F.col("copy")).alias("id"), F.col("id").alias("market_observation_id"), native.alias("source_native_timestamp"), (F.col("id") % 7).alias("collection_run_id"), "retrieved_at", F.when(F.col("id") % 5 == 0, "REPLAY").otherwise("PRODUCTION").alias("analysis_mode"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("event_id") % 7).alias("id")).agg(F.count("*").alias("requested"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).withColumn("status", F.when(F.col("id") == 3, "FAILED").otherwise("SUCCESS"))


def items(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    day = F.when(F.col("doc_id") % 17 != 0, F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 40) * 86400))
    base = docs.join(labels, "doc_id", "left")
    return base.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("external_id"), F.when(F.col("doc_id") % 3 == 0, "SOCIAL").otherwise("ACADEMIC").alias("source_type"), F.col("source").alias("source_name"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("raw_text"), day.alias("published_at"), F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 45) * 86400).alias("retrieved_at"), "lang", "quality")


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fingerprint"), F.col("o_orderpriority").alias("universe"), F.col("o_orderdate").cast("date").alias("as_of"), F.when(F.col("o_orderstatus") == "F", "REJECTED").otherwise("ACCEPTED").alias("disposition"), F.when(F.col("o_orderkey") % 5 == 0, "REPLAY").otherwise("PRODUCTION").alias("analysis_mode"), F.when(F.col("o_orderkey") % 3 == 0, "MARKET").otherwise("ACADEMIC").alias("channel"), F.col("o_totalprice").alias("score"))


def links(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    channel = F.element_at(F.array(F.lit("MARKET"), F.lit("ACADEMIC"), F.lit("SOCIAL")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("hypothesis_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").alias("source_item_id"), F.col("l_suppkey").alias("independence_key"), channel.alias("channel"), F.col("l_returnflag").alias("relation"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations: the copy and model outputs that gates judge."""
    return table(spark, d, "conversations")


VIEWS = """
funding AS (SELECT event_id AS id, event_type AS asset, ts AS observed_at, value AS funding_rate, ts + to_seconds(event_id % 7200) AS retrieved_at FROM events),
candle AS (SELECT asset, observed_at, mark_price FROM (SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS observed_at, value AS mark_price,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
observations AS (SELECT event_id AS id, event_type AS asset, ts AS observed_at, CASE WHEN event_id % 3 = 0 THEN 'candle' ELSE 'funding' END AS observation_kind, value, ts + to_seconds(event_id % 7200) AS retrieved_at FROM events),
receipts AS (SELECT id * 2 + copy AS id, id AS market_observation_id, CASE WHEN observation_kind = 'candle' AND id % 17 <> 0 THEN observed_at + INTERVAL 1 HOUR ELSE observed_at END AS source_native_timestamp,
  id % 7 AS collection_run_id, retrieved_at, CASE WHEN id % 5 = 0 THEN 'REPLAY' ELSE 'PRODUCTION' END AS analysis_mode
  FROM (SELECT *, unnest(CASE WHEN id % 13 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM observations WHERE id % 11 <> 0)),
runs AS (SELECT event_id % 7 AS id, count(*) AS requested, min(ts) AS started_at, max(ts) AS ended_at, CASE WHEN event_id % 7 = 3 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events GROUP BY event_id % 7),
items AS (SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS external_id, CASE WHEN doc_id % 3 = 0 THEN 'SOCIAL' ELSE 'ACADEMIC' END AS source_type, source AS source_name, substr(text, 1, 80) AS title, text AS raw_text,
  CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 40 AS INTEGER)) END AS published_at, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 45 AS INTEGER)) AS retrieved_at, lang, quality FROM documents LEFT JOIN labels USING (doc_id)),
hypotheses AS (SELECT o_orderkey AS id, o_custkey AS fingerprint, o_orderpriority AS universe, CAST(o_orderdate AS DATE) AS as_of, CASE WHEN o_orderstatus = 'F' THEN 'REJECTED' ELSE 'ACCEPTED' END AS disposition,
  CASE WHEN o_orderkey % 5 = 0 THEN 'REPLAY' ELSE 'PRODUCTION' END AS analysis_mode, CASE WHEN o_orderkey % 3 = 0 THEN 'MARKET' ELSE 'ACADEMIC' END AS channel, o_totalprice AS score FROM orders),
links AS (SELECT l_orderkey AS hypothesis_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS source_item_id, l_suppkey AS independence_key, ['MARKET', 'ACADEMIC', 'SOCIAL'][l_linenumber % 3 + 1] AS channel, l_returnflag AS relation FROM lineitem),
lines AS (SELECT * FROM conversations),
pct AS (SELECT id, asset, observed_at, funding_rate, retrieved_at, 100.0 * len(list_filter(w, lambda x: x < funding_rate)) / len(w) AS strict_pct, 100.0 * len(list_filter(w, lambda x: x <= funding_rate)) / len(w) AS pct
  FROM (SELECT *, list(funding_rate) OVER (PARTITION BY asset ORDER BY observed_at, id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS w FROM funding WHERE funding_rate IS NOT NULL)),
flags AS (SELECT *, strict_pct >= 90 AS treated, strict_pct >= 90 AND (NOT coalesce(lag(strict_pct >= 90) OVER o, false) OR observed_at - lag(observed_at) OVER o > INTERVAL 1 HOUR) AS begins
  FROM pct WINDOW o AS (PARTITION BY asset ORDER BY observed_at, id)),
ev AS (SELECT *, CASE WHEN treated THEN CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY observed_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS regime FROM flags),
steps AS (SELECT e.*, h AS horizon, date_trunc('hour', observed_at) - INTERVAL 1 HOUR AS a FROM ev e CROSS JOIN (SELECT unnest([1, 4, 24]) AS h)),
outc AS (SELECT s.*, CASE WHEN c0.mark_price > 0 AND c1.mark_price > 0 THEN ln(c1.mark_price / c0.mark_price) END AS outcome FROM steps s
  LEFT JOIN candle c0 ON c0.asset = s.asset AND c0.observed_at = s.a LEFT JOIN candle c1 ON c1.asset = s.asset AND c1.observed_at = s.a + to_hours(s.horizon)),
pop AS (SELECT *, asset AS population FROM outc UNION ALL SELECT *, 'POOLED' FROM outc),
levels AS (SELECT 'observation' AS level, * FROM pop UNION ALL SELECT 'regime', * FROM pop WHERE NOT treated OR begins),
logret AS (SELECT c.asset, c.observed_at, c.mark_price AS p, b.mark_price AS q, CASE WHEN c.mark_price > 0 AND b.mark_price > 0 THEN ln(c.mark_price / b.mark_price) END AS lr, CASE WHEN c.mark_price > 0 AND b.mark_price > 0 THEN c.mark_price / b.mark_price - 1 END AS sr
  FROM candle c LEFT JOIN candle b ON b.asset = c.asset AND b.observed_at = c.observed_at - INTERVAL 1 HOUR)
"""


def sql(body: str) -> str:
    """The body after the views; a body that begins with a comma adds views of its own."""
    body = body.strip()
    return f"WITH {VIEWS.strip()}{'' if body.startswith(',') else ' '}{body}"


def dates(df: DataFrame) -> DataFrame:
    """Dates as text, so that either engine's rows look alike."""
    return df.select(*(F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name) for f in df.schema))


def dated(query: str, *columns: str) -> str:
    """The oracle's counterpart of dates()."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({query})"
