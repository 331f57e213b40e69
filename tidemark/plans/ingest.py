"""Ingestion queries over documents, pages and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import ingest as I
from tidemark.operators import metrics, pit
from tidemark.plans.standins import candle, funding, items, out, runs, sql, table
from tidemark.session import shared_dir
from tidemark.sources import stores

LOW, HIGH = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
CUT = "2024-01-25 00:00:00"


def _ts(x):
    return F.lit(x).cast("timestamp")


def _docs(s, d):
    """The corpus as a batch of records whose natural key is the text's hash; the store holds those with even ids below 400."""
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("key"), F.col("source").alias("source_name"), "lang")


def _store(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("id"))


def _hashed(df):
    return df.withColumn("hash", I.content_hash(F.col("price").cast("decimal(18,2)").cast("string"))).select("key", "id", "hash")


def _pages(s, d):
    p = table(s, d, "pages")
    return p.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 10 == 0, None).otherwise(F.col("html")).alias("payload"), F.col("page_id"))


def _archive(s, d):
    p = table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("payload"), F.when(F.col("page_id") % 9 == 0, "image/png").otherwise("application/xml").alias("media_type"))
    return I.archive(p, p.where("id % 7 = 0").select(F.sha2(F.col("payload").cast("binary"), 256).alias("sha")), most=6000)


def _records(s, d):
    return items(s, d).select("id", "source_name", "title", F.when(F.col("id") % 10 == 0, F.concat(F.lit("10.1/A"), F.col("id") % 30)).alias("doi")).withColumn("identity", I.work_identity(F.col("doi"), F.col("title")))


def _bounds(s, d):
    return funding(s, d).groupBy("asset").agg(F.date_trunc("day", F.min("observed_at")).alias("start"), F.date_trunc("day", F.max("observed_at")).alias("end"))


def _opens(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("asset"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).otherwise(F.date_trunc("hour", "ts")).alias("open_at"), "value")


def _twice(ticks):
    """Every seventh tick a second time."""
    return ticks.unionByName(ticks.where("id % 7 = 0"))


def _collected(s, d):
    """Two batches of orders taken into one store of a new folder, the second with rows that have no key: (store, runs)."""
    at = f"{shared_dir(s)}/tidemark/collected-{uuid.uuid4().hex}"
    rows = _hashed(_store(s, d).withColumn("key", F.when(F.col("id") % 31 != 0, F.col("key"))))
    batches = {"first": rows.where("id % 3 = 0 AND key IS NOT NULL"), "second": rows.where("id % 3 <> 0")}
    for name, batch in batches.items():
        stores.collect(batch, f"{at}/store", ["key"], "hash", ["id"], stores.spread(["key"], 16), f"{at}/runs", name, 1000)
    return stores.read(s, f"{at}/store", rows.schema), s.read.parquet(f"{at}/runs")


def _refreshed(s, d):
    """Returns recomputed at a cutoff against stored ones: of this cutoff, of an earlier one, under a name that is no longer computed, or later than the cutoff."""
    c = candle(s, d)
    got = metrics.anchor_returns(c).where("return IS NOT NULL").select("asset", "observed_at", F.format_string("return_%dh", "horizon").alias("metric_name"), F.col("return").alias("metric_value"))
    h = F.hour("observed_at")
    name = F.when(h == 5, F.concat("metric_name", F.lit("_old"))).otherwise(F.col("metric_name"))
    stored = got.where(F.dayofmonth("observed_at") % 3 != 0).select("asset", "observed_at", name.alias("metric_name"), (F.col("metric_value") + 1).alias("metric_value"), F.when(h % 2 == 0, _ts(LOW)).otherwise(_ts(HIGH)).alias("cutoff"))
    seen = c.where(F.col("observed_at") <= _ts(HIGH))
    return metrics.refreshed(stored, got.where(F.col("observed_at") <= _ts(HIGH)), seen, _ts(HIGH))


QUERIES = {
    "metrics_refresh": lambda s, d: out(_refreshed(s, d)),
    "store_collect": lambda s, d: _collected(s, d)[0].select("key", "id", "hash"),
    "run_accounting": lambda s, d: _collected(s, d)[1].drop("started_at", "ended_at"),
    "asof_dated": lambda s, d: pit.records_as_of(items(s, d), _ts(LOW), keep_undated=False).select("id", F.lit(True).alias("kept")),
    "asof_records": lambda s, d: pit.records_as_of(items(s, d), _ts(LOW)).select("id", F.lit(True).alias("kept")),
    "dispositions": lambda s, d: pit.dispositions(items(s, d), items(s, d).where("id % 4 <> 0").select(F.col("id").alias("source_item_id")), _ts(HIGH), F.lower(F.concat_ws(" ", "title", "raw_text")).rlike("ing")).select("id", "disposition", "reason_code"),
    "ingest_insert_only": lambda s, d: I.insert_only(_docs(s, d), _docs(s, d).where("id % 2 = 0 AND id < 400"), ["key"], ["id"]),
    "ingest_upsert": lambda s, d: I.upsert(_hashed(_store(s, d).where("id % 3 <> 0")), _hashed(I.first_of(_store(s, d).where("id % 3 = 0"), ["key"], ["id"])), ["key"], "hash", ["id"]),
    "observation_dedup": lambda s, d: out(I.first_of(table(s, d, "events").select(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("observed_at"), F.col("event_id").alias("id"), F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("value")), F.col("user_id").cast("double")).alias("price")), ["asset", "observed_at"], ["id"])),
    "content_hash": lambda s, d: table(s, d, "documents").select("doc_id", I.content_hash(F.col("text"), F.col("lang"), F.col("source")).alias("hash")),
    "archive_dedup": lambda s, d: _archive(s, d)[0],
    "archive_rejects": lambda s, d: _archive(s, d)[1],
    "archive_receipts": lambda s, d: table(s, d, "pages").select(F.sha2(F.col("html").cast("binary"), 256).alias("sha"), "page_id").groupBy("sha").agg(F.count("*").alias("n_receipts"), F.min("page_id").alias("first_page")),
    "media_type": lambda s, d: _pages(s, d).select("page_id", I.media_type(F.col("payload")).alias("media_type")),
    "work_identity": lambda s, d: _records(s, d).select("id", "identity"),
    "works": lambda s, d: I.works(_records(s, d))[0],
    "work_locations": lambda s, d: I.works(_records(s, d))[1],
    "source_fanin": lambda s, d: I.fan_in({"documents": table(s, d, "documents").select(F.col("doc_id").alias("id")), "empty": table(s, d, "pages").where("page_id < 0").select(F.col("page_id").alias("id")), "pages": table(s, d, "pages").select(F.col("page_id").alias("id"))})[1],
    "source_dimension": lambda s, d: I.source_dimension(items(s, d).select("id", "source_name", F.when(F.col("id") % 2 == 0, F.col("source_type")).alias("role")), table(s, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("source_name"), F.col("n_name").alias("role")).where("length(source_name) = 4")),
    "backfill_windows": lambda s, d: out(I.backfill_windows(_bounds(s, d), _bounds(s, d).where("asset = 'click'").select("asset", F.col("start").alias("window_start")))),
    "backfill_bounds": lambda s, d: out(funding(s, d).select("id", I.one_year_back(F.col("observed_at")).alias("start_at"))),
    "resolve_run": lambda s, d: out(I.resolve_run(runs(s, d), status="FAILED")),
    "collection_run": lambda s, d: _docs(s, d).groupBy("source_name").agg(F.count("*").alias("retrieved"), F.count_distinct("key").alias("inserted"), (F.count("*") - F.count_distinct("key")).alias("duplicates")).withColumn("status", F.when(F.col("duplicates") > 0, "PARTIAL").otherwise("SUCCESS")),
    "funding_consolidate": lambda s, d: out(I.consolidate(funding(s, d), _ts(LOW), _ts(HIGH), 300).select("id", "asset", "time_ms", "rn")),
    "funding_diagnostics": lambda s, d: I.diagnostics(_twice(funding(s, d)).withColumn("funding_rate", F.when(F.col("id") % 23 == 0, F.lit(float("nan"))).when(F.col("id") % 29 != 0, F.col("funding_rate"))), _ts(LOW), _ts(HIGH)),
    "candle_normalize": lambda s, d: out(I.candle_normalize(_opens(s, d), _ts(LOW), _ts(HIGH), 500)[0].select("id", "asset", "open_at", "close_at", "rn")),
    "candle_quarantine": lambda s, d: I.candle_normalize(_opens(s, d), _ts(LOW), _ts(HIGH), 500)[1],
}

_RANGE = f"BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}'"
_K = ", k AS (SELECT doc_id AS id, sha256(text) AS key, source AS source_name, lang FROM documents)"
_ST = ", s0 AS (SELECT o_custkey AS key, o_orderkey AS id, sha256(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS hash FROM orders), n AS (SELECT * FROM s0 WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1), o AS (SELECT * FROM s0 WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1)"
_ID = ", r AS (SELECT id, source_name, title, coalesce('doi:' || lower(CASE WHEN id % 10 = 0 THEN '10.1/A' || (id % 30) END), 'title:' || trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS identity FROM items)"
_PG = ", p AS (SELECT page_id AS id, html, CASE WHEN page_id % 9 = 0 THEN 'MEDIA_TYPE' WHEN strlen(html) > 6000 THEN 'TOO_LARGE' END AS reason, sha256(html) AS sha FROM pages)"
_B = ", b AS (SELECT asset, CAST(date_trunc('day', min(observed_at)) AS TIMESTAMP) AS s, CAST(date_trunc('day', max(observed_at)) AS TIMESTAMP) AS e FROM funding GROUP BY asset)"
_O = f", o AS (SELECT event_id AS id, event_type AS asset, CASE WHEN event_id % 3 = 0 THEN ts ELSE CAST(date_trunc('hour', ts) AS TIMESTAMP) END AS open_at FROM events), i AS (SELECT *, date_trunc('hour', open_at) = open_at AS aligned FROM o WHERE open_at {_RANGE})"
_CO = ", s0 AS (SELECT CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey END AS key, o_orderkey AS id, sha256(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS hash FROM orders), b1 AS (SELECT * FROM s0 WHERE id % 3 = 0 AND key IS NOT NULL), b2 AS (SELECT * FROM s0 WHERE id % 3 <> 0), o AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1), n AS (SELECT * FROM b2 WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1)"
_RE = f""", fr AS (SELECT c.asset, c.observed_at, 'return_' || h || 'h' AS metric_name, c.mark_price / b.mark_price - 1 AS v FROM candle c CROSS JOIN (SELECT unnest([1, 4, 24]) AS h) JOIN candle b ON b.asset = c.asset AND b.observed_at = c.observed_at - to_hours(h) AND b.mark_price <> 0),
st AS (SELECT asset, observed_at, metric_name || CASE WHEN hour(observed_at) = 5 THEN '_old' ELSE '' END AS metric_name, v + 1 AS old, CASE WHEN hour(observed_at) % 2 = 0 THEN TIMESTAMP '{LOW}' ELSE TIMESTAMP '{HIGH}' END AS was FROM fr WHERE day(observed_at) % 3 <> 0),
bo AS (SELECT *, CASE WHEN was IS NULL THEN 'inserted' WHEN was = TIMESTAMP '{HIGH}' THEN 'skipped' WHEN observed_at > TIMESTAMP '{HIGH}' THEN 'untouched' WHEN v IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM st FULL JOIN (FROM fr WHERE observed_at <= TIMESTAMP '{HIGH}') USING (asset, observed_at, metric_name))"""

ORACLE = {
    "metrics_refresh": sql(_RE + f" SELECT asset, observed_at, metric_name, round(CASE WHEN change IN ('inserted', 'updated') THEN v ELSE old END, 6) AS metric_value, CASE WHEN change IN ('inserted', 'updated') THEN TIMESTAMP '{HIGH}' ELSE was END AS cutoff, change FROM bo"),
    "store_collect": sql(_CO + " SELECT key, CASE WHEN n.hash IS NOT NULL AND (o.hash IS NULL OR n.hash <> o.hash) THEN n.id ELSE o.id END AS id, CASE WHEN n.hash IS NOT NULL THEN n.hash ELSE o.hash END AS hash FROM n FULL JOIN o USING (key)"),
    "run_accounting": sql(_CO + ", u AS (SELECT count(*) FILTER (WHERE o.key IS NULL) AS i, count(*) FILTER (WHERE n.hash <> o.hash) AS u FROM n LEFT JOIN o USING (key)), c AS (SELECT 'first' AS source, (SELECT count(*) FROM b1) AS retrieved, (SELECT count(*) FROM o) AS inserted, 0 AS updated, 0 AS failed UNION ALL SELECT 'second', (SELECT count(*) FROM b2), i, u, (SELECT count(*) FROM b2 WHERE key IS NULL) FROM u) SELECT source, CAST(1000 AS BIGINT) AS requested, retrieved, inserted, updated, retrieved - failed - inserted - updated AS duplicates, failed, CASE WHEN failed > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM c"),
    "asof_dated": sql(f"SELECT id, true AS kept FROM items WHERE published_at <= TIMESTAMP '{LOW}'"),
    "asof_records": sql(f"SELECT id, true AS kept FROM items WHERE published_at IS NULL OR published_at <= TIMESTAMP '{LOW}'"),
    "dispositions": sql(f", c AS (SELECT id, CASE WHEN published_at IS NULL OR published_at > TIMESTAMP '{HIGH}' THEN 1 WHEN retrieved_at > TIMESTAMP '{HIGH}' THEN 2 WHEN NOT contains(lower(title || ' ' || raw_text), 'ing') THEN 3 WHEN id % 4 = 0 THEN 4 END AS k FROM items) SELECT id, CASE k WHEN 1 THEN 'REJECTED_AVAILABILITY' WHEN 2 THEN 'REJECTED_AVAILABILITY' WHEN 3 THEN 'REJECTED_RELEVANCE' WHEN 4 THEN 'RETAINED_LEGACY_UNARCHIVED' ELSE 'RETAINED' END AS disposition, CASE k WHEN 1 THEN 'PUBLISHED_AFTER_AS_OF' WHEN 2 THEN 'RETRIEVED_AFTER_AS_OF' WHEN 3 THEN 'STRICT_TOPIC_GATE' WHEN 4 THEN 'NO_RAW_ARCHIVE_RECEIPT' END AS reason_code FROM c"),
    "ingest_insert_only": sql(_K + " SELECT key, id, source_name, lang FROM k WHERE key NOT IN (SELECT key FROM k WHERE id % 2 = 0 AND id < 400) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1"),
    "ingest_upsert": sql(_ST + " SELECT key, CASE WHEN n.hash IS NOT NULL AND (o.hash IS NULL OR n.hash <> o.hash) THEN n.id ELSE o.id END AS id, CASE WHEN n.hash IS NOT NULL AND (o.hash IS NULL OR n.hash <> o.hash) THEN n.hash ELSE o.hash END AS hash, CASE WHEN o.hash IS NULL THEN 'inserted' WHEN n.hash IS NULL THEN 'untouched' WHEN n.hash <> o.hash THEN 'updated' ELSE 'skipped' END AS change FROM n FULL JOIN o USING (key)"),
    "observation_dedup": sql("SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS observed_at, event_id AS id, round(CASE WHEN event_id % 2 = 0 THEN value ELSE CAST(user_id AS DOUBLE) END, 6) AS price FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) = 1"),
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '')) AS hash FROM documents",
    "archive_dedup": sql(_PG + " SELECT sha, 'application/xml' AS media_type, CAST(max(strlen(html)) AS INTEGER) AS byte_size, 'objects/' || substr(sha, 1, 2) || '/' || sha AS uri FROM p WHERE reason IS NULL AND sha NOT IN (SELECT sha FROM p WHERE id % 7 = 0) GROUP BY sha"),
    "archive_rejects": sql(_PG + " SELECT id, reason FROM p WHERE reason IS NOT NULL"),
    "archive_receipts": "SELECT sha256(html) AS sha, count(*) AS n_receipts, min(page_id) AS first_page FROM pages GROUP BY 1",
    "media_type": "SELECT page_id, CASE WHEN page_id % 10 = 0 OR html IS NULL THEN 'text/plain' WHEN starts_with(ltrim(html), '<') THEN 'application/xml' ELSE 'application/json' END AS media_type FROM pages",
    "work_identity": sql(_ID + " SELECT id, identity FROM r"),
    "works": sql(_ID + " SELECT identity, arg_min(title, id) AS title, min(id) AS first_id, count(DISTINCT source_name) AS n_locations FROM r GROUP BY identity"),
    "work_locations": sql(_ID + " SELECT DISTINCT identity, source_name FROM r"),
    "source_fanin": "SELECT 'documents' AS source, count(*) AS n_rows, 'READY' AS status FROM documents UNION ALL SELECT 'empty', 0, 'DEGRADED' UNION ALL SELECT 'pages', count(*), 'READY' FROM pages",
    "source_dimension": sql(", g AS (SELECT 'src' || n_nationkey AS source_name, n_name AS role FROM nation WHERE n_nationkey < 10), f AS (SELECT source_name, arg_min(source_type, id) FILTER (WHERE id % 2 = 0) AS x, (SELECT 1) AS one, count(*) AS n_records, arg_min(CASE WHEN id % 2 = 0 THEN source_type ELSE '' END, id) AS own FROM items GROUP BY source_name) SELECT source_name, n_records, coalesce(nullif(own, ''), role, 'UNKNOWN') AS role FROM f LEFT JOIN g USING (source_name)"),
    "backfill_windows": sql(_B + ", w AS (SELECT asset, s, e, unnest(range(s, e + INTERVAL 1 MICROSECOND, INTERVAL 7 DAY)) AS window_start FROM b) SELECT asset, window_start, least(e, window_start + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND) AS window_end FROM w WHERE NOT (asset = 'click' AND window_start = s)"),
    "backfill_bounds": sql("SELECT id, date_trunc('hour', observed_at - INTERVAL 1 YEAR) AS start_at FROM funding"),
    "resolve_run": sql("SELECT * FROM runs WHERE status = 'FAILED'"),
    "collection_run": sql(_K + " SELECT source_name, count(*) AS retrieved, count(DISTINCT key) AS inserted, count(*) - count(DISTINCT key) AS duplicates, CASE WHEN count(*) > count(DISTINCT key) THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM k GROUP BY source_name"),
    "funding_consolidate": sql(f", t AS (SELECT id, asset, epoch_us(observed_at) // 1000 AS time_ms FROM funding WHERE observed_at {_RANGE} QUALIFY row_number() OVER (PARTITION BY asset, epoch_us(observed_at) // 1000 ORDER BY id) = 1) SELECT id, asset, time_ms, row_number() OVER (PARTITION BY asset ORDER BY time_ms) AS rn FROM t QUALIFY rn <= 300"),
    "funding_diagnostics": sql(f", twice AS (FROM funding UNION ALL FROM funding WHERE id % 7 = 0), r AS (SELECT *, CASE WHEN id % 23 = 0 THEN CAST('nan' AS DOUBLE) WHEN id % 29 <> 0 THEN funding_rate END AS rate FROM twice), t AS (SELECT *, rate IS NOT NULL AND NOT isnan(rate) AS ok FROM r) SELECT asset, count(*) AS raw, count(*) FILTER (WHERE NOT ok) AS malformed, count(DISTINCT epoch_us(observed_at) // 1000) FILTER (WHERE ok AND observed_at {_RANGE}) AS eligible, count(*) FILTER (WHERE ok AND observed_at {_RANGE}) - count(DISTINCT epoch_us(observed_at) // 1000) FILTER (WHERE ok AND observed_at {_RANGE}) AS duplicate FROM t GROUP BY asset"),
    "candle_normalize": sql(_O + " SELECT id, asset, open_at, open_at + INTERVAL 1 HOUR AS close_at, row_number() OVER (PARTITION BY asset ORDER BY open_at, id) AS rn FROM i WHERE aligned QUALIFY rn <= 500"),
    "candle_quarantine": sql(_O + " SELECT id, asset, 'UNALIGNED_OPEN' AS reason FROM i WHERE NOT aligned"),
}
