"""Knowledge queries: orders are hypotheses, order lines their evidence links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.editorial import letters_and_digits
from tidemark.operators import knowledge as K

from tidemark.plans.standins import dated, dates, hypotheses, items, links, observations, out, receipts, sql, table

AS_OF = "2024-01-20 10:12:18"


def _at(ts=AS_OF):
    return F.lit(ts).cast("timestamp")


def _drafts(s, d):
    h = hypotheses(s, d).select(F.col("id").alias("hypothesis_id"), "fingerprint", "universe")
    return links(s, d).join(h, "hypothesis_id").select(F.col("fingerprint"), "channel", F.col("source_item_id").alias("evidence_id"), "independence_key", F.when(F.col("line") == 1, F.lit("")).otherwise(F.col("relation")).alias("mechanism"), F.lit("H1").alias("maturity"), (F.col("hypothesis_id") * 10 + F.col("line")).alias("ord"))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _fused(s, d):
    return K.fuse(_drafts(s, d))


def _item_receipts(s, d):
    return receipts(s, d).select("id", (F.col("market_observation_id") % 2000 + 1).alias("source_item_id"), "retrieved_at", "collection_run_id")


def _texts(s, d):
    """Whole documents, normalised, with language, source and a third field as structure."""
    plain = letters_and_digits(F.coalesce(F.regexp_replace("text", "\n", " "), F.lit("")))
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), plain.alias("text"), F.col("lang").alias("iv"), F.col("source").alias("dv"), (F.col("doc_id") % 3).alias("horizon"))


def _searched(s, d):
    """Items of which some speak of order flow, its synonyms or neither."""
    phrase = F.when(F.col("id") % 9 == 0, " Order  flow").when(F.col("id") % 9 == 1, " market MICROSTRUCTURE").when(F.col("id") % 9 == 2, " Order flow").otherwise("")
    return items(s, d).select("id", "title", F.concat("raw_text", phrase).alias("raw_text"), "source_name", "external_id", F.when(F.col("id") % 7 == 3, "order-flow imbalance").otherwise(F.col("lang")).alias("topic"), "published_at", F.when(F.col("id") % 5 == 0, "REPLAY").otherwise("PRODUCTION").alias("analysis_mode"))


def _daily(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.min("ts").alias("started_at"), F.timestamp_seconds(F.unix_seconds(F.min("ts")) + 1800).alias("ended_at"), F.min("event_id").alias("id")).drop("day")


QUERIES = {
    "fuse_evidence": lambda s, d: _fused(s, d).select("fingerprint", F.array_join("channels", ",").alias("channels"), F.sha2(_joined(F.col("evidence")).cast("binary"), 256).alias("evidence"), "n_keys", "maturity"),
    "family_upsert": lambda s, d: K.families(_fused(s, d), table(s, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("fingerprint"))),
    "latest_receipt": lambda s, d: out(K.latest_receipt(receipts(s, d), _at()).select("market_observation_id", "id", "retrieved_at", "collection_run_id")),
    "receipt_complete": lambda s, d: K.receipt_complete(links(s, d), table(s, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("source_item_id"))),
    "evidence_packet": lambda s, d: K.packets(links(s, d)),
    "novelty": lambda s, d: K.novelty(hypotheses(s, d)).select("id", "novelty", "occurrences"),
    "prior_context": lambda s, d: K.prior_context(hypotheses(s, d).where("channel = 'MARKET'"), hypotheses(s, d).where("analysis_mode = 'PRODUCTION'")).select("id", "prior_id"),
    "first_seen_family": lambda s, d: dates(K.first_seen(hypotheses(s, d)).select("fingerprint", "id", "as_of")),
    "occurrences": lambda s, d: K.occurrences(hypotheses(s, d)).select("fingerprint", "id", "occurrence"),
    "latest_prior": lambda s, d: K.latest_prior(hypotheses(s, d).where("channel = 'ACADEMIC'"), hypotheses(s, d).where("channel = 'MARKET'").groupBy("fingerprint", "as_of").agg(F.max("disposition").alias("disposition"))),
    "family_recurrence": lambda s, d: K.family_recurrence(hypotheses(s, d)),
    "family_members": lambda s, d: hypotheses(s, d).join(table(s, d, "customer").select(F.col("c_custkey").alias("fingerprint"), F.col("c_mktsegment").alias("segment")), "fingerprint").groupBy("segment").agg(F.count("*").alias("members"), F.count_distinct("fingerprint").alias("families")),
    "lineage": lambda s, d: K.lineage(hypotheses(s, d), links(s, d), _item_receipts(s, d), _at()),
    "near_duplicates": lambda s, d: K.near_duplicates(_texts(s, d), ["iv", "dv", "horizon"]),
    "duplicate_classes": lambda s, d: K.duplicate_classes(_texts(s, d), ["iv", "dv", "horizon"])[0],
    "duplicate_links": lambda s, d: K.duplicate_classes(_texts(s, d), ["iv", "dv", "horizon"])[1],
    "search": lambda s, d: out(K.search(_searched(s, d), "  Order   FLOW ", ["title", "raw_text", "source_name", "external_id", "topic"], [F.col("published_at").desc_nulls_last(), F.col("id").desc()], 50, K.in_scope(F.col("analysis_mode"), "PRODUCTION")).select("id", "published_at")),
    "search_all": lambda s, d: out(K.search(_searched(s, d), "order flow", ["title", "raw_text", "source_name", "external_id", "topic"], [F.col("published_at").desc_nulls_last(), F.col("id").desc()], 100, K.in_scope(F.col("analysis_mode"), "ALL")).select("id", "published_at")),
    "independence_key": lambda s, d: table(s, d, "events").select("event_id", K.independence_key(F.regexp_replace("props", '"k":', '"doi":'), F.col("event_id").cast("string")).alias("key")),
    "fingerprints": lambda s, d: hypotheses(s, d).select("id", K.fingerprint(F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("Key"), F.col("fingerprint"))), F.col("id").cast("string"), F.col("disposition"), F.col("universe"), F.lit("24H")).alias("fingerprint")),
    "draft_build": lambda s, d: observations(s, d).where("value >= 90").select("id", F.format_string("Extreme %s funding changes later returns against ordinary funding.", "asset").alias("statement"), F.concat("asset", F.lit(" percentile >= 90")).alias("condition"), F.concat(F.lit("funding-extreme:"), F.lower("asset")).alias("semantic_key")),
    "run_interval_join": lambda s, d: K.run_interval(table(s, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at")), _daily(s, d)),
    "disposition_links": lambda s, d: links(s, d).select("source_item_id", F.concat(F.lit("hyp:"), "hypothesis_id").alias("l")).withColumn("h", F.regexp_replace("l", "^hyp:", "").cast("bigint")).groupBy("source_item_id").agg(_joined(F.array_sort(F.collect_set("h"))).alias("linked")),
    "channel_union": lambda s, d: (h := hypotheses(s, d)).where("channel = 'MARKET'").select("id", "channel").unionByName(h.where("channel = 'ACADEMIC'").select("id", "channel")),
    "repeated_families": lambda s, d: (h := hypotheses(s, d)).where("as_of >= DATE '1997-01-01'").select("fingerprint").intersect(h.where("as_of < DATE '1997-01-01'").select("fingerprint")),
}

_DR = ", dr AS (SELECT fingerprint, l.channel, source_item_id AS evidence_id, independence_key, CASE WHEN line = 1 THEN '' ELSE relation END AS mechanism, hypothesis_id * 10 + line AS ord FROM links l JOIN hypotheses h ON h.id = hypothesis_id), fu AS (SELECT fingerprint, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(DISTINCT channel) AS nc, sha256(string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY ord, evidence_id)) AS evidence, count(DISTINCT independence_key) AS n_keys, bool_or(mechanism <> '') AS mech FROM dr GROUP BY fingerprint), fm AS (SELECT *, CASE WHEN nc >= 2 AND n_keys >= 2 THEN 'H3' WHEN mech THEN 'H2' ELSE 'H1' END AS maturity FROM fu)"

_SEARCHED = """, sr AS (SELECT id, published_at, CASE WHEN id % 5 = 0 THEN 'REPLAY' ELSE 'PRODUCTION' END AS analysis_mode, raw_text IS NOT NULL AND id % 9 IN (1, 2) OR id % 7 = 3
  OR regexp_matches(lower(concat_ws('|', title, raw_text, source_name, external_id, CASE WHEN id % 7 <> 3 THEN lang END)), 'order flow|order-flow imbalance|market microstructure') AS hit FROM items)"""
_SETS = """, t AS (SELECT doc_id AS id, (lang, source, doc_id % 3) AS st, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(replace(coalesce(text, ''), chr(10), ' ')), '[^a-z0-9 ]+', '', 'g')), ' '), lambda w: w <> ''))) AS w FROM documents),
k AS (SELECT w, min(id) AS set_id FROM t GROUP BY w), m AS (SELECT id, set_id, st FROM t JOIN k USING (w)), e AS (SELECT set_id, len(w) AS n, unnest(w) AS x FROM k),
p AS (SELECT a.set_id AS a, b.set_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS s FROM e a JOIN e b ON a.x = b.x AND a.set_id < b.set_id GROUP BY 1, 2),
q AS (SELECT a, b, s, EXISTS (FROM m x JOIN m y ON x.st = y.st WHERE x.set_id = p.a AND y.set_id = p.b) AS structured FROM p WHERE s >= 0.25),
li AS (SELECT a, b, round(s, 3) AS similarity, structured FROM q WHERE s >= 0.45 OR structured),
ed AS (SELECT a, b FROM li UNION SELECT b, a FROM li)"""

ORACLE = {
    "fuse_evidence": sql(_DR + " SELECT fingerprint, channels, evidence, n_keys, maturity FROM fm"),
    "family_upsert": sql(_DR + " SELECT fingerprint, maturity, CAST(50 + 10 * nc AS BIGINT) AS priority FROM fm WHERE fingerprint NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)"),
    "latest_receipt": sql(f"SELECT market_observation_id, id, retrieved_at, collection_run_id FROM receipts WHERE retrieved_at <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY market_observation_id ORDER BY retrieved_at DESC, id DESC) = 1"),
    "receipt_complete": sql("SELECT hypothesis_id, count(DISTINCT source_item_id) AS n_items, count(DISTINCT p_partkey) AS n_archived, count(DISTINCT source_item_id) = count(DISTINCT p_partkey) AS complete FROM links LEFT JOIN part ON p_partkey = source_item_id AND p_partkey % 10 <> 0 GROUP BY hypothesis_id"),
    "evidence_packet": sql("SELECT hypothesis_id, array_to_string(list_sort(list(DISTINCT source_item_id)), ',') AS items, array_to_string(list_sort(list(DISTINCT independence_key)), ',') AS keys, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM links GROUP BY hypothesis_id"),
    "novelty": sql(", c AS (SELECT h.id, h.channel, count(p.id) AS n, count(p.id) FILTER (WHERE p.disposition = 'REJECTED') AS r, count(p.id) FILTER (WHERE p.universe = h.universe) AS u FROM hypotheses h LEFT JOIN hypotheses p ON p.fingerprint = h.fingerprint AND p.as_of < h.as_of AND p.analysis_mode = 'PRODUCTION' GROUP BY h.id, h.channel) SELECT id, CASE WHEN n = 0 THEN 'NEW' WHEN r > 0 THEN 'PREVIOUSLY_REJECTED' WHEN u > 0 AND channel = 'MARKET' THEN 'PERSISTENT_REGIME' WHEN u > 0 THEN 'RECURRENT' ELSE 'ASSET_VARIANT' END AS novelty, n AS occurrences FROM c"),
    "prior_context": sql("SELECT h.id, p.id AS prior_id FROM hypotheses h JOIN hypotheses p ON p.fingerprint = h.fingerprint AND p.as_of < h.as_of WHERE h.channel = 'MARKET' AND p.analysis_mode = 'PRODUCTION'"),
    "first_seen_family": dated(sql("SELECT fingerprint, id, as_of FROM hypotheses QUALIFY as_of = min(as_of) OVER (PARTITION BY fingerprint)"), "as_of"),
    "occurrences": sql("SELECT fingerprint, id, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY as_of, id) AS INTEGER) AS occurrence FROM hypotheses"),
    "latest_prior": sql(", r AS (SELECT fingerprint, as_of, max(disposition) AS disposition FROM hypotheses WHERE channel = 'MARKET' GROUP BY ALL) SELECT h.id, arg_max(r.disposition, r.as_of) AS prior FROM hypotheses h LEFT JOIN r ON r.fingerprint = h.fingerprint AND r.as_of < h.as_of WHERE h.channel = 'ACADEMIC' GROUP BY h.id"),
    "family_recurrence": sql(", f AS (SELECT fingerprint, count(*) AS n FROM hypotheses GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'NEW' ELSE 'RECURRENT' END AS kind, count(*) AS families, CAST(sum(n) AS BIGINT) AS occurrences FROM f GROUP BY 1"),
    "family_members": sql("SELECT c_mktsegment AS segment, count(*) AS members, count(DISTINCT fingerprint) AS families FROM hypotheses JOIN customer ON c_custkey = fingerprint GROUP BY 1"),
    "lineage": sql(f", r AS (SELECT id, market_observation_id % 2000 + 1 AS source_item_id, collection_run_id FROM receipts WHERE retrieved_at <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY market_observation_id % 2000 + 1 ORDER BY retrieved_at DESC, id DESC) = 1) SELECT h.id AS hypothesis_id, fingerprint, l.source_item_id, r.id AS receipt_id, r.collection_run_id AS run_id, CASE WHEN r.id IS NULL THEN 'LEGACY_UNARCHIVED' ELSE 'ARCHIVED' END AS raw_status FROM hypotheses h LEFT JOIN links l ON l.hypothesis_id = h.id LEFT JOIN r ON r.source_item_id = l.source_item_id"),
    "near_duplicates": sql(""", t AS (SELECT doc_id AS id, lang AS iv, source AS dv, doc_id % 3 AS hz, list_distinct(list_filter(string_split(trim(regexp_replace(lower(replace(coalesce(text, ''), chr(10), ' ')), '[^a-z0-9 ]+', '', 'g')), ' '), lambda w: w <> '')) AS w FROM documents),
e AS (SELECT id, len(w) AS n, unnest(w) AS x FROM t), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
q AS (SELECT a, b, c / (an + bn - c) AS s FROM p UNION ALL SELECT x.id, y.id, 0.0 FROM t x JOIN t y ON x.id < y.id AND len(x.w) = 0 AND len(y.w) = 0),
r AS (SELECT q.*, (x.iv, x.dv, x.hz) = (y.iv, y.dv, y.hz) AS shared_structure, len(x.w) = 0 AS bare FROM q JOIN t x ON x.id = q.a JOIN t y ON y.id = q.b)
SELECT a, b, round(s, 3) AS similarity, shared_structure FROM r WHERE bare OR s >= 0.45 OR shared_structure AND s >= 0.25"""),
    "duplicate_links": sql(_SETS + " SELECT a, b, similarity, structured FROM li"),
    "duplicate_classes": sql(_SETS + ", lead AS (SELECT set_id AS node, set_id AS label FROM k) SELECT m.id, m.set_id, c.label AS class_id FROM m JOIN (WITH RECURSIVE r(node, label) AS (SELECT node, label FROM lead UNION SELECT ed.b, r.label FROM r JOIN ed ON ed.a = r.node) SELECT node, min(label) AS label FROM r GROUP BY node) c ON c.node = m.set_id"),
    "search": sql(_SEARCHED + " SELECT id, published_at FROM sr WHERE analysis_mode = 'PRODUCTION' AND hit ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 50"),
    "search_all": sql(_SEARCHED + " SELECT id, published_at FROM sr WHERE hit ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 100"),
    "independence_key": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS VARCHAR), CAST(event_id AS VARCHAR)) AS key FROM events",
    "fingerprints": sql("SELECT id, lower(CASE WHEN id % 2 = 0 THEN 'unfused:' || id ELSE 'Key' || fingerprint END || '|' || disposition || '|' || universe || '|24H') AS fingerprint FROM hypotheses"),
    "draft_build": sql("SELECT id, 'Extreme ' || asset || ' funding changes later returns against ordinary funding.' AS statement, asset || ' percentile >= 90' AS condition, 'funding-extreme:' || lower(asset) AS semantic_key FROM observations WHERE value >= 90"),
    "run_interval_join": sql(", dl AS (SELECT min(ts) AS s, min(ts) AS m, min(event_id) AS id FROM events GROUP BY date_trunc('day', ts)) SELECT dl.id, (SELECT 1) * arg_min(e.event_id, (e.ts, e.event_id)) AS market_id FROM dl JOIN events e ON e.event_type = 'click' AND e.ts >= s - INTERVAL 5 MINUTE AND e.ts <= date_trunc('second', s) + INTERVAL 35 MINUTE GROUP BY dl.id"),
    "disposition_links": sql("SELECT source_item_id, array_to_string(list_sort(list(DISTINCT hypothesis_id)), ',') AS linked FROM links GROUP BY 1"),
    "channel_union": sql("SELECT id, channel FROM hypotheses WHERE channel IN ('MARKET', 'ACADEMIC')"),
    "repeated_families": sql("SELECT fingerprint FROM hypotheses WHERE as_of >= DATE '1997-01-01' INTERSECT SELECT fingerprint FROM hypotheses WHERE as_of < DATE '1997-01-01'"),
}
