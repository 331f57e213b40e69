"""Replay, snapshot and payload-parser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import editorial as E
from tidemark.operators import knowledge as K
from tidemark.operators import replay as R
from tidemark.plans.standins import dated, dates, funding, hypotheses, out, sql, table
from tidemark.sources import parsers as P


def _walked(s, d):
    return R.walk_forward(R.facts_by_day(funding(s, d)))


def _days(s, d):
    return funding(s, d).select(F.to_date("observed_at").alias("day")).distinct()


def _title():
    return F.trim(F.regexp_replace(F.substring("text", 1, 60), r"[^\p{L}]+", " "))


def _stamp(fmt):
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600), fmt)


def _atom(s, d):
    """Feeds of ten documents each."""
    entry = F.concat(F.lit("<entry><id>"), "doc_id", F.lit("</id><title> "), _title(), F.lit(" </title>"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("<published>"), _stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published>"))).otherwise(""), F.lit("<author><name>"), "source", F.lit("</name></author><category term=\""), "lang", F.lit("\"/></entry>"))
    return table(s, d, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("g")).agg(F.concat(F.lit("<feed>"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</feed>")).alias("payload"))


def _rss(s, d):
    x = F.concat(F.lit("<rss><channel><item><title>"), _title(), F.lit("</title><link>http://x/"), "doc_id", F.lit("</link><pubDate>Mon, "), _stamp("d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item></channel></rss>"))
    j = F.to_json(F.struct(F.array(F.struct(F.col("doc_id").cast("string").alias("id"), _title().alias("title"), F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.when(F.col("doc_id") % 6 != 0, _stamp("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date_published"))).alias("items")))
    return table(s, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, x).otherwise(j).alias("payload"))


def _undated(s, d):
    """RSS items without dates: every third has a guid alone, every fifth neither."""
    link = F.when((F.col("doc_id") % 3 != 0) & (F.col("doc_id") % 5 != 0), F.concat(F.lit("<link>http://x/"), "doc_id", F.lit("</link>"))).otherwise("")
    guid = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("<guid>guid"), "doc_id", F.lit("</guid>"))).otherwise("")
    return table(s, d, "documents").select(F.concat(F.lit("<rss><channel><item><title>"), _title(), F.lit("</title>"), link, guid, F.lit("<description>"), "lang", F.lit("</description></item></channel></rss>")).alias("payload"))


def _described(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_name"), F.create_map(F.lit("lang"), "lang", F.lit("access_mode"), "source").alias("metadata"))


def _works(s, d):
    w = F.struct(F.concat(F.lit("https://works/W"), "doc_id").alias("id"), _title().alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/A"), "doc_id")).alias("doi"), F.when(F.col("doc_id") % 7 != 0, _stamp("yyyy-MM-dd")).alias("publication_date"), (F.col("doc_id") % 3 == 0).alias("is_oa"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("http://oa/"), "doc_id")).alias("oa_url"), F.lit("").alias("landing_url"), F.array(F.struct(F.col("source").alias("name")), F.struct(F.col("lang").alias("name"))).alias("authorships"), F.array(F.col("lang")).alias("topics"))
    return table(s, d, "documents").select(F.to_json(F.struct(F.array(w).alias("results"))).alias("payload"))


def _doi(s, d):
    parts = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(2024))).when(F.col("doc_id") % 4 == 1, F.array(F.lit(2024), F.lit(3))).when(F.col("doc_id") % 4 == 2, F.array(F.lit(2024), F.lit(3), F.lit(9)))
    w = F.struct(F.concat(F.lit("10.1/ABC"), "doc_id").alias("DOI"), F.array(_title(), F.lit("second")).alias("title"), F.array(F.struct(F.col("lang").alias("given"), F.col("source").alias("family"))).alias("author"), F.struct(F.array(parts).alias("date-parts")).alias("issued"))
    return table(s, d, "documents").select(F.to_json(F.struct(F.array(w).alias("items"))).alias("payload"))


def _index(s, d):
    words = F.split(F.regexp_replace(F.element_at(F.split("text", "\n"), 1), r"\s+", " "), " ")
    each = table(s, d, "documents").select("doc_id", F.posexplode(words).alias("pos", "word"))
    return each.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("pos")).alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))


def _snapshots(s, d):
    g = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    return g.select("id", F.col("x.o_orderkey").alias("names"), F.when(F.col("id") % 8 == 0, F.slice(F.col("x.o_totalprice"), 2, 100000)).otherwise(F.col("x.o_totalprice")).alias("contexts"))


QUERIES = {
    "walk_forward": lambda s, d: dates(out(_walked(s, d))),
    "walk_forward_rollup": lambda s, d: R.rollup(_walked(s, d), _days(s, d)),
    "replay_rollup": lambda s, d: R.replay_rollup(funding(s, d).groupBy(F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n")).withColumn("status", F.when(F.col("n") > 330, "READY").otherwise("DEGRADED"))),
    "daily_funding": lambda s, d: dates(out(R.daily_funding(funding(s, d), E.logical_date(F.col("observed_at"))), 8)),
    "daily_snapshot": lambda s, d: dates(R.daily_snapshot(K.novelty(hypotheses(s, d)))),
    "weekly_snapshot": lambda s, d: dates(R.weekly_snapshot(hypotheses(s, d), E.week_ending(F.col("as_of")))),
    "parse_atom": lambda s, d: out(P.atom(_atom(s, d), F.lit("2024-01-10 00:00:00").cast("timestamp")).select("external_id", "title", "published_at", F.array_join("authors", ";").alias("authors"), F.array_join("categories", ";").alias("categories"))),
    "parse_rss": lambda s, d: out(P.feed(_rss(s, d)).select("external_id", "title", "published_at")),
    "parse_rss_undated": lambda s, d: P.undated_feed(_undated(s, d)),
    "relabel_feed": lambda s, d: P.relabelled(_described(s, d), "mirror", {"access_mode": "OPEN_ACCESS", "origin": "mirror"}).select("id", "source_name", *(F.col("metadata")[k].alias(k) for k in ("lang", "access_mode", "origin"))),
    "parse_works_json": lambda s, d: dates(P.works_json(_works(s, d))),
    "parse_doi_json": lambda s, d: dates(P.doi_json(_doi(s, d))),
    "inverted_index_text": lambda s, d: _index(s, d).select("doc_id", P.inverted_text(F.col("index")).alias("text")),
    "html_links": lambda s, d: P.html_links(table(s, d, "pages"), 3),
    "snapshot_zip": lambda s, d: out(P.snapshot_zip(_snapshots(s, d), "names", "contexts")[0]),
    "snapshot_quarantine": lambda s, d: P.snapshot_zip(_snapshots(s, d), "names", "contexts")[1],
}

_F = ", fd AS (SELECT CAST(observed_at AS DATE) AS day, asset, arg_max(pct, (observed_at, id)) AS percentile FROM pct WHERE observed_at <= CAST(observed_at AS DATE) + INTERVAL 22 HOUR GROUP BY ALL), fx AS (SELECT * FROM fd WHERE percentile >= 90)"
_T = "trim(regexp_replace(substr(text, 1, 60), '[^\\p{L}]+', ' ', 'g'))"
_S = "(TIMESTAMP '2024-01-01' + to_hours(doc_id))"
_SN = ", sn AS (SELECT o_custkey AS id, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) - 1 AS position FROM orders)"

ORACLE = {
    "walk_forward": dated(sql(_F + " SELECT day, asset, round(percentile, 6) AS percentile, day = min(day) OVER (PARTITION BY asset) AS first_seen FROM fx"), "day"),
    "walk_forward_rollup": sql(_F + " SELECT count(*) AS n_days, count(*) FILTER (WHERE n IS NULL) AS zero_days, (SELECT count(*) FROM fx) AS n_facts, (SELECT count(DISTINCT asset) FROM fx) AS n_families, (SELECT count(*) - count(DISTINCT asset) FROM fx) AS n_repeats FROM (SELECT DISTINCT CAST(observed_at AS DATE) AS day FROM funding) LEFT JOIN (SELECT day, count(*) AS n FROM fx GROUP BY day) USING (day)"),
    "replay_rollup": sql(", a AS (SELECT count(*) AS n FROM funding GROUP BY CAST(observed_at AS DATE)) SELECT count(*) FILTER (WHERE n > 330) AS ready_days, CAST(sum(n) AS BIGINT) AS total FROM a"),
    "daily_funding": dated(sql("SELECT asset, CAST(observed_at + INTERVAL 8 HOUR AS DATE) AS logical_date, count(*) AS n_ticks, round(avg(funding_rate), 8) AS mean_rate, round(max(abs(funding_rate)), 8) AS max_abs_rate FROM funding GROUP BY ALL"), "logical_date"),
    "daily_snapshot": dated(sql(", c AS (SELECT h.id, h.as_of, h.disposition, h.channel, count(p.id) AS n, count(p.id) FILTER (WHERE p.disposition = 'REJECTED') AS r, count(p.id) FILTER (WHERE p.universe = h.universe) AS u FROM hypotheses h LEFT JOIN hypotheses p ON p.fingerprint = h.fingerprint AND p.as_of < h.as_of AND p.analysis_mode = 'PRODUCTION' GROUP BY ALL), v AS (SELECT *, CASE WHEN n = 0 THEN 'NEW' WHEN r > 0 THEN 'PREVIOUSLY_REJECTED' WHEN u > 0 AND channel = 'MARKET' THEN 'PERSISTENT_REGIME' WHEN u > 0 THEN 'RECURRENT' ELSE 'ASSET_VARIANT' END AS novelty FROM c) SELECT as_of, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE novelty = '{x}') AS {x.lower()}" for x in ("NEW", "PREVIOUSLY_REJECTED", "PERSISTENT_REGIME", "RECURRENT", "ASSET_VARIANT")) + ", count(*) FILTER (WHERE disposition = 'REJECTED') AS rejected FROM v GROUP BY as_of"), "as_of"),
    "weekly_snapshot": dated(sql(", w AS (SELECT *, CAST(as_of + CAST((6 - dayofweek(as_of) + 7) % 7 AS INTEGER) AS DATE) AS week_ending FROM hypotheses), f AS (SELECT week_ending, count(*) FILTER (WHERE k > 1) AS recurrent, count(*) FILTER (WHERE k = 1) AS new FROM (SELECT week_ending, fingerprint, count(*) AS k FROM w GROUP BY ALL) GROUP BY 1) SELECT week_ending, count(*) AS n, count(DISTINCT as_of) AS n_days, 7 - count(DISTINCT as_of) AS missing_days, any_value(recurrent) AS recurrent, any_value(new) AS new FROM w JOIN f USING (week_ending) GROUP BY 1"), "week_ending"),
    "parse_atom": f"SELECT CAST(doc_id AS VARCHAR) AS external_id, {_T} AS title, CASE WHEN doc_id % 5 <> 0 THEN {_S} END AS published_at, source AS authors, lang AS categories FROM documents WHERE doc_id % 5 = 0 OR {_S} >= TIMESTAMP '2024-01-10'",
    "parse_rss": f"SELECT CASE WHEN doc_id % 3 = 0 THEN 'http://x/' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS external_id, {_T} AS title, {_S} AS published_at FROM documents WHERE {_T} <> '' AND (doc_id % 3 = 0 OR doc_id % 6 <> 0)",
    "parse_rss_undated": f"SELECT CASE WHEN doc_id % 3 = 0 THEN 'guid' || doc_id ELSE 'http://x/' || doc_id END AS external_id, {_T} AS title, lang AS raw_text FROM documents WHERE {_T} <> '' AND doc_id % 5 <> 0",
    "relabel_feed": "SELECT doc_id AS id, 'mirror' AS source_name, lang, 'OPEN_ACCESS' AS access_mode, 'mirror' AS origin FROM documents",
    "parse_works_json": f"SELECT 'W' || doc_id AS external_id, {_T} AS title, CASE WHEN doc_id % 2 = 0 THEN '10.1/a' || doc_id END AS doi, strftime({_S}, '%Y-%m-%d') AS published_on, CASE WHEN doc_id % 6 = 0 THEN 'http://oa/' || doc_id ELSE 'https://works/W' || doc_id END AS canonical_url, CASE WHEN doc_id % 6 = 0 THEN 'OPEN_ACCESS' WHEN doc_id % 3 = 0 THEN 'ABSTRACT_ONLY' ELSE 'METADATA_ONLY' END AS access_mode, source || ';' || lang AS authors, lang AS topics FROM documents WHERE doc_id % 7 <> 0 AND {_T} <> ''",
    "parse_doi_json": f"SELECT '10.1/abc' || doc_id AS doi, {_T} AS title, CASE doc_id % 4 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-03-01' ELSE '2024-03-09' END AS published_on, lang || ' ' || source AS authors FROM documents WHERE doc_id % 4 <> 3",
    "inverted_index_text": "SELECT doc_id, regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g') AS text FROM documents",
    "html_links": "WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 2)) AS label, unnest(range(len(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1)))) AS pos FROM pages), b AS (SELECT page_id, url, min(pos) AS pos, arg_min(label, pos) AS label FROM a GROUP BY 1, 2) SELECT page_id, url, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS rank FROM b QUALIFY rank <= 3",
    "snapshot_zip": sql(_SN + " SELECT id, CAST(position AS INTEGER) AS position, o_orderkey AS name, round(o_totalprice, 6) AS value FROM sn WHERE id % 8 <> 0"),
    "snapshot_quarantine": sql("SELECT DISTINCT o_custkey AS id, 'LENGTH_MISMATCH' AS reason FROM orders WHERE o_custkey % 8 = 0"),
}
