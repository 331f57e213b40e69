"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audits, metrics, study
from tidemark.plans.standins import candle, funding, observations, out, receipts, runs, sql, table

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
ASSETS = ["click", "purchase", "view"]


def _marked(s, d):
    return study.regimes(study.treated(funding(s, d)))


def _coverage(s, d):
    return audits.funding_coverage(funding(s, d), START, END)


def _availability(s, d):
    m = metrics.long_metrics(funding(s, d), candle(s, d))
    return audits.metric_availability(m, candle(s, d), ["return_1h", "return_4h", "return_24h", "volatility_24h"])


def _study_coverage(s, d):
    m = _marked(s, d)
    return audits.study_coverage(m, study.forward_outcomes(m, candle(s, d)), candle(s, d))


def _audit(s, d):
    """Funding ticks as they are; candles at full hours, each under the smallest candle tick of its hour, with receipts by the same rules."""
    o, ts = observations(s, d), lambda x: F.lit(x).cast("timestamp")
    f = o.where("observation_kind = 'funding'").withColumn("funding_rate", F.when(F.col("id") % 29 != 0, F.col("value")))
    c = o.where("observation_kind = 'candle'").groupBy("asset", F.date_trunc("hour", "observed_at").alias("observed_at")).agg(F.min("id").alias("id"))
    both = f.select("id", "asset", "observed_at", "observation_kind", "funding_rate").unionByName(c.select("id", "asset", "observed_at", F.lit("candle").alias("observation_kind"), F.lit(None).cast("double").alias("funding_rate")))
    close = F.date_trunc("hour", F.col("source_native_timestamp"))
    r = receipts(s, d).withColumn("source_native_timestamp", F.when(F.col("market_observation_id") % 3 == 0, close).otherwise(F.col("source_native_timestamp")))
    rows = audits.qualified(both, r, runs(s, d), ts(START), ts(END), "PRODUCTION")
    return audits.qualified_audit(rows, [*ASSETS, "none"])


QUERIES = {
    "gap_count": lambda s, d: audits.gap_count(funding(s, d)),
    "funding_coverage": lambda s, d: out(_coverage(s, d), 3),
    "market_quality": lambda s, d: out(audits.market_quality(candle(s, d))),
    "metric_availability": lambda s, d: _availability(s, d),
    "readiness_gate": lambda s, d: audits.readiness(_coverage(s, d), _availability(s, d)),
    "watermark_min_max": lambda s, d: out(audits.watermark(candle(s, d), ASSETS)),
    "missing_assets": lambda s, d: audits.missing_assets(candle(s, d), table(s, d, "region").select(F.lower("r_name").alias("asset")).unionByName(table(s, d, "events").select(F.col("event_type").alias("asset")).distinct())),
    "study_coverage": lambda s, d: out(_study_coverage(s, d)),
    "coverage_audit": lambda s, d: audits.coverage_audit(_study_coverage(s, d)),
    "coverage_audit_assets": lambda s, d: out(_audit(s, d)),
    "coverage_audit_verdict": lambda s, d: audits.audit_verdict(_audit(s, d).where("asset <> 'none'")),
}

_GAPS = ", g AS (SELECT asset, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', observed_at)) AS h, lag(date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', observed_at))) OVER (PARTITION BY asset ORDER BY observed_at, id) AS b FROM funding)"
_COV = f""", g AS (SELECT asset, epoch_us(observed_at) / 1e6 AS t, epoch_us(observed_at) / 1e6 - lag(epoch_us(observed_at) / 1e6) OVER (PARTITION BY asset ORDER BY observed_at, id) AS gap FROM funding),
cov AS (SELECT asset, count(*) AS n_rows, min(t) - epoch(TIMESTAMP '{START}') AS start_delta, epoch(TIMESTAMP '{END}') - max(t) AS end_delta, min(gap) AS min_gap, max(gap) AS max_gap,
  CAST(sum(CASE WHEN gap > 3600 THEN greatest(0.0, round_even(gap / 3600, 0) - 1) ELSE 0 END) AS BIGINT) AS n_missing, count(*) FILTER (WHERE gap > 3660) AS n_abnormal FROM g GROUP BY asset),
cr AS (SELECT *, concat_ws(',', CASE WHEN start_delta > 60 THEN 'late_start' END, CASE WHEN end_delta > 3660 THEN 'early_end' END, CASE WHEN n_missing > 0 THEN 'missing_intervals' END, CASE WHEN n_abnormal > 0 THEN 'abnormal_gaps' END) AS reasons FROM cov)"""
_AV = """, vol AS (SELECT asset, observed_at, CASE WHEN count(*) OVER x = 24 AND count(q) OVER x = 24 AND count(sr) OVER x >= 2 THEN stddev_samp(sr) OVER x END AS volatility FROM logret WINDOW x AS (PARTITION BY asset ORDER BY observed_at RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)),
lat AS (SELECT asset, max(observed_at) AS at FROM candle GROUP BY asset),
av AS (SELECT l.asset, m.n AS metric_name, CASE WHEN m.h IS NULL AND v.volatility IS NOT NULL OR b.mark_price <> 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status FROM lat l CROSS JOIN (VALUES ('return_1h', 1), ('return_4h', 4), ('return_24h', 24), ('volatility_24h', NULL)) m(n, h)
  LEFT JOIN candle b ON b.asset = l.asset AND b.observed_at = l.at - to_hours(m.h) LEFT JOIN vol v ON v.asset = l.asset AND v.observed_at = l.at)"""
_STUDY = """, a1 AS (SELECT asset, min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) AS n_events, count(*) FILTER (WHERE treated) AS n_treated, coalesce(max(regime), 0) AS n_regimes FROM ev GROUP BY asset),
a2 AS (SELECT asset, date_diff('hour', min(observed_at), max(observed_at)) + 1 AS expected_hours, count(DISTINCT observed_at) AS present_hours FROM candle GROUP BY asset),
a3 AS (SELECT asset, count(*) FILTER (WHERE horizon = 1 AND outcome IS NULL) AS missing_1h, count(*) FILTER (WHERE horizon = 4 AND outcome IS NULL) AS missing_4h, count(*) FILTER (WHERE horizon = 24 AND outcome IS NULL) AS missing_24h FROM outc GROUP BY asset)"""
_AUDIT = f""", ob AS (SELECT id, asset, observed_at, 'funding' AS kind, CASE WHEN id % 29 <> 0 THEN value END AS rate FROM observations WHERE observation_kind = 'funding'
  UNION ALL SELECT min(id), asset, CAST(date_trunc('hour', observed_at) AS TIMESTAMP), 'candle', NULL FROM observations WHERE observation_kind = 'candle' GROUP BY asset, date_trunc('hour', observed_at)),
rc AS (SELECT market_observation_id AS oid, CASE WHEN market_observation_id % 3 = 0 THEN CAST(date_trunc('hour', source_native_timestamp) AS TIMESTAMP) ELSE source_native_timestamp END AS native
  FROM receipts r JOIN runs u ON u.id = r.collection_run_id AND u.status = 'SUCCESS' AND u.ended_at IS NOT NULL WHERE analysis_mode = 'PRODUCTION'),
qu AS (SELECT asset, kind, observed_at AS tm, arg_min(rate, id) AS rate, count(*) AS n FROM ob JOIN rc ON oid = id AND native = CASE WHEN kind = 'candle' THEN observed_at + INTERVAL 1 HOUR ELSE observed_at END
  WHERE observed_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY ALL),
wi AS (SELECT *, date_trunc('hour', tm) - date_trunc('hour', lag(tm) OVER o) > INTERVAL 1 HOUR AS gap, list_filter(list(rate) OVER (PARTITION BY asset, kind ORDER BY tm ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS w FROM qu WINDOW o AS (PARTITION BY asset, kind ORDER BY tm)),
ex AS (SELECT asset, tm, lag(tm) OVER (PARTITION BY asset ORDER BY tm) AS b, date_trunc('hour', tm) - INTERVAL 1 HOUR AS anchor FROM wi WHERE kind = 'funding' AND rate IS NOT NULL AND len(list_filter(w, lambda x: x < rate)) / len(w) >= 0.9),
xc AS (SELECT ex.asset, count(*) AS n_extreme, count(*) FILTER (WHERE b IS NULL OR tm - b > INTERVAL 1 HOUR) AS n_regimes, {", ".join(f"count(*) FILTER (WHERE (asset, anchor) IN (SELECT (asset, tm) FROM qu WHERE kind = 'candle') AND (asset, anchor + INTERVAL {h} HOUR) IN (SELECT (asset, tm) FROM qu WHERE kind = 'candle')) AS eligible_{h}h" for h in (1, 4, 24))} FROM ex GROUP BY asset),
au AS (SELECT a.asset, {", ".join(f"min(tm) FILTER (WHERE kind = '{k}') AS {k}_start, max(tm) FILTER (WHERE kind = '{k}') AS {k}_end, count(*) FILTER (WHERE kind = '{k}') AS {k}_rows, count(*) FILTER (WHERE kind = '{k}' AND gap) AS {k}_gaps, CAST(coalesce(sum(n - 1) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS {k}_duplicates" for k in ("funding", "candle"))}
  FROM (SELECT unnest(['click', 'purchase', 'view', 'none']) AS asset) a LEFT JOIN wi USING (asset) GROUP BY a.asset),
al AS (SELECT au.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_extreme", "n_regimes", "eligible_1h", "eligible_4h", "eligible_24h"))} FROM au LEFT JOIN xc USING (asset))"""

ORACLE = {
    "gap_count": sql(_GAPS + " SELECT asset, count(*) AS n_rows, count(*) FILTER (WHERE h - b > 1) AS n_gaps FROM g GROUP BY asset"),
    "funding_coverage": sql(_COV + " SELECT asset, n_rows, round(start_delta, 3) AS start_delta, round(end_delta, 3) AS end_delta, round(min_gap, 3) AS min_gap, round(max_gap, 3) AS max_gap, n_missing, n_abnormal, reasons FROM cr"),
    "market_quality": sql(", sp AS (SELECT asset, unnest(range(min(observed_at), max(observed_at) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM candle GROUP BY asset), m AS (SELECT sp.asset, h, row_number() OVER (PARTITION BY sp.asset ORDER BY h) AS rn FROM sp LEFT JOIN candle c ON c.asset = sp.asset AND c.observed_at = h WHERE c.asset IS NULL), n AS (SELECT asset, count(*) AS n_missing, string_agg(strftime(h, '%Y-%m-%d %H:%M'), ',' ORDER BY h) FILTER (WHERE rn <= 20) AS missing_sample FROM m GROUP BY asset) SELECT asset, count(*) AS n_rows, min(observed_at) AS first_at, max(observed_at) AS last_at, count(*) - count(DISTINCT observed_at) AS n_duplicates, coalesce(any_value(n_missing), 0) AS n_missing, coalesce(any_value(missing_sample), '') AS missing_sample FROM candle LEFT JOIN n USING (asset) GROUP BY asset"),
    "metric_availability": sql(_AV + " SELECT * FROM av"),
    "readiness_gate": sql(_COV + _AV + ", b AS (SELECT asset, unnest(string_split(reasons, ',')) AS x FROM cr WHERE reasons <> '' UNION SELECT asset, 'metric:' || metric_name FROM av WHERE status = 'UNAVAILABLE'), h AS (SELECT asset, string_agg(x, ',' ORDER BY x) AS blockers FROM b GROUP BY asset) SELECT asset, coalesce(blockers, '') AS blockers, CASE WHEN blockers IS NULL THEN 'READY' ELSE 'BLOCKED' END AS status FROM cr LEFT JOIN h USING (asset)"),
    "watermark_min_max": sql(", m AS (SELECT asset, max(observed_at) AS m FROM candle WHERE asset IN ('click', 'purchase', 'view') GROUP BY asset) SELECT count(*) AS n_assets, CASE WHEN count(*) = 3 THEN min(m) END AS watermark FROM m"),
    "missing_assets": sql("SELECT lower(r_name) AS asset FROM region WHERE lower(r_name) NOT IN (SELECT asset FROM candle)"),
    "study_coverage": sql(_STUDY + " SELECT * FROM a1 LEFT JOIN a2 USING (asset) LEFT JOIN a3 USING (asset)"),
    "coverage_audit": sql(_STUDY + " SELECT count(*) AS n_assets, CAST(sum(n_regimes) AS BIGINT) AS total_regimes, min(n_regimes) AS least_regimes, sum(n_regimes) >= 5 AND min(n_regimes) >= 5 AS ready, CASE WHEN sum(n_regimes) >= 5 AND min(n_regimes) >= 5 THEN 'RUN_STUDY' ELSE 'COLLECT_MORE' END AS recommendation FROM a1"),
    "coverage_audit_assets": sql(_AUDIT + " SELECT * FROM al"),
    "coverage_audit_verdict": sql(_AUDIT + ", v AS (SELECT count(*) AS n_assets, CAST(sum(n_regimes) AS BIGINT) AS total_regimes, min(eligible_24h) AS least_eligible FROM al WHERE asset <> 'none') SELECT *, CASE WHEN total_regimes >= 5 AND least_eligible >= 5 THEN 'YES' ELSE 'NO' END AS data_ready, CASE WHEN total_regimes >= 5 AND least_eligible >= 5 THEN 'HISTORY_WINDOW_SUFFICIENT' ELSE 'EXTEND_TO_18_MONTHS' END AS recommendation FROM v"),
}
