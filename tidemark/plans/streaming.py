"""Streaming queries: the events table read as a stream, drained, and compared with the batch semantics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.standins import out, sql, table
from tidemark.session import shared_dir, staged
from tidemark.streaming import streams as S

CUT = "2024-01-20 10:12:18"


def _ticks(s, d):
    return S.events_stream(s, f"{d}/events.parquet")


def _replayed(s, d):
    """The ticks from files in order of time, one a batch."""
    return S.events_stream(s, S.replayed(s, f"{d}/events.parquet"))


def _resumed(s, d):
    """The whole table in several files, read one a batch: a run that stops after two batches, then one that takes it up."""
    events = staged(table(s, d, "events").repartition(6, "event_id"), "ticks")
    stream = S.events_stream(s, events._staged_at).select("id", "asset", "observed_at")
    home = f"{shared_dir(s)}/tidemark/resume-{uuid.uuid4().hex}"
    S.continued(stream, home, most=2)
    return S.continued(stream, home)


QUERIES = {
    "stream_dedup": lambda s, d: out(S.drained(S.dedup(_ticks(s, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), ["id"]).select("id", "asset"))),
    "stream_hourly": lambda s, d: out(S.drained(S.hourly(_ticks(s, d)))),
    "stream_late": lambda s, d: out(S.drained(S.as_received(_ticks(s, d), F.lit(CUT).cast("timestamp")).select("id", "asset"))),
    "stream_gate": lambda s, d: out(S.gated(_ticks(s, d), ["click", "purchase", "view"])),
    "stream_regimes": lambda s, d: out(S.drained(S.sessions(_ticks(s, d).where("funding_rate >= 90")))),
    "stream_percentile": lambda s, d: out(S.drained(S.percentiles(_replayed(s, d).drop("retrieved_at"))).select("id", "percentile")),
    "stream_resume": lambda s, d: out(S.drained(_ticks(s, d).where("asset = 'click'").select("id", "observed_at"))),
    "stream_percentile_ordered": lambda s, d: out(S.drained(S.regimes(_replayed(s, d))).select("id", "percentile")),
    "stream_regimes_exact": lambda s, d: out(S.drained(S.regimes(_replayed(s, d))).select("id", "asset", "treated", "regime", "starts")),
    "stream_resume_stopped": lambda s, d: out(_resumed(s, d)),
}

#: Ticks that the last watermark (in whole milliseconds) has reached.
_PASSED = "observed_at <= (SELECT date_trunc('milliseconds', max(observed_at)) FROM pct) - INTERVAL 1 HOUR"

ORACLE = {
    "stream_dedup": sql("SELECT id, asset FROM funding"),
    "stream_hourly": sql(", h AS (SELECT asset, date_trunc('hour', observed_at) AS observed_at, count(*) AS n_ticks FROM funding GROUP BY ALL) SELECT asset, observed_at, round(mark_price, 6) AS mark_price, n_ticks FROM candle JOIN h USING (asset, observed_at) WHERE observed_at + INTERVAL 1 HOUR <= (SELECT max(observed_at) - INTERVAL 1 HOUR FROM funding)"),
    "stream_late": sql(f"SELECT id, asset FROM funding WHERE retrieved_at <= TIMESTAMP '{CUT}'"),
    "stream_gate": sql(", m AS (SELECT asset, max(observed_at) AS m, max(retrieved_at) AS r FROM funding WHERE asset IN ('click', 'purchase', 'view') GROUP BY asset) SELECT CASE WHEN count(*) < 3 THEN 'MISSING_ASSET' WHEN max(r) - INTERVAL 30 HOUR > min(m) THEN 'STALE' ELSE 'READY' END AS status, min(m) AS watermark FROM m"),
    "stream_regimes": sql(", q AS (SELECT asset, observed_at, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY asset ORDER BY observed_at) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM funding WHERE funding_rate >= 90), g AS (SELECT asset, observed_at, sum(b) OVER (PARTITION BY asset ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS k FROM q) SELECT asset, min(observed_at) AS start_at, max(observed_at) AS end_at, count(*) AS n_ticks FROM g GROUP BY asset, k HAVING max(observed_at) + INTERVAL 1 HOUR <= (SELECT max(observed_at) FROM g) - INTERVAL 1 HOUR"),
    "stream_percentile": sql("SELECT id, round(strict_pct, 6) AS percentile FROM pct"),
    "stream_resume": sql("SELECT id, observed_at FROM funding WHERE asset = 'click'"),
    "stream_percentile_ordered": sql(f"SELECT id, round(strict_pct, 6) AS percentile FROM pct WHERE {_PASSED}"),
    "stream_regimes_exact": sql(f"SELECT id, asset, treated, regime, begins AS starts FROM ev WHERE {_PASSED}"),
    "stream_resume_stopped": sql("SELECT id, asset, observed_at FROM funding"),
}
