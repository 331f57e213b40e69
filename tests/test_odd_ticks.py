"""Queries whose SQL states the rule for odd ticks too: NaN, null and infinite rates, null times, assets and ids."""

import duckdb

from tidemark.plans import registry


def test_funding_diagnostics_on_odd_ticks(spark, tmp_path):
    at = str(tmp_path / "events.parquet")
    value = "CASE i % 9 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN CAST('inf' AS DOUBLE) ELSE i END"
    c = duckdb.connect()
    c.sql(f"COPY (SELECT CASE WHEN i <> 77 THEN i END AS event_id, CASE WHEN i % 11 > 0 THEN TIMESTAMP '2024-01-04' + to_hours(i // 2) END AS ts, i % 5 AS user_id, CASE WHEN i % 7 > 0 THEN 'a' END AS event_type, {value} AS value, '' AS props FROM (SELECT unnest(range(0, 900)) AS i)) TO '{at}'")
    c.sql(f"CREATE VIEW events AS FROM '{at}'")
    got = registry.queries()["funding_diagnostics"](spark, str(tmp_path))
    columns = ["asset", "raw", "malformed", "eligible", "duplicate"]
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['funding_diagnostics']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
    assert len(want) == 2 and all(r[3] and r[4] for r in want)


def test_funding_diagnostics_counts_whole_milliseconds(spark, tmp_path):
    """DuckDB's epoch_ms rounds; a millisecond begins at its first microsecond and holds a thousand of them."""
    at = str(tmp_path / "events.parquet")
    c = duckdb.connect()
    c.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-06' + to_microseconds(CASE i WHEN 1 THEN 1400 WHEN 2 THEN 1600 WHEN 3 THEN 2300 WHEN 4 THEN 2999 ELSE 3000 END) AS ts, 1 AS user_id, 'a' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM (SELECT unnest(range(1, 6)) AS i)) TO '{at}'")
    c.sql(f"CREATE VIEW events AS FROM '{at}'")
    columns = ["asset", "raw", "malformed", "eligible", "duplicate"]
    got = registry.queries()["funding_diagnostics"](spark, str(tmp_path)).select(*columns).collect()
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['funding_diagnostics']})").fetchall()
    assert want == [tuple(r) for r in got] == [("a", 5, 0, 3, 2)]
