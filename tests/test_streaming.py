"""Streams against the batch operators: files in any order, a run stopped between batches, a batch written but not committed."""

import datetime as dt
import os
import random

import pytest

from tidemark.operators import study
from tidemark.streaming import streams

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "event_id bigint, event_type string, ts timestamp, value double"


def ticks(n=400, seed=3):
    """Irregular ticks of three assets with ties in time and value, one asset far more frequent; the last tick is far later than all others."""
    r, at, rows = random.Random(seed), 0.0, []
    for i in range(n):
        at += r.choice([0, 60, 1800, 3600, 3601])
        rows.append((i, r.choice(["a", "a", "a", "b", "c"]), START + dt.timedelta(seconds=at), r.choice([1.0, 2.0, r.random(), 5 + r.random()])))
    return [*rows, (n, "z", START + dt.timedelta(seconds=at + 86400 * 30), 0.5)]


def written(spark, path, rows, files):
    """The rows as `files` files that a stream reads in the order given."""
    os.makedirs(path)
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], SCHEMA).coalesce(1).write.parquet(f"{path}-part{k}")
        (made,) = [f for f in os.listdir(f"{path}-part{k}") if f.endswith(".parquet")]
        os.rename(f"{path}-part{k}/{made}", f"{path}/{k:03d}.parquet")
        os.utime(f"{path}/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(path)


def batch(spark, rows):
    df = spark.createDataFrame([x for x in rows if x[1] != "z"], "id bigint, asset string, observed_at timestamp, funding_rate double")
    return sorted((x.id, x.asset, round(x.percentile, 9), x.treated, x.regime, x.starts) for x in study.regimes(study.treated(df)).collect())


def tuples(df):
    return sorted((x.id, x.asset, round(x.percentile, 9), x.treated, x.regime, x.starts) for x in df.collect())


def test_regimes_over_shuffled_files(spark, tmp_path):
    rows = ticks()
    mixed = rows[:-1]
    random.Random(1).shuffle(mixed)
    stream = streams.events_stream(spark, written(spark, tmp_path / "events", [*mixed, rows[-1]], 5))
    got = tuples(streams.drained(streams.regimes(stream, late="20 days")))
    assert got == batch(spark, rows) and any(x[4] and x[4] > 3 for x in got)


def test_late_ticks_are_dropped_and_waiting_ones_stay(spark, tmp_path):
    rows = [(1, "a", START, 1.0), (2, "a", START + dt.timedelta(hours=5), 2.0), (3, "a", START + dt.timedelta(hours=1), 9.0), (4, "a", START + dt.timedelta(hours=9), 3.0), (5, "a", None, 3.0), (6, "a", START + dt.timedelta(hours=5), None), (7, "a", START, 8.0), (8, "a", START + dt.timedelta(hours=4), 8.0)]
    got = streams.drained(streams.regimes(streams.events_stream(spark, written(spark, tmp_path / "events", rows, 8)), late="2 hours")).collect()
    # 3 is late but after the last tick used; 7 and 8 come after 2 was used; 4 lies after the last watermark of seven hours.
    assert sorted((x.id, x.percentile, x.treated, x.regime) for x in got) == [(1, 0.0, False, None), (2, 100 / 3, False, None), (3, 50.0, False, None)]


def test_a_stopped_run_is_taken_up_with_its_state(spark, tmp_path):
    rows = ticks(seed=8)
    events = written(spark, tmp_path / "events", rows, 5)
    stream = lambda: streams.regimes(streams.events_stream(spark, events), late="3 hours")
    home = str(tmp_path / "home")
    some = streams.continued(stream(), home, most=2).count()
    every = batch(spark, rows)
    assert 0 < some < len(every)
    assert tuples(streams.continued(stream(), home)) == every
    assert tuples(streams.continued(stream(), home)) == every  # nothing left to do


def test_a_batch_written_but_not_committed_is_not_doubled(spark, tmp_path):
    rows = ticks(60)
    events = written(spark, tmp_path / "events", rows, 3)
    stream = lambda: streams.events_stream(spark, events).select("id", "asset")
    home = str(tmp_path / "home")
    streams.continued(stream(), home, most=2)
    (tmp_path / "home/progress/commits/1").unlink()
    (tmp_path / "home/progress/commits/.1.crc").unlink(missing_ok=True)
    assert sorted(x.id for x in streams.continued(stream(), home).collect()) == list(range(61))


def test_no_ticks(spark, tmp_path):
    events = written(spark, tmp_path / "events", [(1, "a", None, None)], 1)
    assert streams.continued(streams.regimes(streams.events_stream(spark, events)), str(tmp_path / "home")).count() == 0


def test_an_error_of_the_stream_is_raised(spark, tmp_path):
    events = written(spark, tmp_path / "events", ticks(5), 1)
    with pytest.raises(Exception, match="boom"):
        streams.continued(streams.events_stream(spark, events).selectExpr("raise_error('boom') AS id"), str(tmp_path / "home"), most=1)


def test_a_table_is_replayed_in_files_of_bounded_size_in_order_of_time(spark, tmp_path):
    rows = ticks()
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    home = streams.replayed(spark, written(spark, tmp_path / "events", mixed, 1), rows=60)
    at = home.removeprefix("file:")
    files = sorted((os.stat(f"{at}/{f}").st_mtime_ns, f) for f in os.listdir(at) if f.endswith(".parquet"))
    held = [[(x.ts, x.event_id) for x in spark.read.parquet(f"{at}/{f}").collect()] for _, f in files]
    assert sorted(x for h in held for x in h) == sorted((t.replace(tzinfo=None), i) for i, _, t, _ in rows)
    assert len(held) >= 5 and max(map(len, held)) < 200
    assert all(max(a)[0] < min(b)[0] for a, b in zip(held, held[1:], strict=False))
    assert tuples(streams.drained(streams.regimes(streams.events_stream(spark, home)))) == batch(spark, rows)
