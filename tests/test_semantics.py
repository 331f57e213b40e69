"""Small literal cases: ties, gaps, late receipts, no look-ahead, idempotence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, editorial, ingest, knowledge, metrics, pit, study
from tidemark.operators.windows import numbered, running, trailing
from tidemark.sources import parsers

T0 = dt.datetime(2024, 1, 1)


def ticks(spark, rates, asset="BTC", step=1.0):
    return spark.createDataFrame([(i, asset, T0 + dt.timedelta(hours=i * step), float(r)) for i, r in enumerate(rates)], "id bigint, asset string, observed_at timestamp, funding_rate double")


def candles(spark, prices, asset="BTC"):
    return spark.createDataFrame([(asset, T0 + dt.timedelta(hours=h), float(p)) for h, p in prices], "asset string, observed_at timestamp, mark_price double")


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy(*columns[:1]).select(*columns).collect()]


def test_inclusive_tie_is_100_and_strict_tie_0(spark):
    t = ticks(spark, [1, 1])
    assert [r[1] for r in values(metrics.percentile(t), "id", "percentile")] == [100.0, 100.0]
    assert [r[1] for r in values(metrics.percentile(t, strict=True), "id", "percentile")] == [0.0, 0.0]


def test_window_is_cut(spark):
    assert values(metrics.percentile(ticks(spark, range(4)), window=2), "id", "percentile")[-1] == (3, 100.0)


def test_future_ticks_do_not_change_the_past(spark):
    full = ticks(spark, [1, 5, 2, 100, 3] * 20)
    label = lambda t: study.regimes(study.treated(t)).select("id", "observed_at", "percentile", "treated", "regime")
    probe = study.leakage_probe(full, ["2024-01-02 03:00:00"], label).collect()
    assert [r.status for r in probe] == ["PASS"]


def test_exact_anchors_and_no_fill(spark):
    r = {(h, x.hour): v for x, h, v in values(metrics.anchor_returns(candles(spark, [(0, 100), (1, 110), (2, 200), (5, 50)])), "observed_at", "horizon", "return")}
    assert r[1, 1] == pytest.approx(0.1) and r[4, 5] == pytest.approx(50 / 110 - 1) and r[1, 5] is None and r[24, 5] is None


def test_volatility_needs_the_complete_window(spark):
    v = dict(values(metrics.complete_volatility(candles(spark, [(h, 100 + h * h) for h in range(4)]), window=2), "observed_at", "volatility"))
    assert [v[T0 + dt.timedelta(hours=h)] is not None for h in range(4)] == [False, False, True, True]


def test_dominant_rate_has_one_extreme_and_one_regime(spark):
    got = study.regimes(study.treated(ticks(spark, [1.0] * 30 + [2.0])))
    assert got.where("treated").count() == 1 and got.where("starts").count() == 1


def test_regimes_split_at_gaps_and_untreated_rows(spark):
    rows = [(i, "A", T0 + dt.timedelta(hours=h), t) for i, (h, t) in enumerate([(0, True), (1, True), (3, True), (4, False), (5, True)])]
    got = study.regimes(spark.createDataFrame(rows, "id bigint, asset string, observed_at timestamp, treated boolean"))
    assert [r[1] for r in values(got, "id", "regime")] == [1, 1, 2, None, 3]


def test_jitter_is_no_gap_and_a_hole_is_one(spark):
    jitter = spark.createDataFrame([(i, "A", T0 + dt.timedelta(hours=i, milliseconds=i % 7), 1.0) for i in range(48)], "id bigint, asset string, observed_at timestamp, funding_rate double")
    assert audits.gap_count(jitter).collect()[0].n_gaps == 0
    assert audits.gap_count(jitter.where("id NOT IN (10, 11)")).collect()[0].n_gaps == 1


def test_missing_hours(spark):
    got = audits.market_quality(candles(spark, [(h, 1) for h in range(10) if h not in (3, 5, 6)])).collect()[0]
    assert got.n_missing == 3 and got.missing_sample.count(",") == 2


def test_valuation_hour(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 59, 59, 999999),), (dt.datetime(2024, 1, 1, 10, 12, 18),), (dt.datetime(2024, 1, 1, 23),)], "t timestamp")
    assert [r[0].hour for r in df.select(pit.valuation_hour(F.col("t"))).collect()] == [22, 9, 22]


def test_keep_first_and_count_duplicates(spark):
    store = spark.createDataFrame([("k", 1, "old")], "key string, id bigint, text string")
    batch = spark.createDataFrame([("k", 2, "new"), ("n", 3, "a"), ("n", 4, "b")], "key string, id bigint, text string")
    assert [tuple(r) for r in ingest.insert_only(batch, store, ["key"], ["id"]).collect()] == [("n", 3, "a")]


def test_backfill_windows_resume(spark):
    bounds = spark.createDataFrame([("A", T0, T0 + dt.timedelta(days=10))], "asset string, start timestamp, end timestamp")
    none = spark.createDataFrame([], "asset string, window_start timestamp")
    first = ingest.backfill_windows(bounds, none)
    assert first.count() == 2
    assert ingest.backfill_windows(bounds, first.select("asset", "window_start").limit(1)).count() == 1


def test_one_year_back_clamps(spark):
    got = spark.createDataFrame([(dt.datetime(2024, 2, 29, 5, 30),)], "t timestamp").select(ingest.one_year_back(F.col("t"))).first()[0]
    assert got == dt.datetime(2023, 2, 28, 5)


def test_fusion(spark):
    rows = [("f", "MARKET", 1, 1, "", "H1", 1), ("f", "ACADEMIC", 2, 2, "", "H1", 2), ("g", "SOCIAL", 3, 3, "", "H1", 3), ("g", "ACADEMIC", 4, 3, "", "H1", 4), ("h", "SOCIAL", 5, 5, "m", "H1", 5)]
    got = {r.fingerprint: (r.maturity, r.n_keys) for r in knowledge.fuse(spark.createDataFrame(rows, "fingerprint string, channel string, evidence_id bigint, independence_key bigint, mechanism string, maturity string, ord bigint")).collect()}
    assert got == {"f": ("H3", 2), "g": ("H1", 1), "h": ("H2", 1)}


def test_novelty_ignores_replay(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(1, "f", "SOL", day(1), "ACCEPTED", "PRODUCTION", "MARKET"), (2, "f", "SOL", day(2), "ACCEPTED", "REPLAY", "MARKET"), (3, "f", "SOL", day(3), "ACCEPTED", "PRODUCTION", "MARKET"), (4, "f", "ETH", day(3), "ACCEPTED", "PRODUCTION", "MARKET")]
    got = knowledge.novelty(spark.createDataFrame(rows, "id bigint, fingerprint string, universe string, as_of date, disposition string, analysis_mode string, channel string"))
    assert values(got, "id", "novelty", "occurrences")[2:] == [(3, "PERSISTENT_REGIME", 1), (4, "ASSET_VARIANT", 1)]


def test_search_bounds(spark):
    with pytest.raises(ValueError):
        knowledge.expand(" ")
    assert knowledge.expand("Basis  trade")[1:] == ["carry", "futures basis", "funding"]


def test_funding_coverage_counts(spark):
    got = audits.funding_coverage(ticks(spark, range(5)).where("id <> 2"), "2024-01-01 00:00:00", "2024-01-01 05:00:00").collect()[0]
    assert (got.n_missing, got.n_abnormal, got.reasons) == (1, 1, "missing_intervals,abnormal_gaps")


def test_horizons(spark):
    got = spark.createDataFrame([("4h and 24h",), ("soon",)], "h string").select(editorial.best_fit(F.col("h")), F.size(editorial.horizon_endpoints(F.col("h")))).collect()
    assert [tuple(r) for r in got] == [("HIGH_FIT", 2), ("OUT_OF_SCOPE_FOR_USER", 0)]


def test_aria_links_and_relabelling(spark):
    pages = spark.createDataFrame([(1, '<a href="/x" aria-label=" A  b ">t</a><a href="/x" aria-label="again">t</a>')], "page_id bigint, html string")
    assert [tuple(r) for r in parsers.html_links(pages, label="aria").select("url", "label").collect()] == [("/x", "A b")]
    rec = spark.createDataFrame([("s", {"a": "1", "b": "2"})], "source_name string, metadata map<string,string>")
    assert parsers.relabelled(rec, "t", {"b": "3"}).first().metadata == {"a": "1", "b": "3"}


def test_undated_feed(spark):
    xml = "<rss><channel><item><title>a</title><guid>g1</guid></item><item><title>b</title><link>l2</link><guid>g2</guid></item></channel></rss>"
    assert sorted(r.external_id for r in parsers.undated_feed(spark.createDataFrame([(xml,)], "payload string")).collect()) == ["g1", "l2"]


def test_two_level_windows_equal_plain_ones(spark):
    df = spark.range(0, 500).select(F.col("id"), F.lit("k").alias("asset"), (F.col("id") * 7 % 13).alias("v"))
    got = trailing(df, ["asset"], ["id"], F.floor(F.col("id") / 37), 30, {"s": lambda w: F.sum("v").over(w)})
    want = [sum(i * 7 % 13 for i in range(max(0, k - 29), k + 1)) for k in range(500)]
    assert [r.s for r in got.orderBy("id").collect()] == want
    assert [r._rank for r in numbered(df, ["asset"], ["id"], F.floor(F.col("id") / 37)).orderBy("id").collect()] == list(range(500))
    assert running(df, ["asset"], ["id"], F.floor(F.col("id") / 37), F.col("v"), "t").agg(F.max("t")).first()[0] == sum(i * 7 % 13 for i in range(500))


def test_study_spec_checks_and_id(spark):
    from tidemark.operators.contracts import StudySpec, ready

    with pytest.raises(ValueError):
        StudySpec(family="1", assets=("BTC",), outcome="simple")
    with pytest.raises(ValueError):
        StudySpec(family="1", assets=("X",), known_assets=("BTC",))
    with pytest.raises(ValueError):
        StudySpec(family="1", assets=("BTC",), horizons=(0,))
    with pytest.raises(ValueError):
        StudySpec(family="1", assets=("BTC",), start="2024-02", end="2024-01")
    spec = StudySpec(family="1", assets=("BTC",))
    assert spec.id == StudySpec(family="1", assets=("BTC",)).id != StudySpec(family="2", assets=("BTC",)).id
    h = spark.createDataFrame([(1, "PRODUCTION", "ACCEPTED"), (2, "REPLAY", "ACCEPTED")], "fingerprint bigint, analysis_mode string, disposition string")
    assert ready(h, spec) and not ready(h, StudySpec(family="2", assets=("BTC",)))


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import streams

    rows = [(i, T0 + dt.timedelta(minutes=17 * i), i % 3, "A" if i % 2 else "B", float(i * 7 % 11), "{}") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    live = streams.events_stream(spark, f"{tmp_path}/events.parquet", files_each=10)
    got = sorted(map(tuple, streams.drained(streams.percentiles(live.drop("retrieved_at"), 5)).collect()))
    batch = metrics.percentile(events.selectExpr("event_id AS id", "event_type AS asset", "ts AS observed_at", "value AS funding_rate"), window=5, strict=True)
    assert got == sorted(tuple(r) for r in batch.select("id", "asset", "percentile").collect())


def test_gate_over_several_files_in_any_order(spark, tmp_path):
    import shutil

    from tidemark.streaming import streams

    ticks = [(1, "view", "2024-01-01 10:10:00"), (2, "click", "2024-01-01 09:00:00"), (3, "purchase", "2024-01-01 08:30:00"), (4, "view", "2024-01-01 07:00:00")]
    (tmp_path / "events").mkdir()
    for k, row in enumerate(ticks):
        one = spark.createDataFrame([row], "event_id bigint, event_type string, ts string").selectExpr("event_id", "event_type", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "1.0D AS value")
        one.coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        shutil.move(str(next((tmp_path / f"part{k}").glob("part-*.parquet"))), tmp_path / "events" / f"{k}.parquet")
    stream = lambda: streams.events_stream(spark, f"{tmp_path}/events")
    got = streams.gated(stream(), ["view", "click", "purchase"]).collect()
    assert [(r.status, str(r.watermark)) for r in got] == [("READY", "2024-01-01 08:30:00")]
    assert [r.status for r in streams.gated(stream(), ["view", "click", "purchase", "other"]).collect()] == ["MISSING_ASSET"]
