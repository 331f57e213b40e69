"""Stores rewritten by touched partitions, run rows, the receipt-qualified audit on literal rows, duplicate classes."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, knowledge, metrics
from tidemark.sources import stores

BATCH = "key bigint, id bigint, hash string"
PART = "coalesce(floor(key / 10), -1)"


def collect(spark, at, rows, **more):
    return stores.collect(spark.createDataFrame(rows, BATCH), f"{at}/store", ["key"], "hash", ["id"], F.expr(PART), f"{at}/runs", "test", 9, **more)


def held(spark, at):
    return {r.key: (r.id, r.hash) for r in stores.read(spark, f"{at}/store", BATCH).collect()}


def stamps(at):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{at}/store") for f in fs if f.startswith("part-")}


def counts(row):
    return tuple(row[k] for k in ("retrieved", "inserted", "updated", "duplicates", "failed", "status"))


def test_only_touched_partitions_are_written(spark, tmp_path):
    at = str(tmp_path)
    assert counts(collect(spark, at, [(1, 1, "a"), (1, 2, "z"), (11, 3, "b"), (21, 4, "c"), (None, 5, "x"), (None, 6, "y")])) == (6, 3, 0, 1, 2, "PARTIAL")
    before = stamps(at)
    assert counts(collect(spark, at, [(11, 7, "B"), (12, 8, "d"), (21, 9, "c")])) == (3, 1, 1, 1, 0, "SUCCESS")
    after = stamps(at)
    assert held(spark, at) == {1: (1, "a"), 11: (7, "B"), 12: (8, "d"), 21: (4, "c")}
    same = {p for p in before if after.get(p) == before[p]}
    assert {p.split("_part=")[1].split("/")[0] for p in before.keys() - same} == {"1"} and len(same) == 2
    assert counts(collect(spark, at, [(11, 7, "B"), (12, 8, "d"), (21, 9, "c")])) == (3, 0, 0, 3, 0, "SUCCESS") and stamps(at) == after
    assert counts(collect(spark, at, [])) == (0, 0, 0, 0, 0, "SUCCESS") and stamps(at) == after
    assert spark.read.parquet(f"{at}/runs").where("requested = 9 AND started_at <= ended_at").count() == 4


def test_a_run_that_dies_leaves_its_row_and_the_store(spark, tmp_path):
    at = str(tmp_path)
    collect(spark, at, [(1, 1, "a")])
    bad = spark.createDataFrame([(2, 2, "b")], BATCH).withColumn("hash", F.raise_error(F.lit("feed broke")).cast("string"))
    with pytest.raises(Exception, match="feed broke"):
        stores.collect(bad, f"{at}/store", ["key"], "hash", ["id"], F.expr(PART), f"{at}/runs", "bad", 9)
    assert held(spark, at) == {1: (1, "a")}
    assert {(r.source, r.status, r.inserted) for r in spark.read.parquet(f"{at}/runs").collect()} == {("test", "SUCCESS", 1), ("bad", "FAILED", 0)}


def test_metrics_of_a_cutoff_replace_stale_ones(spark, tmp_path):
    row = "asset string, observed_at timestamp, metric_name string, metric_value double"
    day = lambda n: f"2024-01-0{n} 03:00:00"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema.replace("observed_at timestamp", "observed_at string")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    cut = F.lit("2024-01-05").cast("timestamp")
    stored = frame([("a", day(1), "r", 1.0, "2024-01-04"), ("a", day(2), "gone", 2.0, "2024-01-04"), ("a", day(3), "r", 3.0, "2024-01-05"), ("a", day(9), "r", 4.0, "2024-01-04")], row + ", cutoff string").withColumn("cutoff", F.col("cutoff").cast("timestamp"))
    fresh = frame([("a", day(1), "r", 1.5), ("a", day(3), "r", 9.0), ("a", day(4), "r", 5.0)], row)
    seen = frame([("a", day(n)) for n in (1, 2, 3, 4)], "asset string, observed_at timestamp")
    path = f"{tmp_path}/metrics"
    placed = lambda df: df.withColumn("day", F.date_format("observed_at", "yyyyMMdd"))
    stores.rewrite(placed(stored).withColumn("change", F.lit("inserted")), path, "day")
    back = stores.read(spark, path, placed(stored).schema)
    assert stores.rewrite(placed(metrics.refreshed(back, fresh, seen, cut)), path, "day") == ["20240101", "20240102", "20240104"]
    got = {(str(r.observed_at)[:10], r.metric_value, str(r.cutoff)[:10]) for r in stores.read(spark, path, placed(stored).schema).collect()}
    assert got == {("2024-01-01", 1.5, "2024-01-05"), ("2024-01-03", 3.0, "2024-01-05"), ("2024-01-04", 5.0, "2024-01-05"), ("2024-01-09", 4.0, "2024-01-04")}


def test_audit_of_literal_rows(spark):
    """Rising rates are extreme once ten are there; ties never are; a null keeps its place; jitter is no gap."""
    hour = lambda h, m=0: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:{m:02d}:00"
    rates = [(hour(h, h % 2), float(h)) for h in range(12)] + [(hour(13), None), (hour(15), 99.0), (hour(17), 99.0)]
    rows = [("a", "funding", t, i, r, 1 + (i == 3)) for i, (t, r) in enumerate(rates)] + [("a", "candle", hour(h), 100 + h, None, 1) for h in (8, 9, 10, 14, 15, 33)]
    df = spark.createDataFrame(rows, "asset string, kind string, t string, id bigint, funding_rate double, n_receipts bigint").withColumn("observed_at", F.col("t").cast("timestamp"))
    got = {r.asset: r for r in audits.qualified_audit(df, ["a", "b"]).collect()}
    a = got["a"]
    # 9 of 10, 10 of 11, 11 of 12 and 12 of 13 are exceeded at hours 9, 10, 11 and 15; the second 99 exceeds 12 of 14. Hour 11 has the candles 10 and 14.
    assert (a.funding_rows, a.funding_gaps, a.funding_duplicates, a.candle_rows, a.candle_gaps, a.candle_duplicates) == (15, 3, 1, 6, 2, 0)
    assert (a.n_extreme, a.eligible_1h, a.eligible_4h, a.eligible_24h) == (4, 3, 1, 1)
    assert a.n_regimes == 3  # 09:01, 10:00 and 11:01 are 59 and 61 minutes apart, 15:00 stands alone
    assert got["b"].funding_rows == 0 and got["b"].funding_start is None and got["b"].n_regimes == 0
    assert audits.audit_verdict(audits.qualified_audit(df, ["a"])).first().recommendation == "EXTEND_TO_18_MONTHS"


def test_duplicate_classes_against_brute_force(spark):
    texts = [(i, "") for i in range(40)] + [(i, "   ") for i in range(40, 60)] + [(60, None)] + [(100 + i, "a b c d e f") for i in range(30)] + [(200, "a b c x"), (201, "c x y z"), (202, "q r s t"), (203, "q r u v w")]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in texts], "id bigint, text string, kind int")
    members, links = knowledge.duplicate_classes(df, ["kind"], least=0.45, least_structured=0.25)
    words = {i: frozenset((t or "").split()) for i, t in texts}
    alike = lambda i, j: words[i] == words[j] or len(words[i] & words[j]) >= (0.25 if i % 2 == j % 2 else 0.45) * len(words[i] | words[j])
    label = {i: i for i in words}
    for _ in words:
        label = {i: min(label[j] for j in words if alike(i, j)) for i in words}
    assert {r.id: r.class_id for r in members.collect()} == label
    assert len(members.collect()) == len(texts) and links.count() < 10
    empty, none = knowledge.duplicate_classes(df.where("id < 0"), ["kind"])
    assert empty.count() == none.count() == 0
