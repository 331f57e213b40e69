"""Operator 8 where the rows of one id exceed the limit together."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty
from tidemark.llm import sharding

LIMIT = 10_000


def rows():
    hot = [(7, "x" * (900 + 37 * (k % 9))) for k in range(300)]
    null = [(None, "y" * (1 + 61 * (k % 90))) for k in range(120)] + [(None, None)] * 5
    large = [(8, "z" * n) for n in (25_000, 10_000, 9_999, 5_001, 5_000, 5_000, 3)]
    return hot + null + large + [(100 + k, "w" * 300) for k in range(80)]


@pytest.mark.parametrize("block", [1, 12])
def test_parts_of_a_hot_id_hold_the_limit(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK", block)
    got = sharding.sharded(documents(spark, rows()).repartition(3), LIMIT).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len(t or "")) for i, t in rows())
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert all(s <= LIMIT or count[k] == 1 for k, s in size.items())
    assert all((r.shard_bytes, r.shard_docs) == (size[r.shard], count[r.shard]) for r in got)
    for i in (7, None):
        parts = {r.shard for r in got if r.doc_id == i}
        assert all("+" in k for k in parts) and len(parts) <= 2 * sum(len(t or "") for j, t in rows() if j == i) / LIMIT + 2


def test_write_has_each_row_once(spark, tmp_path):
    docs = documents(spark, rows())
    sharding.write(docs, f"{tmp_path}/out", LIMIT)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text) for r in back.select("doc_id", "text").collect()) == Counter(rows())
    assert set(docs.columns) < set(back.columns)
    folders = back.groupBy(F.regexp_extract(F.input_file_name(), "_shard=([^/]*)", 1)).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert len(folders) > 30 and all((r.b or 0) <= LIMIT or r.n == 1 for r in folders)
    sharding.write(empty(spark), f"{tmp_path}/none", LIMIT)
