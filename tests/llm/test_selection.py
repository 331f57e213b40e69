"""Operators 1, 4, 6, 7 and 8, and the pipeline, against brute force."""

from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import documents, empty, texts, words
from tidemark.llm import components, lines, neardups, quality, sharding, topk


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def near(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and jaccard(sets[i], sets[j]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i])))
    return out


def group(seed, n, copies=0):
    """Near copies of one text, a few words changed in each."""
    base = words(seed, 200).split(" ")
    out = []
    for k in range(n):
        own = list(base)
        own[(k * 7) % 200] = f"w{k}"
        out.append(" ".join(own))
    return out + [" ".join(base)] * copies


@pytest.mark.parametrize("block", [5, 400])
def test_near_duplicates(spark, block):
    rows = texts() + [(100 + k, t) for k, t in enumerate(group(77, 23, 4))]
    got = [(r.doc_id, r.class_id, r.n_links) for r in neardups.linked(spark, documents(spark, rows), block=block).collect()]
    assert sorted(got, key=str) == sorted(near(rows), key=str)


def test_near_duplicates_empty(spark):
    assert neardups.linked(spark, empty(spark)).count() == 0


def test_one_of_each_class_stays(spark):
    docs = documents(spark)
    kept = neardups.first_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert {2, 3} & {r.doc_id for r in kept.collect()} == set()


def test_prefix_is_shortened_to_the_target():
    d = neardups.prefix_depth(0.8, 16, 6, 0.9995)
    assert neardups.recall(0.8, d, 16) >= 0.9995 > neardups.recall(0.8, d + 1, 16)
    for n in range(1, 60):
        sizes = [(b / (n + m - b)) for m in range(1, 90) for b in range(1, min(n, m) + 1) if b / (n + m - b) >= 0.8 - 1e-12]
        assert abs(neardups.attainable(n, 0.8) - min(sizes)) < 1e-12
    used, enters = neardups.lengths(0.8, 16, 6, 0.9995)
    assert used == (4, 5, 6) and enters[3].tolist() == [False, False, True] and enters[200].tolist() == [True, False, False]
    for n in range(1, 120):  # similar sizes meet at a length at which each pair of them is found
        for m in range(-(-4 * n // 5), 5 * n // 4 + 1):
            both = [k for k, x in zip(used, enters[n] & enters[m]) if x]
            least = max(neardups.attainable(n, 0.8), neardups.attainable(m, 0.8))
            assert any(neardups.recall(least, k, 16) >= 0.9995 for k in both)


def test_near_duplicates_of_short_texts(spark):
    rows = [(100 * n + k, " ".join(f"{x}{n}" for x in "abcdefghijklmnopqrstuvwxyz"[: n + k])) for n in range(1, 20) for k in range(4)]
    rows += [(5000 + k, "the the the the the the the the " * (k + 1)) for k in range(3)]
    got = [(r.doc_id, r.class_id, r.n_links) for r in neardups.linked(spark, documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(near(rows), key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 101, 102)} == {100}


def test_line_dedup(spark):
    rows = [*texts(), (200, "a b c d e f g h i j\nshort one\nq r s t u v w x y z"), (201, "a b c d e f g h i k\nshort one\n\nz y x w v u t s r q"), (202, None)]
    all_lines = [(i, k, frozenset(x.encode().split())) for i, t in set(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    order = lambda i, k: (i is not None, i or 0, k)
    want = Counter()
    for i, k, w in all_lines:
        if w and any(order(j, m) < order(i, k) and len(w & v) * 5 >= len(w | v) * 4 for j, m, v in all_lines):
            want[i] += 1
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in lines.marked(docs).collect()}
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == dict(want)
    assert got[201].removed == "0,1,3" and got[202].n_lines == 0 and got[8].n_lines == 1
    kept = lines.cleaned(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()}[201] == ""
    assert lines.marked(empty(spark)).count() == 0


def test_quality(spark):
    got = {r.doc_id: r for r in quality.measured(spark, documents(spark)).collect()}
    for i, t in texts():
        w = (t or "").encode().split()
        wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {p for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        own = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), len(again), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(own) - len(set(own)))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert not got[18].kept and not got[19].kept and got[1].kept and got[16].kept
    docs = documents(spark)
    kept = quality.filtered(spark, docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.measured(spark, docs).where("kept").collect())
    assert quality.measured(spark, empty(spark)).count() == 0 and quality.filtered(spark, empty(spark)).count() == 0


def test_cascade_verdict_does_not_depend_on_the_order():
    import pyarrow as pa

    column = pa.array([t for _, t in texts()])
    alive = np.ones(len(column), bool)
    names = list(quality.RULES)
    assert quality.cascade(column, alive, names).tolist() == quality.cascade(column, alive, names[::-1]).tolist()


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(5)
    data = [(int(i), [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(120)]
    data += [(200 + i, [0.25] * 8) for i in range(60)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [1.0, 2.0]), (None, [0.9] * 8)]
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    v = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").selectExpr("vec_id", "embedding", "1 AS n", "2 AS block", "3 AS values")
    got = sorted(((x.query_id, x.rank, x.vec_id, x.score) for x in topk.nearest(spark, v, v.where("vec_id % 10 = 0")).where("query_id <> 303").collect()), key=str)
    good = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in data if e is not None and None not in e and not np.isnan(e).any()]
    want = []
    for i, q in good:
        if i is not None and i % 10 == 0:
            scores = sorted((-int(e @ q), -(1 << 63) if j is None else j) for j, e in good if j != i and len(e) == len(q))
            want += [(i, k + 1, None if j == -(1 << 63) else j, -s) for k, (s, j) in enumerate(scores[:5])]
    assert got == sorted(want, key=str) and any(r[2] is None for r in got)
    assert topk.nearest(spark, v.limit(0), v.limit(0)).count() == 0


def test_shards(spark):
    for limit in (500, 20_000, 10**9):
        got = sharding.sharded(documents(spark), limit).collect()
        assert len(got) == len(texts())
        size, count = Counter(), Counter()
        for r in got:
            size[r.shard] += r.n_bytes
            count[r.shard] += 1
        assert all(s <= limit or count[k] == 1 or "+" in k for k, s in size.items())
        plain = sorted(k for k in size if "+" not in k)
        assert all(not b.startswith(a) for a, b in zip(plain, plain[1:]) if a != b) or len(plain) == 1
    assert sharding.sharded(empty(spark)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, words(1, 200)), (2, words(1, 200)), (3, "too short"), (4, words(4, 90) + "\n" + words(5, 90)), (5, words(6, 90) + "\n" + words(5, 90))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen == [[1, 2, 4, 5], [1, 4, 5], [1, 4, 5], [1, 4, 5]]
    assert {r.doc_id: r.text for r in docs.collect()}[5] == words(6, 90)
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == [1, 4, 5]
