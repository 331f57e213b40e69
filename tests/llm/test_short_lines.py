"""Operator 4 on lines of one word or more, and the pipeline's line dedup."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, words
from tidemark.llm import lines

ROWS = [
    (1, "Share this page\na b c d\none\n\nx y z"),
    (2, "this Share page page\na b c d e\n \none two\nx y w"),
    (3, "Share this page\nd c b a\none\n\t\na b c d f"),
    (4, "only\nalone here\n\np q r s t\np q r s"),
    (4, "only\nalone here\n\np q r s t\np q r s"),
    (None, "z z\nalone here"),
    (5, None),
]


def expected(rows, least):
    held = [(i, k, frozenset(x.split())) for i, t in set(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    order = lambda i, k: (i is not None, i or 0, k)
    gone = {}
    for i, k, w in held:
        if len(w) >= least and any(len(v) >= least and order(j, m) < order(i, k) and len(w & v) * 5 >= len(w | v) * 4 for j, m, v in held):
            gone.setdefault(i, []).append(k)
    return {i: ",".join(map(str, sorted(k))) for i, k in gone.items()}


def test_short_lines_against_brute_force(spark):
    for least in (1, 2, 4, 5):
        got = {r.doc_id: r.removed for r in lines.marked(documents(spark, ROWS), min_words=least).collect() if r.n_removed}
        assert got == expected(ROWS, least), least
    assert expected(ROWS, 1)[3] == "0,1,2,4" and "4" in expected(ROWS, 1)[4]


def test_different_words_of_one_hash_are_different_lines(spark):
    same = spark.range(400_000).selectExpr("concat('w', id) AS w").groupBy(F.hash("w")).agg(F.min("w").alias("x"), F.max("w").alias("y"))
    one, two = same.where("x <> y").select("x", "y").first()
    got = lines.marked(documents(spark, [(1, one), (2, two), (3, two)]), min_words=1).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 1}


def test_pipeline_removes_a_later_short_line(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, [(i, "Share this page\n" + words(30 + i, 60) + "\n\n") for i in range(6)])
    kept = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.where("text LIKE '%Share this page%'").collect()} == {0}
    assert {r.doc_id: r.text for r in kept.collect()}[3] == words(33, 60) + "\n\n"


def near_copies(n, changes=2):
    """One line in n copies, each with a few words of its own; copies of copies among them, not all similar to the first."""
    r, base, rows = random.Random(5), words(77, 80, 4000).split(), []
    for i in range(n):
        own = list(rows[r.randrange(len(rows))][1].split() if rows and i % 10 == 0 else base)
        for k in range(changes):
            own[r.randrange(len(own))] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    return rows


def test_near_copies_of_a_line_are_settled_without_their_pairs(spark, monkeypatch):
    rows, made, staged = near_copies(200), [], lines.staged

    def counted(df, name, *more):
        out = staged(df, name, *more)
        made.extend([out.count()] if name in ("pairs", "late", "rest") else [])
        return out

    monkeypatch.setattr(lines, "staged", counted)
    got = {r.doc_id: r.removed for r in lines.marked(documents(spark, rows)).collect() if r.n_removed}
    assert got == expected(rows, 1) and len(got) > 150
    assert sum(made) < 10 * len(rows), made


def test_copies_that_differ_more_or_less_make_few_pairs(spark, monkeypatch):
    """Copies with one to nine words of their own each: most pairs of them are near 80 %, and the earliest one is similar to some only."""
    r, base, rows, made, staged = random.Random(9), words(78, 60, 4000).split(), [], [], lines.staged
    for i in range(300):
        own = list(base)
        for k in r.sample(range(len(own)), 1 + r.randrange(9)):
            own[k] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))

    def counted(df, name, *more):
        out = staged(df, name, *more)
        made.extend([out.count()] if name in ("led", "pairs", "rest") else [])
        return out

    monkeypatch.setattr(lines, "staged", counted)
    got = {r.doc_id: r.removed for r in lines.marked(documents(spark, rows)).collect() if r.n_removed}
    assert got == expected(rows, 1) and len(got) > 100
    assert sum(made) < 60 * len(rows), made


def test_words_that_were_not_counted_are_the_rarest(spark):
    docs = documents(spark, [(1, "a b b c"), (2, "d")])
    levels = spark.range(1).select(F.array_distinct(lines._levels(docs, "text")).alias("x")).first().x
    assert sorted(x >> lines.CODE_BITS for x in levels) == [0, 1, 3]


def test_no_leader_is_asked_where_few_sets_meet(spark, monkeypatch):
    """Under words that few lines have, the join finds the pairs; to ask leaders there costs a shuffle of all index words and saves none."""
    rows = []
    for i in range(40):
        own = words(200 + i, 30).split()
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[1:], f"own{i}"]))]
    made, staged = [], lines.staged

    def counted(df, name, *more):
        out = staged(df, name, *more)
        made.extend([out.count()] if name == "led" else [])
        return out

    monkeypatch.setattr(lines, "staged", counted)
    got = {r.doc_id: r.removed for r in lines.marked(documents(spark, rows)).collect() if r.n_removed}
    assert got == expected(rows, 1) and len(got) >= 35
    assert sum(made) == 0, made


def test_ids_of_any_size_order_lines(spark):
    """Ids that fit with the line number into 63 bits are places by themselves; others are numbered."""
    a, b, c = words(301, 30), words(302, 30), words(303, 30)
    for ids in ([0, 7, (1 << 32) - 1], [-3, 7, (1 << 63) - 1]):
        rows = [(ids[2], f"{a}\n{b}\n{c}"), (ids[0], f"{c}\nx {a}"), (ids[1], f"{a} x\n{c}\n{b} y")]
        got = {r.doc_id: r.removed for r in lines.marked(documents(spark, rows)).collect() if r.n_removed}
        assert got == expected(rows, 1) and len(got) == 2, ids


@pytest.mark.parametrize("fitted", [1, 3])
def test_the_order_of_words_changes_no_row(spark, monkeypatch, fitted):
    """Words are counted on a sample, which orders the index alone."""
    monkeypatch.setattr(lines, "FITTED", fitted)
    own = [words(400 + i, 25).split() for i in range(8)]
    rows = [(i, "\n".join([" ".join(own[i % 8]), " ".join([*own[(i + 3) % 8][i % 4 :], "the", f"x{i}"]), "the same line"])) for i in range(24)]
    got = {r.doc_id: r.removed for r in lines.marked(documents(spark, rows)).collect() if r.n_removed}
    assert got == expected(rows, 1) and len(got) > 10
