"""Operators 2 and 9 against all windows counted one by one."""

import hashlib
from collections import defaultdict

import pytest

from tests.llm.fixtures import documents, empty, texts
from tidemark.llm import passages, substrings


def brute(rows, length, by_word):
    units = [((t or "").encode().split() if by_word else (t or "").encode()) for _, t in rows]
    seen = defaultdict(list)
    for k, u in enumerate(units):
        for s in range(len(u) - length + 1):
            seen[tuple(u[s : s + length])].append((k, s))
    gone = [[False] * len(u) for u in units]
    name = lambda k: (rows[k][0] is not None, rows[k][0] or 0)
    for at in seen.values():
        if len(at) > 1:
            first = min((name(k), s) for k, s in at)
            for k, s in at:
                if not by_word or (name(k), s) > first:
                    gone[k][s : s + length] = [True] * length
    return units, gone


@pytest.mark.parametrize("many", [0, 20_000])
def test_words(spark, many):
    rows = texts()
    units, gone = brute(rows, 20, True)
    want = sorted((str(rows[k][0]), len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()) for k, (u, g) in enumerate(zip(units, gone)))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in passages.removed(documents(spark), many=many).collect())
    assert got == want
    assert sum(w[2] for w in want) > 100


@pytest.mark.parametrize("many", [0, 20_000])
def test_bytes(spark, many):
    rows = texts()
    units, gone = brute(rows, 400, False)
    want = sorted((str(rows[k][0]), len(u), sum(g), sum(b and not a for a, b in zip([False, *g], g)), hashlib.sha256(bytes(c for c, x in zip(u, g) if not x)).hexdigest()) for k, (u, g) in enumerate(zip(units, gone)))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.removed(documents(spark), many=many).collect())
    assert got == want
    assert sum(w[2] for w in want) > 1000


def test_empty_tables(spark):
    assert passages.removed(empty(spark)).count() == 0
    assert substrings.removed(empty(spark)).count() == 0
    assert passages.cleaned(empty(spark)).count() == 0


def test_cleaned_keeps_columns_and_white_space(spark):
    docs = documents(spark)
    got = passages.cleaned(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    found = {r.doc_id: r.text for r in got.collect()}
    assert found[1] == texts()[0][1] and found[2] == "" and found[7] is None and found[14] == dict(texts())[14]


def test_automaton_matching_statistics():
    a = passages.Automaton()
    a.add(list("abcbc"))
    a.add(list("xbcx"))
    seen = ["abcbc", "xbcx"]
    text = "zabcbcxbcxab"
    want = [max((n for n in range(i + 2) if any(text[i + 1 - n : i + 1] in s for s in seen)), default=0) for i in range(len(text))]
    assert a.matches(list(text)) == want


def test_repeat_groups_have_all_occurrences():
    import pyarrow as pa

    table = pa.table({"h": [1, 1, 1], "c": [1, 2, 3], "back": [1, 1, 1], "front": [0, 0, 0], "context": [b"xabcd", b"yabcd", b"zabcd"]})
    assert substrings.repeat_groups(table, 4) == [(4, [(0, 0), (1, 0), (2, 0)])]


def test_interval_tree_against_all_substrings():
    import random

    import numpy as np

    r = random.Random(4)
    for _ in range(200):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(2, 9))]
        before = [r.choice([97, 98, -1 - k]) for k in range(len(texts))]
        root = np.sort([r.randrange(2) for _ in texts])
        order, found = substrings.intervals(root, texts, np.array(before))
        want = set()
        for k in set(root.tolist()):
            own = [i for i in range(len(texts)) if root[i] == k]
            for p in {texts[i][:n] for i in own for n in range(len(texts[i]) + 1)}:
                same = [i for i in own if texts[i].startswith(p)]
                longer = {texts[i][len(p) : len(p) + 1] for i in same}
                if len(same) > 1 and (len(longer) > 1 or longer == {b""}) and len({before[i] for i in same}) > 1:
                    want.add((len(p), frozenset(same)))
        assert {(n, frozenset(order[a : b + 1].tolist())) for a, b, n in found} == want
