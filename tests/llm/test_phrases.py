"""Phrase collocations against plain counting, tries against dictionaries, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import texts

from tidemark.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int"


def plain(rows, longest=3, least=10, share=50, top=2000):
    out = []
    by_lang = {}
    for _, text, lang in rows:
        by_lang.setdefault(lang or "und", []).append(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    for lang, all_texts in by_lang.items():
        f, n = Counter(), 0
        for text in all_texts:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
                w = re.findall("[^ \t]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(100 * b >= share * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(spark, rows, **more):
    made = spark.createDataFrame([(i, t, lang, "x", 3) for i, t, lang in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.collocations(spark, made, **more).collect()))


def corpus(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["The", "red", "fox", "jumps", "ÄÖ", "über", "x", "a.b", "ßa", "　", "\x1c", "z z"]
    return [(i, "".join(r.choice(vocabulary) + r.choice([" ", " ", "\t", "  ", ", ", "\n", "! "]) for _ in range(r.randrange(60))), r.choice(["en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("more", [{}, {"longest": 4, "least": 3, "share": 90}, {"top": 5, "trie": 80, "least": 4}])
def test_equals_plain_counting(spark, more):
    rows = corpus(400)
    want = plain(rows, **{k: v for k, v in more.items() if k != "trie"})
    assert want and got(spark, rows, **more) == want


def test_odd_rows(spark):
    rows = [(i, t, "en") for i, t in texts()] + [(None, "One two THREE " * 30, None), (1, "One two THREE " * 30, "und"), (2, ".,;", "fr"), (3, None, None)]
    assert got(spark, rows, least=5) == plain(rows, least=5)
    assert got(spark, []) == [] and got(spark, [(1, None, None), (2, "", "en")]) == []
    assert got(spark, [(1, "one two", "en")]) == []


def test_full_buckets_change_nothing(spark, monkeypatch):
    """With far too few buckets everything is a candidate; the tries still count exactly."""
    monkeypatch.setattr(phrases, "BUCKETS", (3, 3))
    rows = corpus(300, 5)
    assert got(spark, rows) == plain(rows)


def test_trie_finds_its_keys_and_no_others():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 30, (3000, 4)), axis=0)
    keys[:500, 2:] = -1
    keys = np.unique(keys, axis=0)
    trie = phrases.Trie(keys, 32)
    assert len(set(trie.node.tolist())) == len(keys)
    known = {tuple(x[x >= 0].tolist()): s for x, s in zip(keys, trie.node.tolist(), strict=True)}
    inner = {k[:i] for k in known for i in range(len(k) + 1)}
    for key in r.integers(0, 32, (5000, 4)).tolist() + keys.tolist():
        key = tuple(x for x in key if x >= 0)
        state = np.zeros(1, np.int64)
        for i, d in enumerate(key, 1):
            state = trie.step(state, np.array([d]))
            assert (state[0] >= 0) == (key[:i] in inner)
            if state[0] < 0:
                break
        else:
            assert key not in known or known[key] == state[0]


def test_texts_are_scanned_as_often_with_many_tries_as_with_one(spark):
    """Work grows with the texts, not with texts times tries."""
    rows, seen = corpus(300, 7), spark.sparkContext.accumulator(0)

    def scan(spark, trie):
        before = seen.value
        made = spark.createDataFrame([(i, t, lang, "x", 3) for i, t, lang in rows], SCHEMA).repartition(3)

        def counted(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        found = phrases.counted(spark, made.select("lang", "text").mapInArrow(counted, "lang string, text string"), trie=trie)[0]
        return sorted(map(tuple, found.collect())), seen.value - before

    (one, scans), (many, more) = scan(spark, 1 << 20), scan(spark, 20)
    assert one == many and len(one) > 100 and scans == more <= 5 * len(rows)
