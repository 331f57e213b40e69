"""The corpus pipeline, stage by stage and as a whole, against brute force on documents with every hard case."""

from collections import Counter, defaultdict

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.fixtures import documents, empty, texts, words
from tests.llm.test_repeats import brute
from tests.llm.test_selection import near
from tests.llm.test_short_lines import expected

from tidemark.llm import passages

LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def good(text):
    """The base and the five rules, one by one."""
    text = text or ""
    w, lines = text.encode().split(), text.split("\n")
    wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {p for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    own = [x for x in lines if x.encode().split()]
    dups, chars = len(own) - len(set(own)), sum(len(x.decode()) for x in w)
    letters = [c for c in text if c.isascii() and c.isalpha()]
    return not (
        len(w) < 50
        or 100 * len(again) > 50 * len(w)
        or 10 * sum(c in "#*$%&|<>" for c in text) > len(w)
        or not 2 * len(w) <= chars <= 15 * len(w)
        or (dups > 2 and 10 * dups > 3 * len(lines))
        or 2 * sum(c.isupper() for c in letters) > len(letters)
        or 5 * text.count("!") > len(w)
    )


def without_lines(rows):
    gone = {i: {int(k) for k in v.split(",")} for i, v in expected(rows, 1).items()}
    cut = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) if t else t) for i, t in rows]
    return [(i, t) for i, t in cut if (t or "").encode().split()]


def one_of_each(rows):
    return [r for r, (i, c, _) in zip(rows, near(rows)) if i == c]


def kept_words(rows):
    units, gone = brute(rows, 20, True)
    return [(rows[k][0], b" ".join(w for w, x in zip(u, g) if not x)) for k, (u, g) in enumerate(zip(units, gone))]


def hard():
    shared = words(71, 45)
    return [*texts(), (30, words(31, 90) + "\nShare this page\n" + shared), (31, words(32, 90) + "\nShare this page\n" + shared + " " + words(33, 9)), (32, words(34, 3000) + "\n" + words(35, 70)), (34, words(38, 200)), (35, words(38, 200).replace(" ", "\n", 60)), (33, "\n".join([words(36, 70), "", words(36, 70), words(37, 60)]))]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = documents(spark, hard())
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: corpus_pipeline.staged(stages[name](spark, df, str(tmp_path)), "test")
    key = lambda rows: sorted(map(str, rows))

    one = step("quality rules", docs)
    assert one.columns == docs.columns and key(rows_of(one)) == key([r for r in hard() if good(r[1])])
    two = step("line dedup", one)
    assert two.columns == docs.columns and key(rows_of(two)) == key(without_lines(rows_of(one)))
    three = step("n-gram Jaccard join", two)
    assert three.columns == docs.columns and key(rows_of(three)) == key(one_of_each(rows_of(two)))
    four = step("substring dedup", three)
    assert four.columns == docs.columns
    assert key((i, b" ".join((t or "").encode().split())) for i, t in rows_of(four)) == key(kept_words(rows_of(three)))
    five = step("best-fit packing", four).collect()
    size, places = Counter(), defaultdict(int)
    for r in five:
        size[r.doc_id] += r.length
        places[r.sequence_id] += r.length
    want = Counter()
    for i, t in rows_of(four):
        want[i] += len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1
    assert size == want and max(places.values()) <= 2048
    assert 3 <= len(rows_of(three)) < len(rows_of(two)) < len(hard())


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name


def test_one_id_on_different_texts(spark):
    """Rows are judged one by one: the copy of an earlier text goes, another text of that id stays."""
    a, b = words(81, 80), words(82, 80)
    near_b = b.split(" ")
    near_b[0] = "changed"
    rows = [(5, b), (20, a), (20, b), (None, a), (30, words(83, 60)), (30, words(83, 60)), (40, None), (40, ""), (None, words(84, 50)), (50, " ".join(near_b))]
    got = rows_of(corpus_pipeline.near_duplicates(spark, documents(spark, rows), ""))
    assert sorted(got, key=str) == sorted([(5, b), (20, a), (30, words(83, 60)), (30, words(83, 60)), (40, None), (40, ""), (None, words(84, 50))], key=str)


def test_cut_leaves_wide_white_space():
    """Only ASCII white space parts words; other kinds are characters of words."""
    for end in ("\u3000", "c\u00a0", "c\x1c", "c\u2029"):
        assert passages.cut(f"a b {end}", [{"start": 0, "end": 1}]) == f"b {end}"
    assert passages.cut("a b c \n", [{"start": 0, "end": 1}]) == "b c"
