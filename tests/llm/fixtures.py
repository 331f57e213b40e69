"""Small documents with every hard case: nulls, empty and very long texts, ties, repeated rows, odd characters, names that clash."""

import random

SCHEMA = "doc_id bigint, text string, h bigint, rid string, spans string, word string, _rid int, words string"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(2 + r.randrange(vocabulary) % 7)) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    passage = words(1, 60)
    page = words(2, 300)
    near = page.split(" ")
    near[100] = "changed"
    lines = "\n".join(words(50 + i, 12) for i in range(6))
    return [
        (1, page),
        (2, page),
        (3, " ".join(near)),
        (4, words(3, 40) + " " + passage + " " + words(4, 40)),
        (5, passage + "\n\t " + words(5, 90)),
        (6, words(6, 70) + "  " + passage),
        (7, None),
        (8, ""),
        (9, " \n\t "),
        (10, "one"),
        (11, "the the the " * 200),
        (12, "aaaa" * 400),
        (13, "ÀÉ x  y\n\n 12 ½ ٣ it's I'll 'S 🙂👍🏽 a🙂 中文 \x1c   z　end <|endoftext|>  "),
        (14, lines),
        (15, lines + "\n" + words(99, 12)),
        (16, words(7, 6000)),
        (17, words(7, 6000)[:9000]),
        (10, "one"),
        (18, "### $$$ %%% word | " * 40),
        (19, "LOUD WORDS HERE!! " * 60),
        (None, words(8, 60)),
        (20, words(9, 80)),
        (20, words(9, 80)),
    ]


def documents(spark, some=None):
    rows = texts() if some is None else some
    return spark.createDataFrame([(i, t, 7, "r", "s", "w", 3, "x") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
