"""Quality rules (operator 6): base measures of every document, then a short-circuit cascade whose order comes from cost and selectivity on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import RangeHash, buffers, mixed, slices, word_bounds
from tidemark.session import ship

MEASURES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _ALPHA = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _ALPHA[65:91] = _ALPHA[97:123] = True
_BANG = np.zeros(256, bool)
_BANG[33] = True


class Texts:
    """The texts of a slice and the measures that rules share, each made when first asked for."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = buffers(column)
        self.starts, self.ends, self.words = word_bounds(self.data, self.offsets)
        self.n_words = np.diff(self.words)

    def count(self, marked: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marked)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def word_chars(self) -> np.ndarray:
        space = np.isin(self.data, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
        return self.count(((self.data & 0xC0) != 0x80) & ~space)

    def dup_lines(self) -> np.ndarray:
        raw, out = self.data.tobytes(), np.zeros(len(self.n_words), np.int64)
        for k, (a, b) in enumerate(zip(self.offsets.tolist(), self.offsets[1:].tolist(), strict=False)):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            out[k] = len(lines) - len(set(lines))
        return out

    def repeat_words(self, width: int = 3) -> np.ndarray:
        """Words within windows of `width` words that occur twice or more in their text."""
        n, doc = len(self.starts), np.repeat(np.arange(len(self.n_words)), self.n_words)
        if n < width:
            return np.zeros(len(self.n_words), np.int64)
        h = RangeHash(self.data).of(self.starts, self.ends)
        key = mixed(doc.astype(np.uint64) + np.uint64(1))[: n - width + 1]
        for k in range(width):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k])
        inside = doc[: n - width + 1] == doc[width - 1 :]
        where = np.flatnonzero(inside)
        order = where[np.argsort(key[where])]
        same = key[order][1:] == key[order][:-1]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + width, -1)
        covered = np.cumsum(edge[:-1]) > 0
        return np.bincount(doc[covered], minlength=len(self.n_words))


Rule = Callable[[Texts], np.ndarray]
#: Name -> which documents fail. Integer arithmetic, so that SQL gives the same verdict.
RULES: dict[str, Rule] = {
    "symbols": lambda t: 10 * t.count(SYMBOLS[t.data]) > t.n_words,
    "word_length": lambda t: ((c := t.word_chars()) < 2 * t.n_words) | (c > 15 * t.n_words),
    "dup_lines": lambda t: ((n := t.dup_lines()) > 2) & (10 * n > 3 * (t.count(t.data == 10) + 1)),
    "upper_case": lambda t: 2 * t.count(_UPPER[t.data]) > t.count(_ALPHA[t.data]),
    "exclamations": lambda t: 5 * t.count(_BANG[t.data]) > t.n_words,
}


def subset(column: pa.Array, alive: np.ndarray) -> pa.Array:
    return column if alive.all() else column.filter(pa.array(alive))


def cascade(column: pa.Array, alive: np.ndarray, order: list[str]) -> np.ndarray:
    """Which of the alive documents pass every rule; a later rule sees only what the earlier ones left."""
    alive = alive.copy()
    for name in order:
        at = np.flatnonzero(alive)
        if not len(at):
            break
        alive[at[RULES[name](Texts(subset(column, alive)))]] = False
    return alive


def rule_order(docs: DataFrame, sample: int = 2000, text_col: str = "text") -> list[str]:
    """Rules by documents rejected per second, measured on at most `sample` documents in one task. The order changes the time, never the verdict."""

    def measure(batches):
        for b in batches:
            for some in slices(b, text_col):
                texts = some.column(text_col)
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    failed = int(rule(Texts(texts)).sum())
                    yield pa.record_batch([pa.array([name]), pa.array([time.perf_counter() - began]), pa.array([failed], pa.int64())], names=["rule", "seconds", "failed"])

    rows = docs.select(text_col).limit(sample).mapInArrow(measure, "rule string, seconds double, failed bigint").groupBy("rule").agg((F.sum("failed") / F.greatest(F.sum("seconds"), F.lit(1e-9))).alias("worth")).collect()
    worth = {r.rule: r.worth for r in rows}
    return sorted(RULES, key=lambda k: (-worth.get(k, 0.0), k))


def measured(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every document, whole texts.

    Null and empty texts have no words and fail; repeated rows stay; an empty table gives no row; a very long text is a slice of its own; other columns, whatever
    their names, are left out.
    """
    ship(spark)
    order = rule_order(docs, text_col=text_col)

    def run(batches):
        for b in batches:
            for some in slices(b, text_col):
                column = some.column(text_col)
                t = Texts(column)
                chars, symbols, dups, repeats = t.word_chars(), t.count(SYMBOLS[t.data]), t.dup_lines(), t.repeat_words()
                failed = (t.n_words < 50) | (100 * repeats > 50 * t.n_words)
                kept = cascade(column, ~failed, order)
                yield pa.record_batch([some.column(id_col).cast(pa.int64()), *(pa.array(np.asarray(x, np.int64)) for x in (t.n_words, chars, symbols, dups, repeats)), pa.array(failed), pa.array(kept)], names=[x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, MEASURES)


def filtered(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass the base and all rules, with all their columns, whatever their names, in one pass over the texts. Null, empty and repeated rows: as in measured."""
    ship(spark)
    order = rule_order(docs, text_col=text_col)

    def run(batches):
        for b in batches:
            for some in slices(b, text_col):
                column = some.column(text_col)
                t = Texts(column)
                alive = t.n_words >= 50
                at = np.flatnonzero(alive)
                if len(at):
                    left = Texts(subset(column, alive))
                    alive[at[100 * left.repeat_words() > 50 * left.n_words]] = False
                yield some.filter(pa.array(cascade(column, alive, order)))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), numbered AS (SELECT row_number() OVER () AS r, * FROM base),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM numbered),
dups AS (SELECT r, count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines FROM lines GROUP BY r),
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM numbered)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM wins) WHERE n > 1),
reps AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS alpha, length(regexp_replace(text, '[^!]', '', 'g')) AS bang, length(regexp_replace(text, '[^\n]', '', 'g')) AS nl
  FROM numbered JOIN dups USING (r) LEFT JOIN reps USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
    AND NOT (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * (nl + 1)) AND NOT (2 * up > alpha) AND NOT (5 * bang > n_words) AS kept
FROM b
"""
