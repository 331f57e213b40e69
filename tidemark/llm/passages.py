"""Substring dedup (operator 2): suffix automata of reference shards, documents streamed through them for matching statistics.

The reference is the corpus itself, each word window against all earlier ones, so no set of automata that covers it has a bounded size to broadcast.
Shards are therefore the anchors of repeats: every window can only repeat inside its anchor's shard. In a shard the contexts come in
document order; each is streamed through the automaton of the ones before it (the longest suffix of the words so far that the automaton knows,
at each word), windows with a match of `length` words or more go, then the context is added to the automaton.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slices, word_bounds
from tidemark.llm.repeats import Unit, keyed, merged, of_rows, resolved


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list) -> None:
        nxt, link, size, last = self.next, self.link, self.size, 0
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                last = q if size[q] == size[last] + 1 else self._clone(last, w, q)
                continue
            new = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list) -> list[int]:
        """Matching statistics: at each word, the length of the longest suffix of the words so far that occurs in the automaton's sequences."""
        nxt, link, size, state, n, out = self.next, self.link, self.size, 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = size[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            out.append(n)
        return out


def close(unit: Unit):
    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(table.num_rows, 1 << 30), np.full(table.num_rows, -(1 << 30))
        shard, known, seen, k = None, None, set(), -1
        for h, c, back, text in zip(table.column("h").to_pylist(), table.column("c").to_pylist(), table.column("back").to_pylist(), table.column("context").to_pylist(), strict=True):
            k += 1
            if h != shard:
                shard, known, seen = h, Automaton(), set()
            if c in seen:  # a repeated document
                continue
            seen.add(c)
            words = text.split(b" ")
            ends = [i for i, n in enumerate(known.matches(words)) if n >= unit.length]
            if ends:
                low[k], high[k] = ends[0] - unit.length + 1 - back, ends[-1] - unit.length + 1 - back
            known.add(words)
        return low, high

    return run


def repeated_spans(docs: DataFrame, length: int = 20, many: int = 20_000) -> DataFrame:
    """rid, doc_id and spans (words) of docs (rid, doc_id, text) under windows that also start earlier."""
    unit = Unit(length, max(1, length * 3 // 10), True)
    return resolved(docs, unit, close(unit), ordered=True, many=many)


def removed(docs: DataFrame, length: int = 20, many: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) of every document.

    Null and empty texts have no words; of equal rows (same id, same text) none is earlier; an empty table gives no row; other columns are left out.
    """
    own = keyed(docs, id_col, text_col)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                out: list[list] = [[] for _ in range(4)]
                for doc, text, spans in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), some.column("spans").to_pylist(), strict=True):
                    words, at, kept = (text or "").encode().split(), 0, []
                    for a, b in merged(spans):
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    for col, v in zip(out, (doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                        col.append(v)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.string(),), strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return of_rows(own, repeated_spans(own, length, many)).select("doc_id", "text", "spans").mapInArrow(run, schema)


def cut(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without the words of the spans; what stands between kept words stays."""
    if not text or not spans:
        return text
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = word_bounds(data, np.array([0, len(raw)]))
    edge, at, out = [*starts.tolist(), len(raw)], 0, []
    for a, b in merged(spans):
        out.append(raw[at : edge[a]])
        at = edge[b]
    out.append(raw[at:])
    return b"".join(out).rstrip(b" \t\n\r\x0b\x0c").decode()  # other white space is part of words


def cleaned(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, repeated words taken out of the text."""
    from pyspark.sql import functions as F

    own = keyed(docs, id_col, text_col)
    named = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    found = repeated_spans(own, length).withColumnRenamed("spans", "_spans")
    names, k = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            rows = b.column("_row")
            cols = [rows.field(i) for i in range(len(names))]
            cols[k] = pa.array([cut(t, s) for t, s in zip(cols[k].to_pylist(), b.column("_spans").to_pylist(), strict=True)], cols[k].type)
            yield pa.record_batch(cols, names=names)

    return of_rows(named, found).select("_row", "_spans").mapInArrow(run, docs.schema)
