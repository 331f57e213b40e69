"""Byte-level repeats (operator 9): the common-prefix interval tree of an enhanced suffix array.

Suffixes are those that start under an anchor shared by different contexts (see repeats). Inside a task, those with `length` bytes in common fall together by
128-bit codes: the roots of the tree. A root whose suffixes all have the same byte before them lies inside a longer repeat and is left; below the others
the suffixes are sorted, the common prefixes of neighbours are measured, and a scan with a stack closes the intervals. Each interval with different bytes
before it is a maximal repeat group: it is reported with all its occurrences, not just neighbours, and each covers the common prefix from its start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import buffers, slices
from tidemark.llm.repeats import Unit, keyed, merged, of_rows, resolved, window_codes


def roots(unit: Unit, table: pa.Table) -> tuple[np.ndarray, ...]:
    """Suffixes that share their first `length` bytes with another, where the bytes before them differ: root, row, place against the anchor, first byte in data, byte before; and data.

    A byte that the context does not show counts as one of its own (below 0).
    """
    row, w1, w2, at, place, data = window_codes(unit, table)
    h, c = np.asarray(table.column("h")), np.asarray(table.column("c"))
    again = np.zeros(len(h), bool)  # rows that repeat a context: repeated documents
    order = np.lexsort((c, h))
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
    use = np.flatnonzero(~again[row])
    suffixes = use[np.lexsort((w2[use], w1[use], h[row[use]]))]
    if not len(suffixes):
        return *(np.zeros(0, np.int64) for _ in range(5)), data
    new = np.ones(len(suffixes), bool)
    new[1:] = False
    for key in (h[row[suffixes]], w1[suffixes], w2[suffixes]):
        new[1:] |= key[1:] != key[:-1]
    root = np.cumsum(new) - 1
    before = np.where(place[suffixes] == -np.asarray(table.column("back"))[row[suffixes]], -1 - np.arange(len(suffixes)), data[np.maximum(at[suffixes], 1) - 1].astype(np.int64))
    first = np.flatnonzero(new)
    diverse = (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first))[root]
    kept = suffixes[diverse]
    return root[diverse], row[kept], place[kept], at[kept], before[diverse], data


def common_bytes(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    return most - -(-(int.from_bytes(a[:most], "big") ^ int.from_bytes(b[:most], "big")).bit_length() // 8)


MIXED = -(1 << 62)


def intervals(root: np.ndarray, tails: list[bytes], before: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order of the suffixes by root and tail, the groups): a group is (first, last, bytes that the tails share) over that order, with different bytes before its suffixes."""
    order = sorted(range(len(tails)), key=lambda i: (root[i], tails[i]))
    found: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # open intervals: bytes shared, first suffix, byte before all of them or MIXED
    for k, i in enumerate(order):
        after = order[k + 1] if k + 1 < len(order) else None
        shared = -1 if after is None or root[after] != root[i] else common_bytes(tails[i], tails[after])
        first, left = k, int(before[i])
        while stack and stack[-1][0] > shared:
            deep, first, own = stack.pop()
            left = own if own == left else MIXED
            if left == MIXED:
                found.append((first, k, deep))
        if stack and stack[-1][0] == shared:
            stack[-1][2] = left if left == stack[-1][2] else MIXED
        elif shared >= 0:
            stack.append([shared, first, left])
    return np.array(order, np.int64), found


def groups(unit: Unit, table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Row and place of each suffix of the suffix array, and the maximal repeat groups over it: (first, last, bytes in common)."""
    root, row, place, at, before, data = roots(unit, table)
    _, offsets = buffers(table.column("context").combine_chunks())
    raw = data.tobytes()
    tails = [raw[a:b] for a, b in zip((at + unit.length).tolist(), offsets[row + 1].tolist(), strict=True)]
    order, found = intervals(root, tails, before)
    return row[order], place[order], [(a, b, unit.length + n) for a, b, n in found]


def close(unit: Unit):
    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        row, place, found = groups(unit, table)
        size = np.zeros(len(row), np.int64)
        for first, last, n in sorted(found, key=lambda x: x[2]):  # a suffix counts with its longest group
            size[first : last + 1] = n
        held = np.flatnonzero(size)
        low, high = np.full(table.num_rows, 1 << 30), np.full(table.num_rows, -(1 << 30))
        np.minimum.at(low, row[held], place[held])
        np.maximum.at(high, row[held], place[held] + size[held] - unit.length)
        return low, high

    return run


def repeat_groups(table: pa.Table, length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The maximal repeat groups among contexts, each with the bytes in common and (row, place against the anchor) of every occurrence."""
    row, place, found = groups(Unit(length, length // 2, False), table)
    return [(n, sorted(zip(row[a : b + 1].tolist(), place[a : b + 1].tolist(), strict=True))) for a, b, n in found]


def repeated_spans(docs: DataFrame, length: int = 400, many: int = 20_000) -> DataFrame:
    """rid, doc_id and spans (bytes) of docs (rid, doc_id, text)."""
    unit = Unit(length, max(1, length // 2), False)
    return resolved(docs, unit, close(unit), ordered=False, many=many)


def removed(docs: DataFrame, length: int = 400, many: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document once each byte under a repeated string of `length` bytes is gone.

    Null and empty texts have 0 bytes and the digest of nothing; equal rows repeat each other; an empty table gives no row; other columns are left out.
    """
    own = keyed(docs, id_col, text_col)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                out: list[list] = [[] for _ in range(5)]
                for doc, text, spans in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), some.column("spans").to_pylist(), strict=True):
                    raw, at, kept, cut = (text or "").encode(), 0, [], merged(spans)
                    for a, b in cut:
                        kept.append(raw[at:a])
                        at = b
                    kept.append(raw[at:])
                    for col, v in zip(out, (doc, len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                        col.append(v)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return of_rows(own, repeated_spans(own, length, many)).select("doc_id", "text", "spans").mapInArrow(run, schema)



