"""Repeated substrings across documents: what operators 2 (words) and 9 (bytes) share.

Every window of `length` units picks its smallest hashed gram of `gram` units (the leftmost of equals). Equal windows pick equal grams at the
same place, so windows can only repeat where their gram, the anchor, does. An anchor occurrence answers for a run of consecutive windows; the text
under that run is its context. Contexts that are equal settle all their windows at once; only anchors with several different contexts need a closer
look, at one copy of each context. All groups are counted before anything is gathered: an anchor with more than `many` contexts (12 MB of text at 20,000) is
resolved window by window through aggregations that pre-combine, the others inside tasks over runs of rows sorted by anchor.
The windows under one anchor lie within `length` of each other, so its first and last repeated window give all bytes (words) they cover.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RangeHash, buffers, mixed, signed, slices, word_bounds
from tidemark.session import discard, ship, staged

ANCHORS = "h bigint, c bigint, rid bigint, doc_id bigint, pos int, back int, front int"
CONTEXTS = "h bigint, c bigint, doc_id bigint, pos int, back int, front int, context binary"
FOUND = "h bigint, c bigint, low int, high int"


@dataclass(frozen=True)
class Unit:
    length: int
    gram: int
    words: bool

    def texts(self, column: pa.Array) -> pa.Array:
        """Texts as bytes; for words, the words joined by single spaces."""
        if not self.words:
            return column
        return pa.array([b" ".join(x.encode().split()) if x else b"" for x in column.to_pylist()], pa.large_binary())

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.words:
            return word_bounds(data, offsets)
        at = np.arange(len(data) + 1, dtype=np.int64)
        return at[:-1], at[1:], offsets


def anchors_of(unit: Unit, column: pa.Array) -> tuple[np.ndarray, ...]:
    """For each anchor: text, hash, hash of its context, place of the gram in the text, and how far before it the first and the last of its windows start."""
    data, offsets = buffers(unit.texts(column))
    starts, ends, bound = unit.bounds(data, offsets)
    length, gram = unit.length, unit.gram
    n = len(starts) - length + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    one, two = RangeHash(data, 0), RangeHash(data, 1)
    grams = one.of(starts[: len(starts) - gram + 1], ends[gram - 1 :])
    low = np.uint64((1 << 28) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    text = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    at = np.flatnonzero(text[:n] == text[length - 1 :])
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    pick = (least[at] & low).astype(np.int64)
    new = np.concatenate([[True], (np.diff(pick) != 0) | (np.diff(at) != 1)])
    first = np.flatnonzero(new)
    lo, hi, p = at[first], at[np.concatenate([first[1:], [len(at)]]) - 1], pick[first]
    c = mixed(two.of(starts[lo], ends[hi + length - 1]) + ((p - lo) * 65536 + (p - hi)).astype(np.uint64))
    t = text[lo]
    return t, signed(grams[p]), signed(c), p - bound[t], p - lo, p - hi


def occurrences(docs: DataFrame, unit: Unit) -> DataFrame:
    """Anchors of all texts. docs: rid, doc_id, text."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                t, h, c, pos, back, front = anchors_of(unit, some.column("text"))
                take = pa.array(t)
                ints = [pa.array(x.astype(np.int32)) for x in (pos, back, front)]
                yield pa.record_batch([pa.array(h), pa.array(c), some.column("rid").take(take), some.column("doc_id").take(take), *ints], names=[x.split()[0] for x in ANCHORS.split(", ")])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, ANCHORS)


def contexts(docs: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The text under each wanted anchor occurrence. wanted: rid, doc_id, picks (array of h, c, pos, back, front)."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                texts = unit.texts(some.column("text"))
                out: list[list] = [[] for _ in range(7)]
                for doc, text, picks in zip(some.column("doc_id").to_pylist(), texts.to_pylist(), some.column("picks").to_pylist(), strict=True):
                    raw = text if isinstance(text, bytes) else (text or "").encode()
                    units = raw.split(b" ") if unit.words else raw
                    for x in picks:
                        part = units[x["pos"] - x["back"] : x["pos"] - x["front"] + unit.length]
                        for col, v in zip(out, (x["h"], x["c"], doc, x["pos"], x["back"], x["front"], b" ".join(part) if unit.words else part), strict=True):
                            col.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in CONTEXTS.split(", ")])

    return of_rows(docs.select("rid", "doc_id", "text"), wanted, "inner").mapInArrow(run, CONTEXTS)


def runs(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.Table]:
    """Whole groups of equal h from rows sorted by h, many groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            part = batch.slice(k, most)
            h = np.asarray(part.column("h"))
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield pa.Table.from_batches([*held, part.slice(0, last)])
                held = [part.slice(last)]
            elif held and held[-1].column("h")[-1].as_py() != int(h[0]):
                yield pa.Table.from_batches(held)
                held = [part]
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def resolved(docs: DataFrame, unit: Unit, close: Callable, ordered: bool, many: int = 20_000) -> DataFrame:
    """rid, doc_id and spans (array of start, end in units) of all covered units.

    close(table) gives low and high for the rows of whole anchor groups: the first and last of the windows that count, as places against the anchor, or null.
    ordered: a window counts where an equal one starts earlier (else: where an equal one starts anywhere else).
    """
    ship(docs.sparkSession)
    found = occurrences(docs, unit)
    stats = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1").select("h", (F.col("c0") != F.col("c1")).alias("several"))
    stats = staged(stats, "stats")  # a table of its own, so that AQE may split a frequent anchor in the join
    shared = staged(found.join(stats, "h"), "anchors")
    by_context = shared.groupBy("h", "c", "several").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "rid", "back", "front")).alias("first"))
    several = by_context.where("several")
    size = several.groupBy("h").agg(F.count("*").alias("m"))
    picks = several.select("h", "c", "first.*").groupBy("rid", "doc_id").agg(F.collect_list(F.struct("h", "c", "pos", "back", "front")).alias("picks"))
    texts = staged(contexts(docs, picks, unit).join(size, "h"), "contexts")
    few, rest = texts.where(F.col("m") <= many).drop("m"), texts.where(F.col("m") > many).drop("m")

    def look(batches):
        for table in runs(batches):
            low, high = close(table)
            keep = pa.array(low <= high)
            cols = [table.column("h").combine_chunks(), table.column("c").combine_chunks(), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
            yield pa.record_batch(cols, names=["h", "c", "low", "high"]).filter(keep)

    near = few.repartition("h").sortWithinPartitions("h", "doc_id", "pos", "c").mapInArrow(look, FOUND)
    windows = rest.mapInArrow(_windows(unit), "w1 bigint, w2 bigint, h bigint, c bigint, doc_id bigint, start int, at int")
    if ordered:
        firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("f"))
        later = windows.join(firsts, ["w1", "w2"]).where(F.struct("doc_id", "start") > F.col("f"))
    else:
        twice = windows.groupBy("w1", "w2").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("w1", "w2")
        later = windows.join(twice, ["w1", "w2"])
    far = later.groupBy("h", "c").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    partial = near.unionByName(far).groupBy("h", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    whole = ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))) if ordered else F.col("n") > 1
    known = staged(by_context.select("h", "c", "n", "first").join(partial, ["h", "c"], "left"), "known")
    spans = shared.drop("several").join(known, ["h", "c"]).select("rid", "doc_id", F.when(whole, F.col("pos") - F.col("back")).otherwise(F.col("pos") + F.col("low")).alias("start"), (F.when(whole, F.col("pos") - F.col("front")).otherwise(F.col("pos") + F.col("high")) + unit.length).alias("end"))
    found = staged(spans.where("start IS NOT NULL").groupBy("rid", "doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    discard(stats, shared, texts, known)
    return found


def window_codes(unit: Unit, table: pa.Table) -> tuple[np.ndarray, ...]:
    """For each window of each context: row, first code, second code (128 bits together stand for the window's text), byte place in `data`, place against the anchor; and data."""
    data, offsets = buffers(table.column("context").combine_chunks())
    starts, ends, bound = unit.bounds(data, offsets)
    back, front = (np.asarray(table.column(x)).astype(np.int64) for x in ("back", "front"))
    each = back - front + 1
    row = np.repeat(np.arange(len(each)), each)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    s = bound[:-1][row] + inside
    a, b = starts[s], ends[s + unit.length - 1]
    return row, signed(RangeHash(data, 0).of(a, b)), signed(RangeHash(data, 1).of(a, b)), a, inside - back[row], data


def _windows(unit: Unit) -> Callable:
    def run(batches):
        for batch in batches:
            for some in slices(batch, "context", 1 << 20):
                table = pa.Table.from_batches([some])
                row, w1, w2, _, at, _ = window_codes(unit, table)
                take = pa.array(row)
                start = np.asarray(some.column("pos")).astype(np.int64)[row] + at
                yield pa.record_batch([pa.array(w1), pa.array(w2), some.column("h").take(take), some.column("c").take(take), some.column("doc_id").take(take), pa.array(start.astype(np.int32)), pa.array(at.astype(np.int32))], names=["w1", "w2", "h", "c", "doc_id", "start", "at"])

    return run


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (64 bits over the id and the text), doc_id, text. A row is known by rid and doc_id together, 128 bits; equal rows share them."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def of_rows(rows: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """rows with what `found` (rid, doc_id and others) holds for them; a null id meets a null id."""
    right = found.withColumnsRenamed({"rid": "_found_rid", "doc_id": "_found_id"})
    return rows.join(right, (F.col("rid") == F.col("_found_rid")) & F.col("doc_id").eqNullSafe(F.col("_found_id")), how).drop("_found_rid", "_found_id")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping or touching spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
