"""Best-fit packing of token sequences: pattern packing by non-negative least squares (operator 3)."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.encoders import SLICE, Spaced, encoder
from tidemark.session import ship, staged

#: Pieces shorter than capacity / SPARE stay out of patterns: they fill the gaps of the residue.
SPARE = 32
#: The fit has converged when no pattern's count can move by this much; counts are rounded to whole ones.
LEAST = 0.1
#: Power of a length by which the fit weighs what it misses there.
WEIGHT = 0.5
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document's ids, with its number among the pieces of that length in its task.

    A document longer than `capacity` is cut into full pieces; the first piece takes the remainder. A null text is empty: its one piece is the end id.
    """

    def encode(batches):
        enc, seen, task = encoder(Spaced, vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                ids, bounds = enc.ids(part.column(text_col), end_id)
                raw, out = memoryview(ids.tobytes()), [[] for _ in range(7)]
                for doc, at, n in zip(part.column(id_col).to_pylist(), bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True):
                    cut = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                        for col, v in zip(out, (doc, k, a, b - a, zlib.crc32(raw[4 * (at + a) : 4 * (at + b)]), task, int(seen[b - a])), strict=True):
                            col.append(v)
                        seen[b - a] += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(encode, PIECES)


def patterns(left: np.ndarray, capacity: int) -> np.ndarray:
    """Multisets of lengths still left that fill the capacity exactly, four columns padded with 0: all of two and three, and of four those made of the most frequent pair of each sum. Their number is bounded by the capacity, not by the data."""
    lengths = np.flatnonzero(left)
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    inside = (a <= b) & (a + b < capacity)
    a, b = a[inside], b[inside]
    small = lengths[lengths <= capacity // 2]
    two = np.stack([small, capacity - small], 1)[left[capacity - small] > 0]
    c = capacity - a - b
    three = np.stack([a, b, c], 1)[(c >= b) & (left[c] > 0)]
    worth = np.where(a == b, left[a] // 2, np.minimum(left[a], left[b]))
    order = np.lexsort((-worth, a + b))
    sums, first = np.unique((a + b)[order], return_index=True)
    best = np.zeros((capacity + 1, 2), np.int64)
    best[sums] = np.stack([a, b], 1)[order][first]
    low = np.arange(1, capacity // 2 + 1)
    low = low[(best[low, 0] > 0) & (best[capacity - low, 0] > 0)]
    rows = [two, three, np.concatenate([best[low], best[capacity - low]], 1)]
    return np.concatenate([np.pad(r.astype(np.int64), ((0, 0), (0, 4 - r.shape[1]))) for r in rows])


def fitted(rows: np.ndarray, counts: np.ndarray, least: float = LEAST, at_once: int = 8192) -> np.ndarray:
    """Non-negative repeat counts x that lower ||W (A x - counts)||², a column of A for each pattern, from 0 until no single x can move by `least`.

    W weighs a length's miss by the length to the power WEIGHT: long pieces are fitted first, and what the fit leaves is short and easily placed.

    Steepest coordinate descent: in each round the patterns whose own best step lowers the sum most move by just that step, as many at once as share no length
    with one that lowers it more (so each is still at its own minimum). Patterns that are not needed stay at 0, so few are not 0.
    """
    gap, x = counts.astype(float), np.zeros(len(rows))
    gap[0] = 0.0  # the padding
    weight = np.arange(len(gap), dtype=float) ** (2 * WEIGHT) / float(len(gap) - 1) ** (2 * WEIGHT)
    weight[0] = 0.0
    size = (((rows[:, :, None] == rows[:, None, :]) & (rows[:, :, None] > 0)).sum(2) * weight[rows]).sum(1)
    while len(rows):
        step = np.maximum(-x, (gap * weight)[rows].sum(1) / size)
        gain = np.where(np.abs(step) >= least, step * step * size, 0.0)
        moving = np.flatnonzero(gain)
        if not len(moving):
            break
        if len(moving) > at_once:
            moving = moving[np.argpartition(-gain[moving], at_once)[:at_once]]
        moving = moving[np.argsort(-gain[moving], kind="stable")]
        place = np.arange(len(moving))
        first = np.full(len(gap), len(moving))
        np.minimum.at(first, rows[moving], place[:, None])
        own = moving[((first[rows[moving]] == place[:, None]) | (rows[moving] == 0)).all(1)]
        x[own] += step[own]
        np.subtract.at(gap, rows[own], step[own, None])
        gap[0] = 0.0
    return x


def plan(counts: np.ndarray, capacity: int, fit: Callable[[np.ndarray, np.ndarray], np.ndarray] = fitted) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """((lengths, repeats) that use up `counts`, pieces by length, a fixed-size histogram; how many of these come from patterns).

    Patterns are fitted to the histogram and their counts rounded (a pattern of less than a half is not used), the largest first, as far as pieces last. The residue
    goes by best fit, longest first.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rows = patterns(np.where(np.arange(capacity + 1) < capacity // SPARE, 0, left), capacity)
    x = fit(rows, left)
    wanted = np.floor(x + 0.5).astype(np.int64)
    used = np.flatnonzero(wanted)
    held = left.tolist()
    for j in used[np.argsort(-x[used], kind="stable")].tolist():
        row = [v for v in rows[j].tolist() if v]
        k = min([int(wanted[j]), *(held[v] // row.count(v) for v in row)])
        if k > 0:
            out.append((tuple(sorted(row, reverse=True)), k))
            for v in row:
                held[v] -= k
    left = np.array(held, np.int64)
    from_patterns = len(out)
    # Residue: the bins open at each free length, as (contents, number of equal bins).
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        for free in range(size, capacity + 1):
            while n and room[free]:
                held, k = room[free].pop()
                m = min(n, k)
                if k > m:
                    room[free].append([held, k - m])
                room[free - size].append([(*held, size), m])
                n -= m
            if not n:
                break
        if n:
            each = capacity // size
            if n >= each:
                room[capacity - each * size].append([(size,) * each, n // each])
            if n % each:
                room[capacity - n % each * size].append([(size,) * (n % each), 1])
    return out + [(held, k) for bins in room for held, k in bins], from_patterns


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to staged pieces. Only the histogram (a number for each length up to the capacity) reaches the driver."""
    sizes = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").agg(F.count("*")).collect():
        counts[length] = n
    used, first, key, seq, off = np.zeros(capacity + 1, np.int64), 0, [], [], []
    for held, k in plan(counts, capacity)[0]:
        at = 0
        for v in held:
            key.append((v << 44) + used[v])
            seq.append(first)
            off.append(at)
            used[v] += k
            at += v
        first += k
    order = np.argsort(np.array(key, np.int64)) if key else np.zeros(0, int)
    keys, seqs, offs = (np.array(x, np.int64)[order] for x in (key, seq, off))

    def place(batches):
        for b in batches:
            where = (np.asarray(b.column("length")).astype(np.int64) << 44) + np.asarray(b.column("rank"))
            k = np.searchsorted(keys, where, "right") - 1
            yield pa.record_batch([*b.columns[:-1], pa.array(seqs[k] + where - keys[k]), pa.array(offs[k])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    ranked = found.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty tables give an empty result; null texts are empty; repeated rows and null ids are packed each for itself; other columns, whatever their names, are left out.
    A text longer than `capacity` is cut into pieces.
    """
    ship(spark)
    return pack(staged(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
