"""Phrase collocations by level-wise candidates and double-array tries (operator 13).

Candidates come first: a scan counts words and runs of words by hashed buckets, whose counts are upper bounds, and a second one lists the runs of which every part may
reach the least count, each place by its longest one. Runs are dealt to tries by their first two words, each of a bounded size and built where its runs are; a task advances the states of
all its runs together, one digit of a word number at a time, and sums how often each state at a word's end is reached. The texts are scanned three times, whatever the number of tries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RangeHash, buffers, mixed, slices
from tidemark.session import discard, ship, staged

#: Runs of one trie, about: what a task holds.
TRIE = 1 << 18
#: Bits of the number of hash buckets: at least, and at most (a bitmap of 128 MB). Between them there are about as many buckets as words.
BUCKETS = (16, 30)
#: Buckets that are summed together; bits of one digit of a word number.
CHUNK, DIGIT = 1 << 16, 10
#: Keys that a task holds before it sums them.
HELD = 1 << 22
#: Bytes of text that are taken together.
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 0x20]] = True


class Words:
    """The words of some texts: their lower-case bytes end to end, the bounds of each, and how many words follow it in its piece."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        solid = ~_GAP[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        begins = solid & (first[:-1] | np.concatenate([[True], ~solid[:-1]])[: len(data)])
        starts = np.flatnonzero(begins)
        self.data = _LOWER[data[solid]]
        place = np.cumsum(solid) - solid  # of a byte among the solid ones
        self.edge = np.append(place[starts], len(self.data)).astype(np.int64)
        cuts = np.cumsum(_BREAK[data] | first[:-1])[starts] if len(data) else starts
        last = np.flatnonzero(np.append(np.diff(cuts) > 0, True)) if len(starts) else starts
        self.left = last[np.searchsorted(last, np.arange(len(starts)))] - np.arange(len(starts)) if len(starts) else starts

    def __len__(self) -> int:
        return len(self.left)

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and the number of each position's word among them."""
        made = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.edge), pa.py_buffer(np.ascontiguousarray(self.data))]).dictionary_encode()
        return made.dictionary.to_pylist(), np.asarray(made.indices)

    def different(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One position for each different run of k words among the given ones, and how many there are of it."""
        if not hasattr(self, "_numbers"):
            self._numbers = self.distinct()[1].astype(np.int64)
        rows = np.stack([self._numbers[at + j] for j in range(k)])
        size = int(self._numbers.max(initial=0)) + 1
        if size**k < 1 << 63:
            code = rows[0]
            for r in rows[1:]:
                code = code * size + r
            _, one, n = np.unique(code, return_index=True, return_counts=True)
        else:
            _, one, n = np.unique(rows, axis=1, return_index=True, return_counts=True)
        return at[one], n

    def buckets(self, k: int, bits: int, lang: str) -> np.ndarray:
        """The bucket of the run of k words at each position; -1 where its piece ends before."""
        out = np.full(len(self), -1, np.int64)
        at = np.flatnonzero(self.left >= k - 1)
        if len(at):
            seed = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8), "little")) * np.uint64(2 * k + 1)
            own = np.zeros(len(at), np.uint64)
            hashes = self.hashes()
            for j in range(k):
                own = mixed(own + hashes[at + j] + seed)
            out[at] = (own >> np.uint64(64 - bits)).astype(np.int64)
        return out

    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = RangeHash(self.data).of(self.edge[:-1], self.edge[1:])
        return self._hashes

    def runs(self, at: np.ndarray, k: int) -> pa.Array:
        """The text of runs of k words, joined by a space."""
        word = (at[:, None] + np.arange(k)).ravel()
        size = self.edge[word + 1] - self.edge[word]
        gap = np.tile(np.append(np.ones(k - 1, np.int64), 0), len(at))
        ends = np.cumsum(size + gap)
        flat = np.arange(size.sum())
        before = np.cumsum(size) - size
        out = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
        out[flat + np.repeat(ends - size - gap - before, size)] = self.data[flat + np.repeat(self.edge[word] - before, size)]
        edge = np.append(0, ends[k - 1 :: k]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edge), pa.py_buffer(out)]).cast(pa.binary())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    """The words of a batch, language by language, a slice of texts at a time."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        for part in slices(batch.filter(pc.equal(langs, lang)), "text", SLICE):
            yield lang, Words(part.column("text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n: words of a slice."""
    for batch in batches:
        for lang, words in _texts(batch):
            names, at = words.distinct()
            yield pa.record_batch([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()), pa.array(np.bincount(at, minlength=len(names)).astype(np.int64))], names=["lang", "word", "n"])


def _bucketed(bits: int, longest: int, least: int):
    """chunk, low, n: the counts of hash buckets of runs of 2 to `longest` words, cut off at `least` (a bucket counts as full from there on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            low, n = (keys % CHUNK).astype("<u2"), np.minimum(n, least).astype("<u4")
            chunks, first = np.unique(keys // CHUNK, return_index=True)
            edge = np.append(first, len(keys))
            pick = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            return pa.record_batch([pa.array(chunks, pa.int64()), pick(low), pick(n)], names=["chunk", "low", "n"])

        for batch in batches:
            for lang, words in _texts(batch):
                for k in range(2, longest + 1):
                    found = words.buckets(k, bits, lang)
                    held.append(found[found >= 0])
                    size += len(held[-1])
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _full(least: int):
    """chunk, full: bitmaps of the buckets that hold `least` or more; a task keeps one array for each of its chunks, however many rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                total = sums.setdefault(r["chunk"], np.zeros(CHUNK, np.uint16))
                low = np.frombuffer(r["low"], "<u2")
                total[low] = np.minimum(total[low] + np.frombuffer(r["n"], "<u4"), least)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()], pa.binary())], names=["chunk", "full"])

    return run


def _listed(bitmap, bits: int, longest: int):
    """lang, phrase, n: the runs whose bucket is full and whose shorter runs are listed too; at each place the longest one, whose beginnings are the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for lang, words in _texts(batch):
                before, size = np.ones(len(words), bool), np.ones(len(words), np.int64)
                for k in range(2, longest + 1):
                    bucket = words.buckets(k, bits, lang)
                    on = (bucket >= 0) & before & np.append(before[1:], False)
                    on[on] = (full[bucket[on] >> 3] >> (bucket[on] & 7)) & 1 == 1
                    before, size[on] = on, k
                for k in range(2, longest + 1):
                    at, n = words.different(np.flatnonzero(size == k), k)
                    yield pa.record_batch([pa.array([lang] * len(at), pa.string()), words.runs(at, k), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])

    return run


class Trie:
    """A double array over the digits of word numbers: the child of state s by digit d is base[s] + d, if check there is s. State 0 is the root."""

    def __init__(self, keys: np.ndarray, width: int):
        """keys: rows of digits, -1 behind the end of the shorter ones; all of different rows. `node` has the state of each row."""
        self.width, digits = width, keys.shape[1]
        order = np.lexsort([keys[:, c] for c in reversed(range(digits))])
        keys = keys[order]
        # Nodes of the tree, level by level: parent (by number), digit.
        parent_of = np.zeros(len(keys), np.int64)
        parents, labels, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(keys), np.int64)
        made = 1
        for c in range(digits):
            live = np.flatnonzero(keys[:, c] >= 0)
            if not len(live):
                break
            p, d = parent_of[live], keys[live, c]
            new = np.append(True, (np.diff(p) != 0) | (np.diff(d) != 0))
            number = np.cumsum(new) - 1 + made
            parents.append(p[new])
            labels.append(d[new])
            parent_of = parent_of.copy()
            parent_of[live] = number
            ends[live] = number
            made += int(new.sum())
        parent, label = np.concatenate(parents), np.concatenate(labels)  # of the nodes 1, 2, ...
        self._place(parent, label, made, width)
        self.node = np.empty(len(keys), np.int64)
        self.node[order] = self.slot[ends]

    def _place(self, parent: np.ndarray, label: np.ndarray, made: int, width: int) -> None:
        """Lays out the nodes: those with many children first, all nodes of one number of children together, each at a random place that is free for all its
        children (of two that want one slot, one tries again); an only child takes any free slot.
        """
        by = np.lexsort([label, parent])
        parent, label, child = parent[by], label[by], by + 1
        owner, first, count = np.unique(parent, return_index=True, return_counts=True)
        draw = np.random.default_rng(made)
        size = 2 * made + 2 * width
        taken, claim = np.zeros(size, bool), np.zeros(size, np.int64)
        taken[0] = True
        base, slot = np.zeros(made, np.int64), np.zeros(made, np.int64)
        for m in np.unique(count)[::-1].tolist():
            left, tries = np.flatnonzero(count == m), 0
            while m > 1 and len(left):
                if tries == 50:  # too full for so many children
                    taken, claim, tries = np.append(taken, np.zeros(size, bool)), np.append(claim, np.zeros(size, np.int64)), 0
                    size *= 2
                at = first[left][:, None] + np.arange(m)
                b = draw.integers(1, size - width, len(left))
                slots = b[:, None] + label[at]
                free = ~taken[slots].any(1)
                claim[slots[free]] = left[free][:, None]
                won = free.copy()
                won[free] = (claim[slots[free]] == left[free][:, None]).all(1)
                base[owner[left[won]]] = b[won]
                slot[child[at[won]]] = slots[won]
                taken[slots[won]] = True
                left, tries = left[~won], tries + 1
        lone = np.flatnonzero(count == 1)
        free = np.flatnonzero(~taken)[: len(lone)]
        slot[child[first[lone]]] = free
        base[owner[lone]] = free - label[first[lone]]
        self.slot = slot
        self.check = np.full(int(slot.max()) + 1 + width, -1, np.int32)
        self.check[slot[child]] = slot[parent]
        self.base = np.full(len(self.check), -width - 1, np.int32)  # a state without children leads nowhere
        self.base[slot[owner]] = base[owner]

    def step(self, state: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """The states one digit on; -1 where there is none."""
        to = self.base[state] + digit
        good = (to >= 0) & (to < len(self.check))
        good[good] = self.check[to[good]] == state[good]
        return np.where(good, to, -1)


def _tried(least: int):
    """(runs of one shard: lang, phrase, n) -> lang, phrase, words, f of the beginnings of two words and more that are found `least` times in all, counted by a trie of the runs."""

    def run(table: pa.Table) -> pa.Table:
        langs = table.column("lang").combine_chunks().dictionary_encode()
        parts = pc.split_pattern(table.column("phrase").combine_chunks(), " ")
        n, size = table.column("n").to_numpy(), np.asarray(pc.list_value_length(parts)).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        words = parts.flatten().dictionary_encode()
        # Words are numbered by language; the digits of a number, the highest first, are the labels of the trie.
        code = np.asarray(langs.indices).astype(np.int64)[row] * len(words.dictionary) + np.asarray(words.indices)
        codes, number = np.unique(code, return_inverse=True)
        digits = max(1, math.ceil(len(codes).bit_length() / DIGIT))
        longest = int(size.max())
        keys = np.full((len(size), digits * longest), -1, np.int64)
        column = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)) * digits
        for d in range(digits):
            keys[row, column + d] = number >> (DIGIT * (digits - 1 - d)) & ((1 << DIGIT) - 1)
        trie = Trie(keys, 1 << DIGIT)
        state, found = np.zeros(len(size), np.int64), []
        place = np.arange(len(size))
        for k in range(1, longest + 1):
            place, state = place[size[place] >= k], state[size[place] >= k]
            for c in range((k - 1) * digits, k * digits):
                state = trie.step(state, keys[place, c])
            if k > 1:
                seen, one, whose = np.unique(state, return_index=True, return_inverse=True)
                total = np.bincount(whose, n[place], len(seen)).astype(np.int64)  # sums below 2**53 are exact
                held = total >= least
                at = pa.array(place[one[held]])
                names = pc.binary_join(pc.list_slice(parts.take(at), 0, k), b" ")
                found.append(pa.table({"lang": table.column("lang").combine_chunks().take(at), "phrase": names.cast(pa.string()), "words": pa.array(np.full(len(at), k, np.int32)), "f": pa.array(total[held])}))
        return pa.concat_tables(found)

    return run


def counted(spark: SparkSession, documents: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", trie: int = TRIE) -> tuple[DataFrame, DataFrame]:
    """lang, phrase (words joined by a space), words, f of every run of 1 to `longest` words found `least` times or more; and lang, n of each language."""
    ship(spark)
    docs = documents.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = staged(docs.mapInArrow(_counts, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least).select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("words"), "f")
    n = words.agg(F.sum("f")).first()[0]
    if not n or longest < 2:
        return frequent, sizes
    bits = min(max(math.ceil(math.log2(n + 1)), BUCKETS[0]), BUCKETS[1])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // (CHUNK * 64))
    sums = docs.mapInArrow(_bucketed(bits, longest, least), "chunk bigint, low binary, n binary").repartition(parts, "chunk")
    bitmap = np.zeros(max(1 << bits, CHUNK) // 8, np.uint8)
    for r in sums.mapInArrow(_full(least), "chunk bigint, full binary").toLocalIterator():  # 2**bits / 8 bytes at most, a chunk at least
        bitmap[r["chunk"] * (CHUNK // 8) : (r["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(r["full"], np.uint8)
    held = spark.sparkContext.broadcast(bitmap.tobytes())
    del bitmap
    listed = staged(docs.mapInArrow(_listed(held, bits, longest), "lang string, phrase binary, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "candidates")
    held.destroy()
    shards = max(1, math.ceil(listed.count() / trie))
    start = F.substring_index(F.col("phrase").cast("string"), " ", 2)  # all runs that begin with some phrase meet in one trie
    dealt = listed.withColumn("shard", F.pmod(F.xxhash64("lang", start), F.lit(shards)).cast("int"))
    phrases = staged(dealt.repartition(min(1000, shards), "shard").groupBy("shard").applyInArrow(_tried(least), "lang string, phrase string, words int, f bigint"), "phrases")
    discard(listed)
    return frequent.unionByName(phrases), sizes


def collocations(spark: SparkSession, documents: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", trie: int = TRIE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `longest` words.

    a, l and r are the counts of the phrase and of the two parts of its lowest-scoring cut, n those of all words; score = floor(1000000 a a / (l r)), exactly (counts
    below 10**15). Phrases within a longer one with `share` percent of their count are left out. Null texts are empty, a null language is `und`, repeated rows
    count each, other columns are left out. Without such phrases there is no row.
    """
    found, sizes = counted(spark, documents, longest, least, lang_col, text_col, trie)
    found = staged(found, "runs")
    many = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", F.col("f").alias("a"), "words", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    f = lambda name, value: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    scored = cuts.join(f("left", "l"), ["lang", "left"]).join(f("right", "r"), ["lang", "right"]).withColumn("aa", whole("a") * whole("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn("lr", whole("l") * whole("r")).withColumn("score", F.expr("aa div lr"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "words")).alias("b")).select("lang", "phrase", "b.*")
    inner = many.where(F.col("words") > 2).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("p", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    above = inner.groupBy("lang", part(F.col("p"), F.col("m")).alias("phrase")).agg(F.max("f").alias("above"))
    kept = best.join(above, ["lang", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < share * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # First within parts of a language, so that no task holds all of its phrases.
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("place", rank("lang", "part")).where(F.col("place") <= top)
    return first.withColumn("rank", rank("lang")).where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT *, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM c CROSS JOIN (SELECT unnest([1, 2]) AS j) WHERE j < words),
s AS (SELECT cut.*, fx.f AS l, fy.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(fx.f AS HUGEINT) * fy.f) AS BIGINT) AS score FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
u AS (SELECT lang, phrase, max(a) AS above FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, score FROM b LEFT JOIN u ON u.lang = b.lang AND u.phrase = b.phrase WHERE above IS NULL OR 100 * above < 50 * a)
SELECT o.lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
