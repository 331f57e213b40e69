"""N-gram Jaccard join (operator 1): a MinHash LSH forest, then exact verification of shingle sets.

Each text has `trees` signatures of `deepest` minimum hashes; a tree is a trie of them, a node the texts that share a prefix. For each text the matched prefix
starts at the deepest level and is shortened until a pair at the least similarity that this text can have with any similar one is found with the target
probability in one tree at least: a text of few shingles has few possible similarities, all well above the threshold, and keeps a longer prefix.
A text enters the nodes at the lengths that it and its possible partners (by size) settle at, so two similar texts meet at the longer one of theirs. Texts
below one node are candidates. Candidate clusters gather each text once; a cluster beyond `block` texts is dealt out in pairs of blocks.
In a task, two texts that share a node are compared by their whole sets of five-word shingles. Tasks return a row for each text
(its links, and the smallest text it is tied to there), never pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import RangeHash, buffers, mixed, signed, slices, word_bounds
from tidemark.llm.components import components
from tidemark.llm.repeats import Unit, keyed, of_rows
from tidemark.session import discard, ship, staged

WORDS = Unit(5, 1, True)


def recall(similarity: float, depth: int, trees: int) -> float:
    """Chance that two texts of this similarity share a prefix of this depth in a tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, trees: int, deepest: int, target: float) -> int:
    """The matched prefix, shortened level by level until the recall at the threshold reaches the target."""
    depth = deepest
    while depth > 1 and recall(similarity, depth, trees) < target:
        depth -= 1
    return depth


def shingles(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text of each shingle in order, its hash, the number of words of each text, and a hash of the words of each text. A text of fewer words is one shingle."""
    data, offsets = buffers(WORDS.texts(column))
    starts, ends, bound = word_bounds(data, offsets)
    each = np.diff(bound)
    hashes = RangeHash(data)
    text = np.repeat(np.arange(len(each)), each)
    n = max(0, len(starts) - words + 1)
    at = np.flatnonzero(text[:n] == text[words - 1 :]) if n else np.zeros(0, np.int64)
    short = np.flatnonzero((each > 0) & (each < words))
    first = np.concatenate([at, bound[:-1][short]])
    last = np.concatenate([at + words - 1, bound[1:][short] - 1])
    who = text[first] if len(first) else np.zeros(0, np.int64)
    h = hashes.of(starts[first], ends[last]) if len(first) else np.zeros(0, np.uint64)
    order = np.argsort(who, kind="stable")
    whole = signed(mixed(hashes.of(offsets[:-1], offsets[1:]) + np.uint64(17)))
    return who[order], h[order], each, whole


def attainable(n: int, similarity: float) -> float:
    """The least Jaccard similarity of `similarity` or more that a set of n can have with another set."""
    least = 1.0
    for m in range(math.ceil(similarity * n - 1e-9), math.floor(n / similarity + 1e-9) + 1):
        both = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
        if both <= min(n, m):
            least = min(least, both / (n + m - both))
    return least


#: Sets of more shingles have similarities so close to the threshold that they settle at its own prefix length.
FEW = 256


@lru_cache
def lengths(similarity: float, trees: int, deepest: int, target: float) -> tuple[tuple[int, ...], np.ndarray]:
    """(prefix lengths in use, which of them a text of n distinct shingles enters: a row for each n up to FEW, the last one for all above)."""
    at = [prefix_depth(attainable(n, similarity), trees, deepest, target) for n in range(1, int(FEW / similarity) + 2)]
    used = range(prefix_depth(similarity, trees, deepest, target), deepest + 1)
    enters = np.zeros((FEW + 1, len(used)), bool)
    for n in range(1, FEW):
        for m in range(math.ceil(similarity * n - 1e-9), math.floor(n / similarity + 1e-9) + 1):
            enters[n, max(at[n - 1], at[m - 1]) - used[0]] = True
    enters[FEW, 0] = True
    return tuple(used), enters


def signatures(who: np.ndarray, h: np.ndarray, trees: int, how: tuple[float, int, float], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have shingles; for each the hash of its prefix in each tree at each length in use; and which of these nodes it enters. how: similarity, deepest, target."""
    similarity, deepest, target = how
    used, enters = lengths(similarity, trees, deepest, target)
    rng = np.random.default_rng(seed)
    first = np.flatnonzero(np.concatenate([[True], np.diff(who) != 0])) if len(who) else np.zeros(0, np.int64)
    keys = np.zeros((len(first), trees, len(used)), np.uint64)
    for t in range(trees if len(first) else 0):
        key = np.full(len(first), t + 1, np.uint64)
        for d, (a, b) in enumerate(rng.integers(1, 2**63, (deepest, 2), np.uint64).tolist(), 1):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * np.uint64(2 * a + 1 & (2**64 - 1)) + np.uint64(b), first))
            if d >= used[0]:
                keys[:, t, d - used[0]] = key
    distinct = np.bincount(np.searchsorted(first, np.flatnonzero(_new(who, h)), "right") - 1, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    return who[first], keys.reshape(len(first), -1), np.repeat(enters[np.minimum(distinct, FEW)][:, None, :], trees, 1).reshape(len(first), -1)


def _new(who: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Marks, in order of text and hash, the first of equal shingles; texts keep their places."""
    order = np.lexsort((h, who))
    a, b = who[order], h[order]
    return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _sign(trees: int, how: tuple[float, int, float]):
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                who, h, each, whole = shingles(some.column("text"))
                texts, keys, enters = signatures(who, h, trees, how)
                take = pa.array(texts)
                nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(enters.sum(1))]), pa.int32()), pa.array(signed(keys[enters])))
                yield pa.record_batch([some.column("rid").take(take), some.column("doc_id").take(take), pa.array(whole[texts]), nodes], names=["rid", "doc_id", "tid", "keys"])

    return run


def _sets(trees: int, how: tuple[float, int, float]):
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                who, h, each, whole = shingles(some.column("text"))
                texts, keys, enters = signatures(who, h, trees, how)
                alone = mixed(signed(whole[texts]).astype(np.uint64)[:, None] + np.arange(keys.shape[1], dtype=np.uint64)[None, :])
                keys = np.where(enters, keys, alone)  # a node that the text does not enter is shared with none
                cut = np.searchsorted(who, [*texts.tolist(), len(each)])
                own = [np.unique(h[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.record_batch([pa.array(whole[texts]), pa.array(own, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())], names=["tid", "shingles", "keys"])

    return run


class Ties:
    """Union-find over the rows of a task's cluster or block pair."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def compared(tid: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], keys: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row (the copies of the texts similar to it) and the smallest tid it is tied to. Rows come in order of tid; side 0/1: only pairs across are compared, side 2: all pairs."""
    n = len(tid)
    links, ties = np.zeros(n, np.int64), Ties(n)
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    for i in range(n - 1):
        ok = (keys[i + 1 :] == keys[i]).any(1) & (size[i + 1 :] >= similarity * size[i]) & (size[i + 1 :] * similarity <= size[i]) & (tid[i + 1 :] != tid[i])
        if side[i] < 2:
            ok &= side[i + 1 :] != side[i]
        if not ok.any():
            continue
        own = flat[edge[i] : edge[i + 1]]
        mark[own] = True
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            both = int(np.count_nonzero(mark[flat[edge[j] : edge[j + 1]]]))
            if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                links[i] += copies[j]
                links[j] += copies[i]
                ties.join(i, j)
        mark[own] = False
    return links, tid[[ties.root(i) for i in range(n)]]


def _verify(similarity: float):
    def run(batches):
        held, name = [], None

        def done():
            rows = sorted(held, key=lambda r: r["tid"])
            rows = [r for k, r in enumerate(rows) if not k or r["tid"] != rows[k - 1]["tid"]]  # repeated documents
            if len(rows) < 2:
                return None
            tid = np.array([r["tid"] for r in rows])
            links, root = compared(tid, np.array([r["copies"] for r in rows]), np.array([r["side"] for r in rows]), [np.frombuffer(r["shingles"], np.uint64) for r in rows], np.stack([np.frombuffer(r["keys"], np.uint64) for r in rows]), similarity)
            some = links > 0
            return pa.record_batch([pa.array(tid[some]), pa.array(links[some]), pa.array(root[some])], names=["tid", "links", "root"])

        for batch in batches:
            for row in (r for k in range(0, batch.num_rows, 500) for r in batch.slice(k, 500).to_pylist()):
                if (row["cluster"], row["i"], row["j"]) != name:
                    if held and (out := done()) is not None:
                        yield out
                    held, name = [], (row["cluster"], row["i"], row["j"])
                held.append(row)
        if held and (out := done()) is not None:
            yield out

    return run


def linked(spark: SparkSession, docs: DataFrame, similarity: float = 0.8, trees: int = 16, deepest: int = 6, target: float = 0.9995, block: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of its component of similar documents), n_links (other documents with a Jaccard similarity of `similarity` or more) of every document.

    Documents without words (null, empty) are linked to none and are their own class. Equal rows are copies of each other. An empty table gives no row.
    Texts are told apart by a 64-bit hash of their words. A very long text is a slice of its own; other columns, whatever their names, are left out.
    """
    return classed(spark, docs, similarity, trees, deepest, target, block, id_col, text_col).select("doc_id", "class_id", "n_links")


def classed(spark: SparkSession, docs: DataFrame, similarity: float = 0.8, trees: int = 16, deepest: int = 6, target: float = 0.9995, block: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As linked, with the rid of the row (64 bits over id and text) and the component of its text; null for a row without words."""
    ship(spark)
    how = (similarity, deepest, target)
    own = keyed(docs, id_col, text_col)
    signed_docs = staged(own.mapInArrow(_sign(trees, how), "rid bigint, doc_id bigint, tid bigint, keys array<bigint>"), "signatures")
    texts = signed_docs.groupBy("tid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.min("rid").alias("rid"))
    paths = signed_docs.select("tid", F.explode("keys").alias("key"))  # a key holds its tree and length
    nodes = paths.groupBy("key").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).where("a <> b")
    below = paths.join(nodes.select("key", "a"), "key").select(F.col("tid").alias("a"), F.col("a").alias("b"))
    clusters = staged(components(below).withColumnsRenamed({"node": "tid", "component": "cluster"}), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    wanted = clusters.join(texts, "tid").join(sizes, "cluster").select("tid", "rid", "copies", "cluster", "m")
    sets = own.join(wanted.select("rid", F.col("tid").alias("want")), "rid").select("rid", "text").mapInArrow(_sets(trees, how), "tid bigint, shingles binary, keys binary")
    blocks = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("tid"), blocks).cast("int")
    dealt = wanted.select("tid", "copies", "cluster", blocks.alias("n"), mine.alias("mine")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("tid", "copies", "cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"))
    # A pair of blocks i < j gets the rows of both and compares across; a pair i = i compares within.
    compared_rows = dealt.join(sets, "tid").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_verify(similarity), "tid bigint, links bigint, root bigint")
    verified = staged(compared_rows, "links")
    links = verified.groupBy("tid").agg(F.sum("links").alias("links"))
    ties = components(verified.select(F.col("tid").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "tid"})
    placed = texts.join(ties, "tid", "left").join(links, "tid", "left").withColumn("component", F.coalesce("component", "tid"))
    lowest = placed.groupBy("component").agg(F.min("first_doc").alias("class_id"))
    known = staged(placed.join(lowest, "component").select("tid", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    discard(clusters, verified)
    having = signed_docs.select("rid", "doc_id", "tid").join(known, "tid").select("rid", "doc_id", "component", "class_id", "n_links")
    bare = own.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("rid", "doc_id", F.lit(None).cast("bigint").alias("component"), F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return having.unionByName(bare)


def first_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each class, with all its columns: that with the smallest id; a null id counts as none.

    Rows are judged one by one, not by their ids: of one id on different texts each row has its own class. Where an id stands on similar texts of one class, the
    row with the smallest hash stays. Equal rows stay or go together; documents without words stay.
    """
    found = classed(spark, docs, id_col=id_col, text_col=text_col, **how)
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("f"))
    keep = first.select("f.rid", "f.doc_id").unionByName(found.where("component IS NULL").select("rid", "doc_id").distinct())
    rows = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("rid"), docs[id_col].cast("bigint").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return of_rows(rows, keep, "left_semi").select("_row.*")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, array_to_string(w, ' ') AS t, w FROM w WHERE len(w) > 0),
texts AS (SELECT t, min(doc_id) AS id, count(*) AS copies, any_value(w) AS w FROM t GROUP BY t),
s AS (SELECT DISTINCT id, copies, g FROM (SELECT id, copies, unnest(CASE WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM texts)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
class AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS id, sum(copies) AS links FROM link JOIN texts ON texts.id = b GROUP BY a)
SELECT doc_id, CAST(class_id AS BIGINT) AS class_id, CAST(coalesce(links, 0) + copies - 1 AS BIGINT) AS n_links
FROM t JOIN texts USING (t) JOIN class ON class.id = texts.id LEFT JOIN links ON links.id = texts.id
UNION ALL SELECT doc_id, doc_id, 0 FROM w WHERE len(w) = 0
"""
