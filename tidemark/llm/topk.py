"""Exact top-k search by inner product over a bit-sliced index (operator 7).

Each block of rows keeps, for each attribute, one bitmap per bit of its value (offset by the block's minimum); the lowest `coarse` bits are left out
of the slices. A query's score slices are the sums of the attribute slices times the query's weights, added with bitmap arithmetic (full adders over whole
bitmaps). The best rows are selected from the most significant slice downward; all rows whose true score may reach the k-th are then resolved exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ship, staged

#: Rows of an index block and queries of a query block.
ROWS, QUERIES = 32768, 256
#: Query blocks that share one copy of an index block.
SHARED = 2
COARSE = 2


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, values (floor(scale * x), x as double), n (components). Null vectors and those that hold a null or non-finite component are left out."""
    x = F.col(vec_col)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(whole).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("values"), F.size(x).alias("n"))


def add(total: list[np.ndarray], slices: list[np.ndarray], shift: int, zero: np.ndarray) -> None:
    """total += slices << shift, with bitmaps as digits."""
    while len(total) < shift:
        total.append(zero)
    carry = zero
    for k, s in enumerate(slices):
        if shift + k == len(total):
            total.append(zero)
        t = total[shift + k]
        x = t ^ s
        total[shift + k] = x ^ carry
        carry = (t & s) | (x & carry)
    k = shift + len(slices)
    while carry.any():
        if k == len(total):
            total.append(zero)
        total[k], carry = total[k] ^ carry, total[k] & carry
        k += 1


def ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


class Block:
    """The bit-sliced index of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, dims = values.shape
        self.low = values.min(0) if n else np.zeros(dims, np.int64)
        raised = values - self.low
        self.width = [max(0, int(x).bit_length() - COARSE) for x in raised.max(0)] if n else [0] * dims
        words = -(-n // 64)
        self.all = self.bitmap(np.ones(n, bool), words)
        self.zero = np.zeros(words, np.uint64)
        self.slices = [[self.bitmap((raised[:, d] >> (COARSE + b)) & 1 == 1, words) for b in range(self.width[d])] for d in range(dims)]

    @staticmethod
    def bitmap(on: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, np.uint8)
        packed = np.packbits(on, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of a lower bound of (score - a constant) / 2**COARSE, and how far below the true value it may be, in score units."""
        total: list[np.ndarray] = []
        slack = 0
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            slices = self.slices[d]
            if q < 0:  # a negative weight on v is a positive one on the complement of v
                slices = [self.all & ~s for s in slices]
            slack += abs(q) * ((1 << COARSE) - 1)
            for b in range(abs(q).bit_length()):
                if abs(q) >> b & 1:
                    add(total, slices, b, self.zero)
        return total, slack

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with the id `own`; of equal scores the smaller id."""
        need = k + int(np.count_nonzero(self.ids == own))
        total, slack = self.sums(query)
        sure, open_, kth = self.zero, self.all, 0
        for b in reversed(range(len(total))):
            tried = sure | (open_ & total[b])
            n = ones(tried)
            if n >= need:
                open_, kth = open_ & total[b], kth | (1 << b)
            else:
                sure, open_ = tried, open_ & ~total[b]
        # kth: the need-th largest lower bound. A row can matter if its lower bound plus the slack reaches it.
        least = max(0, kth - (slack >> COARSE) - 1)
        above, equal = self.zero, self.all
        for b in reversed(range(len(total))):
            if least >> b & 1:
                equal = equal & total[b]
            else:
                above, equal = above | (equal & total[b]), equal & ~total[b]
        rows = np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little", count=len(self.ids)))
        rows = rows[self.ids[rows] != own]
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[order]], scores[order]


def _blocks(rows: DataFrame, per: int, name: str) -> DataFrame:
    """Rows dealt out to blocks of about `per`, each block one row of packed ids and values."""
    counted = rows.groupBy("n").agg(F.ceil(F.count("*") / per).alias("blocks"))
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(counted), "n").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))  # one row for each vector length

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("vec_id").fill_null(-(1 << 63))), kind="stable")
        table = table.take(pa.array(order))
        n = table.column("n")[0].as_py()
        values = np.asarray(table.column("values").combine_chunks().flatten())
        if len(values) and max(values.max(), -values.min()) >= 1 << 31:
            raise ValueError("a component is beyond 32 bits")
        values = values.astype("<i4").reshape(-1, n)
        return pa.table({"n": pa.array([n], pa.int32()), name: table.column("block").combine_chunks()[:1].cast(pa.int64()), "ids": pa.array([np.asarray(table.column("vec_id").fill_null(-(1 << 63))).astype("<i8").tobytes()]), "values": pa.array([values.tobytes()])})

    return dealt.select("n", "block", "vec_id", "values").groupBy("n", "block").applyInArrow(build, f"n int, {name} bigint, ids binary, values binary")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the highest integer inner product for each row of `queries`, its own id left out.

    Queries and rows meet in blocks: a task has a copy of one index block and a few query blocks. Vectors of different lengths do not meet. Empty tables give no row; repeated rows count each; other columns are left out.
    Rows without an id are candidates like others, before all ids where scores are equal, and come back without one; as queries they are left out of their own results, all of them.
    Components must stay below 2**31 / scale in size. The result holds k rows for a query, or all if there are fewer.
    """
    ship(spark)
    index = staged(_blocks(quantised(vectors, id_col=id_col, vec_col=vec_col), ROWS, "block"), "index")
    asked = staged(_blocks(quantised(queries, id_col=id_col, vec_col=vec_col), QUERIES, "part"), "asked")
    # One row for each vector length: how many index blocks there are, and how many copies of each the query blocks need.
    many = index.groupBy("n").agg(F.max("block").alias("last")).join(asked.groupBy("n").agg((F.floor(F.max("part") / SHARED) + 1).cast("bigint").alias("copies")), "n")
    zero = F.lit(0).cast("bigint")
    rows = index.join(F.broadcast(many), "n").select("n", "block", F.explode(F.sequence(zero, F.col("copies") - 1)).alias("copy"), F.lit(-1).cast("bigint").alias("part"), "ids", "values")
    tasks = asked.join(F.broadcast(many), "n").select("n", F.explode(F.sequence(zero, "last")).alias("block"), F.floor(F.col("part") / SHARED).cast("bigint").alias("copy"), "part", "ids", "values")
    met = rows.unionByName(tasks).repartition("n", "block", "copy").sortWithinPartitions("n", "block", "copy", "part")  # the index block comes first

    def search(batches):
        block, name = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                held, values = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["values"], "<i4").reshape(-1, row["n"]).astype(np.int64)
                own_name = (row["n"], row["block"], row["copy"])
                if row["part"] < 0:
                    block, name = Block(held, values), own_name
                if row["part"] < 0 or own_name != name:  # no row fell into this block
                    continue
                out: list[list] = [[], [], [], []]
                for j, (own, q) in enumerate(zip(held.tolist(), values, strict=True)):
                    ids, scores = block.best(q, own, k)
                    out[0] += [own] * len(ids)
                    out[1] += [row["part"] * QUERIES * 64 + j] * len(ids)
                    out[2] += ids.tolist()
                    out[3] += scores.tolist()
                yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["query_id", "asked", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id bigint, asked bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "asked").orderBy(F.col("score").desc(), "vec_id")
    named = lambda c: F.nullif(F.col(c), F.lit(-(1 << 63)).cast("bigint")).alias(c)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(named("query_id"), "rank", named("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * r.e[i])) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
