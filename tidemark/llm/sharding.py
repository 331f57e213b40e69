"""Sharding by extendible hashing (operator 8): a directory over hash-prefix bits where only buckets above the byte limit split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import discard, staged

#: Bits of the hash that place a row.
BITS = 60
#: Bits that one round of splitting looks at: a round's directory has at most 2**ROUND entries below each bucket still open.
ROUND = 16
#: Rows of one block of the running totals: 2**BLOCK; a block of blocks has 2**BLOCK of them.
BLOCK = 12


def code(key: Column) -> Column:
    """The first 60 bits of the key's MD5 (a null key counts as an empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def _dealt(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(dealt, held): rows (code, n_bytes and others), each code above the limit, with part, shard_bytes, shard_docs; held is the staged table beneath.

    A row of more than half the limit is a part of its own (odd numbers). The others are cut where their running total passes a multiple of `limit` less the
    longest of them, so a part holds at most `limit` bytes and at least about half of it (even numbers). Rows are numbered in the staged table, once, and summed in blocks
    and blocks of blocks; no task holds a code.
    """
    held = staged(rows.withColumn("_row_no", F.monotonically_increasing_id()), "hot-ids")
    alone = F.col("n_bytes") * 2 > limit
    sized = held.withColumn("_small", F.when(alone, 0).otherwise(F.col("n_bytes"))).withColumn("_large", alone.cast("bigint")).withColumn("_block", F.shiftright("_row_no", BLOCK))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda keys, df: df.groupBy(*keys).agg(F.sum("_small").alias("_small"), F.sum("_large").alias("_large"), F.max("_most").alias("_most"))
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = sums(["code", "_block"], sized.withColumn("_most", F.col("_small"))).withColumn("_over", F.shiftright("_block", BLOCK))
    wide = before(["code"], "_over")
    over = sums(["code", "_over"], blocks).select("code", "_over", so_far("_small", wide).alias("_s"), so_far("_large", wide).alias("_l"), (F.lit(limit) - F.max("_most").over(Window.partitionBy("code"))).alias("_width"))
    mid = before(["code", "_over"], "_block")
    starts = blocks.join(over, ["code", "_over"]).select("code", "_block", (F.col("_s") + so_far("_small", mid)).alias("_s"), (F.col("_l") + so_far("_large", mid)).alias("_l"), "_width")
    near = before(["code", "_block"], "_row_no")
    placed = sized.join(starts, ["code", "_block"]).withColumn("_s", F.col("_s") + so_far("_small", near)).withColumn("_l", F.col("_l") + so_far("_large", near))
    parts = placed.withColumn("part", F.when(F.col("_large") == 1, F.col("_l") * 2 + 1).otherwise(F.expr("_s div _width") * 2))
    totals = parts.groupBy("code", "part").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return parts.join(totals, ["code", "part"]).select(*rows.columns, "part", "shard_bytes", "shard_docs"), held


def _placed(left: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(left with shard, depth, shard_bytes, shard_docs for every row, staged tables beneath); left has code, n_bytes and any others, which are carried along."""
    own, done, beneath, at = left.columns, [], [], 0
    while True:
        to = min(BITS, at + ROUND)
        prefix = lambda d: F.shiftright("code", BITS - d)
        cells = left.groupBy(prefix(to).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        depths = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(at), F.lit(to))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {to} - depth)"))
        buckets = depths.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") <= 1)
        # For each cell the shallowest bucket that fits; its parent did not fit, so it was split.
        entry = depths.select("cell", "depth", "prefix").join(buckets.where(fits), ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("e"))
        directory = cells.select("cell").join(entry, "cell", "left").select("cell", "e.*")
        placed = left.withColumn("cell", prefix(to)).join(F.broadcast(directory) if at == 0 else directory, "cell")  # the first round's directory has at most 65,536 entries
        done.append(placed.where("depth IS NOT NULL").select(*own, F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')")).alias("shard"), "depth", "shard_bytes", "shard_docs"))
        open_cells = directory.where("depth IS NULL")
        if open_cells.isEmpty():
            break
        left = placed.where("depth IS NULL").select(*own)
        if to == BITS:
            dealt, held = _dealt(left, limit)
            beneath.append(held)
            done.append(dealt.select(*own, F.concat(F.expr(f"lpad(bin(code), {BITS}, '0')"), F.lit("+"), F.col("part").cast("string")).alias("shard"), F.lit(BITS).alias("depth"), "shard_bytes", "shard_docs"))
            break
        at = to
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, beneath


def _sized(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"), code(F.col(id_col)).alias("code"))


def sharded(docs: DataFrame, limit: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (its prefix bits), depth, shard_bytes, shard_docs for every document; every shard holds at most `limit` bytes.

    A document above the limit stands alone in its shard. Equal ids hash alike; where the rows of one id exceed the limit together, they are cut into
    parts by running totals (shard ends in "+part"), and the totals are those of the part. Null texts have 0 bytes; an empty table gives no row; other columns,
    whatever their names, are left out. Texts are not moved: only sizes are.
    """
    placed, _ = _placed(_sized(docs, id_col, text_col, F.col(id_col).cast("bigint").alias("doc_id")), limit)
    return placed.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def write(docs: DataFrame, path: str, limit: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents as one folder for each shard: every row carries its shard, and rows of ids above the limit are staged once on the way."""
    placed, beneath = _placed(_sized(docs, id_col, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("_row")), limit)
    placed.select("_row.*", F.col("shard").alias("_shard")).repartition("_shard").write.partitionBy("_shard").parquet(path)
    discard(*beneath)


ORACLE = """
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS code FROM documents),
p AS (SELECT *, CAST(unnest(range(0, 31)) AS INTEGER) AS depth FROM d),
q AS (SELECT *, code >> (60 - depth) AS prefix FROM p),
b AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM q GROUP BY ALL),
f AS (SELECT * FROM q JOIN b USING (depth, prefix) WHERE shard_bytes <= 1048576 OR shard_docs <= 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_docs
FROM f QUALIFY depth = min(depth) OVER (PARTITION BY doc_id)
"""
