"""Fixed-width token-id files (operator 5): blocks of ids in the minimum bits of the vocabulary, read back with numpy.

A file set is a Parquet table, one row for each block, in ascending document order within and across `part`:
part, block, doc_ids (array), sizes (ids of each document, array), first_id (ids before the block in its part), payload (binary).
A payload is the magic b"TIDB", the width in bits (1 byte), 3 zero bytes, the number of ids (8 bytes, little-endian), and the ids:
id k takes bits k*width to (k+1)*width of a row of 64-bit little-endian words, lowest bit first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.encoders import SLICE, Dropped, encoder, vocabulary_size
from tidemark.session import ship, staged

BLOCKS = "part int, block int, first_id bigint, doc_ids array<bigint>, sizes array<bigint>, payload binary"
HEAD = struct.Struct("<4sB3xQ")
BLOCK_IDS = 1 << 17


def width_of(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """64 ids fill `width` words exactly, so one numpy pass for each of the 64 columns packs all rows."""
    n = len(ids)
    if n and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    rows = np.zeros((-(-n // 64), 64), np.uint64)
    rows.reshape(-1)[:n] = ids
    words = np.zeros((len(rows), width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return HEAD.pack(b"TIDB", width, n) + words.astype("<u8").tobytes()


def read_ids(payload: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids first to first + count of a block, without unpacking the rest."""
    magic, width, n = HEAD.unpack_from(payload)
    if magic != b"TIDB":
        raise ValueError("not a block of token ids")
    count = n - first if count is None else count
    if first < 0 or count < 0 or first + count > n:
        raise IndexError("ids beyond the block")
    low, high = first // 64, -(-(first + count) // 64)
    words = np.frombuffer(payload, "<u8", (high - low) * width, HEAD.size + 8 * low * width).reshape(-1, width)
    rows, mask = np.empty((high - low, 64), np.uint64), np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        v = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[:, at + 1] << np.uint64(64 - shift))
        rows[:, j] = v & mask
    return rows.reshape(-1)[first - 64 * low :][:count].astype("<u4")


def blocks(docs: DataFrame, vocabulary: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Range-partitions the documents by id and packs each partition in order. A block closes at the first document that fills it, so documents stay whole."""
    width = width_of(size)

    def encode(batches):
        enc, part = encoder(Dropped, vocabulary), TaskContext.get().partitionId()
        held, names, sizes, n, block, first = [], [], [], 0, 0, 0

        def flush():
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack_bits(np.concatenate(held), width)], pa.binary())], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for some in slices(batch, text_col, SLICE):
                ids, bounds = enc.ids(some.column(text_col), end_id)
                for doc, a, b in zip(some.column(id_col).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                    held.append(ids[a:b])
                    names.append(doc)
                    sizes.append(b - a)
                    n += b - a
                    if n >= BLOCK_IDS:
                        yield flush()
                        held, names, sizes, n, block, first = [], [], [], 0, block + 1, first + n
        if names:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    return ordered.mapInArrow(encode, BLOCKS)


def read_documents(written: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the blocks."""
    totals = written.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("ids"))
    bases = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def unpack(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, sizes = read_ids(row["payload"]), np.array(row["sizes"], np.int64)
                at = np.cumsum(sizes) - sizes
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(at + row["base"] + row["first_id"]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return written.join(F.broadcast(bases), "part").mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes the blocks of all documents to the shared folder and returns them read back, ids in the bits that the vocabulary file takes.

    Null texts are empty; an empty table gives no block; repeated rows are kept; a null id comes first; other columns, whatever their names, are left out.
    A very long text is a block of its own.
    """
    ship(spark)
    return staged(blocks(docs, vocabulary, vocabulary_size(vocabulary), end_id), "ids")
