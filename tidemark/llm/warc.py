"""WARC archives: written by Spark's text writer, read back through a verified chain of record boundaries (operator 12).

A record is one line of the text writer, whose separator is the empty line pair that ends every record; so the files are plain WARC, committed like any
other output of a job. Reading cuts the files at the version line, wherever it stands, in payloads too: each piece is a candidate for a record. A task emits
for every candidate its offset and that of the successor its Content-Length claims. Pointers are then jumped (doubled until they settle): within a
split by numpy, from split to split by joins over one pointer for each place where a split is entered. What is reached from the start of a file is a record; all else is
payload, and is put back behind the record that it was cut from.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import discard, shared_dir, ship, staged

#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: str) -> Column:
    """The SHA-1 of a column in base32: each five hexadecimal digits are four digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """value: one WARC record for each row, without the separator at its end.

    Of rows with equal payloads of at least `least` bytes those with the largest id are responses, the others (a null id among them) revisit it. The payload
    itself is read twice and, where the revisits are few, never shuffled: groups are known by the SHA-256 of their payload, and only revisits are joined back, by id and digest.
    """
    plain = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    known = plain.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("same", F.sha2("payload", 256))
    slim = known.where(F.col("size") >= least).select("page", "same")
    groups = slim.groupBy("same").agg(F.max("page").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    revisits = staged(slim.join(groups, "same").where(~F.col("page").eqNullSafe(F.col("first"))).distinct(), "revisits").withColumnsRenamed({"page": "r_page", "same": "r_same"})
    told = known.join(revisits, known["page"].eqNullSafe(revisits["r_page"]) & (known["same"] == revisits["r_same"]), "left")

    seen = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    where = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]+", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    block = F.concat(F.col("http"), F.when(seen, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(seen, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", where), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1("payload"))),
        F.when(seen, F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", name("first")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return told.withColumn("http", http).withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write(pages: DataFrame, path: str, **options) -> str:
    """Writes pages (see records) as WARC files below path; each task writes a file. Returns path."""
    records(pages, **options).write.option("lineSep", END).text(path)
    return path


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


def _head(piece: bytes) -> tuple[int, int]:
    """Of a candidate without its version line: bytes of its header with the empty line, bytes of the block it claims; -1, -1 where it is no record's beginning."""
    if piece.startswith(b"\r\n"):
        return -1, -1
    end = piece.find(b"\r\n\r\n")
    found = _LENGTH.search(piece, 0, end + 1) if end > 0 else None
    return (end + 4, int(found[1])) if found and len(found[1]) < 16 else (-1, -1)


def jumped(pointer: np.ndarray) -> np.ndarray:
    """Where each pointer leads in the end: pointers are doubled until none moves. A node that points at itself is an end."""
    while True:
        far = pointer[pointer]
        if np.array_equal(far, pointer):
            return far
        pointer = far


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each candidate (its place in the split, header and block, or the bare bytes if it is cut short), and a row for each split (all places and claimed ends)."""
    names = ["file", "split", "at", "size", "cut", "head", "body", "places", "ends"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    now, at, places, ends = None, 0, [], []

    def row(columns: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def summary() -> pa.RecordBatch:
        return row([[now[0]], [now[1]], [None], [at], [None], [None], [None], [np.array(places, "<i8").tobytes()], [np.array(ends, "<i8").tobytes()]])

    for batch in batches:
        out: list[list] = [[] for _ in names]
        for file, split, piece in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("piece"), strict=True):
            if (file, split) != now:
                if now is not None:
                    yield summary()
                now, at, places, ends = (file, split), 0, [], []
            piece = piece.as_py()
            # A piece begins behind a version line, but for the first of a file, which stands before it. Places count from the version line.
            first = split == 0 and not at
            begin = at - len(MAGIC)
            at += len(piece) + len(MAGIC)
            if first and not piece:
                continue
            head, claimed = (-1, -1) if first else _head(piece)
            size = len(MAGIC) + head + claimed + 4 if head > 0 else -1
            whole = head > 0 and len(piece) == head + claimed + 4 and piece.endswith(b"\r\n\r\n")
            places.append(begin)
            ends.append(begin + size if head > 0 else -1)
            for column, value in zip(out, (file, split, begin, size, not whole, piece[: head - 2] if whole else None, piece[head : head + claimed] if whole else piece, None, None), strict=True):
                column.append(value)
        if out[0]:
            yield row(out)
    if now is not None:
        yield summary()


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate the place at or behind the end of its split to which its chain leads; -1 where it breaks off."""
    for batch in batches:
        for r in batch.to_pylist():
            places, pointer, stop = _pointers(r)
            out = stop[jumped(pointer)]
            yield pa.record_batch([pa.array([r["file"]] * len(places)), pa.array(np.full(len(places), r["split"])), pa.array(places), pa.array(out)], names=["file", "split", "place", "exit"])


def _pointers(split: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a split's candidates in the file, each one's successor in the split (itself where there is none), and then where its chain leaves to (-1: nowhere)."""
    places, ends = (np.frombuffer(split[k], "<i8") for k in ("places", "ends"))
    places, ends = places + split["base"], np.where(ends < 0, -1, ends + split["base"])
    next_split = split["base"] + split["total"] - len(MAGIC)
    found = np.minimum(np.searchsorted(places, ends), max(len(places) - 1, 0))
    here = (ends >= 0) & (places[found] == ends) if len(places) else np.zeros(0, bool)
    return places, np.where(here, found, np.arange(len(places))), np.where(here | (ends < next_split), -1, ends)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the candidates that no chain reaches, and those that are records."""
    for batch in batches:
        for r in batch.to_pylist():
            places, pointer, _ = _pointers(r)
            reached = np.zeros(len(places), bool)
            if r["entry"] is not None:
                reached[places == r["entry"]] = True
                for _ in range(int(len(places)).bit_length() + 1):  # what is marked marks where it leads, and pointers double
                    reached[pointer[reached]] = True
                    pointer = pointer[pointer]
            yield pa.record_batch([pa.array([r["file"]] * len(places)), pa.array(np.full(len(places), r["split"])), pa.array(places - r["base"]), pa.array(places), pa.array(reached)], names=["file", "split", "at", "place", "record"])


def _entries(jumps: DataFrame) -> DataFrame:
    """file, split, entry: where the chain from each file's start enters its splits. jumps: file, split, place, exit.

    Only places that some chain leaves a split for can be entered, so a file has about one pointer for each split; each round doubles the pointers and what is reached.
    """
    starts = jumps.where("place = 0").select("file", F.col("place").alias("exit"))
    near = jumps.where("exit >= 0").select("file", "exit").distinct().unionByName(starts).distinct()
    now = staged(jumps.join(near.withColumnRenamed("exit", "place"), ["file", "place"]).select("file", "split", "place", "exit"), "pointers")
    reached = staged(now.where("place = 0").select("file", "place"), "reached")
    n = reached.count()
    pointers = now
    while True:
        hop = pointers.select("file", "place", "exit")
        more = reached.join(hop, ["file", "place"]).where("exit >= 0").select("file", F.col("exit").alias("place"))
        more = more.join(now.select("file", "place"), ["file", "place"], "left_semi")  # the end of the file is no place
        last, reached = reached, staged(reached.unionByName(more).distinct(), "reached")
        discard(last)
        found = reached.count()
        if found == n:
            break
        n = found
        onward = hop.select("file", F.col("place").alias("exit"), F.col("exit").alias("far"))
        last, pointers = pointers, staged(hop.join(onward, ["file", "exit"]).select("file", "place", F.col("far").alias("exit")), "pointers")
        if last is not now:
            discard(last)
    return now.join(reached, ["file", "place"]).select("file", "split", F.col("place").alias("entry"))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, offset, head (the lines of its header), block (bytes) of every record of the WARC files below path.

    strict: a file whose chain of records does not end at its last byte is an error; otherwise the records before the break are returned. A version line inside a
    payload begins no record, whatever follows it. An empty folder gives no row.
    """
    ship(spark)
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))
    found = staged(pieces.mapInArrow(_candidates, "file string, split bigint, at bigint, size bigint, cut boolean, head binary, body binary, places binary, ends binary"), "candidates", "zstd")
    splits = found.where("at IS NULL").select("file", "split", F.col("size").alias("total"), "places", "ends")
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = splits.select("file", "split", "total").withColumn("base", F.coalesce(F.sum("total").over(order), F.lit(0)))  # numbers alone: a row for each split
    bases = staged(sizes.select("file", "split", "base"), "bases")
    based = staged(splits.join(bases, ["file", "split"]), "splits")
    jumps = staged(based.mapInArrow(_exits, "file string, split bigint, place bigint, exit bigint"), "jumps")
    entries = staged(_entries(jumps), "entries")
    if strict:
        ends = based.groupBy("file").agg((F.max(F.col("base") + F.col("total")) - len(MAGIC)).alias("end"))
        whole = jumps.join(entries.select("file", F.col("entry").alias("place")), ["file", "place"]).select("file", F.col("exit").alias("end")).distinct()
        broken = ends.where("end > 0").join(whole, ["file", "end"], "left_anti").count()
        if broken:
            raise ValueError(f"{broken} files do not end where their chain of records does")
    walked = staged(based.join(entries, ["file", "split"], "left").mapInArrow(_walked, "file string, split bigint, at bigint, place bigint, record boolean"), "walked")
    discard(jumps)
    return _joined(found.where("at IS NOT NULL"), walked, bases).select("file", "offset", F.col("head").cast("string").alias("head"), "block")


def _joined(found: DataFrame, walked: DataFrame, bases: DataFrame) -> DataFrame:
    """Records that are whole as they are, and those that hold version lines, put together from their pieces.

    Both tables that whole records meet are written ones (a row for each split, a row for each odd piece), so Spark knows their sizes: it sends them to every task where they are small and shuffles otherwise.
    """
    place = ["file", "split", "at"]
    cut = found.where("cut").select(*place, "size", F.col("body").alias("piece"))
    odd = staged(walked.join(cut.select(*place, "size"), place, "left").where("NOT record OR size IS NOT NULL"), "cut-places").withColumn("size", F.coalesce("size", F.lit(-1)))
    lost = odd.where("NOT record").select(*place)
    sound = found.where("NOT cut").join(lost, place, "left_anti").join(bases, ["file", "split"])
    sound = sound.select("file", (F.col("base") + F.col("at")).alias("offset"), "head", F.col("body").alias("block"))
    # A payload's pieces stand behind their record in the file: the last record before a piece owns it.
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    owned = odd.withColumn("owner", F.last(F.when(F.col("record"), F.col("place")), ignorenulls=True).over(before)).where("owner IS NOT NULL")
    back = F.concat(F.lit(MAGIC), "head", F.lit(b"\r\n"), "body", F.lit(END.encode()))
    texts = found.join(owned.select(*place, "place", "owner"), place).select("file", "owner", "place", F.when(F.col("cut"), F.concat(F.lit(MAGIC), F.col("body"))).otherwise(back).cast("string").alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece")))  # those of one record
    whole = texts.groupBy("file", F.col("owner").alias("offset")).agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").cast("binary").alias("all"))
    return sound.unionByName(whole.mapInArrow(_parsed, sound.schema))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header and block of the record at the beginning of its bytes; one that is cut off at the file's end is left out."""
    for batch in batches:
        rows = []
        for file, offset, raw in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("all"), strict=True):
            piece = raw.as_py()[len(MAGIC) :]
            head, size = _head(piece)
            if head > 0 and piece[head + size : head + size + 4] == b"\r\n\r\n":
                rows.append((file, offset, piece[: head - 2], piece[head : head + size]))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["file", "offset", "head", "block"])


def field(name: str) -> Column:
    """The value of a header line; null where there is none."""
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload of each response (behind its HTTP header), the length that the HTTP header states, and the SHA-1 of the payload itself."""
    for batch in batches:
        sizes, digests, payloads = [], [], []
        for raw in batch.column("block"):
            head, size = _head(block := raw.as_py())
            payloads.append(block[head:])
            sizes.append(size)
            digests.append(base64.b32encode(hashlib.sha1(payloads[-1]).digest()).decode())
        kept = [c for c in batch.schema.names if c != "block"]
        yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(payloads, pa.binary())], names=[*kept, "stated", "digest", "payload"])


def pages_of(archived: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload of records (see read) that `write` made.

    A response's size and digest are those of the bytes read back, which must be those of its header; a revisit, which holds no payload, states them.
    """
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(.*)>", 1), F.lit("null")).cast("bigint")
    told = archived.select(number(field("WARC-Record-ID")).alias("page_id"), field("WARC-Type").alias("record_type"), number(field("WARC-Refers-To")).alias("refers_to"), field("WARC-Target-URI").alias("url"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("said"), "block")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema if f.name != "block")
    read_ = told.mapInArrow(_payloads, f"{kinds}, stated bigint, digest string, payload binary")
    seen = F.col("record_type") == "revisit"
    size = F.when(seen, F.col("stated")).otherwise(F.octet_length("payload").cast("bigint"))
    sound = seen | ((F.col("digest") == F.col("said")) & (F.col("stated") == size))
    digest = F.when(sound, F.when(seen, F.col("said")).otherwise(F.col("digest"))).otherwise(F.raise_error(F.lit("a payload is not the one its header states")))
    return read_.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "url", F.when(~seen, F.col("payload")).alias("payload"))


def archived(spark: SparkSession, pages: DataFrame, least: int = 0, **options) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back and returns page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null payloads are empty ones; empty payloads are equal to one another. Repeated rows are records each: those with the largest id of their payload all
    responses, the others revisits. A null id is smaller than any; rows with equal payloads that all lack an id are responses. Other columns are left out. An empty table gives no row.
    """
    path = write(pages, f"{shared_dir(spark)}/tidemark/archive-{uuid.uuid4().hex}.warc", least=least, **options)
    return pages_of(read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 of binary strings: DuckDB returns it in hexadecimal; base32 by digits as in base32_sha1.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS first FROM p GROUP BY payload),
s AS (SELECT p.page_id, octet_length(encode(p.payload)) AS size, sha1(p.payload) AS hex, g.first FROM p JOIN g ON g.payload = p.payload)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM s
"""
