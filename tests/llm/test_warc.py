"""WARC archives: plain files by hand, payloads that hold records, splits of every size, odd rows."""

import base64
import hashlib
import itertools
from pathlib import Path

import pytest
from tidemark.llm import warc

SCHEMA = "page_id bigint, url string, html string, head string"


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = max(first.get(html or "", page), page)
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        to = first.get(html or "") if len(data) >= least else page
        seen = to is not None and to != page
        out.append((page, len(data), b32(data), "revisit" if seen else "response", to if seen else None))
    return sorted(out, key=str)


def got(spark, rows, **more):
    return sorted(map(tuple, warc.archived(spark, spark.createDataFrame(rows, SCHEMA).repartition(2), **more).collect()), key=str)


def record(payload: bytes, page: int) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (page, len(block)) + block + b"\r\n\r\n"


FAKE = record(b"not a record", 77).decode()
ROWS = [
    (1, "http://a/ b\r\nX: y", "<p>one</p>", "x"),
    (2, None, None, None),
    (3, "http://c", "", "x"),
    (4, "http://d", FAKE, "x"),
    (5, "http://e", f"before {FAKE}{FAKE} behind\r\n\r\n", "x"),
    (6, "http://f", "WARC/1.1\r\n", "x"),
    (7, "http://g", "WARC/1.1\r\nContent-Length: 99999999999\r\n\r\n", "x"),
    (8, "http://h", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n", "x"),
    (9, "http://i", "<p>one</p>", "x"),
    (9, "http://i", "<p>one</p>", "x"),
    (None, "http://j", "<p>one</p>", "x"),
    (None, "http://k", "no id", "x"),
    (-3, "http://l", "ü中\U0001f600" * 50, "x"),
    (10, "http://m", "x" * 300_000, "x"),
]


def test_rows_come_back(spark):
    assert got(spark, ROWS) == expected(ROWS)
    assert got(spark, ROWS, least=5) == expected(ROWS, least=5)
    assert got(spark, []) == []


@pytest.mark.parametrize("split", [61, 1000])
def test_splits_of_any_size(spark, tmp_path, split):
    """Boundaries fall within version lines, headers and payloads: the same records come back."""
    path = f"file://{tmp_path}/a.warc"
    warc.write(spark.createDataFrame(ROWS[:8], SCHEMA).coalesce(1), path)
    whole = sorted(map(tuple, warc.read(spark, path).select("offset", "head", "block").collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        parts = sorted(map(tuple, warc.read(spark, path).select("offset", "head", "block").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts == whole and len(whole) == 8


def test_archive_from_elsewhere(spark, tmp_path):
    """A fake record whose claimed end is the start of a true one is no record; the offsets are those of the file."""
    inner = b"text WARC/1.1\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
    made = [record(b"a", 1), record(inner, 2), record(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % 0, 3), record(b"", 4)]
    (tmp_path / "x.warc").write_bytes(b"".join(made))
    rows = warc.read(spark, f"file://{tmp_path}/x.warc").orderBy("offset").collect()
    assert [r["offset"] for r in rows] == [0, *itertools.accumulate(len(m) for m in made[:-1])]
    assert bytes(rows[1]["block"]).endswith(inner)


def test_broken_files(spark, tmp_path):
    made = record(b"a", 1) + record(b"bb WARC/1.1\r\n cc", 2)
    (tmp_path / "cut.warc").write_bytes(made + record(b"third", 3)[:-7])
    with pytest.raises(ValueError, match="1 files"):
        warc.read(spark, f"file://{tmp_path}/cut.warc")
    assert warc.read(spark, f"file://{tmp_path}/cut.warc", strict=False).count() == 2
    (tmp_path / "odd.warc").write_bytes(b"junk" + made)
    with pytest.raises(ValueError, match="1 files"):
        warc.read(spark, f"file://{tmp_path}/odd.warc")
    assert warc.read(spark, f"file://{tmp_path}/odd.warc", strict=False).count() == 0


def test_files_are_plain_warc(spark, tmp_path):
    """Read by hand, record after record, by their lengths alone."""
    path = f"{tmp_path}/plain.warc"
    warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), f"file://{path}")
    (file,) = Path(path).glob("part-*")
    data, at, kinds = file.read_bytes(), 0, []
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at)
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        kinds.append(fields["WARC-Type"])
        at = end + 4 + int(fields["Content-Length"]) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
    assert at == len(data) and sorted(kinds) == sorted(r[3] for r in expected(ROWS))
