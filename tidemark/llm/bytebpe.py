"""Byte-level BPE (operator 10): pre-tokenisation by a scan of transition functions over code-point classes, cached pair merging, decoding by offsets.

The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ . Each code point gets a class that
already holds the look-ahead it needs (does white space follow, does a contraction follow), so a nine-state automaton finds the boundaries.
A class is a function from states to states; composing functions is associative, so blocks of text are reduced side by side and joined by a scan.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import slices
from tidemark.session import ship

LETTER, NUMBER, OTHER, SPACE_MID, SPACE_LAST, OTHER_LAST, SHORT, LONG, NONE = range(9)  # classes; NONE fills up blocks
IN_L, IN_N, IN_O, IN_W, PREFIX, DONE, ONE_MORE, TWO_MORE, START = range(9)  # states
#: Code points with the property White_Space (fixed values of the Unicode standard).
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 256


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """After state and whether a token starts, by class and state; the classes from 9 on are those of a text's first code point, whatever the state."""
    after, starts = np.zeros((18, 9), np.uint8), np.zeros((18, 9), bool)
    for c in range(9):
        for s in range(9):
            pending = s in (ONE_MORE, TWO_MORE)
            if c == NONE:
                to, new = s, False
            elif pending:
                to, new = (DONE if s == ONE_MORE else ONE_MORE), False
            elif c in (LETTER, NUMBER, OTHER):
                to = (IN_L, IN_N, IN_O)[c]
                new = s not in (to, PREFIX)
            elif c in (SHORT, LONG):
                run = s in (IN_O, PREFIX)
                to, new = (IN_O if run else ONE_MORE if c == SHORT else TWO_MORE), not run
            elif c == SPACE_MID:
                to, new = IN_W, s != IN_W
            else:
                to, new = (PREFIX if c == SPACE_LAST else DONE), True
            after[c, s], starts[c, s] = to, new
    after[9:], starts[9:] = after[:9, [START] * 9], True
    return after, starts


AFTER, STARTS = _transitions()
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space for each code point, from the Unicode database."""
    global _kinds
    if _kinds is None:
        first = {"L": LETTER, "N": NUMBER}
        _kinds = np.fromiter((first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        _kinds[WHITE] = 3
    return _kinds


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each code point; `first` marks those that begin a text."""
    kind = kinds()[points]
    n = len(points)
    white = kind == 3
    ahead = np.zeros(n + 2, np.uint32)
    ahead[:n] = points
    own = np.ones(n + 2, bool)  # the next code point belongs to another text
    own[:n] = first
    out = kind.copy()
    mid = white & (np.concatenate([white[1:], [True]]) | own[1 : n + 1])
    out[white] = np.where(points == 0x20, SPACE_LAST, OTHER_LAST)[white]
    out[mid] = SPACE_MID
    at = np.flatnonzero((points == 0x27) & ~own[1 : n + 1])
    one, two = ahead[at + 1], np.where(own[at + 2], 0, ahead[at + 2])
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    out[at[long]] = LONG
    return out + np.uint8(9) * first


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of each code point that begins a token."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, NONE, np.uint8)
    padded[:n] = classes(points, first)
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T).astype(np.int64) * 9
    flat, emit = AFTER.reshape(-1), STARTS.reshape(-1)
    whole = np.broadcast_to(np.arange(9, dtype=np.uint8), (rows, 9))
    for line in grid:  # each block's function, all blocks at once
        whole = flat[line[:, None] + whole]
    step = 1
    while step < rows:  # inclusive scan of the blocks' functions
        joined = whole.copy()
        joined[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.int64), 1)
        whole, step = joined, 2 * step
    state = np.concatenate([[START], whole[:-1, START]]).astype(np.uint8)
    marks = np.empty((BLOCK, rows), bool)
    for k, line in enumerate(grid):
        where = line + state
        marks[k] = emit[where]
        state = flat[where]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


class ByteBPE:
    """Encodes as a rank file says, each pre-token once; decodes by table."""

    def __init__(self, path: str, cached: int = 700_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.cache: dict[bytes, bytes] = {}
        self.cached = cached

    def merged(self, piece: bytes) -> bytes:
        """Little-endian 32-bit ids of one pre-token: the adjacent pair of lowest rank is joined until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return ranks[piece].to_bytes(4, "little")
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self._merged_long(parts)
        pair = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while pair:
            best, at = None, -1
            for i, r in enumerate(pair):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pair[at - 1] = ranks.get(parts[at - 1] + parts[at])
        return b"".join(ranks[p].to_bytes(4, "little") for p in parts)

    def _merged_long(self, parts: list[bytes]) -> bytes:
        """The same for long pre-tokens: a heap of pairs over linked parts, ties to the left."""
        import heapq

        ranks, n = self.ranks, len(parts)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], nxt[i] = a + b, b"", nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                if x >= 0 and nxt[x] < n and parts[x] and (r := ranks.get(parts[x] + parts[nxt[x]])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[nxt[x]]))
        return b"".join(ranks[p].to_bytes(4, "little") for p in parts if p)

    def encode(self, texts: list[str]) -> list[tuple[bytes, list[bytes]]]:
        """Ids of each text, and its pre-tokens."""
        if len(self.cache) > self.cached:
            self.cache.clear()
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        chars = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(points), bool)
        first[chars[:-1][np.diff(chars) > 0]] = True
        begin = boundaries(points, first)
        width = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
        data, cuts = whole.encode(), width[begin].tolist()
        tokens = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)] if cuts else []
        cache = self.cache
        for t in {t for t in tokens if t not in cache}:
            cache[t] = self.merged(t)
        where = np.searchsorted(begin, chars).tolist()
        return [(b"".join(map(cache.__getitem__, own)), own) for a, b in zip(where, where[1:], strict=False) for own in [tokens[a:b]]]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, ByteBPE] = {}


def encoded(spark: SparkSession, docs: DataFrame, ranks: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; with_ids adds ids and token_bytes (the length in bytes of each id's text: offsets for decoding).

    A null text is empty and has no ids; repeated rows stay; an empty table gives no row; a very long text is a slice of its own, and a very long pre-token is
    merged over a heap; other columns, whatever their names, are left out.
    """
    ship(spark)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, token_bytes array<int>" * with_ids

    def run(batches):
        if ranks not in _made:
            _made[ranks] = ByteBPE(ranks)
        bpe = _made[ranks]
        for batch in batches:
            for some in slices(batch, text_col):
                ids = [x for x, _ in bpe.encode([x or "" for x in some.column(text_col).to_pylist()])]
                cols = [some.column(id_col).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())]
                if with_ids:
                    lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
                    cols += [pa.array(lists, pa.list_(pa.int64())), pa.array([[len(bpe.bytes_of[i]) for i in x] for x in lists], pa.list_(pa.int32()))]
                yield pa.record_batch(cols, names=[x.strip().split()[0] for x in schema.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
