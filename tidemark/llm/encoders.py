"""Exact encoding by a vocabulary file through a cache of chunks that the pre-tokeniser never joins.

A slice of texts is cut by numpy over its bytes, its chunks are numbered by Arrow's dictionary encoding, each distinct chunk is looked up once (or encoded
by the tokenizers library, once for each worker), and the ids of all texts are put together by one take.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from tidemark.llm.common import SPACE, buffers

#: Chunks kept by a Python worker; beyond it the cache starts anew.
CACHED = 600_000
#: Bytes of text that are encoded together.
SLICE = 4 << 20
#: What sends a chunk to the library by itself: numbers, letters beyond the Latin ones, control characters.
ALONE = r"[^\W_a-zA-Z\u00c0-\u024f]|[\x00-\x1f\x7f-\x9f]"
#: Chunks that are encoded in one call.
JOINED = 100
#: White space beyond ASCII, in UTF-8 (fixed values of the Unicode standard).
WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts, and where ASCII white space follows anything but white space."""
    mark, blank = np.zeros(len(data), bool), SPACE[data]
    np.greater(blank[1:], blank[:-1], out=mark[1:])
    far = np.flatnonzero(mark[1:] & (data[:-1] >= 0x80)) + 1
    for end in WIDE_SPACE if len(far) else []:
        same = np.ones(len(far), bool)
        for k, byte in enumerate(reversed(end), 1):
            same &= data[np.maximum(far - k, 0)] == byte
        mark[far[same]] = False
    mark[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(mark)


class Chunked:
    """Encodes texts with the tokenizers library, each distinct chunk once. Chunks end where no pre-token can span, so the ids equal those of the whole text.

    The library's own default holds for special tokens: their strings in a text become their ids, and a chunk with one is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = re.compile("|".join([ALONE, self.blank, *map(re.escape, added)])).search
        self.mark = self.tokenizer.encode(" 0", add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.edge, self.seen = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def shrink(self) -> None:
        """Keeps the chunks that came more than once."""
        keep = [c for c, often in zip(self.known, self.seen.tolist(), strict=True) if often]
        if len(keep) > CACHED // 2:
            return self.clear()
        size = np.diff(self.edge)
        self.flat = self.flat[np.repeat(self.seen, size)]
        self.edge = np.concatenate([[0], np.cumsum(size[self.seen])])
        self.known, self.seen = dict(zip(keep, range(len(keep)), strict=True)), np.zeros(len(keep), bool)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """Encodes chunks, JOINED to a text with a lone zero between them: its token comes from nothing else, as chunks that hold a number, a special token or odd white space go alone."""
        texts = [self.text(c) for c in new]
        alone = [bool(self.apart(x)) for x in texts]
        together, apart = ([c for c, x in zip(new, alone, strict=True) if x is kind] for kind in (False, True))
        one = [x for x, kind in zip(texts, alone, strict=True) if not kind]
        groups = [one[i : i + JOINED] for i in range(0, len(one), JOINED)]
        joined = self.whole([self.gap.join(g) + self.gap for g in groups])
        rest = self.whole([x for x, kind in zip(texts, alone, strict=True) if kind])
        ids = np.fromiter((i for x in joined for i in x), np.uint32)
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(one):
            raise RuntimeError("chunks were joined across a mark")
        sizes = np.concatenate([np.diff(ends, prepend=-1) - 1, np.array([len(x) for x in rest], np.int64)])
        self.known.update(zip(together + apart, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, np.delete(ids, ends), np.fromiter((i for x in rest for i in x), np.uint32)])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes)])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), bool)])

    def ids(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with end_id behind it, and where each text's ids begin, plus the end. A null is empty."""
        if len(self.known) > CACHED:
            self.shrink()
        data, offsets = buffers(column)
        begin = cuts(data, offsets)
        places = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, places, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        chunks, known = coded.dictionary.to_pylist(), self.known
        old = len(known)
        if new := [c for c in chunks if c not in known]:
            self.learn(new)
        own = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        self.seen[own[own < old]] = True
        entry = own[np.asarray(coded.indices)]
        size = self.edge[entry + 1] - self.edge[entry]
        before = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.arange(before[-1]) + np.repeat(self.edge[entry] - before[:-1], size)]
        bounds = before[np.searchsorted(begin, offsets)]
        if end_id is not None:
            out = np.insert(out, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return out.astype("<u4", copy=False), bounds


class Spaced(Chunked):
    """For a byte-level pre-tokeniser whose only white space inside a token is one leading space."""

    blank, gap = r"\s\Z", " 0"

    def text(self, chunk: bytes) -> str:
        return chunk.decode()


class Dropped(Chunked):
    """For a pre-tokeniser that drops white space."""

    blank, gap = r"\s", " 0 "

    def text(self, chunk: bytes) -> str:
        return chunk.lstrip(b" \t\n\r\x0b\x0c").decode()


_made: dict[tuple[type, str], Chunked] = {}


def encoder(kind: type[Chunked], path: str) -> Chunked:
    """One for each worker process: it outlives a task, so its cache stays warm."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


def vocabulary_size(path: str) -> int:
    """Ids of a vocabulary file, special tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
