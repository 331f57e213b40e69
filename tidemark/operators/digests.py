"""The first eight hex digits of many MD5 digests at once: the steps of MD5 on numpy arrays, for short texts that share a beginning."""

from __future__ import annotations

import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_AT = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that one block of MD5 takes.
MOST = 55


class Endings:
    """Texts by their ends; numbers(beginning) are those of beginning + end, in the order of the ends."""

    def __init__(self, ends: list[bytes]):
        size = np.fromiter(map(len, ends), np.int64, len(ends))
        text = np.array(ends, "S")
        self.count, self.parts, self.words = len(ends), [], {}
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            self.parts.append((at, np.frombuffer(b"".join(text[at].tolist()), np.uint8).reshape(len(at), n) if n else np.zeros((len(at), 0), np.uint8)))

    @classmethod
    def counting(cls, before: bytes, start: int, stop: int) -> Endings:
        """The ends before + i, for i from start up to stop."""
        made = cls([])
        made.count = stop - start
        for digits in range(len(str(start)), len(str(stop - 1)) + 1):
            i = np.arange(max(start, 10 ** (digits - 1) if digits > 1 else 0), min(stop, 10**digits))
            own = i[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10 + 48
            made.parts.append((i - start, np.concatenate([np.tile(np.frombuffer(before, np.uint8), (len(i), 1)), own.astype(np.uint8)], axis=1)))
        return made

    def numbers(self, beginning: bytes) -> np.ndarray:
        got = np.empty(self.count, np.uint32)
        for k, (at, ends) in enumerate(self.parts):
            got[at] = _first(beginning, self._block(k, len(beginning), ends), len(at))
        return got

    def _block(self, k: int, at: int, ends: np.ndarray) -> list:
        """The sixteen words of the block without the beginning; words that no end touches are plain numbers."""
        if (k, at) not in self.words:
            n = ends.shape[1]
            if at + n > MOST:
                raise ValueError(f"texts have at most {MOST} bytes")
            block = np.zeros((len(ends), 64), np.uint8)
            block[:, at : at + n] = ends
            block[:, at + n] = 0x80
            words = block.view("<u4")
            own = range(at // 4, (at + n) // 4 + 1)
            self.words[k, at] = [np.ascontiguousarray(words[:, j]) if j in own else (at + n) * 8 if j == 14 else 0 for j in range(16)]
        return self.words[k, at]


def _first(beginning: bytes, block: list, count: int) -> np.ndarray:
    start = np.frombuffer(beginning.ljust(64, b"\0"), "<u4")
    a, b, c, d = (np.full(count, v, np.uint32) for v in _START)
    f, x = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i in range(61):  # the last three steps do not change the first word
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        j = _AT[turn](i)
        f += a
        f += np.uint32((_K[i] + int(start[j]) + (0 if isinstance(block[j], np.ndarray) else block[j])) & 0xFFFFFFFF)
        if isinstance(block[j], np.ndarray):
            f += block[j]
        s = _TURN[turn][i % 4]
        np.left_shift(f, np.uint32(s), out=x)
        f >>= np.uint32(32 - s)
        f |= x
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap()
