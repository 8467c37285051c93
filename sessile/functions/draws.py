"""clean.draw of many keys at once in numpy: MD5 of short texts, a step of the digest for all of them together."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The first word of the digest is whole after 61 of the 64 steps; one block has texts of so many bytes.
_STEPS, _BLOCK = 61, 55
#: Digests that are made together, so that what a step reads and writes stays near the processor; fewer keys than FEW are not worth it.
TOGETHER, FEW = 24_576, 64


class Draws:
    """Numbers below 2**32 of prefix + key for the same keys and many prefixes: the first four bytes of the MD5."""

    def __init__(self, keys: Sequence[bytes]):
        self.keys = list(keys)
        self.lengths = np.array([len(k) for k in self.keys], np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self._words: dict[int, np.ndarray] = {}
        self._held: tuple[tuple[int, int], list[np.ndarray]] = ((0, 0), [])

    def numbers(self, prefixes: Sequence[bytes]) -> np.ndarray:
        """(prefixes, keys) as uint32."""
        out = np.empty((len(prefixes), len(self.keys)), np.uint32)
        if len(self.keys) < FEW or max(map(len, prefixes), default=0) + self.longest > _BLOCK:
            for row, prefix in zip(out, prefixes, strict=True):
                row[:] = np.frombuffer(b"".join([hashlib.md5(prefix + k).digest()[:4] for k in self.keys]), ">u4")
            return out
        parts = -(-len(self.keys) // TOGETHER)
        width = -(-len(self.keys) // parts)
        for length in sorted({len(p) for p in prefixes}):
            rows = [i for i, p in enumerate(prefixes) if len(p) == length]
            step = max(1, TOGETHER // width)
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                head = np.frombuffer(b"".join([prefixes[k].ljust(_BLOCK + 1, b"\0") for k in some]), "<u4").reshape(len(some), -1)
                for at in range(0, len(self.keys), width):
                    out[some, at : at + width] = self._digests(head, length, slice(at, at + width))
        return out

    def _tails(self, shift: int) -> np.ndarray:
        """The keys and the byte that ends a text as words (word, key), moved by so many bytes."""
        if shift not in self._words:
            size = -(-(shift + self.longest + 1) // 4) * 4
            text = b"".join([(b"\0" * shift + k + b"\x80").ljust(size, b"\0") for k in self.keys])
            self._words[shift] = np.ascontiguousarray(np.frombuffer(text, "<u4").reshape(len(self.keys), -1).T)
        return self._words[shift]

    def _digests(self, head: np.ndarray, length: int, keys: slice) -> np.ndarray:
        tails = dict(enumerate(self._tails(length % 4)[:, keys], length // 4))
        tails[14] = (self.lengths[keys] * 8).astype(np.uint32)  # the length in bits; the block is never so full that a key gets here
        fixed = {j: head[:, j : j + 1] for j in range(-(-length // 4))} | {14: np.full((1, 1), length * 8, np.uint32)}
        shape = (len(head), len(tails[14]))
        if self._held[0] != shape:
            self._held = (shape, [np.empty(shape, np.uint32) for _ in range(6)])
        a, b, c, d, f, turned = self._held[1]
        for x, start in zip((a, b, c, d), _START, strict=True):
            x.fill(start)
        for i in range(_STEPS):
            if i < 16:
                np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
            elif i < 32:
                np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
            elif i < 48:
                np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
            else:
                np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
            np.add(a, f, a)
            j, added, by = _WORD[i], np.array(_ADDED[i], np.uint32), _SHIFTS[i]
            np.add(a, fixed[j] + added if j in fixed else added, a)
            if j in tails:
                np.add(a, tails[j], a)
            np.left_shift(a, np.array(by, np.uint32), turned), np.right_shift(a, np.array(32 - by, np.uint32), a), np.bitwise_or(a, turned, a), np.add(a, b, a)
            a, b, c, d = d, a, b, c
        return (b + np.uint32(_START[0])).byteswap()
