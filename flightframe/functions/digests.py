"""MD5 of many short texts at once, in numpy: every step goes over all texts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

#: Texts at once, so that what a step reads and writes stays in a processor's own memory.
AT_ONCE = 1 << 14
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNED = [turn for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in turns * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: One block has room for so many bytes of text; a number and the closing byte together are written as two words.
_ROOM, _DIGITS = 55, 4


def _md5(words: list[np.ndarray | None]) -> list[np.ndarray]:
    """The four words of the digest, from the sixteen of one block; None stands for zeros."""
    n = len(words[14])
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    mixed, spare = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, (added, turned) in enumerate(zip(_ADDED, _TURNED)):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=mixed)
            np.bitwise_and(mixed, b, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_and(mixed, d, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        else:
            k = 7 * i % 16
            np.invert(d, out=mixed)
            np.bitwise_or(mixed, b, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
        a += mixed
        a += np.uint32(added)
        if words[k] is not None:
            a += words[k]
        np.right_shift(a, np.uint32(32 - turned), out=spare)
        np.left_shift(a, np.uint32(turned), out=a)
        a |= spare
        a += b
        a, b, c, d = d, a, b, c
    return [v + np.uint32(start) for v, start in zip((a, b, c, d), _START)]


class Digests:
    """MD5 of ``names[i]``, ``mark`` and a whole number from 0 to ``most``, as the hexadecimal text of it is read: digits 1 to
    13, and 14 to 26, each as a number."""

    def __init__(self, names: pa.StringArray, mark: bytes, most: int) -> None:
        ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]
        data, sizes = np.frombuffer(names.buffers()[2] or b"", np.uint8), np.diff(ends)
        self.digits = np.arange(most + 1).astype(f"S{len(str(most))}")
        self.single = len(str(most)) <= _DIGITS and sizes.max(initial=0) + len(mark) + _DIGITS <= _ROOM
        if not self.single:
            self.names = [data[low:high].tobytes() + mark for low, high in zip(ends, ends[1:])]
            return
        # Names with the mark after them and zeros up to the end, as words.
        self.sizes = sizes.astype(np.int64) + len(mark)
        rows = np.zeros((len(sizes), self.sizes.max(initial=0) // 4 * 4 + 8), np.uint8)
        rows[np.arange(rows.shape[1]) < sizes[:, None]] = data[ends[0] : ends[-1]]
        rows[np.arange(len(sizes))[:, None], sizes[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
        self.words = np.ascontiguousarray(rows.view("<u4").T)
        # Digits and the closing byte, to be moved to where the name ends.
        self.shift, self.word = (8 * (self.sizes % 4)).astype(np.uint64), self.sizes // 4
        self.lengths = np.char.str_len(self.digits).astype(np.int64)
        self.tails = np.char.add(self.digits, b"\x80").astype("S8").view("<u8")

    def numbers(self, row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For names ``row`` with ``number`` each."""
        if not self.single:
            found = [hashlib.md5(self.names[i] + self.digits[n], usedforsecurity=False).hexdigest() for i, n in zip(row.tolist(), number.tolist())]
            return np.array([int(f[:13], 16) for f in found], np.int64), np.array([int(f[13:26], 16) for f in found], np.int64)
        block = np.take(self.words, row, axis=1)
        tail, flat, at = self.tails[number] << self.shift[row], block.reshape(-1), self.word[row] * len(row) + np.arange(len(row))
        flat[at] |= tail.astype(np.uint32)
        flat[at + len(row)] |= (tail >> np.uint64(32)).astype(np.uint32)
        words = [*block, *[None] * (16 - len(block))]
        words[14] = ((self.sizes[row] + self.lengths[number]) * 8).astype(np.uint32)
        a, b, c, d = (v.byteswap().astype(np.int64) for v in _md5(words))
        return a << 20 | b >> 12, (b & 0xFFF) << 40 | c << 8 | d >> 24
