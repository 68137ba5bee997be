"""The md5 draws of ``mathx.uniform`` for many numbers at once, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SHIFT = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).tolist()
_ADD = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _blocks(size: int) -> int:
    """Blocks of 64 bytes that a message of so many bytes takes."""
    return (size + 8) // 64 + 1


class NumberedKeys:
    """Keys ``<prefix><number><tail>`` of the numbers first..first + count - 1, for any prefix of one length.

    All keys take the same number of md5 blocks.
    """

    def __init__(self, size: int, first: int, count: int, tail: bytes = b""):
        numbers = np.arange(first, first + count)
        width = np.char.str_len(numbers.astype("S"))
        length = size + width + len(tail)
        self.size, self.blocks = size, _blocks(int(length.max()))
        data = np.zeros((count, 64 * self.blocks), dtype=np.uint8)
        for w in np.unique(width).tolist():
            rows, end = np.flatnonzero(width == w), size + w
            for j in range(w):
                data[rows, end - 1 - j] = numbers[rows] // 10**j % 10 + 48
            data[rows, end:end + len(tail) + 1] = np.frombuffer(tail + b"\x80", dtype=np.uint8)
        words = np.ascontiguousarray(data.view("<u4").T)
        words[-2] = 8 * length
        # A word that all keys share is one number.
        self.words = [x if (x != x[0]).any() else int(x[0]) for x in words]

    def kept(self, where: np.ndarray) -> NumberedKeys:
        """The same for some of the numbers."""
        out = object.__new__(NumberedKeys)
        out.size, out.blocks = self.size, self.blocks
        out.words = [x if isinstance(x, int) else x[where] for x in self.words]
        return out

    def uniform(self, prefix: bytes, count: int) -> np.ndarray:
        """A number in [0, 1) for each key: the first 13 digits of its md5 over 16 ** 13."""
        head = np.frombuffer(prefix.ljust(-(-len(prefix) // 4) * 4, b"\0"), dtype="<u4").tolist()
        words = [w | h if isinstance(w, int) else w | np.uint32(h) for w, h in zip(self.words, head)] + self.words[len(head):]
        state = [np.full(count, x, dtype=np.uint32) for x in _START]
        for at in range(0, len(words), 16):
            state = _mixed(state, words[at:at + 16])
        a, b = (x.byteswap() for x in state[:2])
        return ((a.astype(np.uint64) << np.uint64(20)) | (b >> np.uint32(12))) / 4503599627370496.0


def _mixed(state: list[np.ndarray], words: list) -> list[np.ndarray]:
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        word, shift = words[_WORD[i]], _SHIFT[i]
        if isinstance(word, int):
            f += np.uint32((word + _ADD[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_ADD[i])
        np.right_shift(f, np.uint32(32 - shift), out=t)
        np.left_shift(f, np.uint32(shift), out=f)
        np.bitwise_or(f, t, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + y for x, y in zip(state, (a, b, c, d))]


def numbered_spans(total: int, size: int, step: int) -> Iterator[tuple[int, int]]:
    """(first, count) of the numbers below ``total``, at most ``step`` at once, whose keys take equally many blocks when
    ``size`` bytes stand beside the number."""
    first = 0
    while first < total:
        width = len(str(first))
        end = 10**width
        while end < total and _blocks(size + len(str(end))) == _blocks(size + width):
            end *= 10
        end = min(end, total, first + step)
        yield first, end - first
        first = end
