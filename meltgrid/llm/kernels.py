"""Vectorised text kernels for use inside Arrow map tasks.

A record batch is walked in slices of about ``SLICE`` bytes of text (one longer text is a slice of its own), so
a task holds a few dozen bytes per byte of a slice whatever its partition holds.  Null texts count as empty.
Hashes are polynomial sums over scrambled symbols modulo the prime 2^61 - 1, finished by an avalanche step; two
different strings of n symbols agree for at most n - 1 of the 2^61 bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

PRIME = np.uint64((1 << 61) - 1)
_BYTE = np.random.default_rng(20).permutation(1 << 20)[:256].astype(np.uint64) + np.uint64(1 << 20)
_BASE = int(np.random.default_rng(61).integers(1 << 60, (1 << 61) - 1))
_UP = np.ones(1, dtype=np.uint64)
_DOWN = np.ones(1, dtype=np.uint64)
_LOW, _MID = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_S61, _S31, _S30 = np.uint64(61), np.uint64(31), np.uint64(30)
_STRETCH, _LONG = 1 << 15, 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(t: np.ndarray) -> np.ndarray:
    """Values below 2^64 modulo the prime."""
    t = (t & PRIME) + (t >> _S61)
    return np.where(t >= PRIME, t - PRIME, t)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of values below 2^61, in halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW, b >> _S31, b & _LOW
    mid = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (mid >> _S30) + ((mid & _MID) << _S31) + a0 * b0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        inverse = pow(_BASE, -1, int(PRIME))
        while len(_UP) < max(n, 1 << 16):
            k = len(_UP)
            _UP, _DOWN = (np.concatenate([x, _times(x, np.full(k, pow(g, k, int(PRIME)), dtype=np.uint64))])
                          for x, g in ((_UP, _BASE), (_DOWN, inverse)))
    return _UP, _DOWN


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE):
    """(rows as a record batch, their bytes, offsets of the rows in these bytes) for each slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        if col.null_count:
            col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        _, off, data = col.buffers()
        off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
        off = off.astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums over scrambled symbols; see ``span_hash``.

    Symbols are taken in stretches that stay in a processor's cache.
    """
    n = len(symbols)
    up, out, last = _powers(n + 1)[0], np.zeros(n + 1, dtype=np.uint64), np.uint64(0)
    small = n > 0 and int(symbols.max()) < 1 << 21
    for at in range(0, n, _STRETCH):
        a, b = symbols[at:at + _STRETCH], up[at:min(at + _STRETCH, n)]
        if small:  # one half of a product has no upper part
            mid = a * (b >> _S31)
            term = a * (b & _LOW)
            term += mid >> _S30
            mid &= _MID
            mid <<= _S31
            term += mid
        else:
            term = _times(a & PRIME, b)
        # Both halves are summed for themselves, so that sums of many terms stay below 2^64.
        high = np.cumsum(term >> _S31)
        term &= _LOW
        total = np.cumsum(term)
        total += high >> _S30
        high &= _MID
        high <<= _S31
        total += high
        total += last
        part = out[at + 1:at + 1 + len(a)]
        np.bitwise_and(total, PRIME, out=part)
        total >>= _S61
        part += total
        part -= PRIME * (part >= PRIME)
        last = part[-1]
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols start..end-1; equal spans have equal hashes wherever they stand."""
    down = _powers(len(pre))[1]
    value = _times(_reduced(pre[end] + (PRIME - pre[start])), down[start])
    return mix(value + (end - start).astype(np.uint64))


def piece_hash(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``span_hash`` of consecutive pieces of bytes, given by their lengths (above 0).

    No running sums are needed: terms are summed piece by piece, in two halves that hold ``_LONG`` of them.
    """
    out = np.zeros(len(length), dtype=np.uint64)
    end = np.cumsum(length)
    up = _powers(_LONG)[0][:_LONG]
    power_high, power_low = up >> _S31, up & _LOW
    at = 0
    while at < len(length):
        low = int(end[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(end, low + _STRETCH, "right")))
        if length[at] > _LONG:
            pre = prefix(_BYTE[data[low:int(end[at])]])
            out[at] = pre[-1]
            at += 1
            continue
        if int(length[at:to].max()) > _LONG:
            to = at + int(np.argmax(length[at:to] > _LONG))
        size = length[at:to]
        head = end[at:to] - size - low
        symbols = _BYTE[data[low:int(end[to - 1])]]
        place = np.arange(len(symbols))
        place -= np.repeat(head, size)
        high = np.add.reduceat(symbols * power_high[place], head)
        rest = np.add.reduceat(symbols * power_low[place], head)
        out[at:to] = _reduced((high >> _S30) + ((high & _MID) << _S31) + (rest & PRIME) + (rest >> _S61))
        at = to
    return mix(out + length.astype(np.uint64))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


class Words:
    """Words of a slice: ``start``/``end`` byte positions, ``bounds`` word range per row, ``hash`` per word."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        solid = ~WHITE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        before = np.empty(n, dtype=bool)
        before[:1] = True
        np.logical_not(solid[:-1], out=before[1:])
        self.start = np.flatnonzero(solid & (before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[-1:] = True
        np.logical_not(solid[1:], out=after[:-1])
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, off)
        self.data = data

    @property
    def hash(self) -> np.ndarray:
        return piece_hash(self.data[~WHITE[self.data]], self.end - self.start)

    def rows(self) -> np.ndarray:
        """Row of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def window_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Every position at which n consecutive symbols of one row start."""
    total = int(bounds[-1])
    last = np.repeat(bounds[1:], np.diff(bounds))
    return np.flatnonzero(np.arange(total) + n <= last) if total else np.zeros(0, dtype=np.int64)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-word window; a row of 1 to n-1 words gives its whole sequence once."""
    symbols, bounds = words.hash, words.bounds
    pre = prefix(symbols)
    at = window_starts(bounds, n)
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    start = np.concatenate([at, bounds[short]])
    end = np.concatenate([at + n, bounds[short + 1]])
    row = np.concatenate([np.searchsorted(bounds, at, "right") - 1, short])
    order = np.argsort(row, kind="stable")
    return span_hash(pre, start, end)[order], row[order]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for every i that has w values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def blocks(symbols: np.ndarray, bounds: np.ndarray, size: int, k: int):
    """Cut the windows of ``size`` symbols into runs that choose the same anchor.

    Each window chooses the leftmost smallest of its k-symbol hashes, which depends on its own symbols only; so
    equal windows choose equal anchors at equal distances, and the windows of one anchor are consecutive.
    Returns (anchor hash, hash of all symbols and offsets of the run, row, first window within the row, windows).
    """
    none = np.zeros(0, dtype=np.int64)
    at = window_starts(bounds, size)
    if not len(at):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    pre = prefix(symbols)
    i = np.arange(len(symbols) - k + 1)
    key = span_hash(pre, i, i + k)
    low = np.uint64((1 << int(len(key)).bit_length()) - 1)
    anchor = (_sliding_min((key & ~low) | i.astype(np.uint64), size - k + 1) & low).astype(np.int64)[at]
    cut = np.ones(len(at), dtype=bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(cut)
    count = np.diff(np.append(head, len(at)))
    first, anchor = at[head], anchor[head]
    shape = ((anchor - first) * 1_000_003 + count).astype(np.uint64)
    whole = mix(span_hash(pre, first, first + count - 1 + size) + shape)
    row = np.searchsorted(bounds, first, "right") - 1
    return key[anchor], whole, row, first - bounds[row], count


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed values, for Arrow and Spark."""
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def spans_to_mask(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions first..last-1 of any span."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, np.minimum(first, n), 1)
    np.add.at(step, np.minimum(last, n), -1)
    return np.cumsum(step[:n]) > 0
