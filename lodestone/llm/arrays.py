"""Vectorised text primitives over Arrow string columns.

Texts stay UTF-8 bytes.  Words are hashed eight bytes at a time with a mixer after
each step (long ones by BLAKE2), and windows of symbols by joining the hashes of their halves; there is
no sum of powers, whose structure lets chosen texts collide.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Odd multipliers: of what a word's hash begins with, between steps, and of lengths.
FIRST, STEP, LENGTH = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)
#: The bytes that count in the last eight of a word; words beyond LONG bytes are hashed one by one.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
LONG = 64


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of one sequence followed by another, from their hashes."""
    return mix((a ^ (a >> U64(31))) * STEP + b)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place (and at the end), zeros beyond the text."""
    held = np.zeros(len(raw) + 8, dtype=np.uint8)
    held[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", held, 0, (1,))


class Windows:
    """Hashes of the windows of a sequence of symbols, each the join of its first and its last symbols,
    as many as the greatest power of two that fits.  `width`: the symbols behind each element."""

    def __init__(self, elements: np.ndarray, width: int = 1):
        self.elements, self.width = elements, width
        self._level: tuple[int, np.ndarray] = (width, elements)

    @classmethod
    def of_bytes(cls, raw: np.ndarray) -> Windows:
        """Windows of at least eight bytes."""
        return cls(mix(eights(raw)[: max(0, len(raw) - 7)] + FIRST), 8)

    def level(self, p: int) -> np.ndarray:
        """The windows of p symbols, p the width times a power of two; the last one asked for is remembered."""
        have, x = self._level if self._level[0] <= p else (self.width, self.elements)
        while have < p:
            x = joined(x[:-have], x[have:])
            have *= 2
        self._level = (have, x)
        return x

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        out = np.zeros(len(n), dtype=U64)
        power = np.frexp(np.maximum(n // self.width, 1))[1] - 1
        for k in np.flatnonzero(np.bincount(power)).tolist() if len(n) else ():
            at = np.flatnonzero(power == k)
            p = self.width << k
            x = self.level(p)
            out[at] = joined(x[start[at]], x[end[at] - p]) + n[at].astype(U64) * LENGTH
        return out

    def of(self, k: int) -> np.ndarray:
        """All windows of k symbols, in order."""
        p = self.width << (k // self.width).bit_length() - 1
        x = self.level(p)
        n = len(self.elements) + self.width - k
        return joined(x[:n], x[k - p : k - p + n]) + U64(k * int(LENGTH) & (1 << 64) - 1) if n > 0 else np.zeros(0, U64)


def in_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow column as its bytes and row offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def parts(batch: pa.RecordBatch, text: str, most: int = 2_000_000, rows: int = 1 << 30):
    """Row ranges of a batch with about so many bytes of text, and rows, at most (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, off = in_bytes(batch.column(text))
    at = 0
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def classes(pattern: str) -> np.ndarray:
    """By byte: is it part of a word?  'space': all but space and tab to carriage
    return; 'alnum': digits, ASCII letters and every byte from 0x80."""
    t = np.zeros(256, dtype=bool)
    if pattern == "space":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(raw: np.ndarray, off: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offsets of the rows.  No word crosses rows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = classes(pattern)[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = inside[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    n = end - start
    h = mix(n.astype(U64) * LENGTH + U64(seed * int(FIRST) & (1 << 64) - 1))
    chunk = eights(raw)
    long = np.flatnonzero(n > LONG)
    live, at, left = np.arange(len(n)), start, n
    if len(long):
        live = np.flatnonzero(n <= LONG)
        at, left = start[live], n[live]
    whole = len(live) == len(n)
    while len(live):
        c = chunk[at] & MASKS[np.minimum(left, 8)]
        if whole:
            h = mix((h ^ c) * STEP + FIRST)
        else:
            h[live] = mix((h[live] ^ c) * STEP + FIRST)
        more = left > 8
        live, at, left, whole = live[more], at[more] + 8, left[more] - 8, False
    for i in long.tolist():
        h[i] = int.from_bytes(blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")
    return h


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Are the n bytes of a from a_start those of b from b_start?  (Pairs of slices, as arrays.)"""
    same = np.ones(len(n), dtype=bool)
    x, y = eights(a), eights(b)
    long = np.flatnonzero(n > LONG)
    live = np.flatnonzero((n > 0) & (n <= LONG))
    done = 0
    while len(live):
        mask = MASKS[np.minimum(n[live] - done, 8)]
        same[live] &= (x[a_start[live] + done] & mask) == (y[b_start[live] + done] & mask)
        done += 8
        live = live[n[live] > done]
    for i in long.tolist():
        same[i] = a[a_start[i] : a_start[i] + n[i]].tobytes() == b[b_start[i] : b_start[i] + n[i]].tobytes()
    return same


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and for each word which one it is.  Equal hashes are held
    against the bytes; should they ever differ, the bytes alone decide."""
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    first = one[which]
    n = end - start
    if not ((n == n[first]).all() and same_bytes(raw, start, raw, start[first], n).all()):
        known: dict[bytes, int] = {}
        one_, which = [], np.empty(len(n), dtype=np.int64)
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            which[i] = known.setdefault(raw[a:b].tobytes(), len(known))
            if which[i] == len(one_):
                one_.append(i)
        one = np.array(one_, dtype=np.int64)
    return one, which


def owners(off: np.ndarray) -> np.ndarray:
    """The row of each element, from row offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenated ranges start[i] .. start[i] + length[i]."""
    length = length.astype(np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start.astype(np.int64) - before, length)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.view(np.int64)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n elements lie in one of the spans start..end."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0
