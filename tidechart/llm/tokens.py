"""Words and word windows of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts are worked on in pieces of whole documents of
about PIECE_BYTES, so memory is bounded by that or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
U = np.uint64
#: Keys of the two word hashes; words over LONG_WORD bytes are hashed by BLAKE2.
KEY, KEY2 = 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B
LONG_WORD = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n; kept for later calls."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        _POWERS[base] = tuple(np.concatenate([[U(1)], np.multiply.accumulate(np.full(size - 1, x, dtype=np.uint64))]) for x in (base, inverse))
    up, down = _POWERS[base]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = KEY) -> np.ndarray:
    """A keyed 64-bit hash of each word data[start:end].

    Words are taken in by eight bytes at a time, each time scrambled by `mix`: words of equal length up to eight
    bytes never collide, and no algebra of the bytes makes longer ones collide.
    """
    size = end - start
    h = mix(U(key) + size.astype(np.uint64))
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    todo, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        chunk = np.ascontiguousarray(wide[(start[todo] + at)[:, None] + np.arange(8)]).view("<u8").ravel()
        h[todo] = mix((h[todo] ^ (chunk & _FIRST[np.minimum(size[todo] - at, 8)])) + U(0x9E3779B97F4A7C15))
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        own = blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little"))
        h[i] = U(int.from_bytes(own.digest(), "little"))
    return h


@dataclass
class Piece:
    """Words of the documents first..last-1 of a column, in order. doc: each word's document less `first`.

    data: the documents' bytes, with A-Z in lower case where that was asked for; offsets, start, end: places in them.
    """

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.last - self.first)

    @cached_property
    def hash2(self) -> np.ndarray:
        """A second hash of each word's bytes, under another key."""
        return word_hashes(self.data, self.start, self.end, KEY2)

    def windows(self, k: int, second: bool = False) -> np.ndarray:
        """Hashes of the k words from each word on; the last k-1 windows of a document run into the next."""
        return window_hashes(self.hash2, k, _BASE2) if second else window_hashes(self.hash, k, _BASE)


def window_hashes(h: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + U(k))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, lower: bool = False, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield piece(data, offsets, first, last, lower)
        first = last


def piece(data: np.ndarray, offsets: np.ndarray, first: int, last: int, lower: bool) -> Piece:
    begin, stop = int(offsets[first]), int(offsets[last])
    own, at = data[begin:stop], offsets[first : last + 1] - begin
    if not len(own):
        none = np.zeros(0, np.int64)
        return Piece(first, last, own, at, none, none, none, np.zeros(0, np.uint64))
    word = ~_SPACE[own]
    cut = np.zeros(len(own) + 1, bool)
    cut[at] = True
    before = np.empty(len(own), bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(len(own), bool)
    after[-1], after[:-1] = False, word[1:]
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    own = _LOWER[own] if lower else own
    return Piece(first, last, own, at, start, end, doc, word_hashes(own, start, end))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of `width` values from each place on, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
