"""Words of whole texts as arrays: positions and 64-bit hashes of a batch without a Python loop per word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of characters other than these, as in ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20_240_611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept per process."""
    global _POWERS, _DOWN
    if len(_POWERS) < size:
        room = max(size, 1 << 20)
        up, down = np.full(room, _BASE), np.full(room, _INVERSE)
        up[0] = down[0] = 1
        _POWERS, _DOWN = np.cumprod(up), np.cumprod(down)
    return _POWERS[:size], _DOWN[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch(NamedTuple):
    """``raw``: bytes of all texts, each followed by a space; word ``i`` is ``raw[starts[i]:ends[i]]``;
    the words of text ``d`` are ``first[d]:first[d + 1]``, its bytes begin at ``begin[d]``."""

    raw: np.ndarray
    space: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    begin: np.ndarray

    def owner(self) -> np.ndarray:
        """Text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, keep: np.ndarray, text: int) -> bytes:
        """Kept words of a text, joined by one space."""
        a, b = self.first[text], self.first[text + 1]
        chosen = np.flatnonzero(keep[a:b]) + a
        raw = self.raw
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[chosen], self.ends[chosen], strict=True))


def words(texts: pa.Array) -> Batch:
    """Words of a string column (null: none)."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    plain = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    local = offsets - offsets[0]
    raw = np.insert(plain, local[1:], 32)
    begin = local + np.arange(len(local))
    space = _SPACE[raw]
    solid = np.concatenate([[False], ~space, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[0::2], edges[1::2]
    return Batch(raw, space, starts, ends, np.searchsorted(starts, begin), begin)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values, mixed."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(batch: Batch) -> np.ndarray:
    return span_hashes(batch.raw, batch.starts, batch.ends)


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` hashes from every position on (positions near the end: of what wraps nothing, zeros)."""
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    out = np.full(len(hashes), np.uint64(seed))
    for i in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + padded[i : i + len(hashes)])
    return out


def rolling_hashes(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """As ``window_hashes`` in constant work per position: a mixed polynomial over re-mixed hashes."""
    up, down = _powers(len(hashes) + size + 1)
    total = np.zeros(len(hashes) + size + 1, np.uint64)
    values = mix(hashes ^ mix(np.full(1, seed, np.uint64)))
    np.cumsum(np.concatenate([values, np.zeros(size, np.uint64)]) * up[:-1], out=total[1:])
    at = np.arange(len(hashes))
    return mix((total[at + size] - total[at]) * down[at])


def inside(batch: Batch, size: int) -> np.ndarray:
    """Whether the ``size`` words from a position on belong to one text."""
    last = np.repeat(batch.first[1:], np.diff(batch.first))
    return np.arange(len(batch.starts)) + size <= last


def covered(marks: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Positions covered by a span of ``size`` that begins at a marked position."""
    change = np.zeros(len(marks) + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(change, at, 1)
    np.subtract.at(change, np.minimum(at + (size if np.isscalar(size) else size[at]), len(marks)), 1)
    return np.cumsum(change[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` of every text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
