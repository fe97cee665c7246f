"""Vectorised word hashing over Arrow text columns.

Documents arrive in Arrow batches; :func:`blocks` cuts a batch into pieces of
bounded size, so the numpy work space never grows with a partition. Everything
works on UTF-8 bytes: all separators used by the operators are ASCII, so byte
classes decide word boundaries and no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes handled at once (a longer document forms a block of its own).
BLOCK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_LANE = _U(int(_rng.integers(2**40, 2**62)) | 1)
_GRAM = [_U(int(x) | 1) for x in _rng.integers(2**40, 2**62, 64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACE = np.ones(256, bool)          # words [^\x20\x09-\x0D]+
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)         # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Block:
    """Rows ``lo:hi`` of a batch; text of row ``lo+i`` is ``data[off[i]:off[i+1]]``."""

    lo: int
    hi: int
    off: np.ndarray
    data: np.ndarray
    valid: np.ndarray


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, bytes and validity of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    valid = np.asarray(col.is_valid()) if col.null_count else np.ones(n, bool)
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return off, data, valid


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    off, data, valid = column_bytes(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]], valid[lo:hi])
        lo = hi


@dataclass
class Words:
    """Words of a block: byte spans, 64-bit hashes, and each row's first word (length rows+1)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(b: Block, kind: np.ndarray) -> Words:
    """Words of ASCII-lower-cased text: maximal runs of bytes with ``kind[byte]``."""
    low = _LOWER[b.data]
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, _U), np.zeros(len(b.off), np.int64))
    inside = kind[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = b.off[:-1][b.off[:-1] < n]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = b.off[1:][b.off[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, _hashes(low, start, end), np.searchsorted(start, b.off, "left"))


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans: every 8-byte lane is mixed with its place before the lanes of a span are added up."""
    if not len(start):
        return np.zeros(0, _U)
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[:len(low)] = low
    windows = np.ndarray(len(low), np.dtype("<u8"), buffer=padded, strides=(1,))  # 8 bytes from every byte on
    length = end - start
    lanes = (length + 7) >> 3
    k = spread(lanes)
    rest = np.repeat(length, lanes) - 8 * k  # bytes of the span from this lane on
    lane = windows[np.repeat(start, lanes) + 8 * k]
    short = rest < 8
    lane[short] &= (_U(1) << (rest[short].astype(_U) * _U(8))) - _U(1)
    lane = mix(mix(lane + _U(1)) + _LANE * (k + 1).astype(_U))
    total = np.add.reduceat(lane, np.cumsum(lanes) - lanes)
    return mix(total + length.astype(_U) * _GRAM[63])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position (length len(h)-n+1)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.full(m, _GRAM[62] * _U(n) if n < 2 else _U((int(_GRAM[62]) * n) & (2**64 - 1)), _U)
    for i in range(n):
        out += h[i:i + m] * _GRAM[i % 60] + _U(i // 60)
    return mix(out)


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, concatenated."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
