"""Golomb codes of sorted numbers, in numpy.

The gaps of ascending distinct numbers in a range are coded with the divisor that
fits their mean. Three bit planes stand one after another, so that all codes are
read at once: quotients in unary, the leading bits of the truncated binary
remainders, and the last bit of those remainders that have one.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQQQ")


def divisor(n: int, span: int) -> int:
    """The Golomb parameter for ``n`` numbers spread over ``span`` values."""
    return max(1, round(0.693 * span / max(n, 1)))


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def encode(values: np.ndarray, low: int, span: int) -> bytes:
    """Ascending distinct ``values`` (uint64) of the range from ``low`` on."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, low, 1, 0)
    m = divisor(n, span)
    gaps = np.diff(values, prepend=np.uint64(low))
    gaps[1:] -= np.uint64(1)
    q, r = (gaps // np.uint64(m)).astype(np.int64), gaps % np.uint64(m)
    ends = np.cumsum(q + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    width = (m - 1).bit_length()
    short = np.uint64((1 << width) - m)
    long_ = r >= short
    word = np.where(long_, r + short, r)
    lead = np.where(long_, word >> np.uint64(1), word)
    planes = [(lead >> np.uint64(j)).astype(np.uint8) & 1 for j in range(width - 2, -1, -1)]
    fixed = np.stack(planes, 1).ravel() if planes else np.empty(0, np.uint8)
    last = (word[long_] & np.uint64(1)).astype(np.uint8) if width else np.empty(0, np.uint8)
    return _HEAD.pack(n, low, m, len(unary)) + _pack(unary) + _pack(fixed) + _pack(last)


def decode(code: bytes) -> np.ndarray:
    """The numbers back, ascending (uint64)."""
    n, low, m, n_unary = _HEAD.unpack_from(code)
    if not n:
        return np.empty(0, np.uint64)
    body = np.frombuffer(code, np.uint8, offset=_HEAD.size)
    width = (m - 1).bit_length()
    lead_bits = max(width - 1, 0)
    cut = (n_unary + 7) // 8
    cut2 = cut + (n * lead_bits + 7) // 8
    q = np.diff(np.flatnonzero(np.unpackbits(body[:cut], count=n_unary) == 0), prepend=-1) - 1
    word = np.zeros(n, np.uint64)
    fixed = np.unpackbits(body[cut:cut2], count=n * lead_bits).reshape(n, lead_bits)
    for j in range(lead_bits):
        word = (word << np.uint64(1)) | fixed[:, j]
    short = np.uint64((1 << width) - m)
    if width:
        long_ = word >= short
        last = np.unpackbits(body[cut2:], count=int(long_.sum()))
        word[long_] = ((word[long_] << np.uint64(1)) | last) - short
    gaps = q.astype(np.uint64) * np.uint64(m) + word
    gaps[1:] += np.uint64(1)
    return np.uint64(low) + np.cumsum(gaps, dtype=np.uint64)
