"""Compressed bitmaps over the positions of one key range.

A bitmap is a sorted array of positions while it is sparse and packed bits once that is smaller,
so a key range with few references in a period costs two or four bytes a reference.
"""

from __future__ import annotations

import numpy as np

_SPARSE, _DENSE = b"S", b"D"


def build(positions: np.ndarray, width: int) -> bytes:
    """Bitmap of the given positions, each in [0, width)."""
    positions = np.unique(np.asarray(positions, dtype=np.uint32))
    if positions.size * 4 <= (width + 7) // 8:
        return _SPARSE + positions.tobytes()
    bits = np.zeros(width, dtype=bool)
    bits[positions] = True
    return _DENSE + np.packbits(bits).tobytes()


def decode(bitmap: bytes) -> np.ndarray:
    """The sorted positions held by a bitmap."""
    body = bitmap[1:]
    if bitmap[:1] == _SPARSE:
        return np.frombuffer(body, dtype=np.uint32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, dtype=np.uint8))).astype(np.uint32)


def contains(bitmap: bytes, positions: np.ndarray) -> np.ndarray:
    """For each position, whether the bitmap holds it."""
    body = bitmap[1:]
    if bitmap[:1] == _SPARSE:
        held = np.frombuffer(body, dtype=np.uint32)
        at = np.searchsorted(held, positions)
        ok = at < held.size
        ok[ok] = held[at[ok]] == positions[ok]
        return ok
    packed = np.frombuffer(body, dtype=np.uint8)
    positions = np.asarray(positions, dtype=np.uint32)
    ok = (positions >> 3) < packed.size
    ok[ok] = (packed[positions[ok] >> 3] >> (7 - (positions[ok] & 7))) & 1 == 1
    return ok


def and_not(left: bytes, right: bytes) -> bytes:
    """Bitmap of the positions in ``left`` that ``right`` lacks."""
    if left[:1] == _DENSE and right[:1] == _DENSE:
        a, b = (np.frombuffer(x[1:], dtype=np.uint8) for x in (left, right))
        n = max(a.size, b.size)
        a, b = np.pad(a, (0, n - a.size)), np.pad(b, (0, n - b.size))
        return build(decode(_DENSE + (a & ~b).tobytes()), n * 8)
    held = decode(left)
    return _SPARSE + held[~contains(right, held)].tobytes()


def union(left: bytes, right: bytes, width: int) -> bytes:
    """Bitmap of the positions in either."""
    return build(np.concatenate([decode(left), decode(right)]), width)
