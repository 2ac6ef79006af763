"""Vectorised word splitting and hashing over UTF-8 bytes.

A word is a run of bytes other than space and TAB, LF, VT, FF, CR; on UTF-8 that equals the pattern
``[^\\x20\\x09-\\x0D]+`` on characters.  A word is taken eight bytes at a time: each piece goes through two keyed
lanes with a bijective finaliser in between, so a block costs a few passes over its words, not over its bytes.
Words over ``LONG`` bytes go through BLAKE2b.  Sequences of words are hashed as a tree of pairs.  Nothing is a
sum of powers, so no text collides by its form; ``KEY`` may be changed where texts could be written against it.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The key of every hash; the second lane's start is derived from it.
KEY = 0x9E3779B97F4A7C15
#: Bytes from which on a word is hashed by itself.
LONG = 256
_ODD, _ODD2 = _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the one of SplitMix64)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def split(raw: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of every word and the row it is in."""
    inside = ~separator[raw]
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = offs[:-1][offs[:-1] < len(raw)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def spans_hash2(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte span."""
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, _U)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = _LOWER[raw] if lower else raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    one = mix(size.astype(_U) + _U(KEY))
    two = one ^ _ODD
    which, at, left = slice(None), starts, size
    while True:
        piece = eight[at] & _MASK[np.minimum(left, 8)]
        one[which] = mix(one[which] ^ piece)
        two[which] = mix(two[which] * _ODD2 + piece)
        more = left > 8
        if not more.any():
            break
        which = np.flatnonzero(more) if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
        keep = size[which] <= LONG
        which, at, left = which[keep], at[keep], left[keep]
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=16, key=KEY.to_bytes(8, "little")).digest()
        one[i], two[i] = np.frombuffer(digest, "<u8")
    return mix(one + two * _ODD), two


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    return spans_hash2(raw, starts, ends, lower)[0]


def runs_hash(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k`` consecutive words of one row, and the index of each one's first word.

    Hashes of 1, 2, 4, ... words are made from those of half as many; the powers of two in ``k`` are then joined.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    out, done, width = None, 0, 1
    while width <= k:
        if k & width:
            part = h[done : done + n]
            out = part if out is None else mix(out * _ODD + part)
            done += width
        if 2 * width <= k:
            h = mix(h[:-width] * _ODD + h[width:])
        width *= 2
    return mix(out[at] + _U(k)), at


def shingles(raw: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct ``k``-word shingles (A-Z lower-cased) as sorted hashes.

    A row with 1 to k-1 words has one: its whole sequence.  A row without words has none.
    """
    starts, ends, row = split(raw, offs)
    h = spans_hash(raw, starts, ends, lower=True)
    grams, at = runs_hash(h, row, k)
    rows = len(offs) - 1
    first = np.searchsorted(row[at], np.arange(rows + 1))
    words = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for i in range(rows):
        if first[i] < first[i + 1]:
            out.append(np.unique(grams[first[i] : first[i + 1]]))
        elif words[i] < words[i + 1]:
            x = words[i + 1] - words[i]
            out.append(runs_hash(h[words[i] : words[i + 1]], np.zeros(x, np.int64), int(x))[0])
        else:
            out.append(np.zeros(0, _U))
    return out
