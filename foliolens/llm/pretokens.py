"""Tokenising each distinct chunk of a block once and spreading the ids with numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from foliolens.llm.words import SEPARATOR, spans_hash

#: Bytes that a worker's remembered chunks may take.
CACHE_BYTES = 48 << 20


def chunks(raw: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of chunks: a run of separators with what follows up to the next such run."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    sep = separator[raw]
    new = np.empty(len(raw), bool)
    new[0] = True
    new[1:] = sep[1:] & ~sep[:-1]
    new[offs[:-1][offs[:-1] < len(raw)]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(raw)), np.searchsorted(offs, starts, "right") - 1


class Known:
    """The ids of the chunks that a worker has met, by the chunks' hashes.

    Chunks lie in sorted parts, each at least twice as long as the next, so that adding copies little; beyond
    ``limit`` bytes the oldest part is forgotten.  What the ids decode to is held against the text:
    chunks for which that differs (a hash met twice, or bytes that no id gives back) are encoded by themselves.
    """

    def __init__(self, decoded: list[bytes], limit: int | None = None):
        self.limit = CACHE_BYTES if limit is None else limit
        self.exact = True  # whether the ids of the last call decode to the very text
        self.table = np.frombuffer(b"".join(decoded), np.uint8)
        self.sizes = np.array([len(x) for x in decoded], np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, ids, how many ids each has

    def _add(self, hashes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.parts.append((hashes, flat.astype(np.int32), lengths.astype(np.int32)))
        while len(self.parts) > 1 and len(self.parts[-2][0]) < 2 * len(self.parts[-1][0]):
            (h1, f1, n1), (h2, f2, n2) = self.parts[-2:]
            h, f, n = np.concatenate([h1, h2]), np.concatenate([f1, f2]), np.concatenate([n1, n2])
            order = np.argsort(h, kind="stable")
            self.parts[-2:] = [(h[order], spread(f, n, order)[0], n[order])]
        while self.parts and sum(x.nbytes for p in self.parts for x in p) > self.limit:
            self.parts = self.parts[1:]

    def _lookup(self, hashes, raw, starts, ends, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of chunks by their sorted, distinct hashes."""
        flats, lengths, found = [], [], np.full(len(hashes), -1)
        begin = 0
        for part, flat, n in self.parts:
            at = np.minimum(np.searchsorted(part, hashes), len(part) - 1)
            has = (found < 0) & (part[at] == hashes)
            got, own = spread(flat, n, at[has])
            flats.append(got)
            lengths.append(own)
            found[has] = begin + np.arange(len(own))
            begin += len(own)
        new = np.flatnonzero(found < 0)
        if len(new):
            text = raw.tobytes()
            got, own = encode([text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            flats.append(got)
            lengths.append(own)
            found[new] = begin + np.arange(len(new))
            self._add(hashes[new], got, own)
        return spread(np.concatenate(flats), np.concatenate(lengths), found)

    def ids_of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All chunks' ids in order, and how many each has; ``encode`` gives new chunks' ids and their counts.

        The chunks cover ``raw`` without gaps.
        """
        self.exact = True
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        hashes, first, inverse = np.unique(spans_hash(raw, starts, ends), return_index=True, return_inverse=True)
        flat, n = spread(*self._lookup(hashes, raw, starts[first], ends[first], encode), inverse)
        back, length = spread(self.table, self.sizes, flat)
        if len(back) == len(raw) and (back == raw).all():
            return flat, n
        self.exact = False
        size = per_row(length, np.repeat(np.arange(len(n)), n), len(n))
        wrong = size != ends - starts
        fits = np.flatnonzero(~wrong)
        where, count = spread(np.arange(len(back)), size, fits)
        place = np.repeat(starts[fits] - (np.cumsum(count) - count), count) + np.arange(len(where))
        wrong[fits[np.unique(np.repeat(np.arange(len(fits)), count)[back[where] != raw[place]])]] = True
        wrong = np.flatnonzero(wrong)
        text = raw.tobytes()
        own, m = encode([text[a:b] for a, b in zip(starts[wrong].tolist(), ends[wrong].tolist())])
        which = np.arange(len(n))
        which[wrong] = len(n) + np.arange(len(wrong))
        return spread(np.concatenate([flat, own]), np.concatenate([n, m]), which)


def spread(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` (with ``lengths``) that ``which`` names, one after another, and their lengths."""
    lengths = lengths.astype(np.int64, copy=False)
    begin = np.cumsum(lengths) - lengths
    n = lengths[which]
    at = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return flat[at], n


def per_row(n: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``n`` by row."""
    return np.bincount(row, weights=n, minlength=rows).astype(np.int64)
