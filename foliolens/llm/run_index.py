"""A run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends, and matching statistics over it.

Positions of the indexed text are sorted by the ``CONTEXT`` bytes that start there, ties by position.  The transform is the
byte before each position in that order; only its runs are kept, with the text positions at both ends of each run.  As
contexts are bounded, a step to the byte before leads to a row of the right context, if not always to the very row, and
nothing here asks for more: what streams through the index is the length, ``CONTEXT`` at most, of the longest match of
each place of a pattern, and the context that it ends in.

Patterns run from right to left, all in step.  Where the row's run holds the pattern's next byte, the match grows by one;
else the nearest runs of that byte above and below are asked, and the one whose sampled position agrees longest with the
pattern goes on.  The match's length follows from that agreement, so no suffix array is kept.
"""

from __future__ import annotations

import numpy as np

CONTEXT = 100
#: Longest text of an index: a position and two ranks go into one 64-bit number.
MOST_BYTES = (1 << 21) - 1
#: A byte that UTF-8 does not use; it stands between the strings of a text.
BORDER = 0xFF
_U = np.uint64


def sort_contexts(text: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Positions by their next ``context`` bytes (ties by position), and for each whether its context differs from the one before.

    Sorted by five bytes first, then by twice as many each time; a position's rank is the first row of those alike so far, and
    only positions that are not alone in theirs are sorted on.
    """
    n = len(text)
    padded = np.full(n + 8, BORDER, np.uint8)
    padded[:n] = text
    packed = (np.ndarray((n,), ">u8", padded, strides=(1,)).astype(_U) >> _U(24)).view(np.int64)
    packed <<= 21
    packed |= np.arange(n)
    packed.sort()
    at, new = packed & MOST_BYTES, np.ones(n, bool)
    packed >>= 21
    new[1:] = packed[1:] != packed[:-1]
    rank = np.full(n + context, n, np.int32)  # beyond the end is as a row of borders
    rank[at] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    done = 5
    while done < context:
        step = min(done, context - done)
        alone = new.copy()
        alone[:-1] &= new[1:]
        rows = np.flatnonzero(~alone)
        if not len(rows):
            break
        open_ = np.zeros(n, bool)
        open_[at[rows]] = True
        own = np.flatnonzero(open_)  # by position, so ranks are read in order
        packed = rank[own].astype(np.int64)
        packed <<= 21
        packed |= rank[step : step + n][open_]
        packed <<= 21
        packed |= own
        packed.sort()
        own = packed & MOST_BYTES
        packed >>= 21
        at[rows], new[rows[1:]] = own, packed[1:] != packed[:-1]
        rank[own] = np.maximum.accumulate(np.where(new[rows], rows, 0))
        done += step
    return at.astype(np.int32), new


class RunIndex:
    """Runs, their sampled ends, and the earliest position of every row's context."""

    def __init__(self, text: np.ndarray, ends: np.ndarray | None = None):
        """``ends``: ends of pieces of the text, in order; their rows are kept, for streams of the text itself to begin at, and
        whether a context in the piece occurs again: others need not be streamed."""
        if len(text) >= MOST_BYTES:
            raise ValueError(f"an index holds less than {MOST_BYTES} bytes")
        text = np.append(text, np.uint8(BORDER))  # so what is before the first byte is the last one
        self.text = np.concatenate([text, np.full(CONTEXT, BORDER, np.uint8)])
        at, new = sort_contexts(text)
        before = text[at - 1]
        self.end_rows, self.live = None, None
        if ends is not None:
            rows = np.empty(len(text), np.int32)
            rows[at] = np.arange(len(text), dtype=np.int32)
            self.end_rows = rows[ends]
        first = np.append(True, before[1:] != before[:-1])
        self.heads = np.flatnonzero(first).astype(np.int32)
        tails = np.append(self.heads[1:], len(text)) - 1
        # which run a row is in: a bit for each head, and how many heads are before each 64 rows
        marks = np.zeros(-(-len(text) // 64) * 64, np.uint8)
        marks[self.heads] = 1
        self.marks = np.packbits(marks, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.marks).astype(np.int32)
        self.before = np.cumsum(count, dtype=np.int32) - count
        self.bytes = before[self.heads]
        self.at_head, self.at_tail = at[self.heads], at[tails]
        size = tails - self.heads + 1
        self.last = (size - 1).astype(np.int32)  # from a run's head to its tail
        # runs by byte, then in order; rows of a byte before each run
        self.by_byte = np.argsort(self.bytes, kind="stable").astype(np.int32)
        self.begin = np.searchsorted(self.bytes[self.by_byte], np.arange(257)).astype(np.int32)
        seen = np.cumsum(size[self.by_byte]) - size[self.by_byte]
        self.target = np.empty(len(size), np.int32)  # the row that a run's head leads to
        self.target[self.by_byte] = seen
        self.nth = np.empty(len(size), np.int32)  # a run's place among those of its byte
        self.nth[self.by_byte] = np.arange(len(size)) - self.begin[self.bytes[self.by_byte]]
        self.sorted_runs = self.bytes[self.by_byte].astype(np.int64) << 32 | self.by_byte
        group = np.flatnonzero(new)
        length = np.diff(np.append(group, len(text)))
        again = length > 1
        if ends is not None:  # which stretches up to these ends hold a context that occurs again
            inner = np.ones(len(text), bool)
            inner[group[~again]] = False
            flag = np.zeros(len(text), bool)
            flag[at[inner]] = True
            self.live = np.logical_or.reduceat(flag, np.maximum(np.append(0, ends[:-1] - CONTEXT + 1), 0)) if len(ends) else flag[:0]
        self.again = bool(again.any())
        self.earliest = np.repeat(at[group], length)  # of each row's context; one that occurs once has its own position

    def __len__(self) -> int:
        return len(self.heads)

    def _run(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        upto = self.marks[word] & (~_U(0) >> (63 - (row & 63)).astype(_U))
        return self.before[word] + np.bitwise_count(upto) - 1

    def _agree(self, sample: np.ndarray, pattern: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes (``most`` at most) of the text at ``sample`` and of the pattern at ``place`` agree."""
        out = np.zeros(len(sample), np.int64)
        open_ = np.flatnonzero(most > 0)
        for width in (8, CONTEXT):  # most differ early
            if not len(open_):
                break
            step = np.arange(width)
            same = self.text[np.minimum(sample[open_, None] + step, len(self.text) - 1)] == pattern[np.minimum(place[open_, None] + step, len(pattern) - 1)]
            n = np.where(same.all(1), width, same.argmin(1))
            out[open_] = np.minimum(n, most[open_])
            open_ = open_[(n == width) & (most[open_] > width)]
        return out

    def stream(self, pattern: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray | None = None):
        """Yields, from right to left and for all patterns that are that long, the patterns' numbers, the places reached,
        the lengths of the longest matches there (``CONTEXT`` at most), and their rows."""
        order = np.argsort(starts - ends, kind="stable")  # the longest first, so those still open are in front
        starts, ends = starts[order], ends[order]
        size = ends - starts
        row = np.zeros(len(order), np.int64) if rows is None else rows[order].astype(np.int64)
        match = np.zeros(len(order), np.int64)
        open_ = len(order)
        for step in range(1, int(size.max(initial=0)) + 1):
            while open_ and size[open_ - 1] < step:
                open_ -= 1
            place = ends[:open_] - step
            byte = pattern[place]
            run = self._run(row[:open_])
            offset = row[:open_] - self.heads[run]
            length = match[:open_]
            other = np.flatnonzero(self.bytes[run] != byte)
            if len(other):
                b = byte[other].astype(np.int64)
                has = self.begin[b + 1] > self.begin[b]
                below = np.searchsorted(self.sorted_runs, b << 32 | run[other].astype(np.int64))  # the first run of the byte after this one
                up, down = has & (below > self.begin[b]), has & (below < self.begin[b + 1])
                above = self.by_byte[np.maximum(below - 1, 0)]
                below = self.by_byte[np.minimum(below, len(self.by_byte) - 1)]
                most = length[other]
                n_up = np.where(up, self._agree(self.at_tail[above], pattern, place[other] + 1, np.where(up, most, 0)), -1)
                ask = down & (n_up < most)
                n_down = np.where(down, 0, -1)
                if ask.any():
                    n_down[ask] = self._agree(self.at_head[below[ask]], pattern, place[other][ask] + 1, most[ask])
                go_up = n_up >= n_down
                run[other] = np.where(go_up, above, below)
                offset[other] = np.where(go_up, self.last[above], 0)
                length[other] = np.where(has, np.where(go_up, n_up, n_down), -1)
            row[:open_] = np.where(length >= 0, self.target[run] + offset, 0)
            match[:open_] = np.minimum(length + 1, CONTEXT)
            yield order[:open_], place, match[:open_], row[:open_]

    def matched(self, pattern: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the ``CONTEXT`` bytes of the pattern at each place occur in the text."""
        out = np.zeros(len(pattern), bool)
        for _, place, match, _ in self.stream(pattern, starts, ends):
            out[place[match == CONTEXT]] = True
        return out

    def repeated(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the ``CONTEXT`` bytes of the text itself at each place occur at an earlier place, streamed like any pattern.

        ``ends`` are those that the index was built with, if any.
        """
        out = np.zeros(len(self.text), bool)
        if not self.again:
            return out
        rows = self.end_rows
        if rows is not None:
            starts, ends, rows = starts[self.live], ends[self.live], rows[self.live]
        for _, place, match, row in self.stream(self.text, starts, ends, rows):
            out[place[(match == CONTEXT) & (self.earliest[row] < place)]] = True
        return out


def pieces(starts: np.ndarray, ends: np.ndarray, windows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spans cut into ones of at most ``windows`` contexts each, so that none keeps the others waiting."""
    n = np.maximum(-(-(ends - starts - CONTEXT + 1) // windows), 1)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(starts, n) + nth * windows
    return first, np.minimum(first + windows + CONTEXT - 1, np.repeat(ends, n))
