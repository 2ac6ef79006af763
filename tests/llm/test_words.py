"""Word hashes: no text collides by its form, and every length and lane counts."""

import random

import numpy as np
import pyarrow as pa

from foliolens.llm.common import utf8
from foliolens.llm.words import LONG, runs_hash, spans_hash2, split


def hashes(texts):
    raw, offs = utf8(pa.array(texts))
    starts, ends, _ = split(raw, offs)
    return spans_hash2(raw, starts, ends)


def test_lengths_and_bytes_count(alike):
    r = random.Random(1)
    words = {"".join(r.choice("abé") for _ in range(n)) for n in range(1, 4 * LONG, 3) for _ in range(4)}
    words |= {"a" * n for n in range(1, 2 * LONG)} | set(alike) | {x * 3 for x in alike}
    words = sorted(words)
    one, two = hashes(words)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    again = hashes([" ".join(words)])
    assert (again[0] == one).all() and (again[1] == two).all()


def test_runs_are_ordered_and_by_row():
    h = np.arange(1, 40, dtype=np.uint64)
    row = np.array([0] * 20 + [1] * 19)
    for k in (1, 2, 3, 4, 5, 13):
        out, at = runs_hash(h, row, k)
        assert len(at) == 39 - 2 * (k - 1) and len(set(out.tolist())) == len(out)
    assert runs_hash(h[:3], row[:3], 3)[0] != runs_hash(h[:3][::-1].copy(), row[:3], 3)[0]
    assert len(runs_hash(h[:3], row[:3], 4)[0]) == 0
