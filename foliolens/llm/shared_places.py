"""Which places (buckets that texts have something in) more than one text has, with one shuffle and constant memory.

Rows of a place arrive one after another, sorted, so whether a second one follows is known when it does; nothing of a
place is gathered.  A block of input sends one row a place; where it knows by itself that several of its texts have a place,
their rows are ``known``: they are dealt out by hash instead of by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: ``n`` is how much the block has in the place; less than 0 if the row's own text is in ``known`` rows as well.
HELD = "place long, key long, version long, n long"
#: ``total`` is 0, or in rows of their own how much all texts have in a place with more than was asked for.
SHARED = "key long, version long, bucket long, total long"
_NAMES = ["place", "key", "version", "n"]


def held_rows(key: np.ndarray, version: np.ndarray, bucket: np.ndarray, n: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a block sends: per (text, bucket) the text's ids, the bucket (32 bits) and how often; more than once is shared."""
    order = np.lexsort((version, key, bucket))
    key, version, bucket, n, spread = key[order], version[order], bucket[order].astype(np.int64), n[order].astype(np.int64), spread[order]
    first = np.ones(len(bucket), bool)
    first[1:] = bucket[1:] != bucket[:-1]
    if not len(bucket):
        return
    heads = np.flatnonzero(first)
    size = np.diff(np.append(heads, len(bucket)))
    many = (size > 1) | (np.maximum.reduceat(n, heads) > 1)
    total = np.add.reduceat(n, heads)
    known = np.repeat(many, size)
    own = -1 - ((spread >> np.uint64(33)).astype(np.int64) << 32 | bucket)
    yield _batch(bucket[heads], key[heads], version[heads], np.where(many, -total, total))
    yield _batch(own[known], key[known], version[known], np.zeros(known.sum(), np.int64))


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def _scan(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def rows(key, version, bucket, total):
        columns = [pa.array(c, pa.int64()) for c in (key, version, bucket, total)]
        return pa.RecordBatch.from_arrays(columns, ["key", "version", "bucket", "total"])

    none = np.zeros(0, np.int64)
    open_ = [none] * 4  # the first row of the last place, if nothing followed it yet
    at, had, total = -1, 0, 0  # the last place, how many rows it had, and how much they hold
    for batch in batches:
        place, key, version, n = (batch[c].to_numpy() for c in _NAMES)
        known = place < 0
        if known.any():
            yield rows(key[known], version[known], (-1 - place[known]) & 0xFFFFFFFF, np.zeros(known.sum(), np.int64))
            place, key, version, n = place[~known], key[~known], version[~known], n[~known]
        if not len(place):
            continue
        goes_on = place[0] == at
        if had and not goes_on and total > most:
            yield rows([0], [0], [at], [total])
        place, key, version, n = (np.concatenate([o, x]) if goes_on else x for o, x in zip(open_, (place, key, version, n)))
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(place)))
        shared = size > 1
        amount = np.add.reduceat(np.abs(n), heads)
        if goes_on:
            shared[0] |= had > 1
            amount[0] += total if not len(open_[0]) else 0
        out = np.repeat(shared, size) & (n > 0)
        yield rows(key[out], version[out], place[out], np.zeros(out.sum(), np.int64))
        big = np.flatnonzero(amount[:-1] > most)
        yield rows(np.zeros(len(big), np.int64), np.zeros(len(big), np.int64), place[heads[big]], amount[big])
        before = had if goes_on and len(heads) == 1 else 0
        had = int(size[-1]) + (before - len(open_[0]) if before else 0)
        at, total = int(place[-1]), int(amount[-1])
        keep = slice(len(place) - 1, None) if had == 1 else slice(0, 0)
        open_ = [x[keep] for x in (place, key, version, n)]
    if had and total > most:
        yield rows([0], [0], [at], [total])


def shared(held: DataFrame, most: int) -> DataFrame:
    """Of ``HELD`` rows those whose bucket another row has too, and the totals of buckets that hold more than ``most``."""
    return held.repartition("place").sortWithinPartitions("place").mapInArrow(lambda batches: _scan(batches, most), SHARED)
