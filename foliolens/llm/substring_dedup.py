"""Exact removal of repeated word windows, partitioned by super-k-mers.

A window is ``WINDOW`` consecutive words of one document.  Every word that lies in a window whose word sequence
also starts in a document with a smaller id is removed; all windows are judged on the input.

Each window belongs to the bucket of its minimiser, the least of its ``MINIMISER``-word sequences in an order
that prefers long (hence rarer) ones.  Consecutive windows of one bucket travel as one packed string.  As all
strings together are three times the text, a first pass finds, from ids alone, the buckets that more than one
document has windows in; the strings of other buckets need not travel.  In the bucket the windows of all
strings are sorted by a 128-bit hash, and the least id of each run of equal ones decides.  Before the shuffle
the same is done within each block of input: windows that a smaller document of the block has too are settled
there and do not travel, so what a bucket gets of one passage is one string a block, however many documents
repeat it.  A task reads its buckets by id; a window met before belongs to a smaller document, so of an open
bucket only the windows that are first of their kind are held.  Buckets with many windows are split by the
windows' own hashes and by document; what is first of its kind there meets once more, dealt by the window alone.

Defined cases: a null text has no words; a null id counts as larger than any other; rows that share an id
are not held against each other (a 64-bit hash of the text tells them apart; rows with the same id and text are
alike); fewer than 13 words are never removed; a text longer than a block is a block of its own; only doc_id and
text are read, so further columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import blocks, cut_wide, utf8
from foliolens.llm.words import mix, runs_hash, spans_hash2, split

WINDOW = 13
MINIMISER = 3
#: Windows that a task gathers before it settles them.
FLUSH_WINDOWS = 400_000
#: Windows beyond which a bucket is split by the windows' own hashes, and how many buckets are at most: the
#: largest, so any other has less than 1/MOST_HOT of all windows.
HOT_WINDOWS, MOST_HOT = 1 << 14, 100_000
#: Into how many groups of documents the equal windows of a hot bucket are dealt before their least ids meet.
SALTS = 64
BLOCK = 2 << 20
_LAST_ID = np.iinfo(np.int64).max


def _windows(raw, starts, ends, row):
    """Two hashes of each window, the index of its first word, and the hash of each word."""
    h1, h2 = spans_hash2(raw, starts, ends)
    one, at = runs_hash(h1, row, WINDOW)
    two, _ = runs_hash(h2, row, WINDOW)
    return one, two, at, h1


def _least_owner(one: np.ndarray, two: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window the least owner among equal windows."""
    if not len(one):
        return owner
    order = np.argsort(one)
    a, b = one[order], two[order]
    new = np.empty(len(a), bool)
    new[0] = True
    new[1:] = a[1:] != a[:-1]
    if (b[1:][~new[1:]] != b[:-1][~new[1:]]).any():  # equal first hashes of different windows
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], first)
    out = np.empty_like(owner)
    out[order] = np.repeat(least, np.diff(np.append(first, len(a))))
    return out


def _minimisers(h, starts, ends, row, at) -> np.ndarray:
    """The bucket (32 bits of a hash of the minimiser) of the windows that start at words ``at``."""
    grams, first = runs_hash(h, row, MINIMISER)
    length = np.append(0, np.cumsum(ends - starts))  # of words alone: separators may differ
    size = length[first + MINIMISER] - length[first]
    key = np.full(len(starts) + WINDOW, np.iinfo(np.uint64).max)  # an order of sequences
    key[first] = grams >> np.minimum(size // 3, 24).astype(np.uint64)
    width, n = WINDOW - MINIMISER + 1, len(key)
    step = 1
    while 2 * step <= width:
        key[: n - step] = np.minimum(key[: n - step], key[step:])
        step *= 2
    return mix(np.minimum(key[at], key[at + width - step])).astype(np.uint32)


def _runs(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run over which all arrays stay equal."""
    n = len(same[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in same])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n) - 1


_PACKED = "bucket int, key long, version long, word int, upto int, packed binary"
_NAMES = ["bucket", "key", "version", "word", "upto", "packed"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _block_windows(batches: Iterator[pa.RecordBatch], block: int):
    """For each block: its rows in the batch, bytes, word starts and ends, and of each window both hashes, first word, row and bucket."""
    for batch in batches:
        raw_all, offs_all = utf8(batch["text"])
        for lo, hi, raw, offs in blocks(raw_all, offs_all, block):
            starts, ends, row = split(raw, offs)
            one, two, at, h = _windows(raw, starts, ends, row)
            if len(at):
                bucket = _minimisers(h, starts, ends, row, at).view(np.int32)
                yield batch.slice(lo, hi - lo), raw, starts, ends, row, one, two, at, bucket


def _held(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Which documents have windows of which bucket.

    ``place`` is the bucket itself for one document of a block, which has to ask whether others have it; for
    all documents of a bucket that several of the block have, the answer is known, and ``place`` is negative:
    -1 less a number of its own with the bucket in its low 32 bits.  ``n`` is how many windows the block has in
    the bucket, in the row of its first document.
    """
    for batch, _, _, _, row, _, _, at, bucket in _block_windows(batches, block):
        key, version = batch["key"].to_numpy(), batch["version"].to_numpy()
        pair, windows = np.unique(row[at].astype(np.uint64) << np.uint64(32) | bucket.view(np.uint32), return_counts=True)
        row, bucket = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.lexsort((key[row], bucket))
        row, bucket = row[order], bucket[order]
        first = np.ones(len(row), bool)
        first[1:] = bucket[1:] != bucket[:-1]
        known = ~(first & np.append(first[1:], True))
        own = -1 - ((mix(key[row].view(np.uint64)) >> np.uint64(33)).astype(np.int64) << 32 | bucket)
        total = np.add.reduceat(windows[order], np.flatnonzero(first))
        for place, take, n in ((bucket, first, total), (own, known, np.zeros(known.sum(), np.int64))):
            columns = place[take], key[row][take], version[row][take], n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "key", "version", "n"])


def _dealt(bucket: np.ndarray, one: np.ndarray, hot: tuple[np.ndarray, np.ndarray], salt: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each window and whether its bucket is hot; hot ones are dealt out by their windows' own hashes (and the salt)."""
    names, parts = hot
    if not len(names) or not len(bucket):
        return bucket, np.zeros(len(bucket), bool)
    at = np.minimum(np.searchsorted(names, bucket), len(names) - 1)
    is_hot = names[at] == bucket
    nth = one % parts[at].astype(np.uint64) * np.uint64(SALTS) + np.asarray(salt, np.uint64)
    return np.where(is_hot, mix(bucket.view(np.uint32).astype(np.uint64) << np.uint64(32) | nth).astype(np.uint32).view(np.int32), bucket), is_hot


def _super_kmers(batches: Iterator[pa.RecordBatch], block: int, hot) -> Iterator[pa.RecordBatch]:
    """Packed strings of windows to be settled in their bucket, and ranges (word to upto) already settled.

    Windows of hot buckets travel one by one, with a negative ``upto``.
    """
    for batch, raw, starts, ends, row, one, two, at, bucket in _block_windows(batches, block):
        shared = batch["buckets"]
        owner = np.repeat(np.arange(len(shared)), shared.value_lengths().to_numpy()).astype(np.uint64)
        asked = owner << np.uint64(32) | shared.flatten().to_numpy().view(np.uint64)
        travels = np.isin(row[at].astype(np.uint64) << np.uint64(32) | bucket.view(np.uint32), asked)
        one, two, at, bucket = one[travels], two[travels], at[travels], bucket[travels]
        if not len(at):
            continue
        key, version = batch["key"].to_numpy()[row[at]], batch["version"].to_numpy()[row[at]]
        word = at - np.searchsorted(row, row[at])
        seen = key > _least_owner(one, two, key)
        bucket, is_hot = _dealt(bucket, one, hot.value, mix(key.view(np.uint64)) % np.uint64(SALTS))
        is_hot &= ~seen
        bucket = np.where(seen, key.astype(np.int32), bucket)  # settled ranges go anywhere
        first, last = _runs(seen, bucket, row[at], np.arange(len(at)) - at, np.where(is_hot, np.arange(len(at)), -1))
        text = raw.tobytes()
        packed = [None if s else text[a:b] for s, a, b in zip(seen[first].tolist(), starts[at[first]].tolist(), ends[at[last] + WINDOW - 1].tolist())]
        upto = np.where(is_hot[first], -1, 1) * (word[last] + WINDOW)
        yield _rows(bucket[first], key[first], version[first], word[first], upto, packed)


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


class _Bucketed:
    """Windows that arrive by bucket and then by id, so no later one has a smaller id than an equal one before."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: list[tuple] = []
        self.count = 0

    def add(self, bucket, doc, version, word, again, packed) -> None:
        """``again``: rows of hot buckets, one window each, which meet once more unless they are settled here."""
        raw, offs = utf8(packed)
        starts, ends, row = split(raw, offs)
        one, two, at, _ = _windows(raw, starts, ends, row)
        r = row[at]
        source = np.full(len(at), -1)
        hot = np.flatnonzero(again[r])
        if len(hot):
            source[hot] = len(self.texts) + np.arange(len(hot))
            target = mix(one[hot]).astype(np.uint32).view(np.int32)  # by the window alone: SALTS rows of a kind at most
            self.texts += zip(target.tolist(), (packed[i] for i in r[hot].tolist()))
        self.parts.append((one, two, doc[r], version[r], word[r] + at - np.searchsorted(row, r), bucket[r], source))
        self.count += len(at)

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Ranges that repeat a smaller document's windows, and what meets once more; of the last bucket the windows
        that are first of their kind are kept."""
        one, two, doc, version, word, bucket, source = (np.concatenate(x) for x in zip(*self.parts))
        least = _least_owner(one, two, doc)
        on = np.flatnonzero((source >= 0) & (doc == least))
        if len(on):
            target, text = zip(*(self.texts[i] for i in source[on].tolist()))
            yield _rows(target, doc[on], version[on], word[on], word[on] + WINDOW, pa.array([t.as_py() for t in text]).cast(pa.binary()))
        kept = np.flatnonzero((bucket == bucket[-1]) & (doc == least))
        source[kept] = -1
        self.parts, self.texts, self.count = [tuple(x[kept] for x in (one, two, doc, version, word, bucket, source))], [], 0
        seen = np.flatnonzero(doc > least)
        doc, version, word = doc[seen], version[seen], word[seen]
        first, last = _runs(doc, version, word - np.arange(len(word)))
        yield _rows(np.zeros(len(first)), doc[first], version[first], word[first], word[last] + WINDOW, pa.nulls(len(first), pa.binary()))


def _settle(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    held = _Bucketed()
    for batch in batches:
        bucket, doc, version, word, upto = (batch[c].to_numpy() for c in _NAMES[:5])
        open_ = batch["packed"].is_valid().to_numpy(zero_copy_only=False)
        if not open_.all():
            done = ~open_
            yield _rows(bucket[done], doc[done], version[done], word[done], upto[done], pa.nulls(done.sum(), pa.binary()))
        if not open_.any():
            continue
        text = batch["packed"].filter(pa.array(open_)).cast(pa.string())
        held.add(bucket[open_], doc[open_], version[open_], word[open_].astype(np.int64), upto[open_] < 0, text)
        if held.count >= flush:
            yield from held.settle()
    if held.count:
        yield from held.settle()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key (the id; null as the largest) and version (a hash of the text where rows may share an id, else 0)."""
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1")
    version = F.coalesce(F.xxhash64("text"), F.lit(0))
    if repeated.isEmpty():
        version = F.when(F.col("doc_id").isNull(), version).otherwise(F.lit(0))
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(int(_LAST_ID))).alias("key"), version.cast("long").alias("version"))


def _hot(shared: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets with more than ``hot`` windows and into how many each is split; the ``MOST_HOT`` largest at most."""
    rows = shared.filter(F.col("windows") > hot).groupBy("bucket").agg(F.max("windows").alias("windows"))
    rows = rows.orderBy(F.desc("windows"), "bucket").limit(MOST_HOT).toArrow()
    name, windows = rows["bucket"].to_numpy().astype(np.uint32).view(np.int32), rows["windows"].to_numpy()
    order = np.argsort(name)
    return name[order], windows[order] // hot + 1


def repeated_ranges(docs: DataFrame, flush: int = FLUSH_WINDOWS, block: int = BLOCK, hot: int = HOT_WINDOWS) -> DataFrame:
    """key, version, word, upto of ``_keyed`` documents: ranges of words to remove, which may overlap."""
    held = docs.select("text", "key", "version").mapInArrow(lambda batches: _held(batches, block), "place long, key long, version long, n long")
    w = Window.partitionBy("place")  # a row a block and place
    held = held.select("place", "key", "version", F.min("key").over(w).alias("lo"), F.max("key").over(w).alias("hi"), F.sum("n").over(w).alias("windows"))
    bucket = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).bitwiseAND(0xFFFFFFFF)
    held = held.filter("place < 0 or lo < hi or windows > %d" % hot)
    shared = cut_wide(held.select("key", "version", bucket.alias("bucket"), F.greatest("windows", F.lit(hot)).alias("windows")))
    parts = docs.sparkSession.sparkContext.broadcast(_hot(shared, hot))
    asked = shared.groupBy("key", "version").agg(F.collect_set("bucket").alias("buckets"))
    rows = docs.join(asked, ["key", "version"]).mapInArrow(lambda batches: _super_kmers(batches, block, parts), _PACKED)

    def settled(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(lambda batches: _settle(batches, flush), _PACKED)

    once = settled(rows)
    if len(parts.value[0]):
        once = cut_wide(once)
        once = once.filter("packed is null").unionByName(settled(once.filter("packed is not null")))
    return once.select("key", "version", "word", "upto")


def _rewrite(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, ranges in zip(batch["text"], batch["ranges"]):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if ranges.is_valid:
                    keep = np.ones(len(words), bool)
                    for r in ranges.as_py():
                        keep[r["word"] : r["upto"]] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                removed.append(total[-1] - len(words))
                out = b" ".join(words)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup(docs: DataFrame, digest: bool = False, **tuning: int) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (``kept``; with ``digest`` their SHA-256)."""
    docs = _keyed(docs)
    ranges = repeated_ranges(docs, **tuning).groupBy("key", "version").agg(F.collect_list(F.struct("word", "upto")).alias("ranges"))
    both = docs.join(ranges, ["key", "version"], "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(_rewrite(digest), "doc_id long, n_words long, n_removed long, kept string")
