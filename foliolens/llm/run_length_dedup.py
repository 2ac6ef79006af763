"""Exact removal of repeated byte strings by a run-length index, partitioned by super-k-mers of bytes.

A window is ``CONTEXT`` (100) consecutive bytes of one text in UTF-8.  Every byte that lies in a window whose bytes also
start earlier, in a document with a smaller id or earlier in the same one, is removed; all windows are judged on the input.

Texts are indexed and streamed where repeats can meet, in two steps of one kind.  A step lays its strings out in the order
of their documents, builds the run-compressed Burrows-Wheeler transform with sampled run ends (``run_index``), and streams
the strings' matching statistics through it: a window that is matched in full, in a context whose earliest place is not its
own, is repeated.  The first step does this within a block of input, whatever the windows' contents, so of a passage that
many documents repeat a block sends one string.  The second does it in buckets: a window belongs to the bucket of its
minimiser, the least of its ``MINIMISER``-byte sequences in a random order; consecutive windows of one bucket travel as one
packed string.  A bucket that goes on beyond a chunk keeps the index of what was new in it, and the strings that follow
are streamed through that.

Which windows can meet at all is found first from ids alone: minimisers are some forty bytes apart, and only buckets that
more than one place of the corpus has take part (``shared_places``); other windows occur once.  Buckets that hold very
much are split by a second minimiser, of another order, so equal windows stay together and strings stay packed.

Defined cases: a null text is empty; fewer than ``CONTEXT`` bytes are never removed; a null id counts as larger than any
other; rows that share an id are parts of one document in the order of a hash of their texts, and rows with the same id and
text are one, each with the same result; a long text is walked in pieces that overlap; only doc_id and text are read, so
further columns of any name are ignored; an empty table gives no rows.  Removal can cut characters: ``kept`` is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import blocks, cut_wide, utf8
from foliolens.llm.pretokens import spread
from foliolens.llm.run_index import BORDER, CONTEXT, MOST_BYTES, RunIndex, pieces
from foliolens.llm.shared_places import HELD, held_rows, shared
from foliolens.llm.substring_dedup import _keyed, _runs
from foliolens.llm.words import mix

MINIMISER = 24
#: Minimisers' orders: of the first and of the second.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of text that are indexed at once, and windows of a packed string.
BLOCK, STRING = 1_500_000, 1024
#: Minimisers' occurrences beyond which a bucket is split, and how many buckets are at most: the largest.
HOT, MOST_HOT = 1 << 12, 100_000

_PACKED = "bucket int, key long, version long, start int, upto int, packed binary"
_NAMES = ["bucket", "key", "version", "start", "upto", "packed"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_U = np.uint64


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _blocks(text: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Row ranges with bytes and offsets; of a row beyond the limit pieces, with where they begin; each window is in one."""
    raw_all, offs_all = utf8(text)
    for lo, hi, raw, offs in blocks(raw_all, offs_all, limit):
        for base in range(0, max(len(raw) - CONTEXT + 1, 1), limit) if hi == lo + 1 else (0,):
            part = raw[base : base + limit + CONTEXT - 1] if hi == lo + 1 else raw
            yield lo, hi, part, np.array([0, len(part)]) if hi == lo + 1 else offs, base


def _sliding(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """At each place the least (or greatest) of the ``width`` values that start there."""
    x, step = x.copy(), 1
    while 2 * step <= width:
        x[:-step] = least(x[:-step], x[step:])
        step *= 2
    if width > step:
        x[: step - width] = least(x[: step - width], x[width - step :])
    return x


def _minimisers(raw: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place a key of the bytes there (the largest where they do not fit) and the least key of the window there."""
    n, top = len(raw), np.uint32(0xFFFFFFFF)
    padded = np.zeros(n + MINIMISER, np.uint8)
    padded[:n] = raw
    eight = np.ndarray((n + MINIMISER - 8,), "<u8", padded, strides=(1,))
    h = eight[:n] * _U(order)
    for at in range(8, MINIMISER, 8):
        h ^= h >> _U(32)
        h += eight[at : at + n]
        h *= _U(0xD6E8FEB86659FD93)
    key = (h >> _U(32)).astype(np.uint32)
    for end in offs[1:].tolist():
        key[max(end - MINIMISER + 1, 0) : end] = top
    return key, _sliding(key, CONTEXT - MINIMISER + 1)


def _is_window(offs: np.ndarray) -> np.ndarray:
    out = np.ones(offs[-1], bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        out[max(a, b - CONTEXT + 1) : b] = False
    return out


def _bucket(least: np.ndarray) -> np.ndarray:
    return mix(least.astype(_U)).astype(np.uint32)


def _chosen(key: np.ndarray, least: np.ndarray, is_window: np.ndarray) -> np.ndarray:
    """Places whose key is the least of some window; a window's bucket is that of such a place within it."""
    width = CONTEXT - MINIMISER + 1
    least = np.concatenate([np.zeros(width - 1, np.uint32), np.where(is_window, least, np.uint32(0))])
    return np.flatnonzero(key == _sliding(least, width, np.maximum)[: len(key)])


def _held(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Which texts have a minimiser in which bucket."""
    for batch in batches:
        for lo, hi, raw, offs, _ in _blocks(batch["text"], block):
            if len(raw) < CONTEXT:
                continue
            key, least = _minimisers(raw, offs, ORDERS[0])
            at = _chosen(key, least, _is_window(offs))
            pair, n = np.unique(np.searchsorted(offs, at, "right").astype(_U) - _U(1) << _U(32) | _bucket(key[at]), return_counts=True)
            row = (pair >> _U(32)).astype(np.int64)
            keys, versions = batch["key"].slice(lo, hi - lo).to_numpy()[row], batch["version"].slice(lo, hi - lo).to_numpy()[row]
            yield from held_rows(keys, versions, pair & _U(0xFFFFFFFF), n, mix(keys.view(_U) ^ mix(pair)))


def _laid_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given spans one after another with a border behind each, and where each begins."""
    size = ends - starts
    begin = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), BORDER, np.uint8)
    text[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())] = raw[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return text, begin


def _repeated(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Of the windows in spans of ``raw``, given in the order that counts, those that start earlier in them; by place in ``raw``.

    Spans are indexed together as far as the limit allows.
    """
    out = np.zeros(len(raw), bool)
    starts, ends = pieces(starts, ends, max(limit - CONTEXT, 1))
    group = (np.cumsum(ends - starts + 1) - 1) // limit
    for g in range(int(group[-1]) + 1 if len(group) else 0):
        a, b = np.searchsorted(group, [g, g + 1])
        if a == b:
            continue
        text, begin = _laid_out(raw, starts[a:b], ends[a:b])
        at, to = pieces(begin, begin + ends[a:b] - starts[a:b])
        found = np.flatnonzero(RunIndex(text, to).repeated(at, to))
        span = np.searchsorted(begin, found, "right") - 1
        out[starts[a:b][span] + found - begin[span]] = True
    return out


def _super_kmers(batches: Iterator[pa.RecordBatch], block: int, hot) -> Iterator[pa.RecordBatch]:
    """Ranges (start to upto) that a block settles by itself, and packed strings of the windows that are new to it."""
    for batch in batches:
        asked_of = batch["buckets"]
        for lo, hi, raw, offs, base in _blocks(batch["text"], block):
            if len(raw) < CONTEXT:
                continue
            some = asked_of.slice(lo, hi - lo)
            owner = np.repeat(np.arange(hi - lo), some.value_lengths().to_numpy()).astype(_U)
            asked = owner << _U(32) | some.flatten().to_numpy().astype(_U)
            keys, least = _minimisers(raw, offs, ORDERS[0])
            is_window = _is_window(offs)
            place = np.flatnonzero(is_window)
            row = (np.searchsorted(offs, place, "right") - 1).astype(np.int32)
            first, last = _runs(row, least[place])
            travels = np.isin(row[first].astype(_U) << _U(32) | _bucket(least[place[first]]), asked)
            travels = np.repeat(travels, last - first + 1)
            place, row = place[travels], row[travels]
            if not len(place):
                continue
            key, version = (batch[c].slice(lo, hi - lo).to_numpy() for c in ("key", "version"))
            # windows around the one place of their bucket in the block differ from each other and from all others in it
            names, n = np.unique(_bucket(keys[_chosen(keys, least, is_window)]), return_counts=True)
            some = np.flatnonzero(np.isin(_bucket(least[place]), names[n > 1]))
            first, last = _runs(row[some], place[some] - np.arange(len(some)))
            first, last = some[first], some[last]
            order = np.lexsort((place[first], version[row[first]], key[row[first]]))
            seen = _repeated(raw, place[first][order], place[last][order] + CONTEXT, block)[place]
            bucket = np.where(seen, np.uint32(0), _bucket(least[place]))
            names = hot.value
            if len(names) and (is_hot := np.isin(bucket, names) & ~seen).any():
                _, second = _minimisers(raw, offs, ORDERS[1])
                bucket[is_hot] = mix(bucket[is_hot].astype(_U) << _U(32) | second[place[is_hot]]).astype(np.uint32)
            first, last = _runs(seen, bucket, row, np.arange(len(place)) - place)
            n = -(-(last - first + 1) // STRING)  # long strings are cut
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first, last = np.repeat(first, n) + nth * STRING, np.minimum(np.repeat(first, n) + (nth + 1) * STRING - 1, np.repeat(last, n))
            text, a = raw.tobytes(), place[first]
            b = place[last] + CONTEXT
            r = row[first]
            packed = [None if s else text[x:y] for s, x, y in zip(seen[first].tolist(), a.tolist(), b.tolist())]
            shift = base - offs[r]
            target = np.where(seen[first], mix(key[r].view(_U)).astype(np.uint32), bucket[first])  # settled ranges go anywhere
            yield _rows(target.view(np.int32), key[r], version[r], a + shift, b + shift, packed)


class _Chunk:
    """Strings in the order of bucket and document, gathered until they are worth an index."""

    def __init__(self):
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.texts: list[bytes] = []
        self.size = 0
        self.bucket: int | None = None  # the bucket that was open at the last settling,
        self.new: list[np.ndarray] = []  # what was new in it, each part with borders,
        self.indexes: list[RunIndex | None] = []  # and their indexes once they are needed

    def add(self, bucket, key, version, start, packed: pa.Array) -> None:
        self.columns.append((bucket, key, version, start))
        self.texts += packed.to_pylist()
        self.size += pc.sum(pc.binary_length(packed)).as_py() + len(packed)

    def settle(self) -> Iterator[pa.RecordBatch]:
        bucket, key, version, start = (np.concatenate(x) for x in zip(*self.columns))
        # a string alone in its bucket meets nothing: what it holds twice its block has settled; the last one may go on
        alone = np.append(True, bucket[1:] != bucket[:-1]) & np.append(bucket[1:] != bucket[:-1], False) & (bucket != self.bucket if self.bucket is not None else True)
        if alone.any():
            bucket, key, version, start = (x[~alone] for x in (bucket, key, version, start))
            self.texts = [t for t, one in zip(self.texts, alone.tolist()) if not one]
        size = np.array([len(t) for t in self.texts])
        begin = np.cumsum(size + 1) - size - 1
        raw = np.frombuffer(bytes([BORDER]).join(self.texts) + bytes([BORDER]), np.uint8)
        self.columns, self.texts, self.size = [], [], 0
        seen = _repeated(raw, begin, begin + size, MOST_BYTES - 1)  # all in one index
        if self.bucket == bucket[0]:
            goes_on = bucket == self.bucket
            at, to = pieces(begin[goes_on], (begin + size)[goes_on])
            for i, text in enumerate(self.new):
                self.indexes[i] = self.indexes[i] or RunIndex(text)
                seen |= self.indexes[i].matched(raw, at, to)
        window = np.ones(len(raw), bool)
        window[np.repeat(begin + size - CONTEXT + 1, CONTEXT) + np.tile(np.arange(CONTEXT), len(size))] = False
        place = np.flatnonzero(seen & window)
        string = np.searchsorted(begin, place, "right") - 1
        first, last = _runs(string, place - np.arange(len(place)))
        s = string[first]
        a = start[s] + place[first] - begin[s]
        yield _rows(np.zeros(len(first)), key[s], version[s], a, a + last - first + CONTEXT, pa.nulls(len(first), pa.binary()))
        self._keep(raw, begin, size, window & ~seen, bucket)

    def _keep(self, raw, begin, size, new, bucket) -> None:
        """Of the last bucket, which may go on, what is new; small parts are joined."""
        if self.bucket != bucket[-1] or self.bucket != bucket[0]:
            self.new, self.indexes = [], []
        self.bucket = bucket[-1]
        since = begin[np.searchsorted(bucket == self.bucket, True)]
        place = np.flatnonzero(new[since:]) + since
        if not len(place):
            return
        first, last = _runs(place - np.arange(len(place)))
        self.new.append(_laid_out(raw, place[first], place[last] + CONTEXT)[0])
        self.indexes.append(None)
        while len(self.new) > 1 and len(self.new[-2]) < 2 * len(self.new[-1]) and len(self.new[-2]) + len(self.new[-1]) < MOST_BYTES - 1:
            self.new[-2:], self.indexes[-2:] = [np.concatenate(self.new[-2:])], [None]


def _settle(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    held = _Chunk()
    for batch in batches:
        open_ = batch["packed"].is_valid().to_numpy(zero_copy_only=False)
        if not open_.all():
            yield batch.filter(pa.array(~open_)).select(_NAMES)
        batch, at = batch.filter(pa.array(open_)), 0
        upto = np.append(0, np.cumsum(pc.binary_length(batch["packed"]).to_numpy() + 1))
        while at < len(batch):
            n = int(np.searchsorted(upto, upto[at] + block - held.size, "right")) - 1 - at
            if n < 1 and held.size:
                yield from held.settle()
                continue
            some = batch.slice(at, max(n, 1))
            held.add(*(some[c].to_numpy() for c in _NAMES[:4]), some["packed"])
            at += len(some)
    if held.size:
        yield from held.settle()


def repeated_ranges(docs: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """key, version, start, upto (bytes) of ``_keyed`` documents: ranges to remove, which may overlap."""
    held = docs.select("text", "key", "version").mapInArrow(lambda batches: _held(batches, block), HELD)
    places = cut_wide(shared(held, hot))
    largest = places.filter("total > 0").orderBy(F.desc("total"), "bucket").limit(MOST_HOT).select("bucket").toArrow()
    names = docs.sparkSession.sparkContext.broadcast(largest["bucket"].to_numpy().astype(np.uint32))
    asked = places.filter("total = 0").groupBy("key", "version").agg(F.collect_set("bucket").alias("buckets"))
    rows = docs.join(asked, ["key", "version"]).mapInArrow(lambda batches: _super_kmers(batches, block, names), _PACKED)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "key", "version", "start")
    return rows.mapInArrow(lambda batches: _settle(batches, block), _PACKED).select("key", "version", "start", "upto")


def _rewrite(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, spans, kept = [], [], [], []
            for text, ranges in zip(batch["text"], batch["ranges"]):
                raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int32)
                if ranges.is_valid and len(ranges):
                    np.add.at(gone, ranges.values.field("start").to_numpy(), 1)
                    np.add.at(gone, ranges.values.field("upto").to_numpy(), -1)
                gone = np.cumsum(gone)[:-1] > 0
                total.append(len(raw))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0)
                out = raw[~gone].tobytes()
                kept.append(hashlib.sha256(out).hexdigest() if digest else out)
            columns = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup(docs: DataFrame, digest: bool = False, **tuning: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that are left (``kept``; with ``digest`` their SHA-256)."""
    docs = _keyed(docs)
    ranges = repeated_ranges(docs.dropDuplicates(["key", "version"]) if _shares_ids(docs) else docs, **tuning)
    ranges = ranges.groupBy("key", "version").agg(F.collect_list(F.struct("start", "upto")).alias("ranges"))
    both = docs.join(ranges, ["key", "version"], "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(_rewrite(digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")


def _shares_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("key", "version").count().filter("count > 1").isEmpty()
