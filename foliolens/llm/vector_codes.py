"""Product codes of vectors, each part's nearest codebook entry found by annular norm pruning.

Components become integers, floor(``SCALE`` * x), and vectors are cut into equal consecutive parts.  A codebook of
each part position starts from the vectors with the smallest ids and is moved by rounds of assignment and averaging.

The nearest entry of a part is looked for by norm: | |x| - |c| | is never above the distance of x and c.  Entries lie
sorted by norm; the nearer of the two beside |x| gives a first distance, a binary search gives the interval of norms
from |x| less it to |x| plus it, and all entries in there, both ends included, are evaluated exactly in integers.  Norms
are rounded outwards, so the interval never loses an entry that is as near; of equally near ones the lowest index counts.

Every round reads the vectors once, in tasks; a task adds up count and componentwise sum of each entry's parts before
anything is shuffled, and the driver gets one row an entry.  Codebooks (parts x entries rows) are what is broadcast.

Defined cases: a vector that is null, empty, or holds a null, NaN or infinite component is left out, and so is one with
a component whose integer is beyond +-2**24, for which 64-bit distances could overflow.  All vectors must be as long as
the one with the smallest id whose length the parts divide; others are left out.  Null ids come last; rows that share an
id are ordered by their components, and each gets its code.  Fewer rows than entries: as many entries as rows, and
alike rows give alike entries, of which the lowest index is used.  A part without a mean keeps its entry.  Null labels
are a label; other columns of any name are ignored.  No rows: no codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond it are left out.
LARGEST = 1 << 24
#: Vectors whose distances a task holds at once.
BLOCK_ROWS = 4096
#: Labels up to which their sums are broadcast.
BROADCAST_LABELS = 100_000
#: Shares of a label's rows where labels are too many to broadcast.
SALTS = 16


@dataclass
class Codebooks:
    """``entries[part, index]`` is an integer vector."""

    entries: np.ndarray

    def __post_init__(self):
        norm = np.sqrt((self.entries.astype(np.float64) ** 2).sum(2))
        self.order = np.argsort(norm, axis=1, kind="stable")  # by norm; equal norms by index
        self.norms = np.take_along_axis(norm, self.order, 1)

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry to each row, and how many entries were evaluated."""
        norms, entries = self.norms[part], self.entries[part][self.order[part]]
        own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        slack = 1e-9 * (own + norms[-1] + 1)
        best, index, evaluated = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(norms)), 0
        begin = end = np.searchsorted(norms, own)  # entries that are evaluated, and the interval that has to be
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), len(norms))
        open_, reach = np.arange(len(x)), 1
        while len(open_):
            for a, b in ((np.maximum(lo, begin - reach), begin), (end, np.minimum(hi, end + reach))):
                n = np.maximum(b - a, 0)
                row = np.repeat(np.arange(len(open_)), n)
                at = np.arange(len(row)) + np.repeat(a - (np.cumsum(n) - n), n)
                found, name = _distance(x[open_[row]], entries[at]), self.order[part][at]
                has = np.flatnonzero(n)
                if len(has):
                    first = (np.cumsum(n) - n)[has]
                    least = np.minimum.reduceat(found, first)
                    lowest = np.minimum.reduceat(np.where(found == np.repeat(least, n[has]), name, len(norms)), first)
                    who = open_[has]
                    index[who] = np.where(least < best[who], lowest, np.where(least == best[who], np.minimum(lowest, index[who]), index[who]))
                    best[who] = np.minimum(least, best[who])
                evaluated += len(row)
            begin, end = np.minimum(begin, np.maximum(lo, begin - reach)), np.maximum(end, np.minimum(hi, end + reach))
            radius = np.sqrt(best[open_].astype(np.float64)) + slack[open_]
            lo, hi = np.searchsorted(norms, own[open_] - radius, "left"), np.searchsorted(norms, own[open_] + radius, "right")
            more = (lo < begin) | (hi > end)
            open_, begin, end, lo, hi, reach = open_[more], begin[more], end[more], lo[more], hi[more], 2 * reach
        return index, best, evaluated

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every part of integer vectors."""
        parts, _, width = self.entries.shape
        found = [self.nearest(p, x[:, p * width : (p + 1) * width]) for p in range(parts)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes stand for."""
        parts = self.entries.shape[0]
        return self.entries[np.arange(parts), codes].reshape(len(codes), -1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def usable(embedding: Column) -> Column:
    """Whether a vector has components, and all of them numbers of a size that can be coded."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & F.floor(F.least(F.greatest(x, F.lit(-1e18)), F.lit(1e18)) * SCALE).between(-LARGEST, LARGEST))
    return F.coalesce((F.size(embedding) > 0) & fine, F.lit(False))


def kept(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """The rows that get codes."""
    rows = vectors.filter(usable(F.col("embedding")) & (F.size("embedding") % parts == 0))
    first = _first(rows, 1)
    return rows.filter(F.size("embedding") == (len(first[0]) if first else 0))


def _first(rows: DataFrame, n: int) -> list[list[float]]:
    return [r.embedding for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(n).collect()]


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as integers, one a row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, width)


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floored means of the parts assigned to them."""
    parts, size, width = books.entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, count, total = shared.value, np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                x = integers(batch["embedding"].slice(at, BLOCK_ROWS), parts * width)
                code, _ = books.encode(x)
                for p in range(parts):
                    count[p] += np.bincount(code[:, p], minlength=size)
                    np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
        p, k = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(count[p, k]), pa.array(list(total[p, k]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = rows.select("embedding").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total"))
    entries = books.entries.copy()
    for r in sums.collect():  # one row an entry
        entries[r.part, r.entry] = [t // r.n for t in r.total]
    shared.unpersist()
    return Codebooks(entries)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``kept`` rows; None without rows."""
    first = _first(rows, entries)
    if not first:
        return None
    start = np.floor(np.array(first, np.float64) * SCALE).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of ``kept`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    if books is not None and books.entries.shape[1] > 256:
        raise ValueError("two hex digits name 256 entries at most")
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                code, error = shared.value.encode(integers(some["embedding"], shared.value.entries.shape[0] * shared.value.entries.shape[2]))
                text = ["".join(row) for row in digits[code].tolist()]
                yield pa.RecordBatch.from_arrays([some["vec_id"], some["label"], pa.array(text, pa.string()), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, "vec_id long, label long, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that each code stands for, back in the scale of the input."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch["code"].to_pylist())), np.uint8).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(list(shared.value.decode(code) / SCALE), pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the error summed over all rows of an equal label (null is one).

    Sums are made before the shuffle.  Few labels: their sums are broadcast; many: each label's rows are dealt out
    over ``SALTS`` shares, and its sum is sent to each.
    """
    sums = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    sums = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = codes.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = dealt["label"].eqNullSafe(sums["__label"]) & (dealt["__salt"] == sums["__salt"])
    return dealt.join(sums, same).drop("__label", "__salt")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code, error and label_error of every kept vector, and the codebooks."""
    rows = kept(vectors, parts)
    books = fit(rows, parts, entries, rounds)
    return with_label_error(cut(encode(rows, books))), books
