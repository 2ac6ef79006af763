"""Exact BM25 top-k with block-max pruning, a shard at a time.

A task cuts its documents into shards and builds an inverted index of each: postings by term, and for every
block of documents the highest impact of each term in it.  A query sums its terms' block maxima into an upper bound
of each block, and only blocks whose bound reaches its k-th best score are scored; that score carries over from
shard to shard.  Scores use the whole corpus's document frequencies and mean length, so the shards' results merge exactly.

Queries are whole texts: every distinct term counts, times its frequency.  They reach the tasks in blocks of
``QUERY_TERMS`` (query, term) entries; more queries mean more passes.

Many queries are searched together (``Block.search``).  Documents and queries are put in blocks of ``TILE_DOCS`` and
``TILE_QUERIES`` that share their most frequent terms and are about as long.  Where a block of queries meets a
block of documents, terms that are frequent in both make one product of matrices, and only the postings of the
others are walked.  That is done in single precision, so it only says who may be among the k best: a rounding
bound is taken off, and who is left is scored exactly.  Before a pass, its queries are searched in a sample of the documents;
the k-th best score found there is a lower bound that every task starts from, so that tasks do not all score and yield
k rows a query exactly.  It leaves out nothing that belongs to the k best.

Few queries (``FEW_QUERIES``) are searched one by one (``Index.search``), by blocks of ``BLOCK_DOCS`` documents ordered by their
least term hash, the most promising blocks first.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased, held as
64-bit hashes.

Defined cases: a null or empty text finds nothing and is never found; rows with a null id are neither
queries nor found, though they count in the statistics; of several query rows with one id the least text
counts; repeated documents are found each.  Equal scores go by the smaller id.  A long text is indexed whole, as a
shard of its own if need be; only doc_id and text are read, so further columns of any name are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import blocks, cut, utf8
from foliolens.llm.words import spans_hash, split

K1, B = 1.2, 0.75
BLOCK_DOCS = 8
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 16 << 20
#: Twelve bytes each in a task.
QUERY_TERMS = 4_000_000
#: Blocks that a query without a bound scores first.
FIRST_BLOCKS = 8
#: Below so many queries a pass searches them one by one.
FEW_QUERIES = 32
TILE_DOCS, TILE_QUERIES = 1024, 256
#: A term goes to the product if the pairs of its queries and documents are more than one in so many of all pairs.
DENSE = 250
#: Terms in a product of matrices, and postings walked at once.
PRODUCT_TERMS, WALKED = 1024, 1 << 18
#: At least one document in so many is searched for the bounds of a pass; tasks of so many documents do it.
SAMPLE, SAMPLE_DOCS = 4, 16384
#: An exact score costs about as much as so many of the others.
EXACT = 500
_SEPARATOR = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _terms(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every term's hash and row; hashed in small blocks, so that a shard's arrays are those of its terms alone."""
    terms, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for lo, _, part, at in blocks(raw, offs):
        starts, ends, row = split(part, at, _SEPARATOR)
        terms.append(spans_hash(part, starts, ends, lower=True))
        rows.append((row + lo).astype(np.int32))
    return np.concatenate(terms), np.concatenate(rows)


def _pairs(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, row) in order, and how often each occurs."""
    if not len(term):
        return term, row, row
    bits = np.uint64(max(int(row.max()).bit_length(), 1))
    found = np.sort(term)
    found = found[np.append(True, found[1:] != found[:-1])]
    if (found[1:] >> bits == found[:-1] >> bits).any():  # numbers are sorted much faster than places, but rows must fit beside terms
        order = np.lexsort((row, term))
        t, r = term[order], row[order]
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1])))
        return t[first], r[first], np.diff(np.append(first, len(t)))
    key = term >> bits << bits | row.astype(np.uint64)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n, key = np.diff(np.append(first, len(key))), key[first]
    high = key >> bits
    return found[np.cumsum(np.append(False, high[1:] != high[:-1]))], (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(row.dtype), n


def statistics(docs: DataFrame) -> DataFrame:
    """term and df of every term; the term null has the number of documents as df and of words as ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = words = 0
        for batch in batches:
            raw_all, offs_all = utf8(batch["text"])
            for lo, hi, raw, offs in blocks(raw_all, offs_all, SHARD_BYTES):
                term, row = _terms(raw, offs)
                rows, words = rows + hi - lo, words + len(term)
                found, df = np.unique(_pairs(term, row)[0], return_counts=True)
                yield _stats(found.view(np.int64), df, np.zeros(len(df), np.int64))
        yield _stats([None], [rows], [words])

    parts = docs.select("text").mapInArrow(run, "term long, df long, words long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def _stats(term, df, words) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (term, df, words)], ["term", "df", "words"])


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and qtf of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, row, n = _pairs(*_terms(*utf8(batch["text"])))
            ids = batch["query_id"].take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(term.view(np.int64)), pa.array(n, pa.int64())], ["query_id", "term", "qtf"])

    one = queries.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("query_id")).agg(F.min("text").alias("text"))
    return one.mapInArrow(run, "query_id long, term long, qtf long")


class Index:
    """One shard's postings of the terms that queries ask for."""

    def __init__(self, raw, offs, ids: np.ndarray, wanted: np.ndarray, mean: float):
        term, row = _terms(raw, offs)
        least = np.full(len(ids), np.iinfo(np.uint64).max)
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least[row[first]] = np.minimum.reduceat(term, first)
        order = np.argsort(least, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        ids, row = ids[order], place[row]
        length = np.bincount(row, minlength=len(ids))
        if len(wanted) and len(term):
            at = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
            keep = wanted[at] == term
            term, row = term[keep], row[keep]
        term, self.doc, tf = _pairs(term, row)
        self.ids = ids
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / mean)) if len(tf) else np.zeros(0)
        block = self.doc // BLOCK_DOCS
        self.blocks = -(-len(ids) // BLOCK_DOCS)
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.start = first  # of each (term, block) in the postings
        self.count = np.diff(np.append(first, len(term)))
        self.block = block[first]
        self.highest = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        own = term[first]
        self.terms, self.offset = np.unique(own, return_index=True)
        self.offset = np.append(self.offset, len(own))

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """Where each term is in ``terms`` of the index, -1 if nowhere."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def search(self, row: np.ndarray, weight: np.ndarray, top: Top) -> None:
        n = self.offset[row + 1] - self.offset[row]
        entry = np.repeat(self.offset[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weight = np.repeat(weight, n)
        block = self.block[entry]
        bound = np.bincount(block, weights=weight * self.highest[entry], minlength=self.blocks) * (1 + 1e-9)
        left = np.flatnonzero(bound > 0)
        if top.least == 0 and len(left) > FIRST_BLOCKS:
            first = left[np.argpartition(-bound[left], FIRST_BLOCKS)[:FIRST_BLOCKS]]
            self._score(first, entry, block, weight, top)
            bound[first] = -1
        left = np.flatnonzero(bound >= max(top.least, 1e-300))
        if len(left):
            self._score(left, entry, block, weight, top)

    def _score(self, chosen, entry, block, weight, top: Top) -> None:
        if len(chosen) < self.blocks:
            take = np.zeros(self.blocks, bool)
            take[chosen] = True
            keep = take[block]
            entry, weight = entry[keep], weight[keep]
        n = self.count[entry]
        at = np.repeat(self.start[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        scores = np.bincount(self.doc[at], weights=np.repeat(weight, n) * self.impact[at], minlength=len(self.ids))
        found = np.flatnonzero(scores >= max(top.least, 1e-300))
        top.add(scores[found], self.ids[found])


class Top:
    """The k best of one query so far, by score and then id."""

    def __init__(self, k: int):
        self.k, self.least = k, 0.0
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # ties with the k-th stay
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[keep], ids[keep]
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = float(self.scores[-1])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, n numbers each."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _parts(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that have at most ``most`` entries together (one row at least)."""
    total, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - n[lo] + most, "right")))
        yield slice(lo, hi)
        lo = hi


class Bests:
    """The k best of many queries so far, by score and then id; ``least`` is a lower bound of each one's k-th score."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.new = k, least.copy(), 0
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.least[query]
        self.found.append((query[keep], ids[keep], scores[keep]))
        self.new += len(self.found[-1][0])

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, scores = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], scores[last])
        keep = rank < self.k
        self.found, self.new = [(query[keep], ids[keep], scores[keep])], 0
        return self.found[0]


class Asked:
    """A block of queries: entries by query, as they come, and by term."""

    def __init__(self, lo: int, first: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.lo, self.size, n = lo, len(first) - 1, np.diff(first)
        self.first, self.n, self.term, self.weight = first[:-1] - first[0], n, term[first[0] : first[-1]], weight[first[0] : first[-1]]
        order = np.argsort(self.term, kind="stable")
        t = self.term[order]
        self.query = np.repeat(np.arange(self.size, dtype=np.int32), n)[order]
        self.weight32 = self.weight[order].astype(np.float32)
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        self.terms, self.start, self.count = t[start], start, np.diff(np.append(start, len(t)))
        #: What sums of as many products in single precision are off by, in proportion, at most; twice that for good measure.
        self.slack = min((int(n.max()) + 16) * 2.0**-23, 0.5)


class Block:
    """Up to ``TILE_DOCS`` documents: postings by term with their highest impacts, and a product for many queries."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        self.ids, self.doc, self.impact32 = ids, doc, impact.astype(np.float32)
        self.start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.terms, self.count = term[self.start], np.diff(np.append(self.start, len(term)))
        self.highest = np.maximum.reduceat(impact, self.start)
        by_doc = np.argsort(doc.astype(np.uint16), kind="stable")
        self.doc_row, self.doc_impact = np.repeat(np.arange(len(self.terms)), self.count)[by_doc], impact[by_doc]
        self.of_doc = np.bincount(doc, minlength=len(ids))
        self.doc_at = np.cumsum(self.of_doc) - self.of_doc

    def search(self, asked: Asked, place: np.ndarray, bests: Bests) -> None:
        """``place`` says where each wanted term is in ``terms``, -1 if nowhere."""
        row = place[asked.terms]
        has = np.flatnonzero(row >= 0)
        row, n = row[has], asked.count[has]
        entry, of = _ranges(asked.start[has], n), np.repeat(np.arange(len(has)), n)
        query, weight = asked.query[entry], asked.weight32[entry]
        bound = np.bincount(query, weights=weight * self.highest[row][of], minlength=asked.size) * (1 + 1e-6)
        least = bests.least[asked.lo : asked.lo + asked.size]
        alive = np.flatnonzero((bound > 0) & (bound >= least))
        if not len(alive):
            return
        if len(alive) < asked.size:
            number = np.full(asked.size, -1, np.int32)
            number[alive] = np.arange(len(alive))
            query = number[query]
            keep = query >= 0
            query, weight, of = query[keep], weight[keep], of[keep]
            n = np.bincount(of, minlength=len(has))
        sums = self._sums(len(alive), query, weight, of, n, row)
        off = 1 - asked.slack
        floor = np.maximum(np.nextafter((least[alive] * off).astype(np.float32), np.float32(0)), np.float32(1e-37))
        docs = len(self.ids)
        hits = np.flatnonzero(sums >= floor[:, None])
        many = np.flatnonzero(np.bincount(hits // docs, minlength=len(alive)) > 4 * bests.k)
        if len(many):
            kth = np.partition(sums[many], docs - bests.k, axis=1)[:, docs - bests.k]
            floor[many] = np.maximum(floor[many], kth * np.float32(off * off))
            hits = hits[sums.reshape(-1)[hits] >= floor[hits // docs]]
        if len(hits):
            which, doc = np.divmod(hits, docs)
            bests.add(alive[which] + asked.lo, self.ids[doc], self._exact(asked, alive[which], doc, place))

    def _sums(self, size: int, query, weight, of, n, row) -> np.ndarray:
        """Every query's score of every document, in single precision; ``of`` says which of the terms at ``row`` an entry is of."""
        docs, count = len(self.ids), self.count[row]
        sums = np.zeros((size, docs), np.float32)
        dense = np.flatnonzero(n * count * DENSE > size * docs)
        column = np.full(len(row), -1, np.int64)
        column[dense] = np.arange(len(dense))
        at = column[of]
        for lo in range(0, len(dense), PRODUCT_TERMS):
            some = dense[lo : lo + PRODUCT_TERMS]
            left, right = np.zeros((size, len(some)), np.float32), np.zeros((len(some), docs), np.float32)
            mine = np.flatnonzero((at >= lo) & (at < lo + len(some)))
            left[query[mine], at[mine] - lo] = weight[mine]
            posting = _ranges(self.start[row[some]], count[some])
            right[np.repeat(np.arange(len(some)), count[some]), self.doc[posting]] = self.impact32[posting]
            sums += left @ right
        rest = np.flatnonzero(at < 0)
        first, n = self.start[row][of[rest]], count[of[rest]]
        flat, base, weight = sums.reshape(-1), query[rest].astype(np.int64) * docs, weight[rest]
        for part in _parts(n, WALKED):
            posting = _ranges(first[part], n[part])
            np.add.at(flat, np.repeat(base[part], n[part]) + self.doc[posting], np.repeat(weight[part], n[part]) * self.impact32[posting])
        return sums

    def _exact(self, asked: Asked, query: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The scores of pairs of queries, in order, and documents, added up term by term in double precision."""
        weights, scores = np.zeros(len(self.terms)), []
        start, docs = self.doc_at[doc].tolist(), doc.tolist()
        end = (self.doc_at[doc] + self.of_doc[doc]).tolist()
        some, first = np.unique(query, return_index=True)
        for q, lo, hi in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(docs)]):
            own = slice(asked.first[q], asked.first[q] + asked.n[q])
            row = place[asked.term[own]]
            has = row >= 0
            row = row[has]
            weights[row] = asked.weight[own][has]
            for a, b in zip(start[lo:hi], end[lo:hi]):
                scores.append((weights[self.doc_row[a:b]] * self.doc_impact[a:b]).cumsum()[-1])  # one after the other: equal terms, equal sum
            weights[row] = 0
        return np.array(scores)


def _doc_blocks(raw: np.ndarray, offs: np.ndarray, ids: np.ndarray, wanted: np.ndarray, common: np.ndarray, mean: float) -> Iterator[Block]:
    """A shard's documents in blocks, by their most common wanted term and their number of terms; ``common`` ranks the wanted terms."""
    term, row = _terms(raw, offs)
    length = np.bincount(row, minlength=len(ids))
    term, row, tf = _pairs(term, row)
    if not len(term):
        return
    start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    at = np.minimum(np.searchsorted(wanted, term[start]), len(wanted) - 1)
    at = np.repeat(np.where(wanted[at] == term[start], at, -1), np.diff(np.append(start, len(term))))
    keep = np.flatnonzero(at >= 0)
    term, row, tf = at[keep], row[keep], tf[keep]
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
    best = np.full(len(ids), len(wanted), common.dtype)
    np.minimum.at(best, row, common[term])
    order = np.lexsort((-np.bincount(row, minlength=len(ids)), best))  # long ones first: they score high, and bounds rise early
    order = order[best[order] < len(wanted)]
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(order))
    block, doc = np.divmod(place[row], TILE_DOCS)
    by_block = np.argsort(block.astype(np.uint16) if len(order) <= TILE_DOCS << 16 else block, kind="stable")
    term, doc, impact, block = term[by_block], doc[by_block].astype(np.int32), impact[by_block], block[by_block]
    ends = np.searchsorted(block, np.arange(-(-len(order) // TILE_DOCS) + 1))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        yield Block(ids[order[i * TILE_DOCS : (i + 1) * TILE_DOCS]], term[a:b], doc[a:b], impact[a:b])


def _search_many(batches: Iterator[pa.RecordBatch], queries: tuple, least: np.ndarray, k: int, mean: float) -> Iterator[pa.RecordBatch]:
    qid, first, term, weight, wanted, common = queries
    asked = [Asked(lo, first[lo : lo + TILE_QUERIES + 1], term, weight) for lo in range(0, len(qid), TILE_QUERIES)]
    place, bests = np.full(len(wanted), -1, np.int32), Bests(k, least)
    for batch in batches:
        raw_all, offs_all = utf8(batch["text"])
        ids = batch["doc_id"].to_numpy()
        for lo, hi, raw, offs in blocks(raw_all, offs_all, SHARD_BYTES):
            for block in _doc_blocks(raw, offs, ids[lo:hi], wanted, common, mean):
                place[block.terms] = np.arange(len(block.terms), dtype=np.int32)
                for some in asked:
                    block.search(some, place, bests)
                place[block.terms] = -1
                if bests.new >= len(qid) * k // 8:
                    bests.settle()
    query, ids, scores = bests.settle()
    yield _scored(qid[query], ids, scores)


def _search_few(batches: Iterator[pa.RecordBatch], queries: tuple, k: int, mean: float) -> Iterator[pa.RecordBatch]:
    qid, first, term, weight, wanted, _ = queries
    term = wanted[term]
    tops = [Top(k) for _ in qid]
    for batch in batches:
        raw_all, offs_all = utf8(batch["text"])
        ids = batch["doc_id"].to_numpy()
        for lo, hi, raw, offs in blocks(raw_all, offs_all, SHARD_BYTES):
            index = Index(raw, offs, ids[lo:hi], wanted, mean)
            rows = index.rows(term)
            for a, b, top in zip(first[:-1].tolist(), first[1:].tolist(), tops):
                row = rows[a:b]
                has = row >= 0
                if has.any():
                    index.search(row[has], weight[a:b][has], top)
    yield _scored(np.repeat(qid, [len(t.ids) for t in tops]), np.concatenate([t.ids for t in tops]), np.concatenate([t.scores for t in tops]))


def _scored(query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "doc_id", "score"])


def _in_blocks(qid: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple:
    """Queries in the order of their blocks: ids, where each one's entries start, the entries (their terms by place in
    the wanted ones), the wanted terms and their ranks, the most common first."""
    wanted, at = np.unique(term, return_inverse=True)
    common = np.empty(len(wanted), np.int32)
    common[np.argsort(-np.bincount(at), kind="stable")] = np.arange(len(wanted), dtype=np.int32)
    ids, query, n = np.unique(qid, return_inverse=True, return_counts=True)
    best = np.full(len(ids), len(wanted), np.int32)
    np.minimum.at(best, query, common[at])
    order = np.lexsort((n, best))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    entries = np.lexsort((at, place[query]))
    return ids[order], np.append(0, np.cumsum(n[order])), at[entries].astype(np.int32), weight[entries], wanted, common


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), doc_id and score: the k best documents of each query; both tables have doc_id and text."""
    spark = docs.sparkSession
    stats = cut(statistics(docs))
    total = stats.filter("term is null").first()
    size, mean = (total.df, max(total.words, 1) / max(total.df, 1)) if total else (0, 1.0)
    asked = query_terms(queries).join(stats.filter("term is not null"), "term")
    idf = F.log(1 + (F.lit(float(size)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = cut(asked.select("query_id", "term", (idf * F.col("qtf")).alias("weight")))
    passes = -(-asked.count() // QUERY_TERMS)
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found = None
    for i in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow()  # about QUERY_TERMS rows
        if not len(part):
            continue
        qid, term, weight = (part[c].to_numpy() for c in ("query_id", "term", "weight"))
        part = _pass(rows, _in_blocks(qid, term.view(np.uint64), weight), k, mean, size)
        found = part if found is None else found.unionByName(part)
    return _best(spark.createDataFrame([], "query_id long, doc_id long, score double"), k) if found is None else found


def _pass(rows: DataFrame, queries: tuple, k: int, mean: float, size: int) -> DataFrame:
    """The k best of the queries of a pass, which are final, as a query is in one pass; the pass's queries can go then."""
    context, few = rows.sparkSession.sparkContext, len(queries[0]) < FEW_QUERIES
    shared = context.broadcast(queries)

    def best(rows: DataFrame, least: np.ndarray) -> DataFrame:
        bounds = context.broadcast(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _search_few(batches, shared.value, k, mean) if few else _search_many(batches, shared.value, bounds.value, k, mean)

        out = cut(_best(rows.mapInArrow(run, "query_id long, doc_id long, score double"), k))
        bounds.destroy()
        return out

    least = np.zeros(len(queries[0]))
    every = max(SAMPLE, math.isqrt(size // (k * EXACT)))  # a sample of n-th costs a n-th of all scores, and leaves k * n exact ones
    if not few and size > every * k:
        some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).repartition(-(-size // (every * SAMPLE_DOCS)))
        last = best(some, least).filter(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query
        order = np.argsort(queries[0])
        least[order[np.searchsorted(queries[0], last["query_id"].to_numpy(), sorter=order)]] = last["score"].to_numpy()
    found = best(rows, least)
    shared.destroy()
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all shards' own k best."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
