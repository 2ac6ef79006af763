"""The pruned search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from foliolens.llm import bm25_topk, queries
from foliolens.llm.common import utf8


def brute(docs, asked, k):
    bags = [(i, Counter(re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or "")))) for i, t in docs]
    mean = max(sum(sum(b.values()) for _, b in bags), 1) / max(len(bags), 1)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for q, text in asked:
        query = Counter(re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or "")))
        found = []
        for i, bag in bags:
            shared = [w for w in query if w in bag]
            if shared and i is not None:
                norm = 1.2 * (1 - 0.75 + 0.75 * sum(bag.values()) / mean)
                s = sum(query[w] * math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + norm) for w in shared)
                found.append((-round(s, 6), i))
        out[q] = sorted(found)[:k]
    return out


def same(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
    assert [r["rank"] for r in sorted(rows, key=lambda r: (r.query_id, r["rank"]))] == [n for q in sorted(got) for n in range(1, len(got[q]) + 1)]
    for q, best in want.items():
        have = got.get(q, [])
        assert [s for s, _ in have] == [s for s, _ in best]
        last = best[-1][0] if best else None
        assert [x for x in have if x[0] != last] == [x for x in best if x[0] != last]


def test_matches_brute_force(spark, docs_of, monkeypatch):
    r = random.Random(9)
    text = lambda: " ".join(f"{r.choice('xyzé')}{int(r.paretovariate(0.6)) % 300}" for _ in range(r.randrange(1, 60)))
    docs = [(i, text()) for i in range(700)] + [(i, "x1 the same copy") for i in range(700, 730)]
    docs += [(None, "x1 null id"), (800, None), (900, ""), (1000, "--"), (1, "x1, x2! X1"), (1, "x1, x2! X1")]
    asked = [d for d in docs if d[0] is not None and d[0] % 100 == 0]
    monkeypatch.setattr(bm25_topk, "QUERY_TERMS", 60)  # several passes
    df = docs_of(docs).repartition(3)
    same(bm25_topk.top_k(df, df.filter("doc_id % 100 = 0"), 7).collect(), brute(docs, asked, 7))


def test_blocks_are_pruned_without_loss(monkeypatch):
    """Of the blocks of a shard whose documents come in any order, most are never scored, and the best are the same."""
    r = random.Random(3)
    topics = [[f"t{t}w{i}" for i in range(40)] for t in range(60)]
    texts = [" ".join(r.choice(topics[i % 60] if r.random() < 0.8 else r.choice(topics)) for _ in range(r.randrange(20, 90))) for i in range(3000)]
    raw, offs = utf8(pa.array(texts))
    ids = np.arange(3000)
    term, row, _ = bm25_topk._pairs(*bm25_topk._terms(raw, offs))
    wanted, df = np.unique(term, return_counts=True)
    index = bm25_topk.Index(raw, offs, ids, wanted, 50.0)
    scored, score = [], bm25_topk.Index._score
    monkeypatch.setattr(bm25_topk.Index, "_score", lambda self, chosen, *a: (scored.append(len(chosen)), score(self, chosen, *a))[1])
    for q in range(0, 3000, 100):
        own = term[row == q]
        weight = np.log(1 + (3000 - df[np.searchsorted(wanted, own)] + 0.5) / (df[np.searchsorted(wanted, own)] + 0.5))
        pruned, whole = bm25_topk.Top(10), bm25_topk.Top(10)
        index.search(index.rows(own), weight, pruned)
        entry = np.concatenate([np.arange(index.offset[i], index.offset[i + 1]) for i in index.rows(own)])
        size = np.repeat(weight, [index.offset[i + 1] - index.offset[i] for i in index.rows(own)])
        score(index, np.arange(index.blocks), entry, index.block[entry], size, whole)
        assert np.array_equal(pruned.ids, whole.ids) and np.allclose(pruned.scores, whole.scores)
    assert sum(scored) < 0.4 * 30 * index.blocks


def test_words_that_look_alike_and_long_texts(spark, docs_of, alike):
    long = " ".join(f"w{i % 9000}" for i in range(150_000))
    docs = [(100, f"{alike[0]} x"), (101, f"{alike[1]} x"), (102, alike[0]), (200, long), (201, "w5 w6"), (300, "z" * 2_000_000)]
    asked = [d for d in docs if d[0] % 100 == 0]
    same(bm25_topk.top_k(docs_of(docs), docs_of(asked), 5).collect(), brute(docs, asked, 5))


def test_nothing_to_find(spark, docs_of):
    none, some = docs_of([]), docs_of([(0, "a")])
    assert bm25_topk.top_k(none, none).count() == bm25_topk.top_k(some, none).count() == bm25_topk.top_k(none, some).count() == 0


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = list(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    same(queries.op6_bm25_topk(spark, sf).collect(), brute(docs, [d for d in docs if d[0] % 100 == 0], 10))


def prose(n, words=400, seed=5):
    r = random.Random(seed)
    vocabulary = [f"{r.choice('abcdé')}{i}" for i in range(words)]
    return [" ".join(vocabulary[min(int(r.paretovariate(0.7)) - 1, words - 1)] for _ in range(r.randrange(1, 120))) for _ in range(n)]


def many(texts, asked, k):
    """What a task is given: a batch and the queries in blocks, and the exact result of one task that searches them one by one."""
    term, row, tf = bm25_topk._pairs(*bm25_topk._terms(*utf8(pa.array(texts))))
    terms, df = np.unique(term, return_counts=True)
    keep = np.isin(row, asked)
    weight = (np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))[np.searchsorted(terms, term)] * tf)[keep]
    queries = bm25_topk._in_blocks(row[keep].astype(np.int64), term[keep], weight)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (want,) = bm25_topk._search_few(iter([batch]), queries, k, 60.0)
    return batch, queries, want


def rows(batch):
    return sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: (r[0], -r[2], r[1]))


def test_queries_searched_together_find_the_same(monkeypatch):
    texts = prose(500) + ["a1 a1 the same"] * 30 + ["", None, "--", "zz unique"]
    batch, queries, want = many(texts, [*range(0, 500, 7), 505, 533], 6)
    for name, value in (("TILE_DOCS", 50), ("TILE_QUERIES", 9), ("PRODUCT_TERMS", 7), ("WALKED", 100)):
        monkeypatch.setattr(bm25_topk, name, value)
    for dense in (0, 20, 1e9):  # no products, some, nothing but products
        monkeypatch.setattr(bm25_topk, "DENSE", dense)
        (got,) = bm25_topk._search_many(iter([batch.slice(0, 200), batch.slice(200)]), queries, np.zeros(len(queries[0])), 6, 60.0)
        assert rows(got) == rows(want)
    monkeypatch.setattr(bm25_topk, "SHARD_BYTES", 3000)
    (got,) = bm25_topk._search_many(iter([batch]), queries, np.zeros(len(queries[0])), 6, 60.0)
    assert rows(got) == rows(want)


def test_frequent_terms_are_not_walked_posting_by_posting(monkeypatch):
    batch, queries, want = many(prose(3000, 3000), range(0, 3000, 10), 10)
    walked, ranges = [], bm25_topk._ranges
    monkeypatch.setattr(bm25_topk, "_ranges", lambda start, n: (walked.append(int(n.sum())), ranges(start, n))[1])
    (got,) = bm25_topk._search_many(iter([batch]), queries, np.zeros(len(queries[0])), 10, 60.0)
    term, row, _ = bm25_topk._pairs(*bm25_topk._terms(*utf8(batch["text"])))
    df = dict(zip(*(x.tolist() for x in np.unique(term, return_counts=True))))
    assert rows(got) == rows(want) and sum(walked) < sum(df[t] for t in queries[4][queries[2]].tolist()) / 3


def test_tasks_start_from_a_bound_and_yield_few_rows():
    batch, queries, want = many(prose(2000), range(0, 2000, 10), 10)
    last = {q: s for q, _, s in reversed(rows(want))}
    least = np.array([min(s for q, _, s in rows(want) if q == i) for i in queries[0].tolist()])
    tasks = [rows(b) for lo in range(0, 2000, 250) for b in bm25_topk._search_many(iter([batch.slice(lo, 250)]), queries, least, 10, 60.0)]
    assert len(last) == 200 and sum(map(len, tasks)) < 1.1 * len(rows(want)) and not set(rows(want)) - {r for t in tasks for r in t}


def test_many_queries_match_brute_force(spark, docs_of, monkeypatch):
    docs = list(enumerate(prose(900))) + [(i, "a1 the same copy") for i in range(900, 930)] + [(None, "a1 b2"), (930, None), (940, ""), (5, "a1, b2"), (10, "a1")]
    asked = [(i, min(t for j, t in docs if j == i and t is not None)) for i in range(0, 930, 10)]
    for name, value in (("FEW_QUERIES", 0), ("SAMPLE", 4), ("SAMPLE_DOCS", 50), ("QUERY_TERMS", 1500)):
        monkeypatch.setattr(bm25_topk, name, value)
    df = docs_of(docs).repartition(3)
    same(bm25_topk.top_k(df, df.filter("doc_id % 10 = 0 and doc_id < 930"), 7).collect(), brute(docs, asked, 7))


def test_terms_alike_in_their_high_bits_are_told_apart():
    r = random.Random(2)
    for terms in ([5 << 40, 7 << 40], [8, 9, 10, 8 << 20], [2**64 - 1, 2**64 - 2, 0]):
        pairs = [(r.choice(terms), r.randrange(9)) for _ in range(200)]
        term, row, n = bm25_topk._pairs(np.array([t for t, _ in pairs], np.uint64), np.array([d for _, d in pairs], np.int32))
        assert list(zip(term.tolist(), row.tolist(), n.tolist())) == [(*p, c) for p, c in sorted(Counter(pairs).items())]
