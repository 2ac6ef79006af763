"""Window removal against a dictionary of every window."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from foliolens.llm import queries, substring_dedup


def brute(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, words in split:
        for a in range(len(words) - 12):
            key = tuple(words[a : a + 13])
            first[key] = min(first.get(key, float("inf")), order(i))
    out = []
    for i, words in split:
        gone = set()
        for a in range(len(words) - 12):
            if first[tuple(words[a : a + 13])] < order(i):
                gone |= set(range(a, a + 13))
        out.append((i, len(words), len(gone), " ".join(w for a, w in enumerate(words) if a not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("flush,block,hot", [(1_000_000, 2 << 20, 1 << 14), (50, 600, 1 << 14), (50, 600, 6), (1_000_000, 300, 2)])
def test_matches_brute_force(spark, docs_of, flush, block, hot):
    r = random.Random(2)
    passages = [[f"p{r.randrange(50)}é" for _ in range(r.randrange(8, 90))] for _ in range(12)]
    rows = [(0, None), (1, ""), (None, " ".join(passages[0])), (3, "one " * 40), (4, "one " * 30), (4, "one " * 30), (5, " ".join(passages[0]) + "\x0b\x85x y")]
    for i in range(6, 150):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(passages)
        rows.append((i * 7 % 151 + 6, r.choice([" ", "\n", "\t\r "]).join(words)))
    assert got(substring_dedup.dedup(docs_of(rows).repartition(5), flush=flush, block=block, hot=hot)) == brute(rows)


def test_rows_without_an_id_are_told_apart(spark, docs_of):
    """Many null-id rows with different texts, some of which repeat a document: no other row loses a word."""
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(1, line)] + [(None, f"{line} own{i}" if i % 10 == 0 else " ".join(f"x{i}y{j}" for j in range(20))) for i in range(600)]
    assert got(substring_dedup.dedup(docs_of(rows))) == brute(rows)
    twins = [(1, line), (5, line), (5, "z " * 20), (5, line)]
    assert got(substring_dedup.dedup(docs_of(twins))) == brute(twins)


def test_words_that_look_alike_and_long_texts(spark, docs_of, alike):
    a, b = alike
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*words, a])), (2, " ".join([*words, b])), (3, " ".join([b, *words, a]))]
    rows += [(4, " ".join(f"l{i % 70_000}" for i in range(200_000))), (5, "y" * 3_000_000), (6, " ".join(f"l{i}" for i in range(500)))]
    assert got(substring_dedup.dedup(docs_of(rows))) == brute(rows)


def test_no_rows(spark, docs_of):
    assert substring_dedup.dedup(docs_of([])).count() == 0


def test_query_on_the_table(spark, sf):
    rows = list(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    want = sorted(((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows)), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, sf).collect()), key=str) == want
