"""Components of the similarity join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

from foliolens.llm import ngram_jaccard_join as join
from foliolens.llm import queries
from foliolens.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for x, (_, s) in enumerate(sets):
        for g in s:
            at.setdefault(g, set()).add(x)
    met = {p for xs in at.values() for p in combinations(sorted(xs), 2)}
    for x, y in met:
        (i, a), (j, b) = sets[x], sets[y]
        if 100 * len(a & b) >= percent * len(a | b):
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, count):
    """Groups whose members are one to many edits apart, of sizes on both sides of the boundary."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(400))
    rows = []
    while len(rows) < count:
        base = [word() for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 18, 25, 40, 80, 200]))]
        for _ in range(r.choice([1, 2, 3, 8])):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                i = r.randrange(len(x) + 1)
                x[i : i + r.randrange(2)] = [word()] * r.randrange(2)
            rows.append((r.randrange(10**6) * 1000 + len(rows), r.choice([" ", "\n", "\t "]).join(x)))
    return rows


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_matches_all_pairs(spark, docs_of, k, percent):
    rows = near_copies(k, 500) + [(1, None), (2, ""), (3, " \n"), (5, "A b"), (6, "a B"), (7, "a"), (8, "a b c d e")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.join_components(docs_of(rows), k, percent).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("short,part", [(join.SHORT_LIST, join.LIST_PART), (2, 30)])
def test_one_large_group_and_a_common_passage(spark, docs_of, monkeypatch, short, part):
    monkeypatch.setattr(join, "SHORT_LIST", short)
    monkeypatch.setattr(join, "LIST_PART", part)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(400):
        x = list(base)
        for _ in range(r.randrange(12)):
            x[r.randrange(len(x))] = f"m{r.randrange(10**9)}"
        rows.append((i, " ".join(x)))
    for i in range(400, 700):
        x = [f"u{r.randrange(10**9)}" for _ in range(r.randrange(20, 120))]
        rows.append((i, " ".join(x[:10] + common + x[10:])))
    rows += [(i, "the same text in many rows") for i in range(700, 1000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.join_components(docs_of(rows), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_odd_tables(spark, docs_of):
    assert join.join_components(docs_of([])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B c d e f")]
    got = sorted(((r.doc_id, r.component_id) for r in join.join_components(docs_of(rows)).collect()), key=str)
    assert got == [(4, 4), (4, 4), (9, 4), (None, None)]


def test_one_id_with_different_texts(spark, docs_of):
    """Rows of one id are classes of their own: neither passes its links on to the other, and only copies go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = docs_of([(7, a), (7, b), (9, a + " end"), (12, b), (9, c), (20, c + " end"), (20, c + " end")])
    found = join.join_components(docs)
    got = sorted((r.doc_id, r.component_id) for r in found.collect())
    assert got == [(7, 7), (7, 7), (9, 7), (9, 9), (12, 7), (20, 9), (20, 9)] and len({r.component for r in found.collect()}) == 3
    left = join.one_of_each(docs, found)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(7, a), (7, b), (9, c)]


def test_words_that_look_alike_and_long_texts(spark, docs_of, alike):
    rows = [(1, alike[0]), (2, alike[1]), (3, " ".join(alike)), (4, " ".join(alike[::-1]))]
    long = [f"w{i}" for i in range(120_000)]
    rows += [(5, " ".join(long)), (6, " ".join(long[:-9])), (7, "q" * 2_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join.join_components(docs_of(rows)).collect()}
    assert got == brute(rows, 5, 80)


def test_signatures_never_rule_out_a_link():
    r = np.random.RandomState(4)
    for _ in range(300):
        pool = r.randint(0, 2**63, 60).astype(np.uint64)
        a, b = (np.unique(r.choice(pool, r.randint(1, 50))) for _ in range(2))
        bits = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in (join.signature(a) ^ join.signature(b)).tolist())
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


def test_frequent_tokens(spark, docs_of, monkeypatch):
    """Lists that fall into several parts, tokens that many sets of a batch share, and components that meet late."""
    monkeypatch.setattr(join, "LIST_PART", 4)
    r = random.Random(8)
    pool = [[f"s{i}x{j}" for j in range(12)] for i in range(9)]
    rows = []
    for i in range(400):
        words = sum(r.sample(pool, 6), [])
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = f"m{r.randrange(50)}"
        rows.append((i * 37 % 401, " ".join(words)))
    for k, percent in ((3, 75), (4, 85)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in join.join_components(docs_of(rows).repartition(6), k, percent).collect()}
        assert got == brute(rows, k, percent)


def test_query_on_the_table(spark, sf):
    rows = list(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard_join(spark, sf).collect()}
    assert got == brute(rows, 4, 85)


def test_components_of_a_long_path(spark):
    r = random.Random(1)
    ids = r.sample(range(10**9), 300)
    edges = [(ids[i], ids[i + 1]) for i in range(299) if i % 100] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for part in (ids[1:101], ids[101:201], ids[201:]):
        want |= dict.fromkeys(part, min(part))
    assert got == want


@pytest.mark.parametrize("task_edges", [1 << 18, 40, 1])
def test_components_take_few_shuffles(spark, monkeypatch, task_edges):
    """A path in random order: as many edges as one task may contract take no step of joins, fewer take some."""
    from foliolens.llm import components as module

    cuts = []
    monkeypatch.setattr(module, "cut", lambda df: cuts.append(df) or df.checkpoint())
    join.cut(spark.range(1))  # names the folder
    r = random.Random(2)
    ids = r.sample(range(10**9), 400)
    edges = [(ids[i], ids[i + 1]) for i in range(399) if i % 133] + [(7, 7), (None, 3)] + [(ids[5], ids[5 - 3])] * 50
    got = {x.node: x.component for x in components(spark.createDataFrame(r.sample(edges, len(edges)), "a long, b long"), task_edges).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            one = near.get(a, {a}) | near.get(b, {b})
            near |= dict.fromkeys(one, one)
    assert got == {n: min(c) for n, c in near.items()}
    assert (len(cuts) == 2) == (task_edges > len(edges))


@pytest.mark.parametrize("many", [200, 400])
def test_long_lists_make_rows_of_members_and_not_of_pairs(spark, many):
    """Sets of one list, much alike and not linked: blocks give none but the pairs that may link, each once."""
    from pyspark.sql import functions as F

    r = random.Random(many)
    base = [r.getrandbits(63) for _ in range(200)]
    sets = []
    for i in range(many):
        own = sorted(r.sample(base, 140) + [r.getrandbits(63) for _ in range(10)])
        sets.append((i, own))
    sets += [(many + i, sorted(sets[i][1][:-2] + [1 + i])) for i in range(5)]
    df = spark.createDataFrame(sets, "node long, tokens array<long>")
    rows = join.signed(df).select(F.lit(7).cast("long").alias("token"), F.lit(len(sets)).cast("long").alias("members"), F.struct(F.col("node").alias("rep"), F.lit(150).cast("long").alias("n"), F.lit(3).cast("long").alias("pos"), F.col("node").alias("comp"), "s").alias("x"))
    got = {(x.a, x.b) for x in join._in_blocks(rows, 85, part=64).collect()}
    signature = {i: join.signature(np.array(t, np.uint64)) for i, t in sets}
    allowed = 300 - 2 * join.need(150, 150, 85)
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if int(np.bitwise_count(signature[a].view(np.uint64) ^ signature[b].view(np.uint64)).sum()) <= allowed}
    assert got == want and {(i, many + i) for i in range(5)} <= got and len(got) < len(sets)
