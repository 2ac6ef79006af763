"""The run-length index against plain substrings, and removal against a dictionary of every window."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from foliolens.llm import queries, run_index, run_length_dedup, shared_places

W = run_index.CONTEXT


def brute(rows, versions):
    """``versions``: of each row, what tells rows of one id apart and orders them."""
    order = sorted({(i is None, i or 0, v, t or "") for (i, t), v in zip(rows, versions)})
    seen, done = set(), {}
    for *doc, t in order:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - W + 1):
            key = raw[a : a + W]
            if key in seen:
                gone[a : a + W] = True
            seen.add(key)
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        done[*doc] = (len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return sorted(((i, *done[i is None, i or 0, v]) for (i, _), v in zip(rows, versions)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


def versions_of(docs, rows):
    """The operator's own order of rows that share an id."""
    found = {(r.doc_id, r.text): r.version for r in run_length_dedup._keyed(docs).collect()}
    return [found[i, t] for i, t in rows]


def strings(r, n, alphabet="abcdefgh ", most=400):
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, most))) for _ in range(4)]
    out = []
    for _ in range(n):
        x = "".join(r.choice(base)[r.randrange(50) :] for _ in range(r.randrange(1, 4)))
        out.append(x[: len(x) // 2] + "z" * (r.random() < 0.3) + x[len(x) // 2 :] + "a" * (r.randrange(300) if r.random() < 0.2 else 0))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh "])
def test_index_against_plain_substrings(alphabet):
    r = random.Random(len(alphabet))
    for trial in range(12):
        parts = [s.encode() for s in strings(r, r.randrange(2, 20), alphabet)]
        text = np.frombuffer(b"\xff".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        ends = np.cumsum(size + 1) - 1
        cut = run_index.pieces(ends - size, ends, r.choice([3, 50, 512]))
        index = run_index.RunIndex(text, cut[1] if trial % 2 else None)
        assert len(index) < len(text)
        windows = [(text[i : i + W].tobytes(), i) for a, b in zip(ends - size, ends) for i in range(a, b - W + 1)]
        first = {}
        want = np.array([first.setdefault(k, i) < i for k, i in windows], bool)
        assert (index.repeated(*cut)[[i for _, i in windows]] == want).all() if windows else True
        half = np.frombuffer(b"\xff".join(parts[: len(parts) // 2]), np.uint8)
        known = {half[i : i + W].tobytes() for i in range(len(half) - W + 1)}
        found = run_index.RunIndex(half).matched(text, *cut)
        assert [bool(found[i]) for _, i in windows] == [k in known for k, _ in windows]
        # lengths of matches, not only whole ones
        for who, place, match, _ in run_index.RunIndex(half).stream(text, *cut):
            for w, p, m in list(zip(who, place, match))[:3]:
                whole = text[p : min(cut[1][w], p + W)].tobytes()
                assert whole[:m] in half.tobytes() and (m == len(whole) or whole[: m + 1] not in half.tobytes())


@pytest.mark.parametrize("block,hot", [(1_500_000, 1 << 12), (700, 1 << 12), (700, 3), (1_500_000, 2)])
def test_matches_brute_force(spark, docs_of, block, hot):
    r = random.Random(3)
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "y" * 5000), (4, "y" * 4000), (900, "é" * 60), (901, "é" * 60), (902, "b" + "é" * 60)]
    rows += [(5 + i * 7 % 131, t) for i, t in enumerate(strings(r, 120, most=300))] + [(1000 + i, "copy " * 30 + "of one text " * 9) for i in range(20)]
    docs = docs_of(rows).repartition(5)
    assert got(run_length_dedup.dedup(docs, block=block, hot=hot)) == brute(rows, versions_of(docs, rows))


def test_rows_that_share_an_id(spark, docs_of):
    text = "".join(chr(97 + i * i % 26) for i in range(150)) + "tail"
    rows = [(1, text), (5, text), (5, "z" + text), (5, text), (None, text), (None, "q" + text), (None, text), (None, "own " + "r" * 90)]
    docs = docs_of(rows)
    assert got(run_length_dedup.dedup(docs)) == brute(rows, versions_of(docs, rows))


def test_long_texts_and_no_rows(spark, docs_of):
    r = random.Random(4)
    long = "".join(r.choice("abcd") for _ in range(30_000))
    rows = [(1, long), (2, long[::-1] + long[5_000:9_000]), (3, long[7_000:7_099]), (4, long[7_000:7_100])]
    docs = docs_of(rows)
    assert got(run_length_dedup.dedup(docs, block=9_000)) == brute(rows, [0] * 4)
    assert run_length_dedup.dedup(docs_of([])).count() == 0


def test_places_that_others_have(spark):
    r = random.Random(6)
    held = [(r.randrange(40) if r.random() < 0.8 else 1000 + i, i, 0, r.choice([1, 1, -2])) for i in range(200)]
    found = shared_places.shared(spark.createDataFrame(held, shared_places.HELD), 12).collect()
    by = {}
    for p, k, _, n in held:
        by.setdefault(p, []).append((k, n))
    want = {(k, p) for p, rows in by.items() for k, n in rows if len(rows) > 1 and n > 0}
    assert {(x.key, x.bucket) for x in found if not x.total} == want
    assert {(x.bucket, x.total) for x in found if x.total} == {(p, t) for p, rows in by.items() if (t := sum(abs(n) for _, n in rows)) > 12}


def test_query_on_the_table(spark, sf):
    rows = list(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    want = sorted((i, a, b, c, hashlib.sha256(k).hexdigest()) for i, a, b, c, k in brute(rows, [0] * len(rows)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op12_run_length_dedup(spark, sf).collect()) == want


def test_every_row_knows_where_its_context_is_first():
    """A full match is judged by one look-up by row; no search over the contexts that occur again."""
    r = np.random.default_rng(3)
    part = r.integers(97, 99, 300, np.uint8)
    text = np.concatenate([part, r.integers(97, 100, 200, np.uint8), part[:150], part])
    index = run_index.RunIndex(text)
    padded = np.append(text, [run_index.BORDER] * (run_index.CONTEXT + 1)).astype(np.uint8).tobytes()
    contexts = [padded[i : i + run_index.CONTEXT] for i in range(len(text) + 1)]
    first = {}
    for i, c in enumerate(contexts):
        first.setdefault(c, i)
    assert index.earliest.tolist() == [first[c] for c in sorted(contexts)]
    start, end = np.array([0]), np.array([len(text)])
    got = np.flatnonzero(index.repeated(*run_index.pieces(start, end)))
    assert got.tolist() == [i for i in range(len(text) - run_index.CONTEXT + 1) if first[contexts[i]] < i]
