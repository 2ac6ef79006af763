"""Codes and codebooks against plain distances of every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from foliolens.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, part int, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(math.floor(256 * x)) <= 1 << 24 for x in r[1]) and len(r[1]) % parts == 0]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    if not rows:
        return [], None
    x = np.floor(np.array([r[1] for r in rows]).astype(np.float32).astype(float) * 256).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for i in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        code, error = d.argmin(2), d.min(2).sum(1)
        if i < rounds:
            for p, k in {(p, k) for row in code for p, k in enumerate(row)}:
                books[p, k] = np.floor_divide(x[code[:, p] == k, p].sum(0), (code[:, p] == k).sum())
    label = {}
    for r, e in zip(rows, error):
        label[r[2]] = label.get(r[2], 0) + int(e)
    return sorted(((r[0], r[2], "".join(f"{k:02x}" for k in c), int(e), label[r[2]]) for r, c, e in zip(rows, code, error)), key=str), books


def got(codes):
    return sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in codes.collect()), key=str)


def some(n, seed, width=32):
    r = random.Random(seed)
    rows = [(i * 37 % 1009, [float(np.float32(r.gauss(0, 1) * r.choice([0.1, 1, 8]))) for _ in range(width)], r.choice([None, 1, 1, 2])) for i in range(n)]
    return rows + [(2000 + i, list(rows[0][1]), 7) for i in range(n // 3)]  # alike rows


@pytest.mark.parametrize("labels", [100_000, 1])
def test_matches_brute_force(spark, monkeypatch, labels):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", labels)
    rows = some(300, 1)
    odd = [None, [], [None] * 32, [math.nan] * 32, [1.0] * 31 + [math.inf], [1.0] * 16, [1.0] * 33, [1e30] * 32]
    rows += [(-1 - i, v, 1) for i, v in enumerate(odd) if v != [1.0] * 16] + [(5000, odd[5], 1), (None, [0.5] * 32, 3), (None, [0.25] * 32, 3), (1, [0.125] * 32, None)]
    codes, books = vector_codes.compress(table(spark, rows).repartition(7))
    want, entries = brute(rows)
    assert got(codes) == want and (books.entries == entries).all()


def test_ties_go_to_the_lowest_index_and_the_annulus_is_inclusive():
    r = np.random.default_rng(3)
    books = vector_codes.Codebooks(r.integers(-3, 4, (2, 64, 3)))
    x = r.integers(-4, 5, (500, 3))
    for p in range(2):
        d = ((x[:, None] - books.entries[p][None]) ** 2).sum(2)
        index, best, n = books.nearest(p, x)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all() and n < 500 * 64


def test_few_rows_none_and_decoding(spark):
    rows = some(3, 2)
    codes, books = vector_codes.compress(table(spark, rows))
    assert got(codes) == brute(rows)[0] and books.entries.shape == (16, 4, 2)
    back = {r.vec_id: r.embedding for r in vector_codes.decode(codes, books).collect()}
    assert all(abs(a - b) <= 1 / 256 for i, v, _ in rows for a, b in zip(v, back[i]))  # every row is an entry
    codes, books = vector_codes.compress(table(spark, []))
    assert codes.count() == 0 and books is None


def test_query_on_the_table(spark, sf):
    found = queries.op11_vector_codes(spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = brute(rows)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in found) == sorted((i, *x) for i, _, *x in want)
    assert {r.codebooks_sha256 for r in found} == {hashlib.sha256(",".join(str(x) for p in books for k in p for x in k).encode()).hexdigest()}
