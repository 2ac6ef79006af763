"""Pigeonhole edit matching against a plain edit-distance table."""

import random

import pyarrow.parquet as pq

from foliolens.llm import decontamination as dec
from foliolens.llm import queries


def substring_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        old, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            old, row[j] = row[j], min(old + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(300):
        pattern = "".join(r.choice("abcé") for _ in range(r.randrange(1, 90)))
        text = "".join(r.choice("abcé") for _ in range(r.randrange(0, 120)))
        assert dec.myers(pattern, text)[0] == substring_distance(pattern, text)


def edited(r, text, edits):
    x = list(text)
    for _ in range(edits):
        i = r.randrange(len(x))
        x[i : i + r.randrange(2)] = [r.choice("abcdefgh ")] * r.randrange(2)
    return "".join(x)


def test_matches_brute_force(spark, docs_of, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randrange(3, 14)))) for i in range(12)] + [(12, "--"), (13, None), (None, "never found"), (0, "twice the same id here")]
    rows = [(0, None), (1, ""), (2, "twice the same id here"), (2, "twice the same id here"), (None, "twice, THE same\nid here")]
    for i in range(3, 60):
        body = [word() for _ in range(r.randrange(40))]
        at = r.randrange(len(body) + 1)
        rows.append((i, " ".join(body[:at] + [edited(r, items[r.randrange(12)][1], r.randrange(9)).upper()] + body[at:])))
    monkeypatch.setattr(dec, "BLOCK_CHARS", 150)  # several blocks
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text in rows:
        for item, passage in items:
            p = dec.normal(passage)
            if item is not None and p and (d := substring_distance(p, dec.normal(text))) <= len(p) * dec.PERCENT // 100:
                want.append((doc, item, d))
    docs = docs_of(rows)
    got = [tuple(x) for x in dec.matches(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = [x.doc_id for x in dec.clean(docs, benchmark).collect()]
    assert sorted(left, key=str) == sorted((i for i, _ in rows if i not in {w[0] for w in want}), key=str)
    assert dec.clean(docs, benchmark).columns == docs.columns


def test_no_items_and_no_documents(spark, docs_of):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dec.matches(docs_of([(1, "a")]), empty).count() == 0 and dec.clean(docs_of([(1, "a")]), empty).count() == 1
    assert dec.matches(docs_of([]), spark.createDataFrame([(1, "abc")], "item_id long, text string")).count() == 0


def test_query_finds_all_exact_passages(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    exact = {(d["doc_id"], i["item_id"]) for d in docs for i in items if dec.normal(i["text"]) in dec.normal(d["text"])}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op7_decontamination(spark, sf).collect()}
    assert exact and exact == {k for k, d in got.items() if d == 0}


def test_long_texts_and_items(spark, docs_of):
    r = random.Random(2)
    item = " ".join(f"w{r.randrange(10**6)}" for _ in range(400))
    body = " ".join(f"b{i % 977}" for i in range(250_000))
    edits = item[:900].replace("w", "v", 30) + item[900:]
    docs = docs_of([(1, f"{body} {item} {body}"), (2, f"{body} {edits}"), (3, body), (4, "q" * 2_000_000)])
    got = {(x.doc_id, x.item_id): x.distance for x in dec.matches(docs, spark.createDataFrame([(1, item), (2, "zz" * 60)], "item_id long, text string")).collect()}
    assert got == {(1, 1): 0, (2, 1): 30}
