"""The permutation, the tokens against the tokenizer itself, and reading back what was written."""

import base64
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from foliolens.llm import queries
from foliolens.llm import training_order as order


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, order.load_ranks().splitlines())}
    return tiktoken.Encoding("own", pat_str=order.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_permutes(size):
    x = order.feistel(np.arange(size), size, 7)
    assert sorted(x) == list(range(size))
    if size > 100:
        assert (x != order.feistel(np.arange(size), size, 8)).any() and (x == np.arange(size)).mean() < 0.05


def check(rows, texts, encoder, length):
    """Every slot once, and each document's parts together are its tokens."""
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    got = {}
    for r in rows:
        ids = np.frombuffer(r.tokens, "<u2")
        assert len(ids) == length and (ids[r.n_tokens :] == order.END).all() and r.shard == r.slot // order.SHARD
        got.setdefault(r.doc_id, []).append((r.part, ids[: r.n_tokens].tolist()))
    for doc_id, text in texts.items():
        want = encoder.encode_ordinary(text or "") + [order.END]
        assert sum((x for _, x in sorted(got[doc_id])), []) == want


def test_odd_rows(spark, docs_of, encoder, tmp_path):
    r = random.Random(4)
    odd = "a  b\n\n c  d 　e\t\tf 's don't 12 3é…  \n x   "
    texts = {None: "no id", 1: None, 2: "", 3: odd, 4: odd * 300, 5: " \n", 6: "x" * 3000}
    texts |= {i: "".join(r.choice("ab c\n\té'1  ") for _ in range(200)) for i in range(10, 40)}
    rows = order.sequences(docs_of(list(texts.items())).repartition(3), length=16)
    got = rows.collect()
    check(got, texts, encoder, 16)
    path = tmp_path.as_uri()
    manifest = order.write_shards(rows, path).collect()
    assert sum(m.records for m in manifest) == len(got)
    by_slot = {x.slot: x.tokens for x in got}
    assert order.read_records(path, 5, 40, length=16).tobytes() == b"".join(by_slot[s] for s in range(5, 45))
    again = {x.slot: x.tokens for x in order.sequences(docs_of(list(texts.items())).repartition(7), length=16).collect()}
    assert again == by_slot


def test_files_are_the_same_after_a_repeated_and_a_broken_write(spark, docs_of, tmp_path):
    rows = order.sequences(docs_of([(i, f"word{i} " * (i % 40)) for i in range(200)]), length=8, shard=16)
    shards = sorted({r.shard for r in rows.collect()})
    parts = rows.withColumn("task", F.spark_partition_id()).groupBy("shard").agg(F.countDistinct("task").alias("n")).collect()
    assert len(shards) > 9 and {p.n for p in parts} == {1}
    assert all(r.offset == r.slot % 16 * 16 for r in rows.collect())
    path = tmp_path.as_uri()
    read = lambda: {p.name: p.read_bytes() for p in tmp_path.glob("shard-*.bin")}
    manifest = order.write_shards(rows, path, shard=16).collect()
    first = read()
    assert sorted(first) == [f"shard-{s:06d}.bin" for s in shards] and {m.bytes for m in manifest[:-1]} <= {16 * 16, *(len(x) for x in first.values())}
    (tmp_path / "shard-000001.bin").write_bytes(b"cut off")  # a lost attempt leaves its own file, a broken one is replaced
    (tmp_path / ".shard-000001-99.tmp").write_bytes(b"half")
    order.write_shards(rows, path, shard=16).collect()
    assert read() == first
    by_slot = {r.slot: r.tokens for r in rows.collect()}
    assert order.read_records(path, 13, 40, length=8, shard=16).tobytes() == b"".join(by_slot[s] for s in range(13, 53))


def test_chunks_that_look_alike(spark, docs_of, encoder, alike):
    texts = {1: alike[0] + " " + alike[1], 2: alike[1], 3: alike[0], 4: "y" * 300_000}
    check(order.sequences(docs_of(list(texts.items())), length=64).collect(), texts, encoder, 64)


def test_repeated_rows_and_no_rows(spark, docs_of, encoder):
    got = order.sequences(docs_of([(1, "a b"), (1, "a b"), (1, "c"), (None, "z"), (None, "z")]), length=2).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and len(got) == 2 + 2 + 1 + 1 + 1
    assert order.sequences(docs_of([])).count() == 0


def test_query_on_the_table(spark, sf, encoder):
    texts = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    check(queries.op10_training_order(spark, sf).collect(), texts, encoder, order.LENGTH)
