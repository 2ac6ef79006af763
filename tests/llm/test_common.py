"""Cutting lineage in the shared folder, and walking batches in blocks."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliolens.llm import common
from foliolens.llm.words import shingles, split


def test_cut_wide_and_release(spark):
    df = common.cut_wide(spark.range(5))
    path = common._WRITTEN[spark.sparkContext.applicationId][-1]
    assert df.count() == 5 and path.startswith(common.shared_dir(spark))
    assert common.cut(spark.range(3)).count() == 3
    common.release(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not common._WRITTEN[spark.sparkContext.applicationId]


def test_one_table_is_dropped(spark):
    one, two = common.cut_wide(spark.range(5)), common.cut_wide(spark.range(6))
    common.dropped(one)
    assert two.count() == 6 and len(common._WRITTEN[spark.sparkContext.applicationId]) == 1
    common.release(spark)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session)


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 7, *range(20)]), r.randrange(5)) for _ in range(500)]
    got = common.running(spark.createDataFrame(rows, "k long, n long").repartition(7), ["k"], F.col("n")).collect()
    ordered = sorted(got, key=lambda x: x.before + x.n)
    assert [x.before for x in ordered] == [sum(y.n for y in ordered[:i]) for i in range(len(ordered))] and {x.total for x in got} == {sum(n for _, n in rows)}
    assert sorted(((x.k, x.n) for x in got), key=str) == sorted(rows, key=str)
    by_key = sorted((x for x in got if x.n), key=lambda x: x.before)
    assert [x.k for x in by_key] == sorted((x.k for x in by_key), key=lambda k: (k is not None, k))
    assert common.running(spark.createDataFrame([], "k long"), ["k"]).count() == 0


def test_blocks_cover_every_row():
    texts = ["", "aé", None, "x" * 50, "b", ""]
    raw, offs = common.utf8(pa.array(["skip", *texts, "skip"]).slice(1, len(texts)))
    got = []
    for lo, hi, part, at in common.blocks(raw, offs, 10):
        assert hi > lo and (at[-1] <= 10 or hi == lo + 1)
        got += [part[at[i] : at[i + 1]].tobytes().decode() for i in range(hi - lo)]
    assert got == [t or "" for t in texts]


def test_words_are_split_as_bytes_split():
    texts = ["a  b", "", " \n", "é\x0b\x85 x", "end ", "\ta"]
    raw, offs = common.utf8(pa.array(texts))
    starts, ends, row = split(raw, offs)
    assert [(int(r), raw[a:b].tobytes()) for a, b, r in zip(starts, ends, row)] == [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
    one, two, none = shingles(*common.utf8(pa.array(["A b c", "a B  c", " "])), 2)
    assert np.array_equal(one, two) and len(one) == 2 and len(none) == 0
