"""Each stage's decisions against its own operator or brute force, and the whole run."""

import re

import corpus_pipeline
import numpy as np
import pytest

from foliolens.llm import decontamination, toxicity
from test_native import brute_spans
from test_ngram_jaccard_join import brute


def distance_within(item, text):
    """The least edit distance of ``item`` to any part of ``text``, a row at a time."""
    row = np.zeros(len(text) + 1, int)
    steps = np.arange(len(text) + 1)
    for c in item:
        new = np.minimum(row[1:] + 1, row[:-1] + (np.array(list(text)) != c))
        new = np.concatenate([[row[0] + 1], new])
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


def rows_of(df):
    return sorted(df.collect(), key=str)


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    """Input of the first stage and output of every stage, each written and read again."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_names_and_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "sentencepiece"]
    assert all(o.columns == outputs[0].columns for o in outputs[:-1])


def test_toxicity(spark, sf, outputs):
    model = toxicity.fit_on_labels(outputs[0], spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in model.score(outputs[0]).collect() if r.score >= toxicity.THRESHOLD}
    assert bad and {r.doc_id for r in outputs[1].collect()} == {r.doc_id for r in outputs[0].collect()} - bad


def test_near_duplicates(outputs):
    rows = outputs[1].collect()
    want = {c for _, c in brute([(r.doc_id, r.text) for r in rows], 5, 80).values()}
    assert sorted(r.doc_id for r in outputs[2].collect()) == sorted(want) and len(want) < len(rows)


def test_decontamination(spark, sf, outputs):
    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: decontamination.normal(r.text) for r in outputs[2].collect()}
    hit = {d for d, t in texts.items() if any(i in t for i in items)}
    gone = texts.keys() - {r.doc_id for r in outputs[3].collect()}
    assert hit and hit <= gone
    for d in gone - hit:  # those with an item within the error budget, by a plain edit distance
        assert any(distance_within(i, texts[d]) <= len(i) * decontamination.PERCENT // 100 for i in items)


def test_secrets(outputs):
    before, after = ({r.doc_id: r for r in o.collect()} for o in outputs[3:5])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not re.search(r"access|hex", brute_spans(r.text)) and r.n_chars == len(r.text)
        assert (r.text == before[i].text) == ("[REDACTED]" not in r.text)


def test_whole_run(spark, sf, outputs):
    assert rows_of(corpus_pipeline.run(spark, sf)) == rows_of(outputs[5]) and outputs[5].count() == outputs[4].count()


def test_odd_rows_pass_every_stage(spark, sf, docs_of):
    docs = docs_of([(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, "twice"), (3, "twice"), (4, "x " * 60_000), (5, "one id"), (5, "two texts"), (6, "two texts")])
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        assert name == "sentencepiece" or docs.columns == before.columns
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 2, 3, 4, 5, 5, None, None]
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
