"""Held-out accuracy of the classifier, and its defined cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from foliolens.llm import queries, toxicity
from foliolens.llm.words import mix


def brute_features(text):
    """Counts of the buckets of all windows, one at a time."""
    codes, mask = [ord(c) for c in text.lower()], (1 << 64) - 1
    found = Counter()
    for n in toxicity.ORDERS:
        for i in range(len(codes) - n + 1):
            h = codes[i] * int(toxicity._STEP) & mask
            for c in codes[i + 1 : i + n]:
                h = ((h ^ h >> 29) * int(toxicity._STEP) + c) & mask
            found[int(mix(np.array([h + n & mask], np.uint64))[0]) % toxicity.BUCKETS] += 1
    return {*found, *(b + toxicity.BUCKETS for b, c in found.items() if c >= toxicity.OFTEN)}


def test_features_against_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 50)  # texts of several pieces
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 49, 50, 51, 54, 300):
        text = "".join(r.choice("aÀbß🦊 .") for _ in range(n))
        want = brute_features(text)
        assert set(toxicity.ngram_features(text).tolist()) == want
        some = np.zeros(toxicity.BUCKETS, bool)
        some[sorted(w % toxicity.BUCKETS for w in want)[::2]] = True
        assert set(toxicity.ngram_features(text, some).tolist()) == {w for w in want if some[w % toxicity.BUCKETS]}


def test_ratios_and_scores_against_brute_force(spark, docs_of):
    """The whole chain: ratios from counts, the fit's optimum, and every score from the weights."""
    r = random.Random(2)
    text = lambda bad: " ".join(r.choice(["tree", "house", "blue", "walk"] + ["idiot"] * 3 * bad) for _ in range(12))
    rows = [(i, text(i % 3 == 0)) for i in range(90)]
    label = {i: int(i % 3 == 0) for i, _ in rows}
    model = toxicity.fit(spark.createDataFrame([(t, label[i]) for i, t in rows], "text string, label int"))
    sets = {i: brute_features(t) for i, t in rows}
    bad, good = Counter(), Counter()
    for i, s in sets.items():
        (bad if label[i] else good).update(s)
    size = 2 * toxicity.BUCKETS
    share = sum(label.values()) / len(label)
    total_bad, total_good = sum(bad.values()) + size, sum(good.values()) + size
    off = {f: abs(bad[f] - (bad[f] + good[f]) * share) / np.sqrt((bad[f] + good[f]) * share * (1 - share)) for f in {*bad, *good}}
    sure = {f for f, x in off.items() if x >= toxicity.DEVIATIONS}
    assert sure <= set(model.kept.tolist()) and len(model.kept) == max(toxicity.FEWEST, len(sure))
    ratio = {int(f): np.log((bad[f] + 1) / total_bad) - np.log((good[f] + 1) / total_good) for f in model.kept.tolist()}
    weight = dict(zip(model.kept.tolist(), model.weights))
    z = {i: model.intercept + sum(weight.get(f, 0) for f in s) for i, s in sets.items()}
    p = {i: 1 / (1 + np.exp(-x)) for i, x in z.items()}
    for f in sorted(ratio, key=lambda f: -abs(weight[f]))[:40]:  # the gradient of loss and penalty is zero
        slope = sum((p[i] - label[i]) * ratio[f] for i, s in sets.items() if f in s) / len(rows) + toxicity.PENALTY * weight[f] / ratio[f]
        assert abs(slope) < 2e-4
    odd = rows + [(900, None), (901, "IDIOT house " * 9), (902, "ab")]
    scored = {x.doc_id: x.score for x in model.score(docs_of(odd).drop("score")).collect()}
    for i, t in odd:
        want = 1 / (1 + np.exp(-model.intercept - sum(weight.get(f, 0) for f in brute_features(t or ""))))
        assert abs(scored[i] - want) < 1e-9


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, sf).collect()
    label = dict(zip(*pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values()))
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [(label[r.doc_id], r) for r in rows if r.held_out and r.doc_id in label]
    hit = sum(t and r.predicted for t, r in known)
    print("held out", len(known), "toxic", sum(t for t, _ in known), "predicted", sum(r.predicted for _, r in known), "both", hit)
    assert hit / sum(r.predicted for _, r in known) > 0.95 and hit / sum(t for t, _ in known) > 0.85
    lang = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pydict().values()))
    for name in ("de", "en", "es", "fr"):
        toxic = [r.predicted for t, r in known if t and lang[r.doc_id] == name]
        assert sum(toxic) / len(toxic) > 0.65, name


@pytest.mark.parametrize("kinds", [[], [0, 0], [1, 1, 1]])
def test_without_both_labels(spark, docs_of, kinds):
    docs = docs_of([(i, "some text") for i in range(4)])
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)] + [(3, None)], "doc_id long, toxic int")
    want = float(bool(kinds and kinds[0]))
    assert {r.score for r in toxicity.classify(docs, labels).collect()} == {want}


def test_odd_rows(spark, docs_of):
    rows = [(i, "you idiot " + "x" * i if i % 2 else "a kind word " + "y" * i) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    odd = [(None, "idiot"), (100, None), (101, ""), (102, "idiot " * 200_000), (100, None)]
    out = toxicity.classify(docs_of(rows + odd), labels).collect()
    assert len(out) == 45 and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    assert score[100] == score[101] and score[102] > 0.5 > score[0]
