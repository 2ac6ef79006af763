"""Toxicity scores from a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are its 3- to 5-character windows (lower-cased, whole text, hashed to 2**18), each twice:
whether it occurs, and whether it occurs ``OFTEN`` times or more.  Each feature is scaled by the log ratio of its
smoothed shares in toxic and clean labelled texts, and a logistic regression with an L2 penalty is fitted on the
scaled features whose toxic share is ``DEVIATIONS`` standard deviations off.  Only the text is an input.  Cut and
penalty were chosen by three-fold cross-validation in the rows that are not held out.

Fitting takes a bounded sample of labelled rows (``SAMPLE_ROWS``, the first by a hash of the id) and at most
``MOST_FEATURES`` features; every document is scored.  The model is a weight a feature, so what is broadcast has a
fixed size.

Defined cases: a null or empty text, or one under three characters, has no features and gets the model's
intercept; a null id is not held out; rows labelled null are not learned from, and of repeated labels of
one id the highest counts; without both labels the score is the share of toxic rows, 0 without any;
repeated rows are scored each; long texts are walked in pieces and counted whole; ``score`` passes further columns
through and replaces one of the name it is given, ``classify`` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import cut_wide, dropped, lists
from foliolens.llm.words import mix

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
SMOOTHING = 1.0
#: Occurrences from which on an n-gram has its second feature.
OFTEN = 3
PENALTY = 0.005
ITERATIONS = 300
#: A feature counts if its toxic share is so many standard deviations off; the first FEWEST always do, MOST_FEATURES at most.
DEVIATIONS = 4.0
FEWEST, MOST_FEATURES = 128, 4096
SAMPLE_ROWS = 6000
#: Tasks of a step of the fit; its rows and features are bounded.
FIT_PARTITIONS = 6
THRESHOLD = 0.3
#: Characters turned into windows at once.
PIECE = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, with repeats, a piece of the text at a time."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for lo in range(0, len(codes), PIECE):
        for order in ORDERS:  # a window belongs to the piece that it starts in
            x = codes[lo : lo + PIECE + order - 1].astype(np.uint64)
            if len(x) < order:
                break
            h = x[: len(x) - order + 1] * _STEP
            for n in range(1, order):
                h = (h ^ (h >> np.uint64(29))) * _STEP + x[n : len(x) - order + 1 + n]
            yield (mix(h + np.uint64(order)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def ngram_features(text: str, relevant: np.ndarray | None = None) -> np.ndarray:
    """The features of a text: buckets that occur, and BUCKETS plus those that occur ``OFTEN``; of ``relevant`` buckets only, if given."""
    parts = list(_pieces(text)) if relevant is None else [p[relevant[p]] for p in _pieces(text)]
    found, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int32),) * 2
    return np.concatenate([found, found[count >= OFTEN] + BUCKETS])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for evaluation and never learned from."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch["label"].to_pylist(), batch["text"]):
            found = ngram_features(text.as_py() or "")
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), lists(found, [len(found)], pa.int32())], ["label", "found"])


@dataclass
class Model:
    intercept: float
    #: Features with a weight, in order, and the weights.
    kept: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with the probability that a text is toxic."""
        if self.kept is None:
            return docs.withColumn(name, F.lit(self.intercept))
        intercept, shared = self.intercept, docs.sparkSession.sparkContext.broadcast((self.kept, self.weights))

        @F.pandas_udf("double")
        def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            kept, weights = shared.value
            table, relevant = np.zeros(2 * BUCKETS), np.zeros(BUCKETS, bool)
            table[kept], relevant[kept % BUCKETS] = weights, True
            for texts in parts:
                z = np.array([table[ngram_features(t or "", relevant)].sum() for t in texts]) + intercept
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return docs.withColumn(name, probability("text"))


def ratios(features: np.ndarray, toxic: np.ndarray, total: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The features to use, in order, and their log-count ratios, from the toxic and all texts that have each."""
    bad, good = np.full(2 * BUCKETS, SMOOTHING), np.full(2 * BUCKETS, SMOOTHING)
    bad[features] += toxic
    good[features] += total - toxic
    ratio = np.log(bad / bad.sum()) - np.log(good / good.sum())
    texts = bad + good - 2 * SMOOTHING
    off = np.abs(bad - SMOOTHING - texts * share) / np.sqrt(np.maximum(texts, 1) * share * (1 - share))
    order = np.argsort(-off, kind="stable")
    kept = np.sort(order[: min(MOST_FEATURES, max(FEWEST, int((off >= DEVIATIONS).sum())))])
    return kept, ratio[kept]


def fit(labelled: DataFrame) -> Model:
    """A model from (text, label) rows; the caller bounds how many there are."""
    rows = cut_wide(labelled.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_features, "label int, found array<int>"))
    toxic, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not 0 < toxic < total:
        return Model(toxic / total if total else 0.0)
    # a row a feature at most
    counts = rows.select("label", F.explode("found").alias("f")).groupBy("f").agg(F.sum("label").alias("toxic"), F.count("*").alias("total")).toArrow()
    kept, ratio = ratios(*(counts[c].to_numpy() for c in ("f", "toxic", "total")), toxic / total)
    shared = labelled.sparkSession.sparkContext.broadcast((kept, ratio))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ratio = shared.value
        for batch in batches:
            for label, found in zip(batch["label"].to_pylist(), batch["found"]):
                row = np.where(np.isin(kept, found.values.to_numpy()), ratio, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([float(label)]), lists(row, [len(row)], pa.float64())], ["label", "scaled"])

    train = cut_wide(rows.mapInArrow(scaled, "label double, scaled array<double>").repartition(FIT_PARTITIONS))
    lr = LogisticRegression(maxIter=ITERATIONS, regParam=PENALTY, elasticNetParam=0.0, standardization=False, tol=1e-7)
    fitted = lr.fit(train.select("label", array_to_vector("scaled").alias("features")))
    dropped(rows)
    dropped(train)
    return Model(float(fitted.intercept), kept, fitted.coefficients.toArray() * ratio)


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled documents that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # sample_rows rows at most


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit_on_labels(docs, labels, sample_rows)
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
