"""A training corpus from raw documents: five stages, each on all that the one before kept.

1. toxicity: documents that the classifier rejects go.
2. ngram_jaccard_join: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays.
3. benchmark_decontamination: documents that hold a benchmark item go.
4. secret_scan: found secrets are blacked out in the text, and n_chars follows.
5. sentencepiece: what is left becomes token ids.

All but the last return the columns of documents, whatever they are named.  Rows with a null id are classified,
cleaned and encoded like any other but are near-duplicates of nothing; null and empty texts pass through every
stage; of repeated rows (same id and same words) one stays, while rows of one id with different texts are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm import decontamination, ngram_jaccard_join, secret_scan, sentencepiece_codec, toxicity
from foliolens.llm.common import cut_wide, dropped, new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, "__score").filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the class with its smallest id stays, and of that class one row."""
    found = ngram_jaccard_join.join_components(docs, words=5, percent=80)
    return ngram_jaccard_join.one_of_each(docs, found)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def black_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store = new_path(spark)
    secret_scan.update(docs, store)
    return secret_scan.redact(docs, secret_scan.stored(spark, store))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", black_out_secrets),
    ("sentencepiece", encode),
]

#: A classifier and a tokenizer are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written before the next reads it, and goes once that is written too."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_wide(docs)
            if i:
                dropped(before)
    return docs
