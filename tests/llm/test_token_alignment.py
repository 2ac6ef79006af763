"""Groups, links and corpus-wide pair counts against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import pytest

from foliolens.llm import queries, token_alignment


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_alignment.TOKENIZER)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=token_alignment.MODEL)


def brute(texts):
    t, sp = libraries()
    alphabet = token_alignment._byte_alphabet()
    found = []
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ab = [bytes(alphabet[c] for c in t.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            found.append(([], [], "", [], 0))
            continue
        ea, eb, at = {}, {}, 0
        for n, x in enumerate(ab, 1):
            at += len(x)
            ea[at] = n
        at = 0
        for n, x in enumerate(bb, 1):
            at += len(x)
            eb[at] = n
        i = j = 0
        groups, links = [], []
        for e in sorted(set(ea) & set(eb)):
            groups.append(",".join(map(str, a[i : ea[e]])) + "|" + ",".join(map(str, b[j : eb[e]])))
            i, j = ea[e], eb[e]
            links.append((a[i - 1], b[j - 1]))
        found.append((a, b, ";".join(groups), links, len(groups)))
    count = Counter(p for f in found for p in f[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (len(a), len(b), n, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if a else "")
        for a, b, g, links, n in found
    ]


def got(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


ODD = [
    None, "", " ", "  ", "a", "<|endoftext|>", "<s> </s> <unk>", "x▁y", "plain ▁", "   ", "     b", "foo \n\nbar", "foo   bar", "tab\t\tx \n y\r\n", "trailing   ",
    "naïve café über", "中文字符 русский", "\U0001f600\U0001f600 \U0001f468‍\U0001f469", "　wide　", "a\x00b \x1c\x1d c", "don't we'll I'VE", "1234567 12,000.50", "<0x41> <0xFF>", "\x85next", " line",
]


@pytest.mark.parametrize("pairs", [4_000_000, 3])
def test_matches_the_libraries(spark, docs_of, monkeypatch, pairs):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", pairs)
    r = random.Random(5)
    texts = ODD + ["".join(r.choice(["the ", "wor", "d ", "\n", " ", " ", "été ", "x1", ".", "tion", "  "]) for _ in range(r.randrange(60))) for _ in range(150)]
    texts += ["same words here"] * 20 + ["long " + "lorem ipsum dolor " * 4000, "y" * 20_000]
    rows = token_alignment.align(docs_of([(i, t) for i, t in enumerate(texts)]).repartition(5)).orderBy("doc_id").collect()
    assert got(rows) == brute(texts)


def test_rows_without_or_with_the_same_id(spark, docs_of):
    rows = token_alignment.align(docs_of([(None, "one two"), (3, "three"), (3, "three"), (3, "four five")])).collect()
    assert sorted(got(rows)) == sorted(brute(["one two", "three", "three", "four five"])) and sorted(str(r.doc_id) for r in rows) == ["3", "3", "3", "None"]


def test_no_rows(spark, docs_of):
    assert token_alignment.align(docs_of([])).count() == 0


def test_one_sort_merges_both_sides(spark, docs_of):
    """Ends are sorted once for both sides, by generated code (no null elements, a projection of its own), not once a side within a lambda."""
    import re

    tokens = token_alignment.tokenise(docs_of([(1, "one two"), (2, "")]))
    assert not any(tokens.schema[c].dataType.containsNull for c in ("a", "a_ends", "b", "b_ends"))
    plan = token_alignment.groups(tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and "array_intersect(" not in plan
    assert not any(re.search(r"zip_with\(.*sort_array\(", line) for line in plan.splitlines())


def test_a_segment_is_aligned_once_a_block(spark, docs_of):
    from pyspark.sql import functions as F

    tokens = token_alignment.groups(token_alignment.tokenise(docs_of([(i, "same words, same words again\tand again") for i in range(50)]).coalesce(1)))
    (_, _, n, *_), *_ = brute(["same words, words again\tand again"])  # " same" comes twice
    found = tokens.agg(F.sum(F.size("borders")).alias("n")).first().n
    assert found == n


@pytest.mark.parametrize("rows", [2, 10_000])
def test_blocks_rows_and_batches_of_any_size(spark, docs_of, monkeypatch, rows):
    """A block's rows lie in several batches, one batch has several blocks, and a text is put together in steps."""
    for name, value in (("BLOCK_BYTES", 150), ("ROW_TOKENS", 3), ("STEP", 5)):
        monkeypatch.setattr(token_alignment, name, value)
    r = random.Random(7)
    texts = ODD + ["".join(r.choice(["the ", "wor", "d ", "\n", " ", "\u2581", "\u00a0", "été ", "x1", ".", "tion", "  "]) for _ in range(r.randrange(60))) for _ in range(80)]
    docs = docs_of([(i, t) for i, t in enumerate(texts)]).coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        assert got(token_alignment.align(docs).orderBy("doc_id").collect()) == brute(texts)
        found = token_alignment.by_text(token_alignment.groups(token_alignment.tokenise(docs))).orderBy("doc_id").collect()
    finally:
        spark.conf.set(key, before)
    assert [(x.n_a, x.n_b, len(x.links), hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else "") for x in found] == [(a, b, n, h) for a, b, _, n, _, _, h in brute(texts)]


def test_only_texts_without_tokens(spark, docs_of):
    texts = ["", None, "x\u2581y"]
    assert got(token_alignment.align(docs_of([(i, t) for i, t in enumerate(texts)]).coalesce(1)).orderBy("doc_id").collect()) == brute(texts)


def test_segments_with_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    raw = np.frombuffer(b" one two one six", np.uint8)
    starts = np.array([0, 4, 8, 12])
    ends = np.append(starts[1:], len(raw))
    for _ in range(2):
        text, sizes, place = token_alignment._distinct(raw, starts, ends)
        at = np.append(0, np.cumsum(sizes))
        assert b"".join(text[at[i] : at[i + 1]].tobytes() for i in place) == raw.tobytes()
        monkeypatch.setattr(token_alignment, "spans_hash", lambda raw, starts, ends: (ends - starts).astype(np.uint64))


def test_query_on_the_table(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert got(queries.op13_token_alignment(spark, sf).orderBy("doc_id").collect()) == brute(texts)
