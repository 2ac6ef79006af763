"""Ids against the SentencePiece library, Viterbi against all segmentations, and round trips."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from foliolens.llm import queries
from foliolens.llm import sentencepiece_codec as codec


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)


def test_words_match_the_library(library):
    r = random.Random(6)
    vocabulary = [library.id_to_piece(i).replace(codec.MARK, " ") for i in range(300, 32000)]
    texts = ["a", "aaaaaaaaaaa", "  ", "x" * 500, "ééé", "日本語 テキスト", "\U0001f600‍!", "a b", "\x00\t\n", "don't", "<0x0A>", "<s> </s>"]
    texts += ["".join(r.choice(vocabulary) for _ in range(r.randrange(1, 9))).strip(" ") for _ in range(1500)]
    texts += ["".join(r.choice("abeinrst ") for _ in range(r.randrange(1, 40))).strip(" ") for _ in range(1500)]
    encoder = codec.Encoder(codec.Pieces.load())
    words = sorted({w for t in texts for w in (" " + t).replace(" ", codec.MARK + "|").split("|")[:0]} | {codec.MARK + t.replace(" ", codec.MARK) for t in texts if t})
    for word, parts in zip(words, encoder.segment(words)):
        ids = [i for p in parts for i in ([encoder.pieces.ids[p]] if p in encoder.pieces.ids else [encoder.pieces.byte_ids[b] for b in p.encode()])]
        assert ids == library.encode(word[1:].replace(codec.MARK, " ")), word


def test_viterbi_of_a_unigram_model():
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aba": -5.5, "bb": -4.0, codec.MARK: -1.0, codec.MARK + "a": -2.2}
    pieces = codec.Pieces("unigram", {p: i for i, p in enumerate(scores)}, scores, None, 99, [])
    encoder = codec.Encoder(pieces)
    score = lambda p: scores.get(p, encoder.floor if len(p) == 1 else None)

    def best(word):
        if not word:
            return 0.0
        return max(score(word[:n]) + best(word[n:]) for n in range(1, len(word) + 1) if score(word[:n]) is not None)

    r = random.Random(1)
    words = sorted({codec.MARK + "".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(200)})
    for word, parts in zip(words, encoder.segment(words)):
        assert "".join(parts) == word and abs(sum(map(score, parts)) - best(word)) < 1e-9


def test_odd_rows(spark, docs_of, library):
    texts = {None: "no id", 1: None, 2: "", 3: " ", 4: "  two  spaces ", 5: "tab\tline\nend\n", 6: "日本 \U0001f600 é" * 3, 7: "long " * 30_000, 8: "x" * 5000, 9: "a▁b"}
    out = codec.encode(docs_of(list(texts.items()) + [(4, texts[4])])).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.round_trip == (r.doc_id != 9)
    back = {r.doc_id: r.text for r in codec.decode(codec.encode(docs_of(list(texts.items())))).collect()}
    assert back == {i: (t or "").replace(codec.MARK, " ") for i, t in texts.items()}
    bad = spark.createDataFrame([(1, [library.piece_to_id("<0xFF>")]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in codec.decode(bad).collect()} == {1: "�", 2: ""}
    assert codec.encode(docs_of([])).count() == 0


def test_query_on_the_table(spark, sf, library):
    texts = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    for r in queries.op9_sentencepiece_codec(spark, sf).collect():
        assert r.round_trip and r.ids == library.encode(texts[r.doc_id])


def test_words_that_look_alike(spark, docs_of, library, alike):
    texts = {1: f"{alike[0]} {alike[1]}", 2: alike[1], 3: alike[0]}
    for r in codec.encode(docs_of(list(texts.items()))).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.round_trip


def test_chunks_with_one_hash_are_told_apart(monkeypatch, library):
    """Even if every hash were the same, what the ids decode to shows which chunks are wrong."""
    from foliolens.llm import pretokens

    monkeypatch.setattr(pretokens, "spans_hash", lambda raw, starts, ends: (ends - starts).astype(np.uint64))
    pieces = codec.Pieces.load()
    encoder, known = codec.Encoder(pieces), pretokens.Known(pieces.decoded)
    for text in ("one two six the", "the ten two one", "six six né ten"):
        raw = np.frombuffer((" " + text).encode(), np.uint8)
        starts, ends, _ = pretokens.chunks(raw, np.array([0, len(raw)]), codec._SPACE)
        ids, n = known.ids_of(raw, starts, ends, encoder.encode_words)
        assert ids.tolist() == library.encode(text) and n.sum() == len(ids)


def test_the_cache_stays_within_its_bytes(monkeypatch):
    from foliolens.llm import pretokens

    monkeypatch.setattr(pretokens, "CACHE_BYTES", 4000)
    known = pretokens.Known([bytes([i]) for i in range(256)])
    encode = lambda new: (np.frombuffer(b"".join(new), np.uint8).astype(np.int64), np.array([len(x) for x in new]))
    r = random.Random(5)
    for _ in range(60):
        raw = np.frombuffer(" ".join(f"w{r.randrange(5000)}" for _ in range(50)).encode(), np.uint8)
        ids, _ = known.ids_of(raw, *pretokens.chunks(raw, np.array([0, len(raw)]))[:2], encode)
        assert ids.tolist() == raw.tolist() and sum(x.nbytes for p in known.parts for x in p) <= 4000 + 50 * 60
