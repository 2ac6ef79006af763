"""SentencePiece encoding and decoding with forward scores shared along a trie of words.

Spaces become the mark U+2581, one is put in front of a text, and a text falls into marked words: a run of
marks with what follows.  No piece reaches over the start of such a word, so words encode on their own.  The
distinct new words of a block are sorted, which lays them out as a depth-first walk of their trie; each step
of the forward pass belongs to a prefix and is kept for all words below it.

What the forward pass keeps for a prefix is its last piece:

* ``unigram``: that of the segmentation with the highest sum of scores (Viterbi).
* ``bpe``: that of the prefix's merge result.  The highest sum of scores is not what merging yields, so for
  such models the step takes the one piece that merging leaves side by side with the piece before it; by
  the independence of merges on either side of a surviving border, chains of such pairs are exactly the
  merge result.  (The vocabulary at hand is of this kind.)

Characters without a piece become their bytes' pieces, or the unknown id if the model has none.

Defined cases: a null or empty text has no ids and decodes to the empty text; U+2581 in a text is a space to
the model and comes back as one (``round_trip`` is then false); repeated rows are encoded each; a long text is a
block of its own; only doc_id and text (or ids) are read, so further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliolens.llm.common import blocks, lists, utf8
from foliolens.llm.pretokens import Known, chunks, per_row, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True
#: Pairs of pieces whose standing side by side a worker remembers.
PAIRS = 200_000
#: In place of ids: a character without a piece, and the start of a word.
NONE, NOTHING = -1, -2


@dataclass
class Pieces:
    """A vocabulary: pieces that text may become, with scores; the pieces of bytes; what each id decodes to."""

    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int] | None
    unknown: int
    decoded: list[bytes]

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Pieces:
        """Reads a model on the driver; executors need no copy."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)] if any(map(sp.is_byte, range(n))) else None
        decoded = [names[i].replace(MARK, " ").encode() for i in range(n)]
        for i in range(n):
            if sp.is_control(i):
                decoded[i] = b""
            elif sp.is_unknown(i):
                decoded[i] = " ⁇ ".encode()
        for b, i in enumerate(byte_ids or []):
            decoded[i] = bytes([b])
        return cls(kind, {names[i]: i for i in plain}, {names[i]: sp.get_score(i) for i in plain}, byte_ids, sp.unk_id(), decoded)


@dataclass
class Encoder:
    pieces: Pieces
    #: Lengths of pieces by their last two characters, longest first.
    tails: dict[str, list[int]] = field(default_factory=dict)
    #: Whether merging leaves a piece beside the one before it, by both ids.
    beside: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self):
        found: dict[str, set[int]] = {}
        for p in self.pieces.ids:
            if len(p) > 1:
                found.setdefault(p[-2:], set()).add(len(p))
        self.tails = {k: sorted(v, reverse=True) for k, v in found.items()}
        self.floor = min(self.pieces.scores.values(), default=0.0) - 10.0

    def merged(self, text: str) -> list[str]:
        """Merging as trained: again and again the pair with the highest score, the leftmost of equals."""
        out, scores = list(text), self.pieces.scores
        while len(out) > 1:
            best = max(((scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(out, out[1:]))))
            if best[0] == -np.inf:
                break
            i = -best[1]
            out[i : i + 2] = [out[i] + out[i + 1]]
        return out

    def walk(self, words: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """For each word of a sorted list its pieces' ends and ids (NONE for a character without a piece)."""
        ids, tails, scores, beside, unigram = self.pieces.ids, self.tails, self.pieces.scores, self.beside, self.pieces.kind == "unigram"
        last: list[int] = []  # of each prefix of the word at hand: the length of its last piece,
        piece: list[int] = []  # that piece's id,
        best: list[float] = [0.0]  # and its score
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared:], piece[shared:], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                sizes = tails.get(word[end - 2 : end], ()) if end > 1 else ()
                if unigram:
                    top, size = best[end - 1] + scores.get(word[end - 1], self.floor), 1
                    for n in sizes:
                        if n <= end and (s := scores.get(word[end - n : end])) is not None and best[end - n] + s > top:
                            top, size = best[end - n] + s, n
                    best.append(top)
                    last.append(size)
                    piece.append(ids.get(word[end - size : end], NONE))
                    continue
                for n in sizes:
                    if n > end or (found := ids.get(word[end - n : end])) is None:
                        continue
                    at = end - n
                    key = (piece[at - 1] if at else NOTHING) << 24 | found
                    stands = beside.get(key)
                    if stands is None:
                        if len(beside) > PAIRS:
                            beside.clear()
                        pair = [x for x in (word[at - last[at - 1] : at] if at else "", word[at:end]) if x]
                        stands = beside[key] = self.merged("".join(pair)) == pair
                    if stands:
                        last.append(n)
                        piece.append(found)
                        break
                else:
                    last.append(1)
                    piece.append(ids.get(word[end - 1], NONE))
            ends, out, end = [], [], len(word)
            while end:
                ends.append(end)
                out.append(piece[end - 1])
                end -= last[end - 1]
            yield ends[::-1], out[::-1]
            before = word

    def segment(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word of a sorted list."""
        return [[w[a:b] for a, b in zip([0, *ends], ends)] for w, (ends, _) in zip(words, self.walk(words))]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of marked words (which hold spaces for marks) and how many each has."""
        texts = [w.decode("utf-8", "replace").replace(" ", MARK) for w in words]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        found: list = [None] * len(texts)
        for i, (ends, ids) in zip(order, self.walk([texts[i] for i in order])):
            found[i] = self._spelled(texts[i], ends, ids) if NONE in ids else ids
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _spelled(self, word: str, ends: list[int], ids: list[int]) -> list[int]:
        """The ids with those of bytes in place of NONE."""
        out: list[int] = []
        for end, i in zip(ends, ids):
            if i != NONE:
                out.append(i)
            elif self.pieces.byte_ids:
                out += [self.pieces.byte_ids[b] for b in word[end - 1].encode("utf-8", "replace")]
            else:
                out.append(self.pieces.unknown)
        return out


#: The encoder and word cache of this worker by vocabulary; tasks that follow find them filled.
_WORKER: dict[str, tuple] = {}


def _worker(name: str, pieces: Pieces) -> tuple[Encoder, Known]:
    if name not in _WORKER:
        _WORKER.clear()  # one vocabulary at a time
        _WORKER[name] = Encoder(pieces), Known(pieces.decoded)
    return _WORKER[name]


def marked(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space in front of each that is not empty."""
    full = np.diff(offs) > 0
    return np.insert(raw, offs[:-1][full], 0x20), offs + np.append(0, np.cumsum(full))


def encode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether the ids decode to the very text) of every row."""
    pieces = pieces or Pieces.load()
    name = hashlib.md5(repr((pieces.kind, pieces.scores, pieces.byte_ids)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder, known = _worker(name, shared.value)
            raw_all, offs_all = utf8(batch["text"])
            for lo, hi, raw, offs in blocks(raw_all, offs_all):
                raw, offs = marked(raw, offs)
                starts, ends, row = chunks(raw, offs, _SPACE)
                ids, n = known.ids_of(raw, starts, ends, encoder.encode_words)
                count = per_row(n, row, hi - lo)
                back, length = spread(known.table, known.sizes, ids)
                if len(back) == len(raw) and (back == raw).all():
                    same = np.ones(hi - lo, bool)
                else:
                    at = np.append(0, np.cumsum(per_row(length, np.repeat(np.arange(hi - lo), count), hi - lo)))
                    same = np.array([np.array_equal(back[at[i] : at[i + 1]], raw[offs[i] : offs[i + 1]]) for i in range(hi - lo)])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo), pa.array(count), lists(ids.astype(np.int32), count, pa.int32()), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id and text of rows with ids; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces or Pieces.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = shared.value.decoded
        for batch in batches:
            texts = []
            for ids in batch["ids"]:
                raw = b"".join([decoded[i] for i in (ids.as_py() or ())])
                texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
