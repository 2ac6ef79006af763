"""Two tokenizers over the same texts: groups of tokens that cover the same bytes, and links between their last tokens.

A mapper cuts space + text before each run of white space that starts with a space.  No token of either vocabulary reaches
over such a cut, so tokens' ends meet there and what lies between two cuts, a segment, is aligned the same wherever it
stands.  A block of texts becomes a few rows of its distinct segments end to end, with ids and the byte offsets at which
tokens end, each packed with its side and its place; the last row also says which segments each text has.

Groups and links are found by Spark: ``sort_array`` merges both sides' ends, and where ``zip_with`` finds an end of A beside
an equal one of B, both have a token's end, a border, and the tokens that end there are a link.  Each border with the one
before it gives the places of its group's tokens (``zip_with``, ``transform``, ``slice``).  Sorting, merging and turning ids
to text are projections of their own, on arrays without nulls, so that they run as generated code and only the lambdas are
interpreted.  A second mapper, which gets the rows as they were made, puts each text's segments together again.

How often an id pair is linked is counted over the whole corpus: links are counted within each row first and then summed
by pair.  There are at most as many pairs as ids of A times ids of B, whatever the input; up to ``BROADCAST_PAIRS`` of
them go to all tasks, else rows meet them on a plain exchange.  A row's links come back together by the row's number.

Defined cases: a null or empty text, and one whose tokens' bytes (of either side) are not space + text, has no tokens:
counts are 0 and the groups the empty text.  Special tokens' strings are plain text.  Repeated rows, and rows that share
an id, are rows of their own and count each; a long text is a block of its own; texts with white space beyond ASCII's are
one segment.  Other columns of any name are ignored.  No rows: none.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolens.llm.common import blocks, cut, cut_wide, utf8
from foliolens.llm.pretokens import Known, chunks, per_row, spread
from foliolens.llm.sentencepiece_codec import _SPACE, MARK, MODEL, marked
from foliolens.llm.training_order import _ODD_SPACE, PATTERN, encode_chunks
from foliolens.llm.words import SEPARATOR, spans_hash

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Id pairs (16 bytes each and their place in a hash table) up to which their counts are broadcast.
BROADCAST_PAIRS = 4_000_000
#: Bytes that a worker's remembered chunks of either side may take.
CACHE_BYTES = 20 << 20
#: Bits of an id in a packed pair.
ID_BITS = 24

#: Bytes of text whose distinct segments are aligned once.
BLOCK_BYTES = 2 << 20
#: Tokens of A from which on a row takes no further segment; an Arrow batch has up to ``BATCH_ROWS``.
ROW_TOKENS = 100
#: Rows of an Arrow batch while texts are aligned: two mappers at a time hold one each, on either side.
BATCH_ROWS = 2500
#: Segments that are compared, or put together to texts, at once.
STEP = 1 << 16

#: A packed end: the offset, a bit for the side, and the token's place from 1 on with two low bits, of which the lowest is
#: set where B's token is its segment's last.
PLACE_BITS = 31
_PLACE = (1 << PLACE_BITS) - 1
_DOC = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType(), False) for c in ("n_a", "n_b")), T.StructField("segments", T.ArrayType(T.IntegerType(), False), False)])
_TOKENS = T.StructType(
    [T.StructField("docs", T.ArrayType(_DOC, False), False), *(T.StructField(c + e, T.ArrayType(t, False), False) for c in "ab" for e, t in (("", T.IntegerType()), ("_ends", T.LongType())))]
)


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabularies:
    """A byte-level tokenizer's file and the other one's model; read on the driver, so executors need no copy."""

    a: str
    b: bytes

    @classmethod
    def load(cls, a: str = TOKENIZER, b: str = MODEL) -> Vocabularies:
        with open(a, encoding="utf-8") as f, open(b, "rb") as g:
            return cls(f.read(), g.read())

    def key(self) -> str:
        return hashlib.md5(self.a.encode() + self.b).hexdigest()


class _Worker:
    """Both encoders and their remembered chunks."""

    def __init__(self, names: Vocabularies):
        import sentencepiece

        model, to_byte = json.loads(names.a)["model"], _byte_alphabet()
        decoded = [b""] * (max(model["vocab"].values()) + 1)
        for piece, i in model["vocab"].items():
            decoded[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        self.names, self.tokenizer = names, None
        self.a, self.bulk = Known(decoded, CACHE_BYTES), _ranked(model, decoded)
        self.pieces = sp = sentencepiece.SentencePieceProcessor(model_proto=names.b)
        spelled = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]
        self.b, self.mark = Known(spelled, CACHE_BYTES), sp.piece_to_id(MARK)

    def encode_a(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.bulk is not None and not _ODD_SPACE.search(b"".join(new)):
            return encode_chunks(self.bulk, new)
        if self.tokenizer is None:  # the library itself takes memory, and few texts need it
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.names.a)
            self.tokenizer.encode_special_tokens = True
        found = [self.tokenizer.encode(x.decode(), add_special_tokens=False).ids for x in new]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def encode_b(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library puts the first space of each word there by itself."""
        found = self.pieces.encode([x[1:].decode() for x in new], num_threads=1)
        found = [f if len(x) > 1 else [self.mark] for f, x in zip(found, new)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def segments(self, raw: np.ndarray, offs: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """For A and B the distinct segments' ids, ends (counted from the first segment's start) and tokens a segment; for each
        segment of the text its row and its place among them.  Rows that do not come back are left out; all others start with a space."""
        whole = np.zeros(len(offs) - 1, bool)  # rows that are one segment
        whole[np.searchsorted(offs, [m.start() for m in _ODD_SPACE.finditer(raw.tobytes())], "right") - 1] = True
        while True:
            starts, _, row = chunks(raw, offs, SEPARATOR)
            keep = np.where(whole[row], np.diff(row, prepend=-1) > 0, raw[starts] == 0x20)
            starts, row = starts[keep], row[keep]
            text, sizes, place = _distinct(raw, starts, np.append(starts[1:], len(raw)))
            sides = self.tokens(text, np.append(0, np.cumsum(sizes)))
            same = sides[0][3] & sides[1][3]
            bad = np.zeros(len(whole), bool)
            bad[row[~same[place]]] = True
            if not (bad & ~whole).any():
                break
            whole |= bad  # whether such a row's bytes come back is judged on the row
        begin, out = np.cumsum(sizes) - sizes, []
        for ids, ends, count, _ in sides:
            kept = np.repeat(same, count)
            out.append((ids[kept], (ends + np.repeat(begin, count))[kept], count[same]))
        use = ~bad[row]
        return out, row[use], (np.cumsum(same) - 1)[place[use]]

    def tokens(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For A and B: ids, ends (counted from the row's start), tokens a row, and whether the row's bytes come back."""
        starts, ends, row = chunks(raw, offs, SEPARATOR)
        odd = np.unique(np.searchsorted(offs, [m.start() for m in _ODD_SPACE.finditer(raw.tobytes())], "right") - 1)
        if len(odd):  # such rows are one chunk each
            first = np.isin(starts, offs[:-1])
            keep = first | ~np.isin(row, odd)
            starts, row = starts[keep], row[keep]
            ends = np.append(starts[1:], len(raw))
        out = []
        for known, encode, (s, e, r) in ((self.a, self.encode_a, (starts, ends, row)), (self.b, self.encode_b, chunks(raw, offs, _SPACE))):
            ids, n = known.ids_of(raw, s, e, encode)
            count = per_row(n, r, len(offs) - 1)
            out.append((ids, *_ends(known, ids, count, raw, offs)))
        return out


def _ranked(model: dict, decoded: list[bytes]):
    """The tokenizer as ranks, which encodes many words in one call; None where ids are not in the order of merges."""
    import tiktoken

    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ranks = {decoded[model["vocab"][c]]: model["vocab"][c] for c in model["vocab"] if len(c) == 1}
    if sorted(ranks.values()) != list(range(256)):
        return None
    for n, (x, y) in enumerate(merges):
        if model["vocab"][x + y] != 256 + n:
            return None
        ranks[decoded[256 + n]] = 256 + n
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ends(known: Known, ids: np.ndarray, count: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    upto = np.cumsum(known.sizes[ids])
    at = np.append(0, np.cumsum(count))
    begin = np.append(0, upto)[at]
    same = np.ones(len(count), bool)
    if not known.exact:
        back, _ = spread(known.table, known.sizes, ids)
        length, size = np.diff(begin), np.diff(offs)
        same = length == size
        fits = np.flatnonzero(same)
        ours, n = spread(back, length, fits)
        same[np.repeat(fits, n)[ours != spread(raw, size, fits)[0]]] = False
    return upto - np.repeat(begin[:-1], count), count, same


def _distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and sizes of the distinct spans, and which of them each span is; the spans cover ``raw`` without gaps."""
    size = ends - starts
    _, first, place = np.unique(spans_hash(raw, starts, ends), return_index=True, return_inverse=True)
    same = (size[first[place]] == size).all()
    for i in range(0, len(starts), STEP):  # in steps, as index arrays take eight times the text
        same = same and np.array_equal(spread(raw, size, first[place[i : i + STEP]])[0], raw[starts[i] : ends[i : i + STEP][-1]])
    if not same:
        first = place = np.arange(len(starts))  # two spans share a hash: all stay
    return spread(raw, size, first)[0], size[first], place


_WORKERS: dict[str, _Worker] = {}


def _worker(key: str, names: Vocabularies) -> _Worker:
    if key not in _WORKERS:
        _WORKERS.clear()  # one pair of vocabularies at a time
        _WORKERS[key] = _Worker(names)
    return _WORKERS[key]


def _give_back() -> None:
    """Freed memory goes back to the system: workers that wait for a task, or take the other mapper's, keep what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _arrays(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column without null elements."""
    offs = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind), type=pa.list_(pa.field("element", kind, nullable=False)))


def tokenise(docs: DataFrame, names: Vocabularies | None = None) -> DataFrame:
    """Ids and packed ends of both tokenizers over each block's distinct segments, in rows of some ``ROW_TOKENS``; the last of
    a block's rows has its ``docs``: doc_id, number of tokens of either side and places of its segments, from 0 on."""
    names = names or Vocabularies.load()
    key, shared, limit, most = names.key(), docs.sparkSession.sparkContext.broadcast(names), BLOCK_BYTES, ROW_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worker = _worker(key, shared.value)
            raw_all, offs_all = utf8(batch["text"])
            for lo, hi, raw, offs in blocks(raw_all, offs_all, limit):
                sides, row, place = worker.segments(*marked(raw, offs))
                count = sides[0][2]
                first = np.flatnonzero(np.diff((np.cumsum(count) - count) // most, prepend=-1))  # each row's first segment
                first = first if len(first) else np.zeros(1, np.int64)
                columns, totals = [], []
                for side, (ids, ends, count) in enumerate(sides):
                    upto = np.cumsum(count)
                    begin = np.append(0, upto)[first]
                    n = np.diff(begin, append=len(ids))
                    at = (np.arange(1, len(ids) + 1) - np.repeat(begin, n)) << 2
                    at[upto - 1] |= side
                    packed = ends.astype(np.int64) << (PLACE_BITS + 1) | side << PLACE_BITS | at
                    columns += [_arrays(ids.astype(np.int32), n, pa.int32()), _arrays(packed, n, pa.int64())]
                    totals.append(pa.array(per_row(count[place], row, hi - lo)))
                own = _arrays(place.astype(np.int32), np.bincount(row, minlength=hi - lo), pa.int32())
                doc = pa.StructArray.from_arrays([batch["doc_id"].slice(lo, hi - lo), *totals, own], ["doc_id", "n_a", "n_b", "segments"])
                offsets = np.zeros(len(first) + 1, np.int32)
                offsets[-1] = hi - lo
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), doc), *columns], _TOKENS.names)
                _give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TOKENS)


def _group(before: Column, at: Column) -> Column:
    """The text of the group between two borders: mostly one token of each side."""

    def side(ids: str, place) -> Column:
        return F.array_join(F.slice(ids, place(before) + 1, place(at) - place(before)), ",")

    one = F.concat(F.element_at("a_text", _place_a(at)), F.lit("|"), F.element_at("b_text", _place_b(at)))
    # both places grow by 4, whatever the low bit
    return F.when(at - before < (4 << PLACE_BITS) + 6, one).otherwise(F.concat(side("a_text", _place_a), F.lit("|"), side("b_text", _place_b)))


def _place_a(border: Column) -> Column:
    return F.shiftright(border, PLACE_BITS + 2).cast("int")


def _place_b(border: Column) -> Column:
    return F.shiftright(border.bitwiseAND(_PLACE), 2).cast("int")


def groups(tokens: DataFrame) -> DataFrame:
    """``tokenise``'s rows with borders (places of A's and of B's token that end there, packed), groups (as text) and links
    (packed id pairs, and above them a bit where a segment ends)."""
    rows = tokens.withColumn("ends", F.sort_array(F.concat("a_ends", "b_ends"))).drop("a_ends", "b_ends")
    rows = rows.withColumns({f"{c}_text": F.col(c).cast("array<string>") for c in "ab"})
    # ends that differ in the side alone, whatever their places
    same = lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 1
    both = lambda x, y: F.shiftleft(x.bitwiseAND(_PLACE), PLACE_BITS).bitwiseOR(y.bitwiseAND(_PLACE))
    later = F.slice("ends", 2, F.greatest(F.size("ends") - 1, F.lit(0)))
    met = F.zip_with("ends", later, lambda x, y: F.when(same(x, y), both(x, y)))
    rows = rows.withColumn("borders", F.filter(met, lambda x: x.isNotNull())).drop("ends")
    before = F.slice(F.array_prepend("borders", F.lit(0).cast("long")), 1, F.size("borders"))
    pair = lambda x: F.shiftleft(F.element_at("a", _place_a(x)).cast("long"), ID_BITS).bitwiseOR(F.element_at("b", _place_b(x)).cast("long")).bitwiseOR(F.shiftleft(x.bitwiseAND(1), 2 * ID_BITS))
    return rows.withColumn("groups", F.array_join(F.zip_with(before, "borders", _group), ";")).withColumn("links", F.transform("borders", pair))


def by_text(rows: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, groups (as text, or its SHA-256 if there are any) and links (packed id pairs) of every text, of ``groups``' rows."""
    step = STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _WORKERS.clear()  # a worker that was the other mapper's needs its vocabularies no more
        texts, pairs = [], []  # of the block at hand
        for batch in batches:
            docs, groups, links = batch["docs"], batch["groups"].cast(pa.binary()), batch["links"]
            done = 0
            for end in [*(np.flatnonzero(np.diff(docs.offsets.to_numpy())) + 1).tolist(), len(docs)]:
                texts += [x for x in groups[done:end].to_pylist() if x]
                pairs.append(links[done:end].flatten().to_numpy())
                if end > done and len(doc := docs[end - 1 : end].flatten()):
                    yield from _joined(doc, b";".join(texts), np.concatenate(pairs), digest, step)
                    texts, pairs = [], []
                done = end
            _give_back()

    return rows.select("docs", "groups", "links").mapInArrow(run, f"doc_id long, n_a long, n_b long, groups string, links array<long>")


def _joined(doc: pa.StructArray, text: bytes, pairs: np.ndarray, digest: bool, step: int) -> Iterator[pa.RecordBatch]:
    """A block's texts from its distinct segments' groups and links."""
    last = np.flatnonzero(pairs >> 2 * ID_BITS)
    upto = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == ord(";")), len(text))[last].tolist()
    parts = [text[a:b] for a, b in zip([0, *(x + 1 for x in upto)], upto)]
    pairs, size = pairs & ((1 << 2 * ID_BITS) - 1), np.diff(last, prepend=-1)
    offs = np.append(0, np.cumsum(doc.field("segments").value_lengths().to_numpy()))
    for lo, hi, place, at in blocks(doc.field("segments").flatten().to_numpy(), offs, step):
        joined = [b";".join([parts[i] for i in place[a:b].tolist()]) for a, b in zip(at[:-1], at[1:])]
        groups = [(hashlib.sha256(x).hexdigest() if x else "") if digest else x.decode() for x in joined]
        links, n = spread(pairs, size, place)
        count = np.diff(np.append(0, np.cumsum(n))[at])
        yield pa.RecordBatch.from_arrays([*(doc.field(c)[lo:hi] for c in ("doc_id", "n_a", "n_b")), pa.array(groups, pa.string()), _arrays(links, count, pa.int64())], ["doc_id", "n_a", "n_b", "groups", "links"])


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (how many links corpus-wide hold it) and best (whether no pair of its B id has more), of rows with ``links``."""
    n = links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    n = cut(n.withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1)))
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, names: Vocabularies | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    rows = by_text(groups(tokenise(docs, names)), digest=True)
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        rows = cut_wide(rows.select("doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), F.col("groups").alias("groups_sha256"), "links"))
    finally:
        conf.set(key, before)
    counts = cut(pair_counts(rows))
    few = counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    # a row's pairs are counted before they meet anything
    found = rows.select("__row", F.explode("links").alias("pair")).join(F.broadcast(counts) if few else counts, "pair")
    found = found.groupBy("__row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(found, "__row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
