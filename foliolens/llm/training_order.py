"""Training order: every token sequence gets a global slot and a place in a fixed-stride shard.

A document's tokens and an end mark are cut into sequences of ``LENGTH``; the last is filled up with the end
mark.  Sequences are numbered by document id, and a keyed Feistel network over the next power of four,
walked until it falls under their count, permutes the numbers: the slot.  The permutation needs no shuffle,
table or sort, and the same key gives the same order on any cluster.

``SHARD`` slots make a shard; all records take ``2 * LENGTH`` bytes (little-endian uint16), so slot s is at byte
``s % SHARD * 2 * LENGTH`` of shard ``s // SHARD`` and reading can go on anywhere.

The first number of each document comes from counts alone (range partitions of ids, and one sum a
partition); texts are read twice and tokenised twice instead of keeping all tokens.  Sequences are dealt by range
of their slots, whole shards to a task: the slots' number is known by then, so no sampling is needed.  A shard is
written by one task under a name of that attempt and then renamed, so a task that is repeated, or a whole run,
leaves the same files.

Defined cases: a null or empty text is one sequence with the end mark only; null ids come first; rows that
share an id are ordered by a hash of the text, and equal rows take numbers of their own; a long text is walked in
one block and cut like any other; only doc_id and text are read, so further columns of any name are ignored; no
rows, no slots.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import blocks, cut, running, utf8
from foliolens.llm.pretokens import Known, chunks, per_row
from foliolens.llm.words import mix

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before the merges of the rank file (a fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH = 512
SHARD = 8192
KEY = 20_240_229
#: Shards that one task holds at most.
TASK_SHARDS = 16
ROUNDS = 6

_ENCODERS: dict[int, tuple] = {}


def feistel(n: np.ndarray, size: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 to size - 1, applied to ``n``."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    x = n.astype(np.uint64)
    walk = np.arange(len(x))
    while len(walk):
        left, right = x[walk] >> half, x[walk] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        x[walk] = left << half | right
        walk = walk[x[walk] >= size]
    return x.astype(np.int64)


def load_ranks(path: str = TOKENIZER) -> bytes:
    """The rank file's bytes; read on the driver, so executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(ranks: bytes):
    """This worker's encoder and its chunk cache."""
    import tiktoken

    key = hash(ranks)
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        decoded = [b""] * (max(table.values()) + 1)
        for piece, i in table.items():
            decoded[i] = piece
        _ENCODERS.clear()  # one vocabulary at a time
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), Known(decoded)
    return _ENCODERS[key]


#: White space beyond the separators of chunks, in UTF-8.
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def encode_chunks(encoder, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks and their counts.

    Chunks that start with at most a space and hold no odd white space are encoded in one call, a line each,
    as a line feed before them is a token of its own; the others are encoded one by one.
    """
    line = encoder.encode_ordinary("\n")
    plain = np.array([not x[:1].isspace() or (x[:1] == b" " and not x[1:2].isspace() and len(x) > 1) for x in new], bool)
    if len(line) != 1 or not plain.any() or _ODD_SPACE.search(b"".join(new)):
        plain[:] = False
    lengths = np.zeros(len(new), np.int64)
    many = np.array(encoder.encode_ordinary(b"\n".join([x for x, p in zip(new, plain) if p]).decode("utf-8", "replace")), np.int64)
    borders = np.flatnonzero(many == line[0]) if plain.any() else np.zeros(0, np.int64)
    if plain.any() and len(borders) != plain.sum() - 1:
        plain[:] = False
    alone = [encoder.encode_ordinary(x.decode("utf-8", "replace")) for x, p in zip(new, plain) if not p]
    lengths[~plain] = [len(x) for x in alone]
    if plain.any():
        lengths[plain] = np.diff(np.concatenate([[-1], borders, [len(many)]])) - 1
    flat = np.zeros(lengths.sum(), np.int64)
    own = np.repeat(plain, lengths)
    if plain.any():
        flat[own] = np.delete(many, borders)
    flat[~own] = [i for x in alone for i in x]
    return flat, lengths


def _tokenised(batch: pa.RecordBatch, ranks: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their ids and each row's count of them."""
    encoder, known = _encoder(ranks)
    raw_all, offs_all = utf8(batch["text"])
    for lo, hi, raw, offs in blocks(raw_all, offs_all):
        # a token never holds a space after something else, so chunks tokenise on their own
        starts, ends, row = chunks(raw, offs)
        ids, n = known.ids_of(raw, starts, ends, lambda new: encode_chunks(encoder, new))
        yield lo, hi, ids, per_row(n, row, hi - lo)


def numbered(docs: DataFrame, ranks, length: int) -> DataFrame:
    """id, version, first (the document's first sequence number) and total (of all sequences)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(c for *_, c in _tokenised(batch, ranks.value))])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["version"], pa.array(n)], ["id", "version", "n_tokens"])

    # cut first: a range partitioning samples its input, which would tokenise once more
    rows = cut(docs.select("id", "version", "text").mapInArrow(count, "id long, version long, n_tokens long"))
    rows = rows.groupBy("id", "version").agg(F.sum(F.expr(f"n_tokens div {length} + 1")).alias("parts"), F.count("*").alias("copies"))
    return running(rows, ["id", "version"], F.col("parts")).select("id", "version", F.col("before").alias("first"), "total", "copies")


def _with_copy(rows: DataFrame, many: DataFrame) -> DataFrame:
    """Rows that share id and text, each with its number among its like."""
    ranked = running(rows.join(many, ["id", "version"], "left_semi"), ["id", "version"])
    least = cut(ranked.groupBy("id", "version").agg(F.min("before").alias("least")))
    return ranked.join(least, ["id", "version"]).withColumn("copy", F.col("before") - F.col("least")).select(*rows.columns, "copy")


def sequences(docs: DataFrame, ranks: bytes | None = None, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """slot, shard, offset (bytes within the shard's file), doc_id, part, n_tokens (with the end mark) and tokens of every
    sequence, dealt by range of slots in whole shards and sorted by slot."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(ranks or load_ranks())
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("version"), "text")
    numbers = cut(numbered(rows, shared, length))
    some = numbers.first()
    shards = -(-some.total // shard) if some else 1
    many = numbers.filter("copies > 1").select("id", "version")
    if many.isEmpty():
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    else:
        rows = rows.join(many, ["id", "version"], "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(_with_copy(rows, many))
    rows = rows.join(numbers, ["id", "version"]).select("doc_id", "text", "first", "total", "copy")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, total, copy = (batch[c].to_numpy() for c in ("first", "total", "copy"))
            for lo, hi, flat, n in _tokenised(batch, shared.value):
                parts = n // length + 1
                out = np.full((parts.sum(), length), END, "<u2")
                row = np.repeat(np.arange(hi - lo), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                place = np.repeat((np.cumsum(parts) - parts) * length - (np.cumsum(n) - n), n) + np.arange(len(flat))
                out.reshape(-1)[place] = flat
                number = begin[lo:hi][row] + copy[lo:hi][row] * parts[row] + part
                slot = feistel(number, int(total[0]), key)
                used = np.minimum(n[row] + 1 - part * length, length)
                tokens = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), len(row), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(slot // shard), pa.array(slot % shard * 2 * length), batch["doc_id"].slice(lo, hi - lo).take(pa.array(row)), pa.array(part, pa.int32()), pa.array(used, pa.int32()), tokens],
                    ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "tokens"],
                )

    made = rows.mapInArrow(cut_up, "slot long, shard long, offset long, doc_id long, part int, n_tokens int, tokens binary")
    each = max(1, min(TASK_SHARDS, shards // (2 * sc.defaultParallelism)))
    return made.repartitionById(-(-shards // each), F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("slot")


def write_shards(made: DataFrame, path: str, shard: int = SHARD) -> DataFrame:
    """Writes ``sequences`` to ``path`` as shard-<n>.bin and returns shard, records, bytes, sha256.

    A task writes under a name of its own and renames at the end, so a repeated task leaves the same file.
    ``path`` may be any URI that pyarrow's file systems open.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        state, done = None, []

        def close():
            if state:
                number, stream, name, records, size, digest = state
                stream.close()
                fs.move(name, f"{root}/shard-{number:06d}.bin")
                done.append((number, records, size, digest.hexdigest()))

        for pdf in batches:
            for number, group in pdf.groupby("shard", sort=True):
                if not state or state[0] != number:
                    close()
                    name = f"{root}/.shard-{number:06d}-{attempt}.tmp"
                    state = [number, fs.open_output_stream(name), name, 0, 0, hashlib.sha256()]
                data = b"".join(group.tokens)
                state[1].write(data)
                state[3] += len(group)
                state[4] += len(data)
                state[5].update(data)
        close()
        yield pd.DataFrame(done, columns=["shard", "records", "bytes", "sha256"])

    return made.mapInPandas(write, "shard long, records long, bytes long, sha256 string")


def read_records(path: str, slot: int, count: int, length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """``count`` sequences from ``slot`` on, by seeking."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    out, stride = [], 2 * length
    while count > 0:
        take = min(count, shard - slot % shard)
        with fs.open_input_file(f"{root}/shard-{slot // shard:06d}.bin") as f:
            f.seek(slot % shard * stride)
            out.append(np.frombuffer(f.read(take * stride), "<u2").reshape(-1, length))
        slot, count = slot + take, count - take
    return np.concatenate(out)

