"""Operators along turns and ranges: activation, carried values, stages and capped steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from foliolens.sources.shared import cut


def activated(turns: DataFrame, entries: DataFrame) -> DataFrame:
    """conv_id, turn, entry_id, rank of the entries active at each assistant turn.

    What the turn before said, by whichever role, takes effect in this output and no later one.
    """
    from foliolens.operators.slots import hits

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    heard = turns.withColumn("heard", before).filter("role = 'assistant' and heard is not null")
    scenes = heard.select(F.concat_ws(":", "conv_id", "turn").alias("label"), F.col("heard").alias("text"))
    found = hits(scenes, entries)
    where = F.split("label", ":")
    return found.select(where[0].cast("long").alias("conv_id"), where[1].cast("long").alias("turn"), "entry_id", "rank")


def carried(rows: DataFrame, within: str, order: list[str], value: str, name: str) -> DataFrame:
    """The last value that is not null, this row's included."""
    w = Window.partitionBy(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def stage_of(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The first stage whose upper edge (exclusive) lies above the value."""
    out = F.lit(last)
    for edge, name in sorted(edges, reverse=True):
        out = F.when(value < edge, name).otherwise(out)
    return out


def _then(a: tuple, b: tuple) -> tuple:
    """Two steps in a row are one: each maps x to min(hi, max(lo, x + by)), given as (lo, hi, by)."""
    (lo1, hi1, by1), (lo2, hi2, by2) = a, b
    return np.clip(lo1 + by2, lo2, hi2), np.clip(hi1 + by2, lo2, hi2), by1 + by2


def _scanned(head: np.ndarray, steps: tuple) -> tuple:
    """Each row's step after all before it, from the last ``head`` on: spans of 1, 2, 4, ... rows are joined at once."""
    lo, hi, by = (x.astype(np.int64).copy() for x in steps)
    since = np.arange(len(head)) - np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    span = 1
    while span <= since.max(initial=0):
        at = np.flatnonzero(since >= span)
        lo[at], hi[at], by[at] = _then((lo[at - span], hi[at - span], by[at - span]), (lo[at], hi[at], by[at]))
        span *= 2
    return lo, hi, by


def _heads(column: pa.Array, before: object) -> np.ndarray:
    """Whether a row's key differs from the one before (nulls are alike)."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.append(column[0].as_py() != before, codes[1:] != codes[:-1])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``k``: one joined step for each run of a key, and ``before``: the key's value from 0 up to that run."""
    last, held = object(), None  # the key at hand and its step so far
    for batch in batches:
        head = _heads(batch["k"], last)
        steps = tuple(batch[c].to_numpy().astype(np.int64) for c in ("lo", "hi", "by"))
        if not head[0]:  # joined into the first row
            steps = tuple(np.append(x, y[1:]) for x, y in zip(_then(held, tuple(y[0] for y in steps)), steps))
            yield_first = np.clip(held[2], held[0], held[1])
        else:
            yield_first = 0
        lo, hi, by = _scanned(np.append(True, head[1:]), steps)
        total = np.clip(by, lo, hi)
        carry = np.where(head, 0, np.append(yield_first, total[:-1]))
        yield pa.RecordBatch.from_arrays([batch["part"], pa.array(carry), pa.array(~head)], ["part", "carry", "goes_on"])
        last, held = batch["k"][-1].as_py(), (lo[-1], hi[-1], by[-1])


def capped_steps(rows: DataFrame, within: str, scene: str, order: str, step: str, least: int, most: int) -> DataFrame:
    """``rows`` with ``score``: it starts at 0, moves by the first step of each scene only, and is held between the limits
    at every step.

    A held step joins with the next one into a step of the same form, so scores are a segmented scan: rows are dealt by range
    of key and order, however many a key has; each partition joins the steps of each of its keys into one; those, a few a
    partition, are scanned by key; and rows go on from what the partitions before theirs come to.  Rows without a step
    move nothing; rows without a key are one key; rows of one key that ``order`` does not tell apart are taken by scene and step.
    """
    first = F.row_number().over(Window.partitionBy(within, scene).orderBy(order, step))
    by = F.when(first == 1, F.coalesce(F.col(step), F.lit(0))).otherwise(0).cast("long")
    dealt = rows.withColumn("__by", by).repartitionByRange(within, order, scene, step).sortWithinPartitions(within, order, scene, step)
    dealt = cut(dealt.withColumn("__part", F.spark_partition_id()))
    columns = rows.columns

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The joined step of each key of a partition."""
        held = None  # part, key, lo, hi, by
        for batch in batches:
            head = _heads(batch["k"], held[1] if held else object())
            by = batch["by"].to_numpy().astype(np.int64)
            lo, hi, by = _scanned(np.append(True, head[1:]), (np.full(len(by), least), np.full(len(by), most), by))
            ends = np.append(np.flatnonzero(head[1:]), len(head) - 1)
            part = batch["part"][0].as_py()
            found = [(part, batch["k"][int(e)].as_py(), lo[e], hi[e], by[e]) for e in ends]
            if held and not head[0]:
                found[0] = (part, held[1], *_then(held[2:], found[0][2:]))
            elif held:
                found.insert(0, held)
            held = found.pop()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found) if found else [[]] * 5, piece_types)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(held, piece_types)], names)

    key = rows.schema[within].dataType
    names, piece_types = ["part", "k", "lo", "hi", "by"], [pa.int32(), to_arrow_type(key), pa.int64(), pa.int64(), pa.int64()]
    schema = StructType([StructField("part", IntegerType()), StructField("k", key), *(StructField(c, LongType()) for c in ("lo", "hi", "by"))])
    folded = dealt.select(F.col("__part").alias("part"), F.col(within).alias("k"), F.col("__by").alias("by")).mapInArrow(pieces, schema)
    carries = folded.repartition("k").sortWithinPartitions("k", "part").mapInArrow(_folded, "part int, carry long, goes_on boolean")
    carries = carries.filter("goes_on").select(F.col("part").alias("__part"), F.col("carry").alias("__carry"))  # a row a partition at most

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, score, begun = object(), 0, False
        for batch in batches:
            head = _heads(batch[within], last)
            if not begun and batch["__carry"][0].is_valid:
                head[0], score = False, batch["__carry"][0].as_py()
            begun = True
            by = batch["__by"].to_numpy().astype(np.int64)
            lo, hi, by = _scanned(np.append(True, head[1:]), (np.full(len(by), least), np.full(len(by), most), by))
            from_ = np.where(np.cumsum(head) == 0, score, 0)
            out = np.clip(from_ + by, lo, hi)
            last, score = batch[within][-1].as_py(), int(out[-1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(out, pa.int64())], [*columns, "score"])

    return dealt.join(F.broadcast(carries), "__part", "left").mapInArrow(walk, StructType([*rows.schema.fields, StructField("score", LongType())]))


def inversions(rows: DataFrame, within: str, order: str, wanted: Column) -> DataFrame:
    """Rows that stand after one that should come later."""
    before = F.lag("__w").over(Window.partitionBy(within).orderBy(order))
    return rows.withColumn("__w", wanted).withColumn("__b", before).filter("__b > __w").drop("__w", "__b")
