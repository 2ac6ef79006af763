"""Sharding along a Hilbert curve over quantised metadata.

Each dimension is cut into 2**bits bins at its own quantiles, the bins' Hilbert index orders the rows, and
equal runs of that order become shards, so that each shard spans a narrow range of every dimension and
file statistics prune on any of them.  Row counts of two shards differ by one at most.

The global order never meets in one task: rows are dealt by range of (curve, id), numbered within their
partition, and shifted by the rows of the partitions before; only a count a partition is summed up.

Quantiles of numbers are approximate ones of all rows (``percentile_approx``); texts are ranked by their whole
values, through the running counts of the distinct ones.  2**bits - 1 borders a dimension reach the driver.

Defined cases: a null text counts 8 bytes and has the checksum of the empty text; null metadata go to
bin 0; an empty table gives no rows; ties on the curve go by id, then checksum and size; repeated rows
take a slot each; long texts are only measured; ``assign`` reads the named columns only, ``write_shards`` writes
all columns as they are and refuses a name for the shard folders that a column has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import cut_wide, dropped, running

BITS = 5
#: Dimensions of the order: name and kind.
DIMENSIONS = (("lang", "text"), ("source", "text"), ("n_chars", "number"))


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with coordinates under 2**bits (Skilling's transform)."""
    x = [a.astype(np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def _borders(df: DataFrame, dimensions, bits: int) -> list[list]:
    """For each dimension the values at which bins begin, and the bins' numbers: how many 2**bits-th parts of the rows lie
    below, so that a frequent value takes up as much of the axis as it has rows."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    numbers = [F.percentile_approx(n, shares, 10_000).alias(f"d{i}") for i, (n, kind) in enumerate(dimensions) if kind == "number"]
    found = df.agg(*numbers).first() if numbers else {}
    out = []
    for i, (name, kind) in enumerate(dimensions):
        if kind == "number":
            out.append(sorted({v: n for n, v in enumerate(found[f"d{i}"] or [], 1)}.items()))
            continue
        counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("rows"))
        ranked = running(counts, ["value"], F.col("rows")).groupBy(F.expr(f"(before * {2**bits}) div total").alias("bin")).agg(F.min("value").alias("value"))
        out.append(sorted((r.value, r.bin) for r in ranked.filter("bin > 0").collect()))  # 2**bits at most
    return out


def curve(df: DataFrame, dimensions=DIMENSIONS, bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df`` with each row's place on the curve."""
    bins = []
    for (column, _), borders in zip(dimensions, _borders(df, dimensions, bits)):
        steps = zip(borders, [0, *(n for _, n in borders)])
        bins.append(sum((F.when(F.col(column) >= c, n - before).otherwise(0) for (c, n), before in steps), F.lit(0)).cast("int"))

    @F.pandas_udf("long")
    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    return df.withColumn(name, index(*bins))


_ORDER = ["__curve", "doc_id", "__crc", "__size"]


def _measured(docs: DataFrame, dimensions) -> DataFrame:
    """``docs`` with __size, __crc and __curve."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumn("__size", (F.octet_length(text) + 8).cast("long")).withColumn("__crc", F.crc32(F.encode(text, "UTF-8")))
    return curve(sized, dimensions, name="__curve")


def _dealt(ranked: DataFrame, shards: int) -> DataFrame:
    """__shard and __slot from __rank and __total: shard i holds the ranks from i * total / shards (rounded up) on."""
    shard = F.expr(f"(__rank * {shards}) div __total")
    return ranked.withColumn("__shard", shard.cast("int")).withColumn("__slot", F.col("__rank") - F.expr(f"(__shard * __total + {shards - 1}) div {shards}"))


def assign(docs: DataFrame, shards: int = 24, dimensions=DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row; shards are runs of the curve."""
    needed = dict.fromkeys(["doc_id", "text", *(n for n, _ in dimensions)])
    rows = _measured(docs.select(*needed), dimensions).select(*_ORDER)
    ranked = running(rows, _ORDER).withColumnsRenamed({"before": "__rank", "total": "__total"})
    return _dealt(ranked, shards).select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__curve").alias("curve"),
        F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, dimensions=DIMENSIONS, name: str = "shard") -> None:
    """Writes all columns as Parquet under ``path``/``name``=0 and so on: the shards of ``assign``, each in the order of its
    slots, so that the files' statistics prune on every dimension."""
    if name in docs.columns:
        raise ValueError(f"a column is named {name}; give another name for the folders")
    keys = [*_ORDER, "__tie"]
    rows = _measured(docs, dimensions).withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = cut_wide(rows.withColumn("__at", F.monotonically_increasing_id()).drop("__tie"))
    sums = stored.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    sums = sums.select("__part", F.expr("sum(__n) over (order by __part) - __n").alias("__first"), F.expr("sum(__n) over ()").alias("__total"))
    ranked = stored.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(sums), "__part")
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1))
    dealt = _dealt(ranked, shards).withColumn(name, F.col("__shard")).sortWithinPartitions(name, "__slot")
    dealt.select(*docs.columns, name).write.partitionBy(name).parquet(path)
    dropped(stored)
