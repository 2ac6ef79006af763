"""What the operators share: reading tables, cutting lineage, and walking Arrow batches in bounded blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Tables written by ``cut_wide``, by the session's application.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own on a single machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="foliolens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder; ``release`` deletes what is written there."""
    path = f"{shared_dir(spark)}/foliolens-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow table with ``checkpoint()``; Spark removes it once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_wide(df: DataFrame) -> DataFrame:
    """Materialise a wide table as compressed Parquet in the shared folder and read it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``cut_wide`` has written; what was built on it must be stored by then."""
    spark = df.sparkSession
    mine = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in [p for p in mine if any(p.rsplit("/", 1)[1] in f for f in df.inputFiles())]:
        mine.remove(path)
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this application has written; call it once the results built on them are stored."""
    mine = _WRITTEN.get(spark.sparkContext.applicationId, [])
    while mine:
        _delete(spark, mine.pop())


def running(rows: DataFrame, order: list[str], amount: Column | None = None) -> DataFrame:
    """``rows`` in a global order with ``before``, the sum of ``amount`` (or count) of the rows before each, and ``total``.

    Rows are dealt by range, summed within their partition, and shifted by the sums of the partitions before; only
    one row a partition is broadcast or meets in one window.  Equal rows are told apart by their place in the input,
    so many of them do not fall to one task.  Nothing may refer to the columns that start with ``__``.
    """
    keys = [*order, "__tie"]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    at = cut(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    sums = at.groupBy("__part").agg((F.count("*") if amount is None else F.sum(amount)).alias("__n"))
    sums = sums.select("__part", F.expr("sum(__n) over (order by __part) - __n").alias("__before"), F.expr("sum(__n) over ()").alias("total"))
    within = F.col("__at").bitwiseAND((1 << 33) - 1) if amount is None else F.sum(amount).over(Window.partitionBy("__part").orderBy("__at")) - amount
    at = at.withColumn("__within", within).join(F.broadcast(sums), "__part")
    return at.withColumn("before", F.col("__before") + F.col("__within")).drop("__at", "__part", "__before", "__within")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def blocks(raw: np.ndarray, offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (one row at least), with their bytes and offsets from 0."""
    lo, rows = 0, len(offs) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lists(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and each row's length."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
