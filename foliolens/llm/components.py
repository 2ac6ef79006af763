"""Connected components: bounded stretches of edges are contracted to stars, then stars meet by alternating large-star and
small-star steps, which are joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import cut

#: Edges that a task contracts at once (16 bytes each).
TASK_EDGES = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given edges and the smallest node that each reaches by them; smallest nodes themselves are left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        np.minimum.at(least, high, low)
        while (least != (up := least[least])).any():
            least = up
        open_ = least[a] != least[b]
        a, b = a[open_], b[open_]
    off = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[off], nodes[least[off]]


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v) that connect what ``edges`` do: of every ``most`` edges of a task their stars."""

    def flat(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([b[c].to_numpy() for b in held]) for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                held.append(batch.slice(at, most - size))
                at, size = at + len(held[-1]), size + len(held[-1])
                if size == most:
                    yield flat(held)
                    held, size = [], 0
        if held:
            yield flat(held)

    return edges.mapInArrow(run, "u long, v long")


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node in ``edges`` (a, b: long).

    As many edges as one task may contract need no step; more are contracted by stretches before each, and steps grow with the
    logarithm of the longest path that is left.  Null ends and loops are ignored; no edges, no rows.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = edges.count()
    while True:
        whole = n <= task_edges
        edges = cut(_contracted(edges.coalesce(1) if whole else edges, task_edges))
        if whole:
            break
        before = _state(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(hung.unionByName(least.withColumnRenamed("m", "v")).distinct())
        state = _state(edges)
        if state == before:  # the steps change nothing but stars
            break
        n = state[0]
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
