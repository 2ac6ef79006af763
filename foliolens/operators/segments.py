"""Ordered records from structured texts: entry blocks, sections, lines and repeated titles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.functions.text import body, bracket_list, field, fingerprint, title_key

WHOLE = "(전체)"  # the title of a text without headings (a fixed value)


def entry_blocks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row a ``# kb.*`` block: keep, rank (from 0), entry_id, settings, keywords, body; the preamble is left out."""
    parts = F.split("text", r"(?md)(?=^#[^\S\n]+`?kb\.[^`\s]+)")
    rows = docs.select(*keep, F.posexplode(F.filter(parts, lambda p: p.rlike(r"^#[^\S\n]+`?kb\."))).alias("rank", "block"))
    return rows.select(
        *keep, "rank", F.regexp_extract("block", r"^#[^\S\n]+`?(kb\.[^`\s]+)", 1).alias("entry_id"),
        field(F.col("block"), "activation_setting").alias("activation_setting"), field(F.col("block"), "activation_when").alias("activation_when"),
        bracket_list(field(F.col("block"), "keywords")).alias("keywords"), body(F.col("block")).alias("body"),
    )


def sections(docs: DataFrame, file: str = "name") -> DataFrame:
    """file, pos, title, digest of every section of levels 1 to 3; deeper headings stay in their section."""
    head = r"(?md)^#{1,3}\s+(.+?)\s*$"
    parts = F.split("text", r"(?md)(?=^#{1,3}\s+\S)")
    # split once a text: array and size are columns before the array is taken apart; outer, as else a filter on its size splits again
    rows = docs.select(F.col(file).alias("file"), "text", F.filter(parts, lambda p: p.rlike(r"^#{1,3}\s+\S")).alias("found"))
    rows = rows.select("file", F.when(F.size("found") > 0, F.col("found")).otherwise(F.array("text")).alias("found"))
    rows = rows.select("file", "found", (F.size("found") - 1).alias("last")).select("file", F.posexplode_outer("found").alias("pos", "part"), "last")
    titled = F.col("part").rlike(r"^#{1,3}\s+\S")
    # the next heading's mark keeps a blank line before it in the body
    after = F.regexp_replace(F.concat("part", F.when(F.col("pos") < F.col("last"), "#").otherwise("")), r"(?md)\A#{1,3}\s+.+?\s*$", "")
    after = F.when(F.col("pos") < F.col("last"), F.substring(after, F.lit(1), F.length(after) - 1)).otherwise(after)
    rows = rows.select(
        "file", "pos", F.when(titled, title_key(F.regexp_extract("part", head, 1))).otherwise(WHOLE).alias("title"),
        fingerprint(F.when(titled, after).otherwise(F.col("part"))).alias("digest"),
    )
    return number_repeats(rows, ["file"], "title", "pos")


def number_repeats(rows: DataFrame, within: list[str], title: str, order: str) -> DataFrame:
    """Titles made unique: one that is taken gets `` (n)`` with the least n from 2 on that is free in its group.

    Rows are dealt and sorted by group, and each task walks its groups in order, as a number may be taken by what a text says;
    it holds the titles of one group at a time.  Null titles stay null.
    """
    at = rows.columns.index(title)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, least = None, set(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in within]
            begins = {0}.union(*((np.asarray(pc.run_end_encode(k).run_ends)[:-1]).tolist() for k in keys))
            bounds, titles, out = [*sorted(begins), batch.num_rows], batch.column(at).to_pylist(), []
            for begin, end in zip(bounds, bounds[1:]):
                if begin or [k[0].as_py() for k in keys] != group:
                    taken, least = set(), {}
                for t in titles[begin:end]:
                    key = t
                    if t is not None and t in taken:
                        n = least.get(t, 2)
                        while (key := f"{t} ({n})") in taken:
                            n += 1
                        least[t] = n + 1
                    taken.add(key)
                    out.append(key)
            group = [k[-1].as_py() for k in keys]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return rows.repartition(*within).sortWithinPartitions(*within, order).mapInArrow(walk, rows.schema)


def lines(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, pos (from 0) and line."""
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def next_start(rows: DataFrame, within: list[str], start: str, name: str = "end") -> DataFrame:
    """Where each block ends: at the start of the next."""
    return rows.withColumn(name, F.lead(start).over(Window.partitionBy(*within).orderBy(start)))
