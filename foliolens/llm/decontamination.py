"""Benchmark decontamination by pigeonhole edit matching.

An item of length L may differ from a passage by e = L * percent // 100 edits.  Cut into e + 1 pieces, one
piece at least stays intact in any such passage, so exact hits of the pieces find every candidate; each is
then verified by Myers' bit-parallel edit distance, which takes the text of the passage a character at a
time with the whole item in one integer.

Texts are compared lower-cased with every run of other characters than letters and digits as one space.
Pieces of all items go to one Aho-Corasick automaton, so a document is read once a block of items; a block
holds about ``BLOCK_CHARS`` characters of items, which bounds what is broadcast, and more blocks mean more
passes, never fewer items.

Defined cases: a null or empty document has no match; an item without letters or digits is never found, nor
one with a null id; repeated documents and items are matched each; a long text is read whole; ``matches`` ignores
further columns and ``clean`` passes them through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits allowed in a hundred characters of an item.
PERCENT = 8
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, with single spaces between runs of letters and digits."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, percent: int) -> list[tuple[int, str]]:
    """The error budget plus one pieces of an item, with their places."""
    parts = min(len(item), len(item) * percent // 100 + 1)
    edges = [i * len(item) // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any substring of ``text``, and the end of the first such."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        pv = (mh << 1 & mask) | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def found_in(text: str, items: list[tuple[int, str]], automaton, percent: int) -> list[tuple[int, int]]:
    """(item number, distance) of every item within its budget somewhere in a normalised text."""
    spots: dict[int, set[int]] = {}
    for end, (length, owners) in automaton.iter(text):
        for item, at in owners:
            spots.setdefault(item, set()).add(end + 1 - length - at)
    out = []
    for item, starts in spots.items():
        pattern = items[item][1]
        budget = len(pattern) * percent // 100
        best, hi = budget + 1, None
        for start in sorted(starts):  # overlapping windows are verified as one
            a, b = max(0, start - budget), start + len(pattern) + budget
            if hi is not None and a <= hi:
                hi = b
                continue
            if hi is not None:
                best = min(best, myers(pattern, text[lo:hi])[0])
            lo, hi = a, b
        best = min(best, myers(pattern, text[lo:hi])[0])
        if best <= budget:
            out.append((item, best))
    return out


def automaton_of(items: list[tuple[int, str]], percent: int):
    owners: dict[str, list[tuple[int, int]]] = {}
    for number, (_, item) in enumerate(items):
        for at, piece in pieces(item, percent):
            owners.setdefault(piece, []).append((number, at))
    made = ahocorasick.Automaton()
    for piece, own in owners.items():
        made.add_word(piece, (len(piece), own))
    made.make_automaton()
    return made


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, dealt by hash into as many blocks as make about BLOCK_CHARS characters each."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", "text")
    count = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for i in range(count):
        yield [(x.item_id, t) for x in items.filter(block == i).toLocalIterator() if (t := normal(x.text))]


def _hits(docs: DataFrame, known: list[tuple[int, str]], percent: int) -> Column:
    """The items (with distances) of one block that each text holds."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<struct<item_id:long,distance:int>>")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        machine = automaton_of(known, percent)
        for texts in parts:
            yield pd.Series([[{"item_id": known[i][0], "distance": d} for i, d in found_in(normal(t), known, machine, percent)] for t in texts])

    return hits("text")


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, distance of every document and item that it holds within the error budget.

    ``benchmark`` has item_id and text.  Documents stay where they are: nothing is shuffled.
    """
    docs = docs.select("doc_id", "text")
    parts = [docs.select("doc_id", F.explode(_hits(docs, known, percent)).alias("hit")) for known in _blocks(benchmark) if known]
    none = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int")
    return reduce(DataFrame.unionByName, [p.select("doc_id", "hit.*") for p in parts], none) if len(parts) != 1 else parts[0].select("doc_id", "hit.*")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold an item; all their columns stay."""
    for known in _blocks(benchmark):
        if known:
            docs = docs.filter(F.size(_hits(docs, known, percent)) == 0)
    return docs
