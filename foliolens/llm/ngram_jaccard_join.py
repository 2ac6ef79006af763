"""Size-aware heavy-light similarity join of word n-gram sets, and its components.

Two documents link when the Jaccard similarity of their shingle sets reaches ``percent``/100.  Equal sets
are one class from the start.  Then, by set size:

* light: two small sets link exactly if they share a subset of the overlap that their sizes ask for, so each
  small set enumerates those subsets and equal ones meet.
* heavy: a large set is found through inverted lists.  A first pass over the lists of some tokens (those
  with the lowest hashes, so the choice is the same in every set) leaves out the sets that share too few of
  them with any other.  The rest order their tokens from rare to frequent and put only the prefix
  into the lists that a partner must meet; each hit is bounded by the places on both sides, then verified.

The boundary is the size at which the rows to enumerate outweigh those to scan, taken from the size counts.

No list is expanded into all its pairs at once: members are first held against their neighbour by size and
against the smallest of their part of the list (long lists fall into parts of about ``LIST_PART``); what that
connects is one component.  Lists that then hold several components are gone through once more, in an order of
each list's own.  Only pairs across components remain, and of these only those whose signatures (bits of which each
token turns one, so that they differ in no more bits than the sets do in tokens) leave room for a link.  Short lists are
joined for that; members of long ones meet in blocks of two parts, where numpy compares them and only pairs that pass
become rows.  The comparisons within a list of sets that are much alike but not linked still grow with its square.  A token
that many sets of a batch have is sent once with all of them, so a frequent token makes as many rows as there are
batches.

Defined cases: a null or blank text has an empty set and links with nothing; so does a row with a null id,
whose component is null.  Repeated rows are one class; rows of one id with different sets are different classes,
each with its own links.  Ties have no bearing: links are symmetric.  A long text is a set like any other.  Only
doc_id and text are read, so further columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import blocks, cut, cut_wide, lists, utf8
from foliolens.llm.components import components
from foliolens.llm.words import mix, shingles

#: The largest set that may be light.
LIGHT_MOST = 24
#: Sorts and shuffles that a row of each kind goes through, for the boundary.
LIGHT_COST, HEAVY_COST = 2, 4
#: Tokens with hashes below this multiple of the share that a prefix takes are in the first lists.
ZONE = 4 / 3
#: Rows up to which a table of ids and set keys (about 120 bytes a row in memory) is broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 100_000
#: Members of a list that are held against the same least one.
LIST_PART = 512
#: Sets whose tokens a task sorts at once.
BATCH_SETS = 3_000
#: Members up to which what is left of a list is joined with itself; longer ones are compared in blocks.
SHORT_LIST = 48
#: Longs of a set's signature.
SIGNATURE = 8


def need(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """How many tokens of a set of n must be indexed for any partner to meet one."""
    return n - -(-percent * n // 100) + 1


def _zone(percent: int) -> float:
    """The share of tokens in the first lists: more than any prefix takes, so that common tokens can be left out of it."""
    return min(ZONE * (100 - percent) / 100, 0.999)


def _need(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def _prefix(percent: int) -> Column:
    return F.expr(f"n - (({percent} * n + 99) div 100) + 1")


def token_sets(docs: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """Adds n, key, zone and tokens (sorted hashes) to every row in place of its text; tokens beyond the first lists only if ``whole``."""
    low = np.uint64(int(_zone(percent) * 2**64))
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch["text"])
            for lo, hi, part, at in blocks(raw, offs):
                sets = shingles(part, at, words)
                n = [len(s) for s in sets]
                zone = [int(np.searchsorted(s, low)) for s in sets]
                key = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                kept = sets if whole else [s if len(s) <= LIGHT_MOST else s[: max(z, prefix(len(s), percent))] for s, z in zip(sets, zone)]
                tokens = lists(np.concatenate(kept).view(np.int64), [len(s) for s in kept], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(lo, hi - lo) for c in keep), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(zone, pa.int32()), tokens],
                    [*keep, "n", "key", "zone", "tokens"],
                )

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, schema + "n long, key binary, zone int, tokens array<long>")


def signature(tokens: np.ndarray) -> np.ndarray:
    """Bits of which every token turns one: two signatures differ in no more bits than their sets do in tokens."""
    at, count = np.unique(tokens & np.uint64(64 * SIGNATURE - 1), return_counts=True)
    odd = np.zeros(64 * SIGNATURE, np.uint8)
    odd[at[count % 2 == 1].astype(np.int64)] = 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def signed(sets: DataFrame) -> DataFrame:
    """node and the signature ``s`` of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t.values.to_numpy().view(np.uint64)) for t in batch["tokens"]]
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["node"], lists(flat, [SIGNATURE] * len(found), pa.int64())], ["node", "s"])

    return sets.select("node", "tokens").mapInArrow(run, "node long, s array<long>")


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The size up to which sets are light: the cheapest split of the given counts of small sizes."""

    def light(s: int, most: int) -> int:
        return sum(comb(s, need(s, t, percent)) for t in range(1, most + 1) if need(s, t, percent) <= min(s, t))

    def cost(most: int) -> float:
        return sum(c * (LIGHT_COST * light(s, most) if s <= most else HEAVY_COST * (_zone(percent) * s + prefix(s, percent))) for s, c in sizes.items())

    return min(range(1, LIGHT_MOST + 1), key=cost)


def light_links(classes: DataFrame, most: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all light sets which share an overlap subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rep, tokens in zip(batch["node"].to_pylist(), batch["tokens"].to_pylist()):
                s = len(tokens)
                x = np.array(tokens, np.int64).view(np.uint64)
                one, two = mix(x), mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                for t in range(1, most + 1):
                    c = need(s, t, percent)
                    if c > min(s, t):
                        continue
                    left = np.array(list(combinations(range(s), s - c)), np.int64).reshape(comb(s, c), s - c)
                    salt = np.uint64(min(s, t) * 64 + max(s, t))
                    k1 = mix(one.sum() - one[left].sum(axis=1, dtype=np.uint64) + salt).view(np.int64)
                    k2 = mix(two.sum() - two[left].sum(axis=1, dtype=np.uint64) + salt).view(np.int64)
                    out += zip(k1.tolist(), k2.tolist(), [rep] * len(left), [s] * len(left), [s == t] * len(left))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                ["k1", "k2", "rep", "s", "same"],
            )

    rows = classes.filter(f"n <= {most}").select("node", "tokens").mapInArrow(run, "k1 long, k2 long, rep long, s long, same boolean")
    # a key of two sizes links each of one with each of the other, so all of them are connected
    met = rows.groupBy("k1", "k2").agg(F.min("rep").alias("b"), F.count("*").alias("c"), (F.bool_or("same") | (F.min("s") < F.max("s"))).alias("ok"))
    return rows.join(met.filter("c > 1 and ok"), ["k1", "k2"]).filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def _sized(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if there are few enough, else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _by_token(sets: DataFrame) -> DataFrame:
    """token and nodes: the sets of one batch that have the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BATCH_SETS) for b in batches for at in range(0, len(b), BATCH_SETS)):
            tokens = batch["tokens"]
            node = np.repeat(batch["node"].to_numpy(), tokens.value_lengths().to_numpy())
            flat = tokens.flatten().to_numpy()
            order = np.argsort(flat, kind="stable")
            flat, node = flat[order], node[order]
            first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(flat)))
            rest = np.ones(len(flat), bool)
            rest[first] = False
            more = lists(node[rest], size - 1, pa.int64())
            more = pa.ListArray.from_arrays(more.offsets, more.values, mask=pa.array(size == 1))
            yield pa.RecordBatch.from_arrays([pa.array(flat[first], pa.int64()), pa.array(node[first], pa.int64()), more], ["token", "node", "more"])

    return sets.select("node", "tokens").mapInArrow(run, "token long, node long, more array<long>")


def _frequent(rows: DataFrame) -> DataFrame:
    """token, node and df of the tokens that several sets have."""
    df = F.sum(1 + F.coalesce(F.size("more"), F.lit(0))).over(Window.partitionBy("token"))
    nodes = F.coalesce(F.array_prepend("more", F.col("node")), F.array("node"))
    return rows.withColumn("df", df).filter("df > 1").select("token", F.explode(nodes).alias("node"), "df")


def candidates_left(classes: DataFrame, least: int, percent: int) -> DataFrame:
    """The nodes of the heavy classes that share enough tokens of the first lists with others to have a link."""
    heavy = classes.filter(f"n >= {least}").withColumn("p", _prefix(percent).cast("int"))
    rows = _frequent(_by_token(heavy.select("node", F.slice("tokens", F.lit(1), F.greatest("zone", "p")).alias("tokens"))))
    low, most = F.col("token") >= 0, int(_zone(percent) * 2**64)  # hashes as signed numbers: the upper half is negative
    low = low & (F.col("token") < most) if most < 1 << 63 else low | (F.col("token") < most - (1 << 64))
    met = rows.groupBy("node").agg(F.count_if(low).alias("met"))
    return met.join(heavy.select("node", "zone", "p"), "node").filter("zone - met < p").select("node").distinct()


def prefix_lists(sets: DataFrame, percent: int) -> DataFrame:
    """token, part, rep, n, pos: each set's prefix in the order from rare to frequent tokens; tokens of one set left out."""
    w = Window.partitionBy("node")
    rows = _frequent(_by_token(sets))
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy("df", "token"))).withColumn("met", F.count("*").over(w))
    rows = rows.join(sets.select("node", "n"), "node").withColumn("pos", F.col("n") - F.col("met") + F.col("nth") - 1)
    part = F.when(F.col("df") > LIST_PART, F.pmod(F.xxhash64("node"), F.expr(f"df div {LIST_PART} + 1"))).otherwise(0)
    return rows.filter(F.col("pos") < _prefix(percent)).select("token", part.cast("int").alias("part"), F.col("node").alias("rep"), "n", "pos")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether the places of a common token leave room for the overlap."""
    return F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos")) >= _need(F.col(f"{a}.n"), F.col(f"{b}.n"), percent)


def _may_agree(a: str, b: str, percent: int) -> Column:
    """Whether the signatures differ in no more bits than the sets may in tokens."""
    differ = sum((F.bit_count(F.col(f"{a}.s")[i].bitwiseXOR(F.col(f"{b}.s")[i])) for i in range(SIGNATURE)), F.lit(0))
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    return differ <= n - 2 * _need(F.col(f"{a}.n"), F.col(f"{b}.n"), percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.filter(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def heavy_links(lists_: DataFrame, sets: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that, with ``light``, connect all sets which the inverted lists connect."""
    me = F.struct("rep", "n", "pos")
    w = Window.partitionBy("token", "part")
    near = lists_.select("token", me.alias("x"), F.lag(me).over(w.orderBy("n", "rep")).alias("before"), F.min(me).over(w).alias("least"))
    # what a part has in common with the next: its least member
    heads = lists_.filter("part > 0").groupBy("token", "part").agg(F.min(me).alias("x"))
    first = lists_.join(heads.select("token").distinct(), "token", "left_semi").filter("part = 0").groupBy("token", "part").agg(F.min(me).alias("x"))
    along = heads.unionByName(first).select("x", F.lag("x").over(Window.partitionBy("token").orderBy("part")).alias("y"))
    near = near.select("x", F.explode(F.array("before", "least")).alias("y")).unionByName(along)
    near = near.filter("y is not null and x.rep <> y.rep").filter(_may_link("x", "y", percent))
    pairs = cut(near.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())
    first = cut(verified(pairs, sets, percent).unionByName(light))
    # what is left over several components: neighbours in an order of each list's own, then all pairs that may agree
    rows = _across(lists_, first, sets)
    more = cut(verified(_other_neighbours(rows, percent), sets, percent))
    if not more.isEmpty():
        first = first.unionByName(more)
        rows = _across(lists_, first, sets)
    few = rows.filter(f"members <= {SHORT_LIST}")
    meet = few.select("token", "x").join(few.select("token", F.col("x").alias("y")), "token").filter("x.rep < y.rep and x.comp <> y.comp").filter(_may_link("x", "y", percent) & _may_agree("x", "y", percent))
    meet = meet.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).unionByName(_in_blocks(rows.filter(f"members > {SHORT_LIST}"), percent))
    rest = meet.distinct().join(pairs, ["a", "b"], "left_anti")
    return first.unionByName(verified(rest, sets, percent))


def _across(lists_: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """token, members and x (rep, n, pos, comp, signature) of the lists that hold sets of several components."""
    known = components(links).withColumnsRenamed({"node": "rep", "component": "comp"})
    rows = lists_.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).select("token", "rep", "n", "pos", "comp")
    split = cut(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("token", "members"))
    rows = cut(rows.join(split, "token"))
    wanted = sets.join(rows.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    rows = rows.join(signed(wanted).withColumnRenamed("node", "rep"), "rep")
    return cut(rows.select("token", "members", F.struct("rep", "n", "pos", "comp", "s").alias("x")))


def _other_neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that stand side by side in lists ordered, and cut into parts, by hashes of
    token and set: a set has other neighbours in each of its lists."""
    dealt = rows.withColumn("h", F.xxhash64("token", F.col("x.rep"))).withColumn("part", F.expr(f"pmod(h, members div {LIST_PART} + 1)"))
    w = Window.partitionBy("token", "part").orderBy("h")
    near = dealt.select("x", F.lag("x", 1).over(w).alias("y1"), F.lag("x", 2).over(w).alias("y2"))
    near = near.select("x", F.explode(F.array("y1", "y2")).alias("y")).filter("y is not null and x.comp <> y.comp")
    near = near.filter(_may_link("x", "y", percent) & _may_agree("x", "y", percent))
    return near.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _in_blocks(rows: DataFrame, percent: int, part: int = LIST_PART) -> DataFrame:
    """Pairs (a, b) of long lists' members that may link: lists fall into parts, and every two parts meet in one block.

    A block holds about two parts, whose places and signatures are compared in numpy a row of the block at a time; only
    pairs that pass are rows.  A member is sent once for each part of its list.
    """
    parts = F.expr(f"members div {part} + 1").cast("int")
    dealt = rows.withColumn("p", F.pmod(F.xxhash64(F.col("x.rep")), parts).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("token", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", *(F.col(f"x.{c}").alias(c) for c in ("rep", "n", "pos", "comp", "s")))

    def compare(block: pa.Table) -> pa.Table:
        p, i, j, rep, n, pos, comp = (block[c].to_numpy() for c in ("p", "i", "j", "rep", "n", "pos", "comp"))
        s = block["s"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SIGNATURE)
        same, a, b = i[0] == j[0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        right = np.arange(len(p)) if same else np.flatnonzero(p == j[0])
        for x in range(len(p)) if same else np.flatnonzero(p == i[0]):
            y = right[right > x] if same else right
            y = y[comp[y] != comp[x]]
            least = np.ceil((n[x] + n[y]) * percent / (100.0 + percent) - 1e-9)
            y = y[(np.minimum(n[x] - pos[x], n[y] - pos[y]) >= least)]
            least = np.ceil((n[x] + n[y]) * percent / (100.0 + percent) - 1e-9)
            y = y[np.bitwise_count(s[x] ^ s[y]).sum(1, dtype=np.int64) <= n[x] + n[y] - 2 * least]
            a.append(np.minimum(rep[x], rep[y]))
            b.append(np.maximum(rep[x], rep[y]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long")


def join_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id of an equal set) and component_id of every row.

    ``component`` numbers the components (null without a set) and ``text_hash`` tells rows of one id apart.
    """
    docs = docs.select("doc_id", "text")
    every = cut_wide(token_sets(docs.withColumn("text_hash", F.xxhash64("text")), words, percent, whole=False))
    known = every.filter("key is not null and doc_id is not null")
    reps = known.groupBy("key", "doc_id").count().groupBy("key").agg(F.min("doc_id").alias("rep"), F.min_by("count", "doc_id").alias("rows"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))  # a number a class, kept by the checkpoint
    owners = reps.select(F.col("rep").alias("doc_id"), F.col("key").alias("own"), "node")
    classes = known.join(_sized(owners), "doc_id").filter("key = own")
    classes = classes.select("node", "n", "zone", "tokens")  # a repeated row is there as often; nothing below minds
    sizes = {r.n: r["count"] for r in classes.filter(f"n <= {LIGHT_MOST}").groupBy("n").count().collect()}  # LIGHT_MOST rows at most
    most = boundary(sizes, percent)
    light = light_links(classes, most, percent)
    least = -(-percent * (most + 1) // 100)  # the smallest set that a heavy one can link with
    ids = cut(owners.join(candidates_left(classes, least, percent), "node"))
    sets = token_sets(docs.join(_sized(ids), "doc_id"), words, percent, whole=True).filter("key = own").select("node", "n", "tokens")
    if not reps.filter("rows > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])
    sets = cut_wide(sets)
    links = heavy_links(cut(prefix_lists(sets, percent)), sets, cut(light), percent)
    linked = reps.join(components(links), "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = linked.groupBy("root").agg(F.min("rep").alias("smallest"))
    groups = linked.join(smallest, "root").select("key", "rep", "smallest", "root")
    out = every.select("doc_id", "text_hash", "n", "key").join(groups, "key", "left")
    has = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(has, F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(has, F.coalesce("smallest", "doc_id")).alias("component_id"), F.when(has, F.col("root")).alias("component"), "text_hash",
    )


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of ``found``: that with the smallest id, of rows that share it the
    one with the least text hash.  Rows without a set stay; rows with the same id and text are one row."""
    found = cut(found.select("doc_id", "text_hash", "component_id", "component"))
    heads = found.filter("component is not null and doc_id = component_id")
    least = heads.groupBy("component").agg(F.min("text_hash").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    twins = heads.join(least, "component").filter("text_hash <> least")
    gone = found.filter("component is not null and doc_id <> component_id").unionByName(twins.select(*found.columns))
    gone = cut(gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    again = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).count().filter("count > 1")
    again = cut(again.join(gone, ["__id", "__hash"], "left_anti").select("__id", "__hash"))
    keyed = docs.withColumn("__id", F.col("doc_id")).withColumn("__hash", F.xxhash64("text"))
    left = keyed.join(_sized(gone), ["__id", "__hash"], "left_anti")
    if not again.isEmpty():
        repeated = left.join(_sized(again), ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
        left = left.join(_sized(again), ["__id", "__hash"], "left_anti").unionByName(repeated)
    return left.select(*docs.columns)
