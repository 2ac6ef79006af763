"""Which repeated runs of words are worth a symbol: runs counted level by level, and a greedy choice by what they save.

A run of n words can only be frequent if both runs of n - 1 words in it are, so each level looks only at places whose parts
are frequent, one window over each text's places and one count a level.  A symbol saves (length of the run - length of the
symbol) at each use and costs the run, the symbol and ``DEFINITION`` characters once, in the legend.

The choice takes the run that saves most (of equals the first in order), removes all places that overlap its uses, counts the
rest again, and goes on until nothing pays or ``most`` are taken.  No run can save more than its places at the start allow, so a
round looks only at the runs with the highest such bounds, and is certain if the best of them saves more than any other could.

Defined cases: words are runs of characters that are no white space; occurrences of a run that begin within another of the
same are one use; null and empty texts have no words; rows of the same key are one text each by their place in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.sources.shared import cut

# How often a symbol must come back to pay, and what its legend line takes besides run and symbol.
LEAST_USES, DEFINITION = 4, 2

#: How many runs are in play at first, and then.
PROMISING = (1_000, 16_000)


def occurrences(docs: DataFrame, text: str = "text", least: int = LEAST_USES, most_words: int = 6) -> DataFrame:
    """doc (a number of the row), pos (of the first word), n (words) and run of every place of a frequent run of two words or more."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("doc"), words.alias("words")))  # numbered before they are taken apart
    level = rows.select("doc", F.posexplode("words").alias("pos", "run")).withColumn("last", F.col("run"))
    out = None
    for n in range(1, most_words + 1):
        if n > 1:
            after = Window.partitionBy("doc").orderBy("pos")
            both = level.withColumn("__p", F.lead("pos").over(after)).withColumn("__w", F.lead("last").over(after)).filter("__p = pos + 1")
            level = both.select("doc", "pos", F.concat_ws(" ", "run", "__w").alias("run"), F.col("__w").alias("last"))
        often = level.groupBy("run").agg(F.count("*").alias("__c")).filter(F.col("__c") >= least).select("run")
        level = cut(level.join(often, "run", "left_semi"))
        if n > 1:
            rows = level.select("doc", "pos", F.lit(n).alias("n"), "run")
            out = rows if out is None else out.unionByName(rows)
    return out


def heads(places: DataFrame) -> DataFrame:
    """The places that count as uses: those that do not begin within another place of the same run."""
    before = F.lag("pos").over(Window.partitionBy("doc", "run").orderBy("pos"))
    return places.withColumn("__b", before).filter("__b is null or __b + n <= pos").drop("__b")


def saving(run: Column, uses: Column, symbol: int) -> Column:
    return uses * (F.length(run) - symbol) - (F.length(run) + symbol + DEFINITION)


def run_savings(docs: DataFrame, text: str = "text", symbol: int = 1, least: int = LEAST_USES, most_words: int = 6) -> DataFrame:
    """run, n, uses and saves of every run that is used often enough to pay, each by itself."""
    return _counted(occurrences(docs, text, least, most_words), symbol, least)


def _counted(places: DataFrame, symbol: int, least: int) -> DataFrame:
    uses = heads(places).groupBy("run", "n").agg(F.count("*").alias("uses")).filter(F.col("uses") >= least)
    return uses.withColumn("saves", saving(F.col("run"), F.col("uses"), symbol)).filter("saves > 0")


def _chosen_of_all(docs: DataFrame, text: str, symbol: int, least: int, most_words: int, most: int) -> list[tuple]:
    """The choice with the places of all frequent runs in play in each round."""
    places, chosen = cut(occurrences(docs, text, least, most_words)), []
    for nth in range(1, most + 1):
        best = _counted(places, symbol, least).orderBy(F.desc("saves"), "run").first()
        if best is None:
            break
        chosen.append((nth, *best))
        taken = heads(places.filter(F.col("run") == best.run)).select("doc", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("__at")).distinct()
        covered = places.withColumn("__at", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1))).join(taken, ["doc", "__at"]).select("doc", "pos", "n").distinct()
        places = cut(places.join(covered, ["doc", "pos", "n"], "left_anti"))
    return chosen


def _runs(rows: DataFrame, most_words: int) -> DataFrame:
    """doc, n, pos and run of every place, straight from the words of a row."""
    places = rows.select("doc", "words", F.explode(F.array(*map(F.lit, range(2, most_words + 1)))).alias("n")).filter(F.size("words") >= F.col("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.concat_ws(" ", F.slice("words", i, F.col("n"))))
    return places.select("doc", "n", F.posexplode_outer(runs).alias("pos", "run"))  # never empty; outer, as else a filter works the runs out again


def _bounds(rows: DataFrame, symbol: int, least: int, most_words: int) -> DataFrame:
    """h (a run's hash) and bound: what the run would save if all its places were uses; places only become fewer."""
    hashed = _runs(rows, most_words).select(F.xxhash64("run").alias("h"), F.length("run").alias("size"))
    counts = hashed.groupBy("h", "size").agg(F.count("*").alias("places")).filter(F.col("places") >= least)
    return counts.select("h", (F.col("places") * (F.col("size") - symbol) - (F.col("size") + symbol + DEFINITION)).alias("bound")).filter("bound > 0")


def _chosen(rows: DataFrame, within: int, symbol: int, least: int, most_words: int, most: int) -> list[tuple] | None:
    """The choice among the runs with the ``within`` highest bounds; none if one beyond them could come before.

    Their places are held as one array of numbers a text (place, number of the run, its words), so a round removes within rows.
    """
    session, base = rows.sparkSession, most_words + 1
    top = _bounds(rows, symbol, least, most_words).orderBy(F.desc("bound"), "h").limit(within + 1).collect()
    beyond = top[within].bound if len(top) > within else 0
    if not top:
        return []
    hashes = session.createDataFrame([(h,) for h in {x.h for x in top[:within]}], "h long")
    near = _runs(rows, most_words).withColumn("h", F.xxhash64("run")).join(F.broadcast(hashes), "h", "left_semi")
    names = [tuple(x) for x in near.select("run", "n").distinct().collect()]
    wide = len(names)
    number = session.createDataFrame([(k, run) for k, (run, _) in enumerate(names)], "k long, run string")
    coded = near.join(F.broadcast(number), "run").select("doc", ((F.col("pos") * wide + F.col("k")) * base + F.col("n")).alias("x"))
    places = cut(coded.groupBy("doc").agg(F.collect_list("x").alias("xs")))
    looped = [k for k, (run, n) in enumerate(names) if any((w := run.split(" "))[i:] == w[: n - i] for i in range(1, n))]
    number_of, word_of, out = (lambda x: F.pmod(F.floor(x / base), F.lit(wide))), (lambda x: F.floor(F.floor(x / base) / wide)), []
    while len(out) < most:
        each = places.select("doc", F.explode("xs").alias("x")).select("doc", number_of(F.col("x")).alias("run"), word_of(F.col("x")).alias("pos"), (F.col("x") % base).alias("n"))
        # only places of a run that can overlap itself may lie within one another
        uses = each.filter(~F.col("run").isin(looped)).unionByName(heads(each.filter(F.col("run").isin(looped)))) if looped else each
        counts = [(x.run, x.uses) for x in uses.groupBy("run").agg(F.count("*").alias("uses")).collect()]
        paying = [(u * (len(names[k][0]) - symbol) - (len(names[k][0]) + symbol + DEFINITION), k, u) for k, u in counts if u >= least]
        saves, k, u = min(paying, key=lambda x: (-x[0], names[x[1]][0].encode()), default=(0, 0, 0))
        if 0 < beyond and saves <= beyond:
            return None
        if saves <= 0:
            break
        out.append((len(out) + 1, *names[k], u, saves))
        n = names[k][1]
        own = F.transform(F.filter("xs", lambda x: number_of(x) == k), word_of)
        rows_of = places.select("doc", "xs", own.alias("own"))
        if k in looped:
            rows_of = rows_of.select("doc", "xs", F.filter("own", lambda h: ~F.exists("own", lambda p: (p < h) & (p + n > h))).alias("own"))
        meets = lambda x: F.exists("own", lambda h: (word_of(x) < h + n) & (h < word_of(x) + x % base))  # noqa: E731, B023
        places = cut(rows_of.select("doc", F.when(F.size("own") > 0, F.filter("xs", lambda x: ~meets(x))).otherwise(F.col("xs")).alias("xs")).filter(F.size("xs") > 0))  # noqa: B023
    return out


def promoted(docs: DataFrame, text: str = "text", symbol: int = 1, least: int = LEAST_USES, most_words: int = 6, most: int = 20) -> DataFrame:
    """nth, run, n, uses and saves of the runs to promote, in the order of choice.

    Only the most promising runs' places are held; where those do not settle the choice more are, and all of them at last.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("doc"), words.alias("words")))
    chosen = None
    for within in PROMISING:
        if chosen is None:
            chosen = _chosen(rows, within, symbol, least, most_words, most)
    if chosen is None:
        chosen = _chosen_of_all(docs, text, symbol, least, most_words, most)
    return docs.sparkSession.createDataFrame(chosen, "nth int, run string, n int, uses long, saves long")
