"""Which bodies lie, nearly word for word, in which prompts: a join on the share of a body's shingles.

A body is linked with a prompt if the prompt has at least ``percent`` of the body's distinct shingles; the prompt may be any
number of times longer.  To have so many, it must have one of the body's n - needed + 1 rarest, so only those, rarest first
over all prompts, meet prompts by equality; what meets is then counted exactly.  Shingles that no prompt has meet nothing.

Bodies with equal sets are one class, named by the smallest id, and so are prompts; classes are joined, so copies are never
paired with each other.  Shingles are held as 64-bit hashes.

Defined cases: words are runs of characters that are no white space, in lower case; a text of fewer words than a shingle has
one shingle, its whole sequence; one without words, or null, has none and no links.  Repeated rows and ids are of one class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.sources.shared import cut


def shingles(text: Column, words: int) -> Column:
    """The sorted hashes of a text's distinct shingles."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    n = F.lit(words)

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, n))))).otherwise(F.array().cast("array<long>"))

    # the words are bound to a name, as a lambda would work them out for each shingle
    return F.sort_array(F.array_distinct(F.get(F.transform(F.array(found), of), 0)))


def classes(rows: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``key``, class_id (the smallest key with the same set) and the set."""
    sets = cut(rows.select(F.col(key), shingles(F.col(text), words).alias("__set")))
    first = sets.groupBy("__set").agg(F.min(key).alias("class_id"))
    return sets.join(first, "__set").select(key, "class_id", F.col("__set").alias("set"))


def contained(bodies: DataFrame, prompts: DataFrame, body: str, prompt: str, text: str = "text", words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Pairs (body_class, prompt_class, shared, n) that are linked, and one row a body: ``body``, class_id, n_shingles, n_links."""
    members = cut(classes(bodies, body, text, words))
    a = cut(members.groupBy("class_id").agg(F.first("set").alias("set")).filter(F.size("set") > 0).withColumn("n", F.size("set")))
    b = cut(classes(prompts, prompt, text, words).groupBy("class_id").agg(F.first("set").alias("set")).filter(F.size("set") > 0))
    asked = a.select("class_id", "n", F.explode("set").alias("t"))
    offered = b.select(F.col("class_id").alias("prompt_class"), F.explode("set").alias("t")).join(asked.select("t").distinct(), "t")
    offered = cut(offered)
    count = offered.groupBy("t").agg(F.count("*").alias("many"))
    needed = F.ceil(F.col("n") * percent / F.lit(100))
    rare = asked.join(count, "t", "left").groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "t"))).alias("all"))
    rare = rare.select("class_id", F.explode(F.filter(F.slice("all", F.lit(1), (F.col("n") - needed + 1).cast("int")), lambda x: x["many"] > 0)).alias("x"))
    met = rare.select(F.col("class_id").alias("body_class"), F.col("x.t").alias("t")).join(offered, "t").select("body_class", "prompt_class").distinct()
    both = met.join(a.select(F.col("class_id").alias("body_class"), F.col("set").alias("__a"), "n"), "body_class").join(b.select(F.col("class_id").alias("prompt_class"), F.col("set").alias("__b")), "prompt_class")
    pairs = both.select("body_class", "prompt_class", F.size(F.array_intersect("__a", "__b")).alias("shared"), "n").filter(F.col("shared") >= F.ceil(F.col("n") * percent / F.lit(100)))
    pairs = cut(pairs)
    links = pairs.groupBy(F.col("body_class").alias("class_id")).agg(F.count("*").alias("n_links"))
    rows = members.select(body, "class_id", F.size("set").alias("n_shingles")).join(links, "class_id", "left")
    return pairs, rows.select(body, "class_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))
