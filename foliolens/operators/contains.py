"""Which texts contain which phrases: a substring join by equality on an anchor of each phrase.

A phrase of three words or more can only be in a text that has the phrase's inner words as words of its own; its
anchor is the longest of them.  Any other phrase is anchored by its first characters, as many of ``ANCHORS`` as it has.
Texts offer their distinct words and runs of those lengths that are asked for, mostly one, so the work grows with the
texts and not with texts times phrases.  What meets by its anchor is then checked by ``contains``.

Empty phrases match nothing, null texts and null phrases neither; repeated rows match each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases up to which anchors are looked up within each text's row; more meet the texts by a shuffle join.
BROADCAST_PHRASES = 5_000
#: Characters by which phrases of one or two words meet texts, the most first.
ANCHORS = (6, 4, 2, 1)


def _anchor(phrase: Column) -> Column:
    """``w`` and the longest inner word, or the number of characters and that many of the first ones."""
    inner = F.filter(F.slice(F.split(phrase, " "), 2, F.greatest(F.size(F.split(phrase, " ")) - 2, F.lit(0))), lambda w: w != "")
    word = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    size = F.lit(ANCHORS[-1])
    for n in ANCHORS[-2::-1]:
        size = F.when(F.length(phrase) >= n, n).otherwise(size)
    return F.coalesce(F.concat(F.lit("w"), word), F.concat(size.cast("string"), F.substring(phrase, F.lit(1), size)))


def _offers(text: Column, kinds: list[str]) -> Column:
    """What a text offers to anchors of the given kinds (``w`` or a number of characters)."""
    found = [F.array().cast("array<string>")]
    for kind in kinds:
        parts = F.split(text, " ") if kind == "w" else F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{kind}}}))"), F.lit(1))
        found.append(F.transform(F.array_distinct(parts), _of_kind(kind)))
    return F.concat(*found)


def _of_kind(kind: str):
    return lambda x: F.concat(F.lit(kind), x)


def contains_join(texts: DataFrame, phrases: DataFrame, text: str, phrase: str, limit: int = BROADCAST_PHRASES) -> DataFrame:
    """Inner join on ``phrase`` being a substring of ``text``; both tables keep all their columns, so no name may be in both."""
    if set(texts.columns) & set(phrases.columns):
        raise ValueError(f"columns in both tables: {sorted(set(texts.columns) & set(phrases.columns))}")
    phrases = phrases.filter(F.col(phrase) != "").withColumn("__at", _anchor(F.col(phrase)))
    # one small job on the phrases: how many there are decides the way, and the kinds are those of ANCHORS and words
    many, kinds = phrases.agg(F.count("*"), F.sort_array(F.collect_set(F.substring("__at", 1, 1)))).first()
    offers = _offers(F.col(text), kinds)
    if many <= limit:
        asked = phrases.agg(F.collect_set("__at").alias("all")).scalar()  # limit rows at most
        met = texts.withColumn("__at", F.explode(F.array_intersect(offers, asked)))
        return met.join(F.broadcast(phrases), "__at").filter(F.contains(F.col(text), F.col(phrase))).drop("__at")
    digest = F.sha2(F.col(text), 256)
    met = texts.select(digest.alias("__text"), F.explode(offers).alias("__at")).distinct()
    pairs = met.join(phrases.select("__at", F.col(phrase).alias("__phrase")).distinct(), "__at").select("__text", "__phrase")
    hits = texts.withColumn("__text", digest).join(pairs, "__text").filter(F.contains(F.col(text), F.col("__phrase")))
    return hits.join(phrases.drop("__at"), F.col("__phrase") == F.col(phrase)).drop("__text", "__phrase")


def contained_nowhere(phrases: DataFrame, texts: DataFrame, phrase: str, text: str) -> DataFrame:
    """The phrases that no text contains (a bag of texts counts as one); empty and null phrases are not asked about."""
    known = contains_join(texts.select(F.col(text).alias("__in")), phrases.select(F.col(phrase).alias("__is")).distinct(), "__in", "__is")
    asked = phrases.filter(F.col(phrase) != "")
    return asked.join(known.select(F.col("__is").alias(phrase)).distinct(), phrase, "left_anti").select(*phrases.columns)
