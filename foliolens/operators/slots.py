"""Which registered entries a text calls up, and which of them a limited number of slots loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.functions.text import match_key
from foliolens.operators.audits import keyword_rows
from foliolens.operators.contains import contains_join

SLOTS = 3
MOST_ALWAYS = 3
ALWAYS = 0.7
BOTTOM = 0.25


def hits(scenes: DataFrame, entries: DataFrame) -> DataFrame:
    """label, entry_id, rank of every entry of which a keyword is in the scene; both by match key."""
    keyed = scenes.select("label", match_key(F.col("text")).alias("h"))
    return contains_join(keyed, keyword_rows(entries, ["entry_id", "rank"]), "h", "k").select("label", "entry_id", "rank").distinct()


def allocate(found: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds slot (from 1, by rank) and whether it is loaded."""
    slot = F.row_number().over(Window.partitionBy("label").orderBy("rank"))
    return found.withColumn("slot", slot.cast("long")).withColumn("loaded", F.col("slot") <= slots)


def scene_load(scenes: DataFrame, allocated: DataFrame) -> DataFrame:
    """label, hits, loaded and dropped (entries in slot order), and a grade; scenes without a hit too."""

    def names(keep):
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct("slot", "entry_id"))))
        return F.array_join(F.transform(rows, lambda r: r["entry_id"].cast("string")), ",")

    rows = scenes.select("label").join(allocated, "label", "left").groupBy("label")
    out = rows.agg(F.count("entry_id").alias("hits"), names(F.col("loaded")).alias("loaded"), names(~F.col("loaded")).alias("dropped"))
    return out.withColumn("grade", F.when(F.length("dropped") > 0, "WARN").otherwise("PASS"))


def load_rates(entries: DataFrame, allocated: DataFrame, scenes: int) -> DataFrame:
    """entry_id, rank, matched, loads, rate and class of every entry, of ``scenes`` scenes in all."""
    used = allocated.groupBy("entry_id").agg(F.count("*").alias("matched"), F.count_if("loaded").alias("loads"))
    rows = entries.select("entry_id", "rank").join(used, "entry_id", "left").fillna(0, ["matched", "loads"])
    rows = rows.withColumn("rate", F.col("matched") / F.lit(float(max(scenes, 1))))
    kind = F.when(F.col("matched") == 0, "untested").when(F.col("loads") == 0, "all dropped").when(F.col("loads") < F.col("matched"), "partly dropped").otherwise("ok")
    return rows.withColumn("class", kind)


def always_on(rates: DataFrame, entries: int, threshold: float = ALWAYS, bottom: float = BOTTOM) -> DataFrame:
    """Entries that nearly every scene calls up; INFO at the bottom of the order, FAIL above it."""
    rows = rates.filter(F.col("rate") >= threshold)
    return rows.withColumn("verdict", F.when(F.col("rank") < entries * (1 - bottom), "FAIL").otherwise("INFO"))


def always_on_count(flagged: DataFrame) -> DataFrame:
    """One row: how many entries nearly every scene calls up, and FAIL from ``MOST_ALWAYS`` on, as they fill the slots."""
    return flagged.agg(F.count("*").alias("n")).withColumn("verdict", F.when(F.col("n") >= MOST_ALWAYS, "FAIL").otherwise("PASS"))
