"""Event rules: what fires when flags hold, what it sets, and what that lets fire next, until nothing does.

An entity (a story, a user) has flags.  A rule fires for it when all of its triggers are set, none of its blockers is, it is
enabled and its repeat policy allows it; of the rules that could, the one of the highest priority fires (of equals the
lowest id), one an entity and round.  What it sets and clears counts from the next round on, and so does which rules it
enables or disables.

The fixpoint is semi-naive: a rule's standing with an entity (how many of its triggers and blockers are set) is kept, and
each round only flags that changed in the last one meet the rules' conditions, by equality.  Entities for which nothing
fired are done and leave.  Every round ends in the shared folder, so lineage stays short; rounds are limited.

Defined cases: a rule without a trigger never fires; conditions, effects and flags given twice count once; null ids and
flags are left out; clearing a flag that is not set, or setting one that is, changes nothing; an event that both sets and
clears a flag sets it, and one that both enables and disables a rule enables it; a rule may block or disable itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.sources.shared import cut

# Names of priorities, the highest first, and of repeat policies.
PRIORITIES = ("critical", "high", "normal", "ambient")
ONCE, ONCE_PER_ARC, REPEATABLE = "once", "once-per-arc", "repeatable"

_STANDING = {"met": "long", "blocked": "long", "used_in": "long", "fresh": "int", "enabled": "int"}


def fired(
    flags: DataFrame, rules: DataFrame, triggers: DataFrame, blockers: DataFrame, effects: DataFrame, follow_ups: DataFrame, most_rounds: int = 100
) -> DataFrame:
    """entity, round (from 1) and rule_id of every event.

    ``flags``: entity, flag.  ``rules``: rule_id, priority, repeat, enabled (at the start), new_arc (whether it begins the
    entity's next arc; it counts as fired in that).  ``triggers`` and ``blockers``: rule_id, flag.  ``effects``: rule_id,
    flag, sets.  ``follow_ups``: rule_id, other_id, enables.  A repeatable rule fires again only after one of the flags
    it asks about has changed, or it was enabled, since it last fired.  Events that do not end within ``most_rounds``
    are an error.
    """
    spark = flags.sparkSession
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(0)), F.lit(len(PRIORITIES) + 1))
    needs = triggers.dropna().distinct().groupBy("rule_id").agg(F.count("*").alias("needs"))
    rules = rules.select("rule_id", rank.alias("rank"), "repeat", F.col("enabled").cast("int").alias("at_start"), "new_arc").join(needs, "rule_id")
    asked = triggers.dropna().distinct().select("rule_id", "flag", F.lit(1).alias("t"), F.lit(0).alias("b"))
    asked = asked.unionByName(blockers.dropna().distinct().select("rule_id", "flag", F.lit(0).alias("t"), F.lit(1).alias("b")))
    does = effects.dropna().groupBy("rule_id", "flag").agg(F.max(F.col("sets").cast("int")).alias("sets"))
    turns = follow_ups.dropna().groupBy("rule_id", F.col("other_id")).agg(F.max(F.col("enables").cast("int")).alias("enables"))

    flags = cut(flags.select("entity", "flag").dropna().distinct())
    kind = flags.schema["entity"].dataType
    rule_kind = rules.schema["rule_id"].dataType
    changed = flags.withColumn("by", F.lit(1))
    standing, arcs, last, out = None, None, None, []
    for nth in range(1, most_rounds + 2):
        standing = cut(_standing(standing, changed, asked, last, turns, rules, arcs))
        could = standing.join(rules, "rule_id").filter(_may_fire(arcs))
        now = could.groupBy("entity").agg(F.min(F.struct("rank", "rule_id")).alias("first")).select("entity", F.col("first.rule_id").alias("rule_id"))
        now = cut(now.withColumn("round", F.lit(nth)))
        if now.isEmpty():
            break
        if nth > most_rounds:
            raise RuntimeError(f"events go on after {most_rounds} rounds, as for {now.first()}")
        out.append(now)
        going = now.select("entity")
        begun = now.join(rules.filter("new_arc"), "rule_id").groupBy("entity").agg(F.count("*").alias("arc"))
        arcs = cut((begun if arcs is None else arcs.unionByName(begun)).join(going, "entity", "left_semi").groupBy("entity").agg(F.sum("arc").alias("arc")))
        flags, standing = flags.join(going, "entity", "left_semi"), standing.join(going, "entity", "left_semi")
        wanted = now.join(does, "rule_id").select("entity", "flag", "sets")
        changed = cut(wanted.join(flags.withColumn("had", F.lit(1)), ["entity", "flag"], "left").filter("sets <> coalesce(had, 0)").select("entity", "flag", (F.col("sets") * 2 - 1).alias("by")))
        flags = cut(flags.join(changed.filter("by < 0"), ["entity", "flag"], "left_anti").unionByName(changed.filter("by > 0").select("entity", "flag")))
        last = now
    if not out:
        return spark.createDataFrame([], "x int").select(F.lit(None).cast(kind).alias("entity"), F.lit(None).cast("int").alias("round"), F.lit(None).cast(rule_kind).alias("rule_id")).limit(0)
    done = out[0]
    for now in out[1:]:
        done = done.unionByName(now)
    return done.select("entity", "round", "rule_id")


def _may_fire(arcs: DataFrame | None) -> Column:
    allowed = F.when(F.col("repeat") == REPEATABLE, F.col("fresh") == 1).when(F.col("repeat") == ONCE_PER_ARC, F.coalesce(F.col("used_in") < F.col("arc"), F.lit(True)))
    return (F.col("met") == F.col("needs")) & (F.col("blocked") == 0) & (F.coalesce("enabled", "at_start") == 1) & allowed.otherwise(F.col("used_in").isNull())


def _standing(before, changed: DataFrame, asked: DataFrame, last, turns: DataFrame, rules: DataFrame, arcs) -> DataFrame:
    """entity, rule_id, ``_STANDING`` and arc: what was, with the last events and the flags that they changed."""

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("entity", "rule_id", *((given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in {**_STANDING, "did": "int", "woke": "int", "turned": "int"}.items()))

    met = changed.join(asked, "flag")
    parts = [rows(met, met=F.col("by") * F.col("t"), blocked=F.col("by") * F.col("b"), woke=F.lit(1))]
    if before is not None:
        parts.append(rows(before, **{c: F.col(c) for c in _STANDING}))
        did = last.join(rules.select("rule_id"), "rule_id").join(arcs, "entity", "left")
        parts.append(rows(did, used_in=F.coalesce("arc", F.lit(0)), did=F.lit(1)))
        turned = last.join(turns, "rule_id").select("entity", F.col("other_id").alias("rule_id"), "enables")
        parts.append(rows(turned, turned=F.col("enables"), woke=F.nullif("enables", F.lit(0))))
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    still = F.when(F.max("did").isNull(), F.max("fresh"))
    found = all_.groupBy("entity", "rule_id").agg(
        F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"), F.max("used_in").alias("used_in"),
        F.coalesce(F.max("woke"), still, F.lit(0)).alias("fresh"), F.coalesce(F.max("turned"), F.max("enabled")).alias("enabled"),
    )
    if arcs is None:
        return found.withColumn("arc", F.lit(0).cast("long"))
    return found.join(arcs, "entity", "left").withColumn("arc", F.coalesce("arc", F.lit(0)))
