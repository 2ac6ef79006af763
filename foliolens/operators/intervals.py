"""Which of many ranges holds a value: an interval join by equality.

A range of integers, both ends included, falls into at most two dyadic cells a level (cell c of level l holds the numbers
from c * 2**l to the next cell's).  A value is in one cell of each level, so values meet ranges by (level, cell), and what
meets also fits; nothing is compared with every range, and the join can be broadcast or shuffled as any other.

Of several ranges the one that comes first by ``order`` counts.  Each distinct value is looked up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of cells; a range reaches from -2**62 to 2**62 at most.
LEVELS = 62


def cells(ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """``ranges`` with __level and __cell, a row for each cell of a range; empty ranges and null ends have none."""
    ends = [F.greatest(F.least(F.col(c).cast("long"), F.lit(1 << LEVELS)), F.lit(-(1 << LEVELS))) for c in (lo, hi)]
    rows = ranges.withColumn("__lo", ends[0]).withColumn("__hi", ends[1]).filter("__lo <= __hi")

    def at(level):
        first, last = -F.call_function("shiftright", -F.col("__lo"), level), F.call_function("shiftright", F.col("__hi") + 1, level) - 1
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        left = F.when((first <= last) & odd(first), F.struct(level.alias("level"), first.alias("cell")))
        right = F.when((first <= last) & ~odd(last), F.struct(level.alias("level"), last.alias("cell")))
        return F.array_compact(F.array(left, right))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))
    return rows.withColumn("__c", F.explode(found)).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c", "__lo", "__hi")


def located(rows: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, order: str, take: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``take`` of the first range by ``order`` that holds the (integer) value, else null."""
    parts = cells(ranges, lo, hi).select("__level", "__cell", F.struct(F.col(order).alias("o"), F.col(take).alias("t")).alias("__r"))
    levels = sorted(r[0] for r in parts.select("__level").distinct().collect())  # LEVELS + 1 at most
    asked = rows.select(F.col(value).cast("long").alias("__v")).filter("__v is not null").distinct()
    each = F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright("__v", n).alias("cell")) for n in levels)) if levels else F.array().cast("array<struct<level:int,cell:long>>")
    met = asked.select("__v", F.explode(each).alias("c")).select("__v", F.col("c.level").alias("__level"), F.col("c.cell").alias("__cell")).join(parts, ["__level", "__cell"])
    first = met.groupBy("__v").agg(F.min("__r").alias("__r"))
    return rows.join(first, F.col(value).cast("long") == F.col("__v"), "left").withColumn(name, F.col("__r.t")).drop("__v", "__r")
