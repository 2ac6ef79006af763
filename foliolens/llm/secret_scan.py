"""Incremental secret scan over content-addressed versions.

Every text version is addressed by its SHA-256.  A store holds a ledger of the (blob, rule, version) pairs that
were scanned, and their findings.  ``update`` scans only pairs that the ledger lacks, each distinct text once, and
appends to both; ``stored`` gives the findings of the current rules, and ``by_path`` joins them to every path
that carries the blob, in whichever run it was scanned.  A new rule or a higher version makes only that rule run
again.  Findings are appended before the pairs, so a run lost in between is simply repeated: reading drops the
copies.

Spans are code points from 0, end exclusive.  ``split`` and ``regexp_extract_all`` give the texts between
and of the matches; running sums of their lengths give the places.  Only DataFrame functions are used.

Defined cases: a null text is the empty text (no spans, the digest of the empty string); repeated rows share
a blob and get a row each; null ids pass through; a long text is scanned whole; only doc_id and text are read,
``redact`` passes all other columns through whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.llm.common import cut, exists

LEDGER = "blob string, kind string, version int"
SPANS = "blob string, kind_no int, kind string, version int, start bigint, end bigint, base boolean"


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: The least length of ``group``; shorter matches are consumed and dropped.
    least: int
    group: int = 0
    base: bool = False


RULES = (
    Rule("assign", 1, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", 1, r"[0-9a-f]{16,}", 16, 0, True),  # the runs of [0-9a-f]+ with 16 or more
    Rule("forge", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", 40),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)


def versions(docs: DataFrame) -> DataFrame:
    """doc_id and blob of every row."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))


def _pieces(i: int, rule: Rule) -> Column:
    """For rule i: each match with the length of the text since the match before."""

    def piece(x, n):
        part = F.regexp_extract(x["hit"], rule.pattern, rule.group) if rule.group else x["hit"]
        return F.struct(
            F.lit(i).alias("kind_no"), n.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(part).alias("part")
        )

    both = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), F.col(f"m{i}").alias("hit"))
    none = F.array().cast("array<struct<kind_no:int,nth:int,gap:int,hit:int,part:int>>")
    return F.when(F.size(f"m{i}") > 0, F.transform(both, piece)).otherwise(none)


#: New blobs (a hash and the rules that it lacks, some 300 bytes) up to which they are broadcast to find their texts.
BROADCAST_BLOBS = 50_000



def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Spans of the blob and rule-version pairs that ``ledger`` (blob, kind, version) lacks.

    Returns blob, kind_no (the rule's place in ``rules``), kind, version, start, end, base.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    have = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    if ledger is None:
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", have)
    else:  # hashes meet the ledger first, so that texts which it has are not shuffled
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
        todo = texts.select("blob").distinct().join(done, "blob", "left").select("blob", F.array_except(have, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
        todo = cut(todo.filter(F.size("todo") > 0))
        few = todo.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS
        blobs = texts.join(F.broadcast(todo) if few else todo, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    for i, r in enumerate(rules):
        blobs = blobs.withColumn(f"m{i}", F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))))
    found = blobs.filter(" or ".join(f"size(m{i}) > 0" for i in range(len(rules))))
    found = found.withColumn("match", F.explode(F.concat(*[_pieces(i, r) for i, r in enumerate(rules)])))
    w = Window.partitionBy("blob", "kind_no").orderBy("nth")
    spans = found.select("blob", "match.*").filter("hit is not null")  # the gap after the last match has none
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    table = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.lit(r.base).alias("base")) for r in rules])
    spans = spans.withColumn("rule", F.element_at(table, F.col("kind_no") + 1)).filter("part >= rule.least")
    return spans.select("blob", "kind_no", "rule.kind", "rule.version", (F.col("end") - F.col("hit")).alias("start"), "end", "rule.base")


def pairs_of(docs: DataFrame, rules=RULES) -> DataFrame:
    """blob, kind and version of every distinct text and rule."""
    table = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return versions(docs).select("blob").distinct().select("blob", F.explode(table).alias("r")).select("blob", "r.*")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The ledger and the findings stored under ``path``; both empty where there is none."""
    out = []
    for name, schema in (("ledger", LEDGER), ("findings", SPANS)):
        at = f"{path}/{name}"
        out.append(spark.read.schema(schema).parquet(at) if exists(spark, at) else spark.createDataFrame([], schema))
    return out[0], out[1]


def update(docs: DataFrame, path: str, rules=RULES) -> None:
    """One run: scans what the ledger under ``path`` lacks and appends the findings and then the pairs."""
    ledger, _ = read_store(docs.sparkSession, path)
    known = ledger if exists(docs.sparkSession, f"{path}/ledger") else None
    scan(docs, known, rules).write.mode("append").parquet(f"{path}/findings")
    pairs = pairs_of(docs, rules)
    new = pairs if known is None else pairs.join(ledger, ["blob", "kind", "version"], "left_anti")
    new.write.mode("append").parquet(f"{path}/ledger")


def stored(spark: SparkSession, path: str, rules=RULES) -> DataFrame:
    """The stored findings of the given rules in their versions, numbered as in ``rules``."""
    _, findings = read_store(spark, path)
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    rows = findings.withColumn("kind_no", F.try_element_at(number, F.concat_ws(":", "kind", "version"))).filter("kind_no is not null")
    return rows.distinct()


def findings_by_blob(spans: DataFrame) -> DataFrame:
    """blob and its spans by start, then kind as listed."""
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind", "base"))).alias("found"))


def by_path(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and ``found`` (array of spans, empty where there are none) of every row."""
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string,base:boolean>>")
    found = cut(findings_by_blob(spans))  # cut, so that a blob with very many paths can be split in the join
    return versions(docs).join(found, "blob", "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by ``mark`` and n_chars set to the new length.

    Texts are cut in UTF-32, where a place is found without walking there, so many spans in a long text cost little.
    """
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.select("blob", "start", "end", F.coalesce(F.max("end").over(before), F.lit(0)).alias("upto"))
    gaps = gaps.groupBy(F.col("blob").alias("__blob")).agg(
        F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("upto"), F.struct("start", "upto")))).alias("__gaps"), F.max("end").alias("__last")
    )

    def piece(at: Column, size: Column) -> Column:
        return F.decode(F.substring(F.col("__wide"), (at * 4 + 1).cast("int"), (size * 4).cast("int")), "UTF-32")

    pieces = F.transform("__gaps", lambda g: F.concat(piece(g["upto"], g["start"] - g["upto"]), F.lit(mark)))
    whole = F.concat(F.array_join(pieces, ""), piece(F.col("__last"), F.octet_length("__wide") / 4 - F.col("__last")))
    keyed = docs.withColumn("__blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    out = keyed.join(cut(gaps), "__blob", "left").withColumn("__wide", F.when(F.col("__gaps").isNotNull(), F.encode("text", "UTF-32")))
    out = out.withColumn("text", F.when(F.col("__gaps").isNotNull(), whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gaps").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
