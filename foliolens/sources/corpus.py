"""Readers and writers: whole texts, label lines, listings, nested JSON and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.functions.text import trimmed, unix_lines, utf16_units

STAMP = "map<string,map<string,string>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, name, text of whole files, with line feeds only."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return raw.select("path", F.substring_index("path", "/", -1).alias("name"), unix_lines(F.col("value")).alias("text"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """label, text of ``label: text`` lines."""
    return parse_scenes(spark.read.text(path).select(F.col("value").alias("line")))


def parse_scenes(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, label and text; blank lines and those from ``#`` on are skipped; without text the label is the text."""
    kept = lines.select(*keep, trimmed(F.col("line")).alias("line")).filter("line <> '' and not startswith(line, '#')")
    parts = F.split("line", ":", 2)
    label, text = trimmed(parts[0]), trimmed(F.try_element_at(parts, F.lit(2)))
    return kept.select(*keep, label.alias("label"), F.coalesce(F.nullif(text, F.lit("")), label).alias("text"))


def inline_scenes(spark: SparkSession, scenes: list[tuple[str, str | None]]) -> DataFrame:
    """label, text of scenes given in place; without a text it is empty."""
    return spark.createDataFrame([(label, text or "") for label, text in scenes], "label string, text string")


def first_source(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of the given paths that is there (an argument, a configured one, a default)."""
    for path in paths:
        if path and _on(spark, path)[0].exists(_on(spark, path)[1]):
            return path
    return None


def _on(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """name, is_dir, bytes of what lies directly in a folder and is not hidden; the listing is one call on the driver."""
    system, at = _on(spark, path)
    found = [(s.getPath().getName(), s.isDirectory(), s.getLen()) for s in system.listStatus(at)]
    return spark.createDataFrame([f for f in found if not f[0].startswith(".")], "name string, is_dir boolean, bytes long")


def read_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """rel_path and bytes of all files below ``path`` that are not hidden; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.rstrip("/").replace("file://", "").replace("file:", "")
    files = files.select(F.regexp_replace("path", r"^.*?" + "\\Q" + root + "\\E/", "").alias("rel_path"), F.col("length").alias("bytes"))
    return files.filter(F.lower("rel_path").endswith(suffix.lower()) & ~F.col("rel_path").rlike(r"(^|/)\."))


def axes(configs: DataFrame, column: str = "text") -> DataFrame:
    """axis, slug, ko, size, tags, seed and attributes (all of a slug's, as JSON) of a JSON document of axes.

    Values are kept as variants, so attributes that nobody named stay.  What an axis or slug lacks, or has in another form (a
    size that is no list of numbers), is null; values beside the axes that are no objects are left out.
    """
    parsed = configs.select(F.explode(F.from_json(column, "map<string,variant>")).alias("axis", "slugs"))
    rows = parsed.lateralJoin(configs.sparkSession.tvf.variant_explode(F.col("slugs").outer())).filter("key is not null")
    named = [F.try_variant_get("value", f"$.{n}", t).alias(n) for n, t in (("ko", "string"), ("size", "array<int>"), ("tags", "string"), ("seed", "bigint"))]
    return rows.select("axis", F.col("key").alias("slug"), *named, F.to_json("value").alias("attributes"))


def stamp(documents: DataFrame, column: str = "text") -> DataFrame:
    """file, title, digest of a stored snapshot."""
    parsed = documents.select(F.explode(F.from_json(column, STAMP)).alias("file", "titles"))
    return parsed.select("file", F.explode("titles").alias("title", "digest"))


def stamps(sections: DataFrame) -> DataFrame:
    """text: a JSON document for each file, which ``stamp`` reads back; a file's sections make one document."""
    titles = F.map_from_entries(F.array_sort(F.collect_list(F.struct("title", "digest"))))
    return sections.groupBy("file").agg(titles.alias("titles")).select(F.to_json(F.create_map("file", "titles")).alias("text"))


def write_stamp(sections: DataFrame, path: str) -> None:
    """Writes ``stamps`` as a folder of text files, a document a line; ``read_stamp`` reads it."""
    stamps(sections).write.mode("overwrite").text(path)


def read_stamp(spark: SparkSession, path: str) -> DataFrame:
    """file, title, digest of a stamp, be it one document over many lines or one a line; none is an empty snapshot."""
    if first_source(spark, path) is None:
        return spark.createDataFrame([], "file string, title string, digest string")
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    lines = whole.select(F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    single = stamp(whole).dropna(subset=["file"])
    return single.unionByName(stamp(lines).dropna(subset=["file"])).distinct()


def write_snapshot(sections: DataFrame, path: str) -> None:
    sections.select("file", "title", "digest").write.mode("overwrite").parquet(path)


def measure_parts(parts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and measured: the length of each key's texts joined by line feeds, from sums alone; nulls are left out."""
    between = F.count(text) - 1
    cp, units = F.sum(F.length(text)) + between, F.sum(utf16_units(F.col(text))) + between
    return parts.groupBy(key).agg(F.greatest(cp, units, F.lit(0)).alias("measured"))
