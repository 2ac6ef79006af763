"""Audits over ordered records, rosters, inventories and snapshots; each returns rows, none prints or fails.

All limits are parameters with their defaults here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.functions.text import characters, headings, leading_tags, match_key, measured, megabytes, stable_ids, symbol_class, trimmed
from foliolens.operators.contains import contained_nowhere
from foliolens.operators.segments import entry_blocks

# Hard limits and targets of measured lengths.
PROMPT, PROMPT_TARGET = 7000, 6500
OPENING, OPENING_TARGET = 1000, 900
ENTRY, ENTRY_TARGET = 400, 360
MOST_KEYWORDS = 5
HEAVY_MB, HUGE_MB = 2, 20

# Phrases that the unrestricted variant must not hold.
BANNED = ("정책 무시", "정책 우회", "필터 우회", "검열 해제", "안전장치 해제", "무조건 수행", "unfiltered", "bypass safety", "ignore policy")

# Folders of the axes that have one.
AXIS_FOLDERS = {"scenes": "scene", "backgrounds": "bg", "monsters": "mob"}

# What a project holds.
SOURCES = ("story.md", "characters.md")
BUILD = "build"
ARTIFACTS = ("prologue.md", "start-prompt.md", "integrated-prompt-safe.md", "integrated-prompt-unsafe.md", "keyword-book.md")
DERIVED_DIR = "assets"
DERIVED = ("image-prompts.md", "prompts.json", "summary-comment.md", "build-stamp.json")

# The forms of slugs and of the ways to explain a symbol.
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
EQUALS = r"(\S)\s*="
CODE_SPAN = r"`([^`\n]{1,40})`"
TERM = r"([^\s=]{1,8})=([^.\n]{1,60})"
SCALE = r"(\S)[가-힣]{2,}"


def grade(size: Column, target: int = PROMPT_TARGET, limit: int = PROMPT) -> Column:
    """FAIL above the limit, WARN above the target, else PASS."""
    if not 0 < target <= limit:
        raise ValueError("0 < target <= limit is asked for")
    return F.when(size > limit, "FAIL").when(size > target, "WARN").otherwise("PASS")


# --- entries ---------------------------------------------------------------------------------------------


def entry_flags(entries: DataFrame) -> DataFrame:
    """Adds, for each entry, what is wrong with its fields, keywords and body."""
    missing = lambda c: (F.coalesce(F.col(c), F.lit("")) == "") | F.col(c).startswith("[")
    folded = F.array_distinct(F.transform("keywords", F.lower))
    return entries.select(
        "*", missing("activation_setting").alias("setting_missing"), missing("activation_when").alias("when_missing"),
        (~F.size("keywords").between(1, MOST_KEYWORDS)).alias("keyword_count_bad"), (F.size(folded) != F.size("keywords")).alias("keyword_repeated"),
        grade(measured(F.col("body")), ENTRY_TARGET, ENTRY).alias("body_grade"),
    )


def empty_registry(text: Column) -> Column:
    """Whether a text declares that it has no entries."""
    return text.rlike(r"(?md)^- entries:[^\S\n]*\[\][^\S\n]*$")


def keyword_rows(entries: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the distinct non-empty match keys of each entry's keywords."""
    return entries.select(*keep, F.explode(F.array_distinct(F.transform("keywords", match_key))).alias("k")).filter("k <> ''")


def collisions(entries: DataFrame, entry: str = "entry_id") -> DataFrame:
    """Keywords that several entries share: k, n, owners."""
    rows = keyword_rows(entries, [entry]).groupBy("k").agg(F.countDistinct(entry).alias("n"), F.array_sort(F.collect_set(F.col(entry).cast("string"))).alias("owners"))
    return rows.filter("n > 1")


def previous_owner(entries: DataFrame, entry: str = "entry_id", order: str = "rank") -> DataFrame:
    """k, entry and the entry before it with the same keyword, if another."""
    before = F.lag(entry).over(Window.partitionBy("k").orderBy(order))
    rows = keyword_rows(entries, list(dict.fromkeys([entry, order])))
    return rows.withColumn("previous", before).filter(F.col("previous") != F.col(entry)).select("k", entry, "previous")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and how often; nulls are no key."""
    counts = rows.dropna(subset=list(key)).groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(F.count("*").alias("__count"))
    return counts.filter("__count > 1").toDF(*key, "n")


def repeats_after_first(rows: DataFrame, order: str, *key: str) -> DataFrame:
    """The rows of a key after its first in order; nulls are no key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.dropna(subset=list(key)).withColumn("__nth", nth).filter("__nth > 1").drop("__nth")


def empty_tags(rows: DataFrame, tags: str = "tags", separator: str = ",") -> DataFrame:
    """Rows whose tags hold nothing but separators and blanks."""
    return rows.filter(leading_tags(F.coalesce(F.col(tags), F.lit("")), separator) == "")


def banned(docs: DataFrame, keep: list[str], phrases: tuple[str, ...] = BANNED, text: str = "text", variant: str | None = None, only: str = "unsafe") -> DataFrame:
    """keep and phrase of every listed phrase that a text holds in whatever case; with ``variant`` only where that column is ``only``."""
    found = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(F.col(text)), F.lower(p)))
    rows = docs.filter(F.col(variant) == only) if variant else docs
    return rows.select(*keep, F.explode(found).alias("phrase"))


def both_filled(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Adds ``filled``: whether both columns hold more than white space."""
    return rows.withColumn("filled", (trimmed(F.coalesce(left, F.lit(""))) != "") & (trimmed(F.coalesce(right, F.lit(""))) != ""))


# --- set comparison ----------------------------------------------------------------------------------------


def drift(left: Column, right: Column) -> tuple[Column, Column]:
    """What only the left array has and what only the right has."""
    return F.array_except(left, right), F.array_except(right, left)


def drift_report(rows: DataFrame, keep: list[str], left: str, right: str) -> DataFrame:
    """keep, only_left, only_right, equal, and any (whether either side has something to compare)."""
    a, b = drift(F.col(left), F.col(right))
    return rows.select(*keep, F.array_sort(a).alias("only_left"), F.array_sort(b).alias("only_right"), ((F.size(a) == 0) & (F.size(b) == 0)).alias("equal"), ((F.size(left) > 0) | (F.size(right) > 0)).alias("any"))


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key and side (left or right)."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer").filter("l is null or r is null")
    return both.select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def against_expected(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """missing and unknown keys; hidden names (those that start with a dot) do not count."""
    shown = found.filter(~F.col(key).startswith("."))
    return parity(expected, shown, key).select(key, F.when(F.col("side") == "left", "missing").otherwise("unknown").alias("status"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], digest: str = "digest") -> DataFrame:
    """keys and status: added, removed, changed or same."""
    a, b = old.select(*keys, F.col(digest).alias("__old")), new.select(*keys, F.col(digest).alias("__new"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def snapshot_counts(diff: DataFrame, *keys: str) -> DataFrame:
    """keys (a file, say) and how many of its sections were added, removed, changed or are the same."""
    return diff.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "same")])


def route(title: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The target of the first rule whose pattern is in the lower-cased title."""
    out = F.lit(default)
    for pattern, target in reversed(rules):
        out = F.when(F.lower(title).rlike(pattern), target).otherwise(out)
    return out


# --- symbols -------------------------------------------------------------------------------------------------


def symbol_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with symbol, kind, n (occurrences) and first_pos (from 1) of every classified character;
    columns of ``docs`` with these names are replaced.

    Characters are classified before they become rows, so a text without symbols makes none.
    """
    marked = F.filter(F.transform(characters(F.col(text)), lambda c: F.struct(c.alias("symbol"), symbol_class(c).alias("kind"))), lambda x: x["kind"].isNotNull())
    rows = docs.withColumn("__s", F.explode(marked))
    n = F.length(text) - F.length(F.replace(F.col(text), F.col("__s.symbol"), F.lit("")))
    first = F.instr(F.col(text), F.col("__s.symbol"))
    kept = [c for c in docs.columns if c not in ("symbol", "kind", "n", "first_pos")]
    return rows.select(*kept, F.col("__s.symbol"), F.col("__s.kind"), n.cast("long").alias("n"), first.alias("first_pos"))


def symbol_use(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, symbol, kind, n and first_pos of every classified character."""
    return symbol_rows(docs.select(*keep, F.col(text).alias("__t")), "__t").drop("__t")


def glossed(text: Column, symbol: Column, kind: Column) -> Column:
    """Whether a text explains a symbol: ``symbol =``, an inline code span, the right side of a short term, or an emoji scale."""
    equals = F.exists(F.regexp_extract_all(text, F.lit(EQUALS), F.lit(1)), lambda s: s == symbol)
    spans = F.exists(F.regexp_extract_all(text, F.lit(CODE_SPAN), F.lit(1)), lambda s: F.contains(s, symbol))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(TERM), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(TERM), F.lit(2)).alias("r"))
    listed = F.exists(both, lambda x: F.contains(x["r"], symbol) & ~F.contains(x["t"], symbol))

    def scale(line):
        named = F.filter(F.regexp_extract_all(line, F.lit(SCALE), F.lit(1)), lambda c: symbol_class(c) == "emoji")
        return (F.size(named) >= 3) & F.array_contains(named, symbol)

    return equals | spans | listed | ((kind == "emoji") & F.exists(F.split(text, "\n"), scale))


def legend_of(text: Column, heading: str) -> Column:
    """The section under an exact heading, up to the next of level 1 or 2."""
    return F.regexp_extract(text, rf"(?mds)^\Q{heading}\E[^\S\n]*$\n?(.*?)(?=^#{{1,2}} |\z)", 1)


def undefined_symbols(docs: DataFrame, keep: list[str], legend: str = "legend", text: str = "text") -> DataFrame:
    """Used symbols that neither the legend holds nor the text explains."""
    use = symbol_rows(docs.select(*keep, F.col(text).alias("__t"), F.coalesce(legend, F.lit("")).alias("__l")), "__t")
    return use.filter(~F.contains(F.col("__l"), F.col("symbol")) & ~glossed(F.col("__t"), F.col("symbol"), F.col("kind"))).drop("__t", "__l")


def legend_symbols(docs: DataFrame, keep: list[str], legend: str = "legend", text: str = "text") -> DataFrame:
    """keep, symbol, kind and status of every symbol of a legend that is part of its text: ``before`` where the text uses
    it ahead of the legend, ``unused`` where nothing but the legend has it, else ``ok``."""
    rows = docs.filter(F.col(legend) != "").select(*keep, F.col(text).alias("__t"), F.col(legend).alias("__l"))
    use = symbol_rows(rows, "__l").drop("n", "first_pos")
    at, first = F.instr(F.col("__t"), F.col("__l")), F.instr(F.col("__t"), F.col("symbol"))
    body = F.concat(F.substring(F.col("__t"), F.lit(1), at - 1), F.substring(F.col("__t"), at + F.length("__l"), F.length("__t")))
    status = F.when(first < at, "before").when(~F.contains(body, F.col("symbol")), "unused").otherwise("ok")
    return use.withColumn("status", status).drop("__t", "__l")


def legend_counts(marked: DataFrame, keep: list[str]) -> DataFrame:
    """keep, symbols, unused, before and a verdict of each legend of ``legend_symbols``."""
    counts = [F.count("*").alias("symbols"), F.count_if(F.col("status") == "unused").alias("unused"), F.count_if(F.col("status") == "before").alias("before")]
    return marked.groupBy(*keep).agg(*counts).withColumn("verdict", F.when(F.col("before") > 0, "FAIL").when(F.col("unused") > 0, "WARN").otherwise("PASS"))


# --- inventories -------------------------------------------------------------------------------------------------


def asset_paths(axes: DataFrame) -> DataFrame:
    """axis and rel_path of every asset: people by situations, and one a slug of the folder axes."""
    people = axes.filter("axis = 'characters'").select(F.col("slug").alias("p"))
    moods = axes.filter("axis = 'situations'").agg(F.collect_list("slug")).scalar()  # a short closed list
    combos = people.select("p", F.explode(moods).alias("m")).select(F.lit("characters").alias("axis"), F.concat_ws("/", "p", F.concat("m", F.lit(".png"))).alias("rel_path"))
    folder = F.create_map(*[F.lit(x) for pair in AXIS_FOLDERS.items() for x in pair])[F.col("axis")]
    fixed = axes.filter(F.col("axis").isin(*AXIS_FOLDERS)).select("axis", F.concat(folder, F.lit("/"), "slug", F.lit(".png")).alias("rel_path"))
    return combos.unionByName(fixed)


def coverage(expected: DataFrame, found: DataFrame, key: str, axis: str) -> DataFrame:
    """axis, have, total."""
    marked = expected.join(found.select(key).distinct().withColumn("__have", F.lit(1)), key, "left")
    return marked.groupBy(axis).agg(F.count("__have").alias("have"), F.count("*").alias("total"))


def size_band(mb: Column) -> Column:
    return F.when(mb > HUGE_MB, "huge").when(mb > HEAVY_MB, "heavy").otherwise("ok")


def first_of(rows: DataFrame, order: str, count: int, within: str | None = None) -> DataFrame:
    """The first rows in order (of each ``within``), with how many more there are: a report's list and its "and n more"."""
    keys = [within] if within else []
    total = rows.groupBy(*keys).agg(F.count("*").alias("__total"))
    if within:
        first = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(within).orderBy(order))).filter(F.col("__nth") <= count)
        both = first.join(total, within).drop("__nth")
    else:
        both = rows.orderBy(order).limit(count).withColumn("__total", total.scalar())
    return both.withColumn("more", F.greatest(F.col("__total") - count, F.lit(0))).drop("__total")


def first_list(rows: DataFrame, key: str, count: int = 6, separator: str = ", ") -> DataFrame:
    """One row: the first keys in order, joined, with an ellipsis if there are more."""
    some = rows.select(key).distinct().orderBy(key).limit(count + 1).agg(F.array_sort(F.collect_list(key)).alias("__k"))  # count + 1 at most
    return some.select(F.concat(F.array_join(F.slice("__k", 1, count), separator), F.when(F.size("__k") > count, " …").otherwise("")).alias("listed"))


def totals(axes: DataFrame) -> DataFrame:
    """people, combos (people by situations) and fixed (one a slug of the folder axes) of a project's images."""
    n = lambda *names: F.count_if(F.col("axis").isin(*names))
    return axes.agg(n("characters").alias("people"), (n("characters") * n("situations")).alias("combos"), n(*AXIS_FOLDERS).alias("fixed"))


def unreachable(axes: DataFrame, published: DataFrame, text: str = "text") -> DataFrame:
    """axis, slug and severity of slugs that no published text holds: FAIL for situations and scenes, INFO for people.

    Without any published text nothing is asked, so nothing is returned.
    """
    asked = axes.filter(F.col("axis").isin("situations", "scenes", "characters")).select("axis", "slug")
    there = published.filter(F.col(text) != "").limit(1).select(F.lit(True).alias("__any"))
    gone = contained_nowhere(asked, published, "slug", text).join(F.broadcast(there))
    return gone.select("axis", "slug", F.when(F.col("axis") == "characters", "INFO").otherwise("FAIL").alias("severity"))


def inventory(expected: DataFrame, files: DataFrame, key: str = "rel_path", axis: str = "axis", size: str = "bytes") -> DataFrame:
    """Findings on image files: FAIL for unknown or huge ones and for none at all, INFO for heavy and missing ones."""
    unknown = files.join(expected, key, "left_anti")
    known = files.join(expected.select(key), key, "left_semi").withColumn("band", size_band(megabytes(F.col(size))))
    missing = expected.join(files, key, "left_anti")
    none = files.agg(F.count("*").alias("n")).filter("n = 0").withColumn("subject", F.lit("(none)"))
    parts = [
        finding(unknown, "unknown", "FAIL", key), finding(known.filter("band = 'huge'"), "huge", "FAIL", key), finding(none, "none found", "FAIL", "subject"),
        finding(known.filter("band = 'heavy'"), "heavy", "INFO", key), finding(missing, "missing", "INFO", key, F.col(axis)),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- projects ----------------------------------------------------------------------------------------------------


def project_layout(entries: DataFrame, allow_unbuilt: bool = False) -> DataFrame:
    """Findings on the top level of projects (project, name, is_dir): sources that are missing or no file, anything else
    that does not belong there, a build that is missing (unless allowed) or no folder.  Hidden names do not count."""
    shown = entries.filter(~F.col("name").startswith("."))
    projects = entries.select("project").distinct()
    sources = projects.select("project", F.explode(F.array(*map(F.lit, SOURCES))).alias("name"))
    missing = sources.join(shown.filter(~F.col("is_dir")).select("project", "name"), ["project", "name"], "left_anti")
    extra = shown.filter(~F.col("name").isin(*SOURCES, BUILD)).select("project", "name")
    built = shown.filter(F.col("name") == BUILD).select("project", "is_dir")
    state = projects.join(built, "project", "left").filter("is_dir is null or not is_dir" if not allow_unbuilt else "not is_dir")
    no_build = state.select("project", F.lit(BUILD).alias("name"), F.when(F.col("is_dir").isNull(), "build missing").otherwise("build is no folder").alias("check"))
    parts = [missing.withColumn("check", F.lit("source missing")), extra.withColumn("check", F.lit("unexpected")), no_build]
    return reduce(DataFrame.unionByName, parts).select("project", "check", F.lit("FAIL").alias("severity"), F.col("name").alias("subject"))


def expected_files(found: DataFrame, names: tuple[str, ...], group: str = "project", key: str = "name") -> DataFrame:
    """group, key and status (missing or unknown) of every group's files against a fixed list of names."""
    shown = found.filter(~F.col(key).startswith(".")).select(group, key).distinct()
    wanted = found.select(group).distinct().select(group, F.explode(F.array(*map(F.lit, names))).alias(key))
    missing = wanted.join(shown, [group, key], "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(shown.filter(~F.col(key).isin(*names)).withColumn("status", F.lit("unknown")))


def build_audit(projects: DataFrame) -> DataFrame:
    """All findings on the build files of projects (project, name, is_dir, text): one call over everything.

    Missing, unknown and misplaced files; lengths of prompts, prologue and start prompt; both variants filled, with the
    same headings and the same stable ids (where either has any); banned phrases in the unrestricted one; the
    keyword registry's empty fields, counts, repeats and bodies.  Columns: project, check, severity, subject.
    """
    kept = ["project", "name"]
    files = projects.filter(~F.col("is_dir"))
    odd = expected_files(files, ARTIFACTS).select("project", F.col("status").alias("check"), F.lit("FAIL").alias("severity"), F.col("name").alias("subject"))
    folders = projects.filter(F.col("is_dir") & (F.col("name") != DERIVED_DIR) & ~F.col("name").startswith("."))
    odd = odd.unionByName(folders.select("project", F.lit("unknown folder").alias("check"), F.lit("FAIL").alias("severity"), F.col("name").alias("subject")))
    prompt = F.col("name").startswith("integrated-prompt-")
    size = measured(F.col("text"))
    graded = F.when(prompt, grade(size)).otherwise(grade(size, OPENING_TARGET, OPENING))
    lengths = files.filter(prompt | F.col("name").isin("prologue.md", "start-prompt.md")).select("project", F.lit("length").alias("check"), graded.alias("severity"), F.col("name").alias("subject"))
    pick = lambda variant: F.max(F.when(F.col("name") == f"integrated-prompt-{variant}.md", F.col("text")))
    pairs = both_filled(files.groupBy("project").agg(pick("safe").alias("safe"), pick("unsafe").alias("unsafe")).dropna(), "safe", "unsafe")
    differs = lambda f, only_any: drift_report(pairs.select("project", f(F.col("safe")).alias("l"), f(F.col("unsafe")).alias("r")), ["project"], "l", "r").filter("any" if only_any else "true")
    same = lambda rows, check: rows.select("project", F.lit(check).alias("check"), F.when(F.col("equal"), "PASS").otherwise("FAIL").alias("severity"), F.array_join(F.concat("only_left", "only_right"), ", ").alias("subject"))
    empty = pairs.filter("not filled").select("project", F.lit("empty variant").alias("check"), F.lit("FAIL").alias("severity"), F.lit("").alias("subject"))
    phrases = banned(files.withColumn("variant", F.when(F.col("name") == "integrated-prompt-unsafe.md", "unsafe")), kept, variant="variant")
    phrases = phrases.select("project", F.lit("banned phrase").alias("check"), F.lit("FAIL").alias("severity"), F.col("phrase").alias("subject"))
    book = entry_flags(entry_blocks(files.filter("name = 'keyword-book.md'"), ["project"]))
    fail = lambda rows, check, subject="entry_id": rows.select("project", F.lit(check).alias("check"), F.lit("FAIL").alias("severity"), F.col(subject).alias("subject"))
    bodies = book.select("project", F.lit("entry length").alias("check"), F.col("body_grade").alias("severity"), F.col("entry_id").alias("subject"))
    book_checks = [fail(book.filter(c), c) for c in ("setting_missing", "when_missing", "keyword_count_bad", "keyword_repeated")]
    book_checks += [fail(repeated(book, "project", "entry_id"), "entry repeated"), fail(collisions_within(book, "project"), "keyword shared", "k")]
    parts = [odd, lengths, empty, same(differs(headings, False), "headings"), same(differs(stable_ids, True), "stable ids"), phrases, bodies, *book_checks]
    return reduce(DataFrame.unionByName, parts)


def collisions_within(entries: DataFrame, group: str, entry: str = "entry_id") -> DataFrame:
    """Keywords that several entries of one group share: group, k, n."""
    return keyword_rows(entries, [group, entry]).groupBy(group, "k").agg(F.countDistinct(entry).alias("n")).filter("n > 1")


# --- findings ----------------------------------------------------------------------------------------------------


def finding(rows: DataFrame, check: str, severity: str | Column, subject: str, detail: str | Column = "") -> DataFrame:
    """Rows of a report: check, severity, subject, detail."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.lit(check).alias("check"), as_column(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), as_column(detail).alias("detail"))


def verdicts(findings: list[DataFrame] | DataFrame, by: list[str] | None = None) -> DataFrame:
    """check, ok (no FAIL), n, fails, warns and infos of every check, from counts alone; who failed are the rows of ``offenders``."""
    rows = findings if isinstance(findings, DataFrame) else reduce(DataFrame.unionByName, findings)
    n = lambda s: F.count_if(F.col("severity") == s)
    return rows.groupBy(*(by or ["check"])).agg((n("FAIL") == 0).alias("ok"), F.count("*").alias("n"), n("FAIL").alias("fails"), n("WARN").alias("warns"), n("INFO").alias("infos"))


def overall(findings: list[DataFrame] | DataFrame, by: list[str] | None = None) -> DataFrame:
    """ok and counts over all checks: the run's own verdict (one row, or one each of ``by``)."""
    rows = verdicts(findings, [*(by or []), "check"])
    return rows.groupBy(*(by or [])).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.count("*").alias("checks"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fails", "warns", "infos")])


def offenders(findings: list[DataFrame] | DataFrame, count: int = 20) -> DataFrame:
    """check, subject and more: the first failing subjects of each check, and how many further ones there are."""
    rows = findings if isinstance(findings, DataFrame) else reduce(DataFrame.unionByName, findings)
    return first_of(rows.filter("severity = 'FAIL'").select("check", "subject").distinct(), "subject", count, "check")
