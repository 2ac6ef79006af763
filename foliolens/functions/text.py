"""Column functions on text: lengths, keys, fields, segments, fingerprints and symbol classes.

Patterns carry ``(?d)`` with ``(?m)`` so that only a line feed ends a line, and white space means the Unicode
class with U+001C to U+001F.  ``lower`` stands for case folding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)[\s\x1c-\x1f]"

# Characters that carry an assigned meaning, and characters that only lay out a page.
OPERATOR_SYMBOLS = "ⓤⓒⓝⓐ→←↑↓⇒≤≥±×÷·|｜/※≠≈"
LAYOUT_SYMBOLS = "━─│┃▸▪▶◆◇○●•…★☆♂♀§¶"

# The prefixes of stable ids.
ID_PREFIXES = ("char", "loc", "faction", "arc", "scene", "event", "goal", "secret", "flag", "state", "ending", "kb")


# The forms of entries, and where published images are served from.
ENTRY_TEXT = r"(?mds)^##[^\S\n]+(?:Entry text|입력 본문)[^\S\n]*$\n?(.*?)(?=^## |\z)"
LISTED_KEYWORDS = r"(?md)^- keywords:\s*(\[.*?\])\s*$"
SERVED = "https://cdn.jsdelivr.net/gh/%s@%s"


def unix_lines(text: Column) -> Column:
    """Every kind of line end as a line feed."""
    return F.regexp_replace(text, "\r\n?", "\n")


def code_points(text: Column) -> Column:
    return F.length(text).cast("long")


def utf16_units(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def measured(text: Column) -> Column:
    """The length that limits apply to: the larger of code points and UTF-16 units."""
    return F.greatest(code_points(text), utf16_units(text))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def match_key(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, WHITE + "+", ""))


def field(text: Column, name: str) -> Column:
    """The value of the first ``- name: value`` line, empty without one."""
    return F.regexp_extract(text, rf"(?md)^- {name}:[^\S\n]*(.*?)[^\S\n]*$", 1)


def body(text: Column) -> Column:
    """What follows the entry-text heading up to the next second-level heading, without comments and outer blanks."""
    found = F.regexp_extract(text, ENTRY_TEXT, 1)
    return trimmed(F.regexp_replace(found, r"(?s)<!--.*?-->", ""))


def bracket_list(text: Column) -> Column:
    """The items of ``[a, "b", `c`]``; no brackets, no items."""
    inner = F.regexp_extract(trimmed(text), r"(?ds)^\[(.*)\]\z", 1)
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(x, r"(?U)^[\s\"'`]+|[\s\"'`]+\z", ""))
    return F.filter(items, lambda x: x != "")


def listed_keywords(block: Column) -> Column:
    """The lenient form: the bracket list of a block's ``- keywords:`` line, up to the bracket that ends a line; else none."""
    return bracket_list(F.regexp_extract(block, LISTED_KEYWORDS, 1))


def headings(text: Column, without: tuple[str, ...] = ("SAFE", "UNSAFE")) -> Column:
    """Distinct lower-cased titles of levels 1 to 3 that do not start with one of ``without``."""
    titles = F.regexp_extract_all(text, F.lit(r"(?md)^#{1,3}[^\S\n]+(\S.*?)[^\S\n]*$"), F.lit(1))
    for word in without:
        titles = F.filter(titles, _not_starting(word))
    return F.array_distinct(F.transform(titles, F.lower))


def _not_starting(word: str):
    return lambda title: ~title.startswith(word)


def stable_ids(text: Column, prefixes: tuple[str, ...] = ID_PREFIXES) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b((?:{'|'.join(prefixes)})\.[a-z0-9-]+)\b"), F.lit(1)))


def roster(text: Column) -> Column:
    """The slugs of second-level ``char.`` headings."""
    return F.regexp_extract_all(text, F.lit(r"(?md)^##[^\S\n]+`char\.([a-z0-9-]+)`"), F.lit(1))


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def title_key(title: Column) -> Column:
    return trimmed(F.regexp_replace(title, "[`*]", ""))


def line_of(text: Column, position: Column) -> Column:
    """The line (from 1) of a position (from 1)."""
    return F.size(F.split(F.substring(text, F.lit(1), position - 1), "\n"))


def characters(text: Column) -> Column:
    """The distinct characters."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def symbol_class(char: Column) -> Column:
    """operator, layout, emoji or null."""
    emoji = char.rlike(r"[\x{1F000}-\x{1FAFF}]") | (char.rlike(r"\p{So}") & (char >= F.lit("←")))
    return F.when(F.instr(F.lit(OPERATOR_SYMBOLS), char) > 0, "operator").when(F.instr(F.lit(LAYOUT_SYMBOLS), char) > 0, "layout").when(emoji, "emoji")


def leading_tags(tags: Column, separator: str = ",", count: int = 4) -> Column:
    parts = F.filter(F.transform(F.split(tags, separator), trimmed), lambda x: x != "")
    return F.lower(F.array_join(F.slice(parts, 1, count), ", "))


def size_label(size: Column) -> Column:
    """``W×H`` of a two-element array, else a dash."""
    return F.when(F.size(size) == 2, F.concat_ws("×", size[0].cast("string"), size[1].cast("string"))).otherwise("—")


def megabytes(size: Column) -> Column:
    return size / F.lit(1048576.0)


def served_url(repo: Column, path: Column, tag: Column, ref: Column) -> Column:
    """Where a published file is read from: by tag, else by the configured ref, else from ``main``."""
    at = F.coalesce(F.nullif(tag, F.lit("")), F.nullif(ref, F.lit("")), F.lit("main"))
    return F.concat_ws("/", F.format_string(SERVED, repo, at), path)


def percent(rate: Column, digits: int = 0, width: int = 0) -> Column:
    """A rate as per cent, right-aligned to a width."""
    return F.format_string(f"%{width or ''}.{digits}f%%", rate * 100)


def any_lines(text: Column) -> Column:
    """The lines of a text by every kind of line end; a last line end starts no line."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    parts = F.split(text, ends)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def display_label(name: Column, slug: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), slug)
