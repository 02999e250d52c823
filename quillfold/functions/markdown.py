"""Markdown to plain text as a chain of expressions.

Patterns run with ``(?d)``: a line ends with a line feed only, as carriage returns are replaced first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.functions.text import strip

# Patterns that the syntax sets.
FRONT = r"(?s)\A\s*---\s*\n(.*?)\n---\s*?(?:\n|\z)"
FENCE = r"(?dsm)^```([A-Za-z0-9_+.\-]*)[ \t]*\n(.*?)^[ \t]*```[ \t]*$"
RULE_ROW = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"
HEADING = r"(?dm)^(#{1,6})\s+(.+)$"
CODE_MODES = ("preserve", "extract", "drop")
MARK = "\ue000"  # stands for a block of code while the rest is rewritten


def unix(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def front_matter(c: Column) -> Column:
    """``map<string,string>`` of the ``key: value`` lines of a leading block; empty without one. A repeated key has its last value."""
    entries = front_matter_entries(c)
    last = F.map_from_entries(F.transform(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])), lambda e: F.struct(e["key"], e["value"])))
    return F.when(c.isNotNull(), F.coalesce(last, F.create_map().cast("map<string,string>")))


def front_matter_entries(c: Column) -> Column:
    """``array<struct<key, kind, value>>`` in order: kind is list (items joined by a unit separator), bool, int, float or string.

    Lines without a colon or key and comments are left out. Quotes around a value are cut before its kind is told.
    """
    lines = F.split(F.regexp_extract(unix(c), FRONT, 1), "\n")
    used = F.filter(F.transform(lines, strip), lambda x: (x != "") & ~x.startswith("#") & x.rlike(r"(?s)^\s*[^\s:][^:]*:"))

    def entry(x: Column) -> Column:
        key, value = strip(F.regexp_extract(x, r"(?s)^([^:]*):", 1)), F.btrim(strip(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)), F.lit("\"'"))
        items = F.filter(F.transform(F.split(F.substr(value, F.lit(2), F.char_length(value) - 2), ","), strip), lambda v: v != "")
        kind = F.when(value.startswith("[") & value.endswith("]"), "list").when(F.lower(value).isin("true", "false"), "bool").when(value.rlike(r"^\d+$"), "int").when(value.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), "float").otherwise("string")
        shown = F.when(kind == "list", F.array_join(F.transform(items, lambda v: F.btrim(v, F.lit("\"'"))), "\u001f")).when(kind == "bool", F.lower(value)).otherwise(value)
        return F.struct(key.alias("key"), kind.alias("kind"), shown.alias("value"))

    return F.transform(used, entry)


def body(c: Column) -> Column:
    """The text after the front matter, whether or not that could be read."""
    return F.when(c.rlike(FRONT), F.regexp_replace(F.regexp_replace(c, FRONT, ""), r"\A\n+", "")).otherwise(c)


def code_blocks(c: Column) -> Column:
    """``array<struct<language, code>>`` of the fenced blocks; without a language it is unknown."""
    whole = F.regexp_extract_all(unix(c), F.lit(FENCE), F.lit(0))
    language = lambda b: F.regexp_extract(b, FENCE, 1)
    return F.transform(whole, lambda b: F.struct(F.when(language(b) == "", "unknown").otherwise(language(b)).alias("language"), F.regexp_replace(F.regexp_extract(b, FENCE, 2), r"\n\z", "").alias("code")))


def headings(c: Column) -> Column:
    """``array<struct<level int, title string>>`` of what is outside of front matter and code, with the marks within titles."""
    found = F.regexp_extract_all(F.regexp_replace(body(unix(c)), FENCE, "\n"), F.lit(HEADING), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, HEADING, 1)).alias("level"), strip(F.regexp_extract(h, HEADING, 2)).alias("title")))


def tables(c: Column) -> Column:
    """Rule rows out; the other rows' cells joined by `` | ``, empty cells left out."""

    def row(x: Column) -> Column:
        cells = F.filter(F.transform(F.split(F.btrim(strip(x), F.lit("|")), r"\|"), strip), lambda v: v != "")
        return F.when(F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2, F.array_join(cells, " | ")).otherwise(x)

    lines = F.filter(F.split(F.regexp_replace(c, "[\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", "\n"), "\n", -1), lambda x: ~strip(x).rlike(RULE_ROW))
    return F.array_join(F.transform(lines, row), "\n")


def links(c: Column, keep_url: bool = False) -> Column:
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    return F.regexp_replace(c, r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)" if keep_url else "$1")


def inline(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?d)\*\*(.*?)\*\*|__(.*?)__", "$1$2")
    c = F.regexp_replace(c, r"(?d)\*(.*?)\*|_(.*?)_", "$1$2")
    return F.regexp_replace(F.regexp_replace(c, r"`([^`]+)`", "$1"), r"(?d)~~(.*?)~~", "$1")


def to_text(c: Column, code: str = "preserve", keep_url: bool = False) -> Column:
    """Plain text. ``code`` is preserve (blocks stay as they are, no rule touches them), extract (a line
    ``[Code block n: language]`` in place of each) or drop. Null gives null."""
    if code not in CODE_MODES:
        raise ValueError("code must be preserve, extract or drop")
    whole = F.replace(unix(c), F.lit(MARK), F.lit(""))
    x = F.regexp_replace(body(whole), FENCE, "" if code == "drop" else f"\n{MARK}\n")
    if code == "extract":
        x = _filled(x, F.transform(code_blocks(body(whole)), lambda b, i: F.concat(F.lit("[Code block "), (i + 1).cast("string"), F.lit(": "), b["language"], F.lit("]"))))
    x = inline(F.regexp_replace(links(tables(x), keep_url), HEADING, "$2"))
    x = F.regexp_replace(F.regexp_replace(x, r"(?dm)^\s*[-*+]\s+", ""), r"(?dm)^\s*\d+\.\s+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?dm)^\s*>\s?", ""), r"(?dm)^\s*[-*_]{3,}\s*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    if code == "preserve":
        x = _filled(x, F.transform(code_blocks(body(whole)), lambda b: b["code"]))
    return strip(x)


def _filled(x: Column, blocks: Column) -> Column:
    """The text with the n-th block in place of the n-th mark."""
    return F.array_join(F.zip_with(F.split(x, MARK, -1), blocks, lambda part, block: F.concat(part, F.coalesce(block, F.lit("")))), "")


def metadata(c: Column) -> Column:
    """``struct<title, has_front_matter, headings, code_blocks>``; the title is the front matter's, else null."""
    front = front_matter(c)
    return F.struct(F.try_element_at(front, F.lit("title")).alias("title"), (F.size(front) > 0).alias("has_front_matter"), headings(c).alias("headings"), code_blocks(body(unix(c))).alias("code_blocks"))
