"""Text functions as Spark columns: breadcrumbs, slugs, titles, links and sizes."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def breadcrumb(heading_path: Column) -> Column:
    return F.concat_ws(" > ", heading_path)


def embedding_text(heading_path: Column, text: Column, with_path: bool = True) -> Column:
    """The text that is embedded: under its breadcrumb, unless it has none or paths are off."""
    if not with_path:
        return text
    return F.when(F.size(heading_path) > 0, F.concat(breadcrumb(heading_path), F.lit("\n\n"), text)).otherwise(text)


def node_id(parent_id: Column, title: Column, level: Column, ordinal: Column) -> Column:
    """A stable id of a section: sixteen hex digits of its parent, title, level and place among its like."""
    key = F.concat_ws("\x1f", F.coalesce(parent_id, F.lit("")), title, level.cast("string"), ordinal.cast("string"))
    return F.substring(F.sha2(key, 256), 1, 16)


def figure_text(caption: Column, description: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.concat_ws("\n\n", F.when(~empty(caption), caption), F.when(~empty(description), description))


#: Titles of sections that only list sources (fixed values).
REFERENCE_TITLES = ("references", "bibliography", "参考文献", "参考资料")


def is_reference_title(title: Column) -> Column:
    return F.lower(F.trim(title)).isin(*REFERENCE_TITLES)


def slug_heading(heading: Column) -> Column:
    """Letters and digits of any script, A-Z in lower case, with single underscores between runs."""
    joined = F.regexp_replace(heading, r"[^\p{L}\p{N}]+", "_")
    return F.translate(F.regexp_replace(joined, "^_+|_+$", ""), string.ascii_uppercase, string.ascii_lowercase)


def slug(title: Column, longest: int = 48) -> Column:
    """ASCII letters and digits with single dashes, at most ``longest`` characters; never empty."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+", "")
    cut = F.regexp_replace(F.substring(joined, 1, longest), "-+$", "")
    return F.when(cut == "", "untitled").otherwise(cut)


def stem_of(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def normalize(text: Column) -> Column:
    """The text without spaces and line feeds (only those)."""
    return F.translate(text, " \n", "")


def yaml_quoted(value: Column) -> Column:
    out = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def contains_fact(text: Column, fact: Column) -> Column:
    return F.contains(normalize(text), normalize(fact))


def base64_byte_len(encoded: Column) -> Column:
    """Bytes that a base64 text stands for."""
    padding = F.length(encoded) - F.length(F.regexp_replace(encoded, "=+$", ""))
    return F.floor(F.length(encoded) / 4) * 3 - padding


def format_bytes(n: Column) -> Column:
    kb, mb = 1024.0, 1024.0 * 1024.0
    return F.when(n >= mb, F.format_string("%.1f MB", n / mb)).when(n >= kb, F.format_string("%.0f KB", n / kb)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def join_with(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *parts)


def all_of(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None
