"""Frontmatter: filters ``key=value`` and ``key!=value``, and typed accessors.

Frontmatter is kept as JSON text and read as ``MAP<STRING, VARIANT>``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import all_of, slug_heading, stem_of


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    key: str
    value: str
    negated: bool = False

    @classmethod
    def parse(cls, text: str) -> Filter:
        """Splits at the first ``=``; a ``!`` right before it negates.  The value may be empty or hold ``=``."""
        key, found, value = text.partition("=")
        if not found:
            raise FilterError(f"a filter must be key=value or key!=value: {text!r}")
        negated = key.endswith("!")
        key = key[:-1] if negated else key
        if not key:
            raise FilterError(f"a filter must name a key: {text!r}")
        return cls(key, value, negated)

    def column(self, frontmatter: Column) -> Column:
        """True for matching rows and false for all others, missing keys included.

        An array matches if it has the value as a string; anything else matches by
        its text.  Keys and values are literals, never parts of an SQL text.
        """
        v = entry(frontmatter, self.key)
        is_text = lambda e: F.schema_of_variant(e) == "STRING"
        elements = F.try_variant_get(v, "$", "array<variant>")
        in_array = F.exists(elements, lambda e: F.coalesce(is_text(e) & (F.try_variant_get(e, "$", "string") == self.value), F.lit(False)))
        as_text = F.try_variant_get(v, "$", "string") == self.value
        same = F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), in_array).otherwise(as_text), F.lit(False))
        return ~same if self.negated else same


def entry(frontmatter: Column, key: str) -> Column:
    """The variant under a key (dots are part of the key), null if missing."""
    return F.try_element_at(F.from_json(frontmatter, "map<string,variant>"), F.lit(key))


def where(frontmatter: Column, filters: list[Filter]) -> Column | None:
    """All filters together; None for none."""
    return all_of([f.column(frontmatter) for f in filters])


def text_of(frontmatter: Column, key: str) -> Column:
    """A string entry; null if it is missing or of another type."""
    v = entry(frontmatter, key)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def tags_of(frontmatter: Column) -> Column:
    """The strings of the ``tags`` array; empty for a scalar or nothing."""
    v = entry(frontmatter, "tags")
    strings = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.schema_of_variant(e) == "STRING")
    found = F.transform(strings, lambda e: F.variant_get(e, "$", "string"))
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), found), F.array().cast("array<string>"))


def generated(frontmatter: Column, field: str) -> Column:
    """``generated.at`` or ``generated.by``."""
    v = F.try_variant_get(entry(frontmatter, "generated"), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def chapter_label(frontmatter: Column) -> Column:
    """``ch4`` for a number or a text that is one, other texts as they are, else null."""
    v = entry(frontmatter, "chapter")
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.regexp_replace(text, r"^\+?0*(?=\d)", "")
    as_text = F.when(text.rlike(r"^\+?\d+$") & (number.cast("decimal(38,0)") <= 4294967295), F.concat(F.lit("ch"), number)).otherwise(text)
    return F.when(kind == "STRING", as_text).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.concat(F.lit("ch"), text))


def result_title(filename: Column, frontmatter: Column, leaf: Column) -> Column:
    chapter, title = chapter_label(frontmatter), text_of(frontmatter, "title")
    quoted = F.concat(F.lit('"'), title, F.lit('"'))
    named = F.concat_ws(" ", chapter, quoted)
    parts = F.array_compact(F.array(text_of(frontmatter, "book"), F.when(named != "", named), leaf))
    return F.when(F.size(parts) == 0, stem_of(filename)).otherwise(F.concat_ws(" · ", parts))


def result_url(filename: Column, frontmatter: Column, leaf: Column) -> Column:
    book, chapter = text_of(frontmatter, "book"), chapter_label(frontmatter)
    path = F.coalesce(F.concat(book, F.lit("/"), chapter), stem_of(filename))
    uri = F.concat(F.lit("kb://"), path, F.coalesce(F.concat(F.lit("#"), slug_heading(leaf)), F.lit("")))
    return F.concat_ws(" · ", text_of(frontmatter, "resource"), uri)


def result_date(frontmatter: Column) -> Column:
    at, by = generated(frontmatter, "at"), generated(frontmatter, "by")
    return F.when(by.isNull(), at).otherwise(F.concat(at, F.lit(" (generated: "), by, F.lit(")")))
