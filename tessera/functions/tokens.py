"""Token counting and offsets, with a pluggable tokenizer.

The default counts runs of letters, runs of digits and single runs of other
visible characters, which SQL engines can count as well.  A tokenizer file of
the ``tokenizers`` library can be used instead; all algorithms only ask for
offsets.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Protocol

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


class Tokenizer(Protocol):
    #: Whether texts joined by white space have as many tokens as they have by themselves.
    additive: bool

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Character ranges of the tokens, in order."""

    def count(self, text: str) -> int: ...


class RegexTokenizer:
    def __init__(self, pattern: str = TOKEN):
        self.pattern = regex.compile(pattern)
        self.additive = pattern == TOKEN

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)]

    def count(self, text: str) -> int:
        return sum(1 for _ in self.pattern.finditer(text))


class FileTokenizer:
    """A tokenizer file of the ``tokenizers`` library."""

    additive = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return list(self.library.encode(text, add_special_tokens=False).offsets)

    def count(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def tokenizer(path: str | None = None) -> Tokenizer:
    """One tokenizer for each worker process."""
    return FileTokenizer(path) if path else RegexTokenizer()


def token_count(text: Column) -> Column:
    """The default tokenizer's count, in the JVM."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
