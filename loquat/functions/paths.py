"""Path exclusion: plain prefixes and globs, compiled once to regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """``*`` within a component, ``**/`` any number of components, a final ``**`` everything, ``?`` one character.

    ``**`` elsewhere is two ``*``. Anchored, case-sensitive; valid in Java and RE2."""
    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif pattern[i:] == "**":
            out, i = out + "(?:.|\n)*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", pattern[i]), i + 1
    return out + "$"


def exclusion_regex(pattern: str) -> str:
    """A pattern without wildcards excludes the path itself and everything below it; a final slash is ignored."""
    clean = pattern.removesuffix("/")
    compiled = glob_regex(clean)
    return compiled if "*" in clean or "?" in clean else f"{compiled[:-1]}(/|$)"


def is_excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern excludes the path (relative to the base)."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | path.rlike(exclusion_regex(pattern))
    return out
