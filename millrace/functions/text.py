"""Trigrams, literals that a regular expression requires, and bounded edit distance."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # older Pythons
    import sre_constants as sre
    import sre_parse


def trigrams(text: Column) -> Column:
    """The distinct three-character substrings of a text."""
    # a look-ahead steps on by one character, so the text is passed over once
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def required_literals(pattern: str) -> tuple[str, list[str]]:
    """A literal that every match begins the text with (for ^...), and literals that every match contains."""
    runs: list[str] = []

    def walk(items, run: str) -> str:
        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg)
            elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
                run = walk(arg[3], run)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                runs.append(run)
                inner = walk(arg[2], "")
                runs.append(inner)
                run = ""
            elif op is sre.AT:
                continue
            else:
                runs.append(run)
                run = ""
        return run

    parsed = list(sre_parse.parse(pattern))
    if any(op is sre.ASSERT or op is sre.ASSERT_NOT or op is sre.GROUPREF for op, _ in parsed):
        raise ValueError("look-around and back-references are not supported")
    runs.append(walk(parsed, ""))
    prefix = ""
    if parsed and parsed[0] == (sre.AT, sre.AT_BEGINNING):
        for op, arg in parsed[1:]:
            if op is not sre.LITERAL:
                break
            prefix += chr(arg)
    return prefix, sorted({r for r in runs if len(r) >= 3})


def java_pattern(pattern: str) -> str:
    """The pattern in Java's dialect with Unicode classes; a final $ matches at the very end only."""
    if re.search(r"(?<!\\)(?:\\\\)*\$$", pattern):
        pattern = pattern[:-1] + r"\z"
    return "(?U)" + pattern


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, with the cheap tests for its literals first."""
    prefix, literals = required_literals(pattern)
    conditions = ([text.startswith(prefix)] if prefix else []) + [text.contains(x) for x in literals] + [text.rlike(java_pattern(pattern))]
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def pieces(literal: str, errors: int) -> list[str]:
    """errors + 1 parts of a literal: a text within so many edits contains one of them whole."""
    n = errors + 1
    return [p for p in (literal[i * len(literal) // n : (i + 1) * len(literal) // n] for i in range(n)) if p]
