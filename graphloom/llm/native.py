"""Spans of regular expressions as Spark SQL expressions: no Python on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string,before:string,after:string>>"


def quoted(pattern: str) -> str:
    """A SQL literal of a pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str, around: int = 24) -> Column:
    """All leftmost matches that don't overlap: start, end (code points), the match, and text before and after it.

    Splitting at the matches gives the gaps between them, whose lengths and the matches' add up to positions;
    before and after come from the gaps.
    """
    p = quoted(pattern)
    return F.expr(
        f"""CASE WHEN {text} RLIKE {p} THEN aggregate(
            zip_with(
              zip_with(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), (g, x) -> named_struct('g', g, 'x', x)),
              slice(split({text}, {p}, -1), 2, size(regexp_extract_all({text}, {p}, 0))),
              (z, a) -> named_struct('n', length(z.g), 'b', right(z.g, {around}), 'x', z.x, 'a', left(a, {around}))),
            named_struct('at', 0, 'out', CAST(array() AS {SPAN})),
            (acc, z) -> named_struct('at', acc.at + z.n + length(z.x), 'out',
               concat(acc.out, array(named_struct('s', acc.at + z.n, 'e', acc.at + z.n + length(z.x), 'v', z.x, 'before', z.b, 'after', z.a)))),
            acc -> acc.out)
        ELSE CAST(array() AS {SPAN}) END"""
    )


def listed(spans_col: str, kinds: tuple[str, ...]) -> str:
    """SQL: kind:start:end of an array of (s, k, e, ...), by start and then kind, joined by commas."""
    names = "array(" + ",".join(f"'{k}'" for k in kinds) + ")"
    return f"array_join(transform(array_sort(transform({spans_col}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))), x -> concat_ws(':', element_at({names}, x.k + 1), x.s, x.e)), ',')"


def java(pattern: str) -> re.Pattern:
    """The same pattern for Python, for tests: scoped flags and possessive quantifiers are alike in both."""
    return re.compile(pattern, re.ASCII)
