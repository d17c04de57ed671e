"""Small text helpers as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchwell.functions.dialect import java
from patchwell.functions.fixed_values import WHITE_SPACE


def trim(text: Column) -> Column:
    """Strip white space (as ECMAScript defines it) from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def matches(text: Column, pattern: str, any_case: bool = False) -> Column:
    """Whether an ECMAScript ``pattern`` occurs in ``text``."""
    return F.rlike(text, F.lit(java(pattern, any_case)))


def capture(text: Column, pattern: str, group: int, any_case: bool = False) -> Column:
    """A capture group of the first occurrence; ``''`` if there is none."""
    return F.regexp_extract(text, java(pattern, any_case), group)


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether ``text`` holds one of the literals (byte search, no decoding)."""
    return reduce(or_, [text.contains(n) for n in needles])


def contains_any_case(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether ``text`` in lower case holds one of the literals.

    Several times faster than a case-insensitive alternation; as a lambda, so
    that the text is lowered once.
    """
    return F.exists(F.array(F.lower(text)), lambda low: contains_any(low, needles))


def occurrences(text: Column, needle: str, shorter: str) -> Column:
    """How often ``needle`` occurs; ``shorter`` is one byte shorter than it."""
    less = F.replace(text, F.lit(needle), F.lit(shorter))
    return (F.octet_length(text) - F.octet_length(less)).cast("bigint")


def prefix(text: Column, length: Column | int) -> Column:
    """The first ``length`` characters."""
    return F.substring(text, F.lit(1), length if isinstance(length, Column) else F.lit(length))


def tail(text: Column) -> Column:
    """Everything after the first character."""
    return F.substring(text, F.lit(2), F.lit(2147483647))


def record(**fields: Column) -> Column:
    """A struct by field names; unlike aliases these also hold inside lambdas."""
    parts: list[Column] = []
    for name, value in fields.items():
        parts += [F.lit(name), value]
    return F.named_struct(*parts)
