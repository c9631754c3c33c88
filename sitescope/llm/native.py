"""Column helpers for the native operators: DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = ' \t\n\x0b\x0c\r'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the runs of anything but ASCII white space; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit('')), F.lit(BLANKS))
    return F.when(trimmed == '', F.array().cast('array<string>')).otherwise(F.split(trimmed, r'[\x20\x09-\x0D]+'))


def lines(text: Column) -> Column:
    """The text's lines, cut at every line feed; a null text has none."""
    return F.when(text.isNull(), F.array().cast('array<string>')).otherwise(F.split(text, '\n', -1))


def is_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS)) == ''
