"""Cleaning column functions (survey answers, numbers, dates, names).

Every function maps Column -> Column and stays a native Catalyst expression,
so it runs inside whole-stage codegen on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitescope.functions import lexicons as lx

# A number as pandas' to_numeric accepts it; try_cast alone would also accept
# '5d', '5f' and hex floats.
NUMERIC_TEXT = r'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'
# Python str.strip() removes every Unicode whitespace, Spark trim only spaces.
_EDGE_SPACE = r'(?U)^\s+|\s+$'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """C11: strip leading/trailing whitespace of any kind (tabs, newlines...)."""
    return F.regexp_replace(_c(c), _EDGE_SPACE, '')


def norm_name(c) -> Column:
    """Lower-cased, stripped name; null stays null."""
    return strip(F.lower(_c(c)))


def clean_age(c) -> Column:
    """Age band from a free answer; unmatched text passes through."""
    c = _c(c).cast('string')
    expr = None
    for subs, label in lx.AGE_BANDS:
        cond = None
        for s in subs:
            part = c.contains(s)
            cond = part if cond is None else (cond | part)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(c)


def clean_gender(c) -> Column:
    """Gender label from a free answer (case-insensitive)."""
    low = F.lower(_c(c).cast('string'))
    return (F.when(low.contains('male') & ~low.contains('female'), F.lit('Male'))
            .when(low.contains('female'), F.lit('Female'))
            .when(low.contains('prefer not'), F.lit('Prefer not to say'))
            .when(low.contains('other'), F.lit('Other'))
            .otherwise(F.initcap(low)))


def clean_rating(c) -> Column:
    """First rating label contained in the answer (case-sensitive) else null."""
    c = _c(c).cast('string')
    expr = None
    for label in lx.RATING_LABELS:
        cond = c.contains(label)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def rating_score(c, scores: dict | None = None) -> Column:
    """C4: rating label -> integer score; unknown -> null."""
    scores = scores or lx.RATING_SCORES
    expr = None
    for label, val in scores.items():
        cond = _c(c) == F.lit(label)
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.cast('int')


def clean_binary(c) -> Column:
    """C5: 'Yes' if the answer contains 'yes', else 'No' if it contains 'no'."""
    low = F.lower(_c(c).cast('string'))
    return F.when(low.contains('yes'), F.lit('Yes')).when(low.contains('no'), F.lit('No'))


def to_number(c) -> Column:
    """Numeric coercion; anything pandas would reject becomes null."""
    txt = strip(_c(c).cast('string'))
    return F.when(txt.rlike(NUMERIC_TEXT), txt.try_cast('double'))


DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")
TIME_FORMATS = ("", " HH:mm:ss", " HH:mm")


def to_timestamp_any(c, formats: Sequence[str] = tuple(d + t for d in DATE_FORMATS for t in TIME_FORMATS)) -> Column:
    """First format that parses; unparsable -> null.

    Slashed dates are read month first, and day first only where that cannot
    be a date. A ``T`` before the time, a fraction of a second and a zone are
    taken off first, so the result is the naive local time that was written and
    does not depend on the session time zone.
    """
    txt = strip(_c(c).cast('string'))
    txt = F.regexp_replace(txt, r'^(\d{4}-\d{2}-\d{2})T', '$1 ')
    txt = F.regexp_replace(txt, r'(\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?\s*(?:Z|[+-]\d{2}:?\d{2})?$', '$1')
    txt = F.regexp_replace(txt, r'^(\d)/', '0$1/')
    txt = F.regexp_replace(txt, r'^(\d{2})/(\d)/', '$1/0$2/')
    return F.coalesce(*[F.try_to_timestamp(txt, F.lit(f)) for f in formats]).cast('timestamp_ntz')


def month_bucket(c) -> Column:
    """First day of the month (date)."""
    return F.trunc(_c(c), 'month')


def year_part(c) -> Column:
    """C9."""
    return F.year(_c(c))


def postcode_key(c) -> Column:
    """Strip and remove spaces; empty -> null."""
    k = F.regexp_replace(strip(_c(c)), ' ', '')
    return F.when(k != '', k)


def half_even(c, digits: int = 2) -> Column:
    """banker's rounding as NumPy does it."""
    return F.bround(_c(c), digits)


def label_title(c) -> Column:
    """C29: 'some_metric' -> 'Some Metric'."""
    return F.initcap(F.regexp_replace(_c(c), '_', ' '))


def nan_to_null(c) -> Column:
    """NaN is a value in Spark but missing in pandas; normalise at ingestion."""
    col = _c(c)
    return F.when(~F.isnan(col), col)


def plausible_name(c, min_len: int = 4) -> Column:
    """A name longer than three characters."""
    return _c(c).isNotNull() & (F.length(_c(c)) >= min_len)


def equals_flag(c, value: str) -> Column:
    """c == value, null -> False."""
    return F.coalesce(_c(c) == F.lit(value), F.lit(False))


def contains_any(c, terms: Sequence[str]) -> Column:
    """Lower-cased value contains any term; null -> False."""
    low = F.lower(_c(c).cast('string'))
    cond = F.lit(False)
    for t in terms:
        cond = cond | F.coalesce(low.contains(t.lower()), F.lit(False))
    return cond


def visit_band(c) -> Column:
    """1 / 2-3 / 4+ visit bands; null stays unknown."""
    v = _c(c)
    return (F.when(v.isNull(), F.lit('unknown'))
            .when(v <= 1, F.lit('single'))
            .when(v <= 3, F.lit('repeat'))
            .otherwise(F.lit('frequent')))


def champion_band(c, min_visits: int = 2) -> Column:
    """P16 (map variant): champion when visits >= min_visits; null stays unknown."""
    v = _c(c)
    return (F.when(v.isNull(), F.lit('unknown'))
            .when(v >= min_visits, F.lit('champion'))
            .otherwise(F.lit('visited')))


def cluster_colour(c, palette: Sequence[str] = lx.CLUSTER_PALETTE) -> Column:
    """palette[cluster mod len], null cluster -> 0."""
    arr = F.array(*[F.lit(p) for p in palette])
    idx = F.pmod(F.coalesce(_c(c).cast('long'), F.lit(0)), F.lit(len(palette))) + 1
    return F.element_at(arr, idx.cast('int'))
