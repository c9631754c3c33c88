"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a condition on one document's text. Its cost and selectivity are
measured on a bounded sample, and the rules are tried in order of rejection
per cost: a document that an earlier rule rejects never reaches the later
ones. The order changes the work, never the verdict. The base counts are part
of every document's result, so they precede the cascade.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import materialise
from sitescope.llm.native import is_blank, let, lines, words

#: Rows that the costs are measured on.
SAMPLE_ROWS = 2000

#: Timed passes over the sample, after one that warms up.
REPEATS = 3

SYMBOLS = '#*$%&|<>'
REPEAT_WORDS = 5


def count_in(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ''))


def count_matching(text: Column, outside: str) -> Column:
    """Characters that stay once all runs of ``outside`` are taken out."""
    return F.char_length(F.regexp_replace(text, outside, ''))


def repeated_words(ws: Column) -> Column:
    """Words inside five-word windows that occur at least twice in the array ``ws``."""
    n = F.size(ws) - (REPEAT_WORDS - 1)
    hashes = F.transform(F.sequence(F.lit(0), n - 1),
                         lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(REPEAT_WORDS)]))

    def covered(hs: Column) -> Column:
        paired = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias('h'), i.alias('i'))))
        again = let(paired, lambda s: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                     lambda j: (F.get(s, j).h == F.get(s, j - 1).h) | (F.get(s, j).h == F.get(s, j + 1).h)),
            lambda j: F.get(s, j).i))
        # Windows in order of place: each adds the words beyond the last one's end.
        start = F.struct(F.lit(-REPEAT_WORDS).alias('last'), F.lit(0).alias('words'))
        return F.aggregate(F.sort_array(again), start, lambda a, p: F.struct(
            p.alias('last'), (a.words + F.least(F.lit(REPEAT_WORDS), p - a.last)).alias('words')), lambda a: a.words)

    found = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(covered(hs)))
    return F.when(n < 2, 0).otherwise(found)


def add_counts(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text') -> DataFrame:
    """Base counts of every whole text: (id, __text, __words, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words); null counts as empty."""
    base = docs.select(F.col(id_col), F.coalesce(text_col, F.lit('')).alias('__text'))
    base = base.select(id_col, '__text', words(F.col('__text')).alias('__words'))
    text, ws = F.col('__text'), F.col('__words')
    said = F.filter(lines(text), lambda x: ~is_blank(x))
    duplicates = let(said, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    counts = {
        'n_words': F.size(ws),
        'word_chars': count_matching(text, r'[\x20\x09-\x0D]+'),
        'n_symbols': count_in(text, SYMBOLS),
        'n_dup_lines': duplicates,
        'n_repeat_words': let(ws, repeated_words),
    }
    return base.select(id_col, '__text', *[c.cast('long').alias(k) for k, c in counts.items()])


def words_matching(pattern: str) -> Column:
    """How many words contain ``pattern``, which must match at most once a word."""
    return F.regexp_count(F.col('__text'), F.lit(pattern))


#: Rejecting conditions, by name, over the columns of :func:`add_counts`.
RULES: dict[str, Callable[[], Column]] = {
    'decorated_words': lambda: 10 * words_matching(  # words that end in two or more marks
        r'[^\p{L}\p{M}\p{N}\x20\x09-\x0D]{2}(?=[\x20\x09-\x0D]|\z)') > 3 * F.col('n_words'),
    'duplicate_lines': lambda: 2 * F.col('n_dup_lines') > F.size(
        F.filter(lines(F.col('__text')), lambda x: ~is_blank(x))),
    'exclamations': lambda: 10 * count_in(F.col('__text'), '!') > F.col('n_words'),
    'letterless_words': lambda: 10 * words_matching(
        r'(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?=[\x20\x09-\x0D]|\z)') > 4 * F.col('n_words'),
    'letters': lambda: 4 * count_matching(F.col('__text'), r'[^\p{L}]+') < F.col('word_chars'),
    'marks': lambda: 3 * count_matching(F.col('__text'), r'[^\p{L}\p{M}\p{N}]+') < 2 * F.col('word_chars'),
    'shouting': lambda: let(count_matching(F.col('__text'), r'[^\p{Lu}]+'), lambda upper: (upper >= 20) & (
        2 * upper > count_matching(F.col('__text'), r'[^\p{L}]+'))),
    'symbols': lambda: 10 * F.col('n_symbols') > F.col('n_words'),
    'word_length': lambda: (F.col('word_chars') < 2 * F.col('n_words')) | (F.col('word_chars') > 14 * F.col('n_words')),
}


def base_failed() -> Column:
    return (F.col('n_words') < 10) | (100 * F.col('n_repeat_words') > 20 * F.col('n_words'))


def measure_rules(sample: DataFrame, rules: Mapping[str, Callable[[], Column]]) -> dict[str, tuple[float, float]]:
    """(share rejected, cost) of each rule over ``sample``, rows of :func:`add_counts`.

    A rule's cost is the time of a pass that reads every column and evaluates
    the rule, less that of a pass that only reads, in units of the latter:
    planning, scheduling and decoding cancel out. Of REPEATS passes after a
    warm-up, taken in turns, the shortest counts. Costs below a twentieth of
    the empty pass cannot be told apart and count as that.
    """
    read = F.sum(F.octet_length('__text') + F.col('n_words') + F.col('word_chars') + F.col('n_symbols') + F.col('n_dup_lines'))
    passes = {None: F.lit(False)} | {name: rule() for name, rule in rules.items()}
    times, shares = {name: [] for name in passes}, {}
    for _ in range(REPEATS + 1):
        for name, rejects in passes.items():
            began = time.perf_counter()
            rows, rejected, _ = sample.select(F.count('*'), F.count_if(rejects), read).first()
            times[name].append(time.perf_counter() - began)
            shares[name] = rejected / max(1, rows)
    empty = min(times[None][1:])
    return {name: (shares[name], max((min(times[name][1:]) - empty) / empty, 0.05)) for name in rules}


def order_rules(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text', sample_rows: int = SAMPLE_ROWS,
                rules: Mapping[str, Callable[[], Column]] | None = None) -> list[str]:
    """Names of the rules by rejection per cost, measured on at most about ``sample_rows`` rows.

    The sample is drawn once and written to the shared folder. Ratios within a
    factor of four are taken as equal, since times vary from run to run; equal
    ones, rules that reject nothing (last) and an empty table keep the order
    of ``rules``.
    """
    rules = RULES if rules is None else rules
    total = docs.count()
    if not total:
        return list(rules)
    drawn = docs.select(id_col, text_col).sample(fraction=min(1.0, sample_rows / total), seed=7)
    sample = materialise(add_counts(drawn, id_col, text_col).where(~base_failed()).repartition(4))
    measured = measure_rules(sample, rules)
    rank = {name: round(math.log(share / cost, 4)) if share else -math.inf for name, (share, cost) in measured.items()}
    return sorted(rules, key=lambda name: -rank[name])


def judge(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text', order: list[str] | None = None,
          rules: Mapping[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Counts and verdict of every document.

    Columns: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept. Null and empty texts have no
    words and fail the base; repeated rows and null ids stay row by row; other
    columns, whatever their names, take no part and are not returned. ``rules``
    (name to condition over the columns of :func:`add_counts`) default to RULES.
    """
    rules = RULES if rules is None else rules
    order = order_rules(docs, id_col, text_col, rules=rules) if order is None else order
    kept = F.when(F.col('base_failed'), False)
    for name in order:
        kept = kept.when(rules[name](), False)
    counted = add_counts(docs, id_col, text_col).withColumn('base_failed', base_failed())
    return counted.withColumn('kept', kept.otherwise(True)).drop('__text')


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as x from documents),
w as (select doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from t),
win as (select doc_id, i, ws[i:i + 4] as five from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, five) as c from win) where c > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) as p from dup) group by doc_id),
c as (
  select w.doc_id, x, len(ls) as nl, len(ws)::bigint as n_words,
         length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(cov.n, 0)::bigint as n_repeat_words,
         length(regexp_replace(x, '[^!]+', '', 'g')) as bangs,
         length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) as upper_letters,
         length(regexp_replace(x, '[^\p{L}]+', '', 'g')) as letters,
         length(regexp_replace(x, '[^\p{L}\p{M}\p{N}]+', '', 'g')) as spoken,
         len(list_filter(ws, lambda w: regexp_matches(w, '[^\p{L}\p{M}\p{N}]{2}$'))) as decorated,
         len(list_filter(ws, lambda w: not regexp_matches(w, '\p{L}'))) as letterless
  from w left join cov on cov.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words
            or 10 * n_symbols > n_words or 10 * bangs > n_words or 2 * n_dup_lines > nl
            or word_chars < 2 * n_words or word_chars > 14 * n_words or 3 * spoken < 2 * word_chars
            or 10 * decorated > 3 * n_words or 10 * letterless > 4 * n_words
            or (upper_letters >= 20 and 2 * upper_letters > letters) or 4 * letters < word_chars) as kept
from c
"""
