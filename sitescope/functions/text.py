"""Text column functions: cleaning, tokens, n-grams, themes, sentiment.

All of these are native higher-order / regex expressions, so the per-row work
stays in the JVM. Lexicons are parameters with the fixed values as defaults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitescope.functions import lexicons as lx

# One pass: everything that is not a letter, digit, underscore or . ! ? becomes
# a single space. Whitespace is outside the class as well, so runs of
# whitespace collapse in the same pass (same result as "replace, then collapse").
NON_TEXT_RUN = r'[^\p{L}\p{N}_.!?]+'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _str_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast('array<string>')


def clean_text(c) -> Column:
    """Null -> ''; lower; non-text runs -> ' '; trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c).cast('string'), F.lit(''))),
                                   NON_TEXT_RUN, ' '))


def words(clean_col) -> Column:
    """Whitespace split of an already cleaned text ('' -> [])."""
    c = _c(clean_col)
    return F.when(c == '', F.array().cast('array<string>')).otherwise(F.split(c, ' '))


def _drop_tokens(text: Column, pattern: str) -> Column:
    """Remove whole space-delimited tokens matching ``pattern`` (one regex pass)."""
    return F.regexp_replace(text, f'(?:^| )(?:{pattern})(?= |$)', ' ')


def _stop_pattern(stopwords: Sequence[str]) -> str:
    import re
    # longest first so an alternative never shadows a longer one
    return '|'.join(re.escape(w) for w in sorted(set(stopwords), key=lambda w: (-len(w), w)))


def token_text(clean_col, min_length: int = 2, stopwords: Sequence[str] | None = lx.STOPWORDS) -> Column:
    """Cleaned text with short words and stopwords removed, single-spaced.

    Pure regex passes (compiled once per task), so no per-token lambda runs.
    """
    t = _c(clean_col)
    if stopwords:
        t = _drop_tokens(t, _stop_pattern(stopwords))
    if min_length > 1:
        t = _drop_tokens(t, f'[^ ]{{1,{min_length - 1}}}')
    return F.trim(F.regexp_replace(t, ' {2,}', ' '))


def tokenize(clean_col, min_length: int = 2, stopwords: Sequence[str] | None = lx.STOPWORDS) -> Column:
    """C14: words of length >= min_length, stopwords removed (order kept)."""
    return words(token_text(clean_col, min_length, stopwords))


def _shifted_zip(toks: Column, n: int) -> Column:
    shifted = [F.slice(toks, i + 1, F.greatest(F.size(toks) - i, F.lit(0))) for i in range(n)]
    return F.arrays_zip(*shifted)


def ngram_keys_of(toks, n: int = 2) -> Column:
    """Space-joined n-grams of a token array column (built from ``n`` shifted
    slices zipped together; the lambda only touches one zipped element)."""
    toks = _c(toks)
    keys = F.transform(_shifted_zip(toks, n), lambda z: F.concat_ws(' ', *[z[str(i)] for i in range(n)]))
    return F.slice(keys, 1, F.greatest(F.size(toks) - n + 1, F.lit(0)))


def ngram_keys(clean_col, n: int = 2, min_length: int = 2) -> Column:
    """C15 as keys: consecutive n-grams over tokens that keep stopwords (length >= min).

    One regex pass over the single-spaced token text: each token that has
    ``n - 1`` successors is rewritten as "token successors<TAB>" (successors
    read by lookahead, so every token starts one n-gram); splitting on the tab
    gives the n-grams in order plus one trailing remainder, which is dropped.
    No per-element lambda runs.
    """
    t = token_text(clean_col, min_length, stopwords=None)
    if n == 1:
        return words(t)
    pattern = '([^ ]+) (?=' + ' '.join(['([^ ]+)'] * (n - 1)) + ')'
    replacement = ' '.join(f'${i}' for i in range(1, n + 1)) + '\t'
    parts = F.split(F.regexp_replace(t, pattern, replacement), '\t')
    return F.slice(parts, 1, F.size(parts) - 1)


def ngrams(clean_col, n: int = 2, min_length: int = 2) -> Column:
    """Consecutive n-grams (array<array<string>>)."""
    return F.transform(ngram_keys(clean_col, n, min_length), lambda k: F.split(k, ' '))


def theme_labels(clean_col, themes: Mapping[str, Sequence[str]]) -> Column:
    """Themes whose keywords occur as substrings (multi-label, theme order)."""
    c = _c(clean_col)
    flags = []
    for theme, kws in themes.items():
        cond = F.lit(False)
        for k in kws:
            cond = cond | c.contains(k)
        flags.append(F.when(cond, F.lit(theme)))
    return F.array_compact(F.array(*flags))


def sentiment_score(clean_col, positive: Sequence[str] = lx.POSITIVE_WORDS,
                    negative: Sequence[str] = lx.NEGATIVE_WORDS) -> Column:
    """C17 + C32 + U5: (p - n) / (p + n) over distinct tokens (stopwords kept), 0 if none."""
    toks = tokenize(clean_col, stopwords=None)
    # array_intersect returns distinct elements: |distinct tokens ∩ lexicon|
    p = F.size(F.array_intersect(toks, _str_array(positive)))
    n = F.size(F.array_intersect(toks, _str_array(negative)))
    return F.when(p + n > 0, (p - n).cast('double') / (p + n)).otherwise(F.lit(0.0))


def sentiment_class(score_col, band: float = lx.SENTIMENT_BAND) -> Column:
    """C18."""
    s = _c(score_col)
    return (F.when(s > band, F.lit('positive'))
            .when(s < -band, F.lit('negative'))
            .otherwise(F.lit('neutral')))


def says_nothing(c, pattern: str = lx.NOTHING_PATTERN) -> Column:
    """P10: lower-cased text contains a 'nothing' word anywhere (so 'know' counts)."""
    return F.coalesce(F.lower(_c(c)).rlike(pattern), F.lit(False))


def is_substantive(c, pattern: str = lx.NOT_SUBSTANTIVE_PATTERN) -> Column:
    """The whole (untrimmed) answer is not a bare 'nothing' answer.

    A trailing ``$`` may match before one final newline (Python ``re``
    semantics), written as optional-newline + end-of-input so Java and RE2 agree.
    """
    low = F.lower(_c(c))
    pat = pattern[:-1] + r'\n?\z' if pattern.endswith('$') else pattern
    return ~F.coalesce(low.rlike(pat), F.lit(False))


def article_text(title_col, content_col) -> Column:
    """Title + ' ' + content, null-safe."""
    return F.concat_ws(' ', _c(title_col), _c(content_col))
