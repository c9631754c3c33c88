"""Grouped KPIs and report metrics.

All aggregates are single-pass ``agg`` calls (partial aggregation on the map
side); grouping keys drop nulls first, as the application's group-bys do.
Shares of a total use a one-row aggregate cross-joined back, never an
unpartitioned window over raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions import clean as C
from sitescope.functions import lexicons as lx

SURVEY_COLUMNS = {
    'submission_date': 'Submission Date',
    'age': 'How old are you?',
    'gender': 'What gender are you?',
    'rating': ('How would you rate the overall effectiveness of the presentation in raising awareness '
               'about online safety and grooming?'),
    'speaker': 'Did you find the presentation more engaging because it was delivered by an external speaker?',
    'dangers': 'I feel more confident in identifying dangers online',
    'grooming': 'I have a better understanding of grooming and how to recognise it',
    'online_vs_real': 'I understand the difference between online friends and friends in real life',
    'recommend': 'Would you recommend this session to other students your age?',
    'school': 'What is the name of your school?',
    'liked': 'What parts did you like the most or find the most interesting or useful?',
    'improve': ('Is there anything you feel was missing or could be improved in the presentation? '
                'If so, please provide details.'),
    'add': 'What could we add to the presentation to make it better?',
}


def clean_survey(raw: DataFrame, cols: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Typed, cleaned survey table from raw string answers (one ``select``).

    ``cols`` maps roles (keys of SURVEY_COLUMNS) to raw column names; missing
    roles produce null columns.
    """
    cols = dict(SURVEY_COLUMNS if cols is None else cols)

    def src(role):
        name = cols.get(role)
        return F.col(f'`{name}`') if name and name in raw.columns else F.lit(None).cast('string')

    rating = C.clean_rating(src('rating'))
    return raw.select(
        *[F.col(f'`{k}`') for k in keep],
        C.to_timestamp_any(src('submission_date')).alias('submission_date'),
        C.clean_age(src('age')).alias('age_group'),
        C.clean_gender(src('gender')).alias('gender'),
        rating.alias('effectiveness_rating'),
        C.rating_score(rating).alias('effectiveness_score'),
        C.clean_binary(src('speaker')).alias('external_speaker_engaging'),
        C.to_number(src('dangers')).alias('confident_identifying_dangers'),
        C.to_number(src('grooming')).alias('understanding_grooming'),
        C.to_number(src('online_vs_real')).alias('understanding_online_vs_real'),
        C.clean_binary(src('recommend')).alias('would_recommend'),
        src('school').alias('school_name'),
        src('liked').alias('liked_most'),
        src('improve').alias('improvements'),
        src('add').alias('additions'),
    )


def survey_kpis(df: DataFrame, satisfied: Sequence[str] = lx.SATISFIED_RATINGS) -> DataFrame:
    """A1: n, mean score, satisfaction % (of all rows), recommendation % (of answered), schools."""
    n = F.count(F.lit(1))
    sat = F.count_if(F.col('effectiveness_rating').isin(list(satisfied)))
    rec_yes = F.count_if(F.col('would_recommend') == 'Yes')
    rec_n = F.count('would_recommend')
    return df.agg(
        n.alias('total_responses'),
        F.avg('effectiveness_score').alias('avg_effectiveness_score'),
        (sat * 100.0 / n).alias('satisfaction_rate'),
        F.when(rec_n > 0, rec_yes * 100.0 / rec_n).alias('recommendation_rate'),
        F.count_distinct('school_name').alias('unique_schools'),
    )


def score_by(df: DataFrame, key: str, score: str = 'effectiveness_score', with_std: bool = True,
             digits: int | None = 2) -> DataFrame:
    """A2 / A3 / A5: mean, non-null count and sample std of the score per key."""
    aggs = [F.avg(score).alias('mean'), F.count(score).alias('count')]
    if with_std:
        aggs.append(F.stddev_samp(score).alias('std'))
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    if digits is not None:
        out = out.select(key, *[C.half_even(c, digits).alias(c) if c != 'count' else F.col(c)
                                for c in out.columns if c != key])
    return out


def score_by_month(df: DataFrame, date_col: str = 'submission_date', score: str = 'effectiveness_score',
                   digits: int | None = 2) -> DataFrame:
    """A4: monthly mean and count (C8 month bucket), ordered by month."""
    m = df.withColumn('month', C.month_bucket(date_col))
    return score_by(m, 'month', score, with_std=False, digits=digits).orderBy('month')


def learning_outcomes(df: DataFrame, cols: Mapping[str, str] | None = None) -> DataFrame:
    """Mean of each Likert column (one row)."""
    cols = cols or {'identifying_dangers': 'confident_identifying_dangers',
                    'understanding_grooming': 'understanding_grooming',
                    'online_vs_real_friends': 'understanding_online_vs_real'}
    return df.agg(*[F.avg(src).alias(name) for name, src in cols.items()])


def completeness(df: DataFrame, min_missing_pct: float = 20.0) -> DataFrame:
    """% null per column in one pass, unpivoted; keeps columns above the threshold."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], 'field string, missing_percentage double')
    wide = df.agg(*[(F.avg(F.col(f'`{c}`').isNull().cast('double')) * 100.0).alias(f'c{i}')
                    for i, c in enumerate(df.columns)])
    pairs = ', '.join(f"'{c.replace(chr(39), chr(39) * 2)}', c{i}" for i, c in enumerate(df.columns))
    long = wide.selectExpr(f'stack({len(df.columns)}, {pairs}) AS (field, missing_percentage)')
    return long.filter(F.col('missing_percentage') > F.lit(float(min_missing_pct)))


def session_totals(sessions: DataFrame) -> DataFrame:
    """Total sessions and distinct types / months / sources."""
    return sessions.agg(F.sum('count').alias('total_sessions'),
                        F.count_distinct('session_type').alias('unique_session_types'),
                        F.count_distinct('month').alias('months_active'),
                        F.count_distinct('data_source').alias('data_sources'))


def sum_by(df: DataFrame, key: str, value: str = 'count', ascending: bool = False,
           order_by_key: bool = False) -> DataFrame:
    """Sum per key (nulls dropped), sorted by total or by key."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias('total'))
    if order_by_key:
        return out.orderBy(key)
    return out.orderBy(F.col('total').asc() if ascending else F.col('total').desc(), F.col(key))


def latest_non_null(value: str, date_col: str, order_col: str) -> Column:
    """Latest non-null value by date; rows without a date sort last (so they win)."""
    # undated rows rank highest (true > false); among them the order column decides
    key = F.struct(F.col(date_col).isNull(), F.col(date_col), F.col(order_col))
    return F.max_by(F.when(F.col(value).isNotNull(), F.col(value)),
                    F.when(F.col(value).isNotNull(), key))


def visit_summary(bookings: DataFrame, site: str, date_col: str, order_col: str,
                  latest: Mapping[str, str] | None = None) -> DataFrame:
    """A12 + A13 + A14: one row per site: visit_count, first/last visit, latest attributes."""
    latest = latest or {}
    aggs = [F.count(F.lit(1)).alias('visit_count'), F.min(date_col).alias('first_visit'),
            F.max(date_col).alias('last_visit')]
    aggs += [latest_non_null(src, date_col, order_col).alias(name) for name, src in latest.items()]
    return bookings.filter(F.col(site).isNotNull()).groupBy(site).agg(*aggs)


def visit_bands(summary: DataFrame) -> DataFrame:
    """Site counts per visit band (1, >=2, >=3 and 1, 2-3, >=4)."""
    v = F.col('visit_count')
    return summary.agg(F.count(F.lit(1)).alias('total_sites'),
                       F.count_if(v == 1).alias('one_visit'), F.count_if(v >= 2).alias('two_plus'),
                       F.count_if(v >= 3).alias('three_plus'),
                       F.count_if((v >= 2) & (v <= 3)).alias('two_to_three'),
                       F.count_if(v >= 4).alias('four_plus'))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Count per key and its % of all rows (null keys in the denominator)."""
    total = df.agg(F.count(F.lit(1)).alias('_total'))
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias('count'))
    return (counts.crossJoin(F.broadcast(total))
                  .withColumn('pct', F.col('count') * 100.0 / F.col('_total')).drop('_total'))


def repeat_bookings(bookings: DataFrame, answer: str, repeat_value: str) -> DataFrame:
    """A16 (+P17): totals of repeat vs new bookings and their % of all bookings."""
    rep = C.equals_flag(answer, repeat_value)
    n = F.count(F.lit(1))
    return bookings.agg(n.alias('total_bookings'),
                        F.count_if(rep).alias('repeat_bookings'),
                        F.count_if(~rep).alias('new_bookings'),
                        (F.count_if(rep) * 100.0 / n).alias('repeat_pct'),
                        (F.count_if(~rep) * 100.0 / n).alias('new_pct'))


def booking_overview(bookings: DataFrame, site: str, date_col: str) -> DataFrame:
    """Distinct sites and the date range."""
    return bookings.agg(F.count_distinct(site).alias('unique_sites'),
                        F.min(date_col).alias('first_date'), F.max(date_col).alias('last_date'))


def geocode_stats(geocoded: DataFrame) -> DataFrame:
    """Success count / %, failures, and confidence counts."""
    n = F.count(F.lit(1))
    ok = F.count_if(F.col('geocoded'))
    return geocoded.agg(n.alias('total'), ok.alias('geocoded'), (n - ok).alias('failed'),
                        (ok * 100.0 / n).alias('success_pct'),
                        F.count_if(F.col('geocode_confidence') == 'high').alias('high_confidence'),
                        F.count_if(F.col('geocode_confidence') == 'medium').alias('medium_confidence'))


def registry_quality(registry: DataFrame) -> DataFrame:
    """Rows, rows with valid coordinates, rows with FSM data."""
    return registry.agg(F.count(F.lit(1)).alias('rows'),
                        F.count_if(F.col('gias_lat').isNotNull() & F.col('gias_lon').isNotNull())
                        .alias('with_coordinates'),
                        F.count_if(F.col('fsm_percentage').isNotNull()).alias('with_fsm'))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Value counts of one column (nulls dropped), descending then by value."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias('count'))
              .orderBy(F.col('count').desc(), F.col(key)))


def table_profile(df: DataFrame, name: str = 'table') -> DataFrame:
    """One row per column: dtype, non-null count, total rows (one pass)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias('_rows'), *[F.count(F.col(f'`{c}`')).alias(f'c{i}')
                                                       for i, c in enumerate(cols)])
    dtypes = dict(df.dtypes)
    pairs = ', '.join(f"'{c}', '{dtypes[c]}', {i}, c{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"'{name}' AS table_name", '_rows AS rows',
                           f'stack({len(cols)}, {pairs}) AS (column_name, dtype, position, non_null)')


def load_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and date range (first column containing 'date') per table."""
    parts = []
    for name, df in tables.items():
        date_cols = [c for c in df.columns if 'date' in c.lower()]
        if date_cols:
            d = C.to_timestamp_any(F.col(f'`{date_cols[0]}`')) if dict(df.dtypes)[date_cols[0]] == 'string' \
                else F.col(f'`{date_cols[0]}`').cast('timestamp_ntz')
            agg = df.agg(F.count(F.lit(1)).alias('rows'), F.min(d).alias('date_start'), F.max(d).alias('date_end'))
        else:
            agg = df.agg(F.count(F.lit(1)).alias('rows'),
                         F.lit(None).cast('timestamp_ntz').alias('date_start'),
                         F.lit(None).cast('timestamp_ntz').alias('date_end'))
        parts.append(agg.select(F.lit(name).alias('table_name'), 'rows',
                                F.lit(len(df.columns)).alias('columns'), 'date_start', 'date_end'))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def head_rows(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order (a top-k: each task
    keeps its n best rows, so it never gathers a table)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).limit(n)
