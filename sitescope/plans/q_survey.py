"""Survey, session and booking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.operators import metrics as M
from sitescope.plans import bindings as B
from sitescope.plans import sqlparts as S
from sitescope.plans.registry import register

SURVEY_ROLES = {
    'submission_date': 'submission_date', 'age': 'age_answer', 'gender': 'gender_answer',
    'rating': 'rating_answer', 'speaker': 'speaker_answer', 'dangers': 'dangers_answer',
    'grooming': 'grooming_answer', 'online_vs_real': 'online_vs_real_answer',
    'recommend': 'recommend_answer', 'school': 'school_answer',
}


def survey(spark, d):
    return M.clean_survey(B.survey_raw(spark, d), SURVEY_ROLES, keep=['response_id'])


# The same survey, cleaned in SQL (independent restatement of C1-C7).
SURVEY_SQL = """
sraw AS (
  SELECT o_orderkey AS response_id, o_orderdate AS submission_date,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '11 - 13 years' WHEN 'BUILDING' THEN '14-16'
         WHEN 'FURNITURE' THEN '16+ (sixth form)' WHEN 'HOUSEHOLD' THEN '10 or under' ELSE 'Rather not say' END AS a,
    CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'Male' ELSE 'prefer not to say' END AS g,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Excellent - very effective' WHEN '2-HIGH' THEN 'Good'
         WHEN '3-MEDIUM' THEN 'Fair' WHEN '4-NOT SPECIFIED' THEN 'Very Poor' ELSE 'no answer' END AS r,
    CASE o_orderstatus WHEN 'F' THEN 'Yes, definitely' WHEN 'O' THEN 'I don''t know' ELSE NULL END AS sp,
    CAST(o_orderkey % 5 + 1 AS VARCHAR) AS lk, o_orderpriority AS pr,
    CASE WHEN o_totalprice > 150000 THEN 'yes' ELSE 'No' END AS rec, c_name
  FROM orders JOIN customer ON o_custkey = c_custkey),
sv AS (
  SELECT response_id, submission_date,
    CASE WHEN contains(a, '11 - 13') OR contains(a, '11-13') THEN '11-13'
         WHEN contains(a, '14 - 16') OR contains(a, '14-16') THEN '14-16'
         WHEN contains(a, '16+') THEN '16+' WHEN contains(a, '10 or under') THEN '10 or under' ELSE a END AS age_group,
    CASE WHEN contains(lower(g), 'male') AND NOT contains(lower(g), 'female') THEN 'Male'
         WHEN contains(lower(g), 'female') THEN 'Female' WHEN contains(lower(g), 'prefer not') THEN 'Prefer not to say'
         WHEN contains(lower(g), 'other') THEN 'Other' ELSE upper(substr(g, 1, 1)) || lower(substr(g, 2)) END AS gender,
    CASE WHEN contains(r, 'Excellent') THEN 'Excellent' WHEN contains(r, 'Good') THEN 'Good'
         WHEN contains(r, 'Fair') THEN 'Fair' WHEN contains(r, 'Poor') THEN 'Poor' END AS effectiveness_rating,
    CASE WHEN contains(lower(sp), 'yes') THEN 'Yes' WHEN contains(lower(sp), 'no') THEN 'No' END
      AS external_speaker_engaging,
    CAST(lk AS DOUBLE) AS confident_identifying_dangers,
    CASE WHEN pr <> '5-LOW' THEN CAST(lk AS DOUBLE) END AS understanding_grooming,
    CAST(NULL AS DOUBLE) AS understanding_online_vs_real,
    CASE WHEN contains(lower(rec), 'yes') THEN 'Yes' WHEN contains(lower(rec), 'no') THEN 'No' END AS would_recommend,
    c_name AS school_name,
    CAST(NULL AS VARCHAR) AS liked_most, CAST(NULL AS VARCHAR) AS improvements, CAST(NULL AS VARCHAR) AS additions
  FROM sraw),
svs AS (
  SELECT *, CASE effectiveness_rating WHEN 'Excellent' THEN 5 WHEN 'Good' THEN 4 WHEN 'Fair' THEN 3
                 WHEN 'Poor' THEN 2 WHEN 'Very Poor' THEN 1 END AS effectiveness_score
  FROM sv)
"""


@register('L8_clean_survey', f"""
WITH {SURVEY_SQL}
SELECT response_id, submission_date, age_group, gender, effectiveness_rating, effectiveness_score,
       external_speaker_engaging, confident_identifying_dangers, understanding_grooming,
       understanding_online_vs_real, would_recommend, school_name, liked_most, improvements, additions
FROM svs""")
def clean_survey(spark, d):
    """C1-C7 applied to every raw survey answer."""
    return survey(spark, d)


@register('A1_survey_kpis', f"""
WITH {SURVEY_SQL}
SELECT count(*) AS total_responses, avg(effectiveness_score) AS avg_effectiveness_score,
       count(*) FILTER (WHERE effectiveness_rating IN ('Excellent', 'Good')) * 100.0 / count(*) AS satisfaction_rate,
       CASE WHEN count(would_recommend) > 0
            THEN count(*) FILTER (WHERE would_recommend = 'Yes') * 100.0 / count(would_recommend) END
         AS recommendation_rate,
       count(DISTINCT school_name) AS unique_schools
FROM svs""")
def survey_kpis(spark, d):
    return M.survey_kpis(survey(spark, d))


def _score_by_sql(key: str, with_std: bool = True) -> str:
    std = ', round_even(stddev_samp(effectiveness_score), 2) AS std' if with_std else ''
    return f"""
WITH {SURVEY_SQL}
SELECT {key}, round_even(avg(effectiveness_score), 2) AS mean, count(effectiveness_score) AS count{std}
FROM svs WHERE {key} IS NOT NULL GROUP BY {key}"""


@register('A2_score_by_age', _score_by_sql('age_group'))
def score_by_age(spark, d):
    return M.score_by(survey(spark, d), 'age_group')


@register('A3_score_by_gender', _score_by_sql('gender'))
def score_by_gender(spark, d):
    return M.score_by(survey(spark, d), 'gender')


@register('A4_score_by_month', f"""
WITH {SURVEY_SQL}
SELECT CAST(date_trunc('month', submission_date) AS DATE) AS month,
       round_even(avg(effectiveness_score), 2) AS mean, count(effectiveness_score) AS count
FROM svs WHERE submission_date IS NOT NULL GROUP BY 1""")
def score_by_month(spark, d):
    return M.score_by_month(survey(spark, d))


@register('A5_score_by_speaker', _score_by_sql('external_speaker_engaging', with_std=False))
def score_by_speaker(spark, d):
    return M.score_by(survey(spark, d), 'external_speaker_engaging', with_std=False)


@register('A6_learning_outcomes', f"""
WITH {SURVEY_SQL}
SELECT avg(confident_identifying_dangers) AS identifying_dangers,
       avg(understanding_grooming) AS understanding_grooming,
       avg(understanding_online_vs_real) AS online_vs_real_friends
FROM svs""")
def learning_outcomes(spark, d):
    return M.learning_outcomes(survey(spark, d))


_SURVEY_OUT = ('response_id, submission_date, age_group, gender, effectiveness_rating, effectiveness_score, '
               'external_speaker_engaging, confident_identifying_dangers, understanding_grooming, '
               'understanding_online_vs_real, would_recommend, school_name, liked_most, improvements, additions')


@register('A7_completeness', f"""
WITH {SURVEY_SQL}, t AS (SELECT {_SURVEY_OUT} FROM svs),
u AS (UNPIVOT (SELECT {', '.join(f'avg(CASE WHEN {c.strip()} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS {c.strip()}'
                                for c in _SURVEY_OUT.split(','))} FROM t)
      ON COLUMNS(*) INTO NAME field VALUE missing_percentage)
SELECT field, missing_percentage FROM u WHERE missing_percentage > 20.0""")
def completeness(spark, d):
    return M.completeness(survey(spark, d))


# --------------------------------------------------------------------------- sessions

SESSIONS_SQL = """
ses AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, o_orderpriority AS session_type,
               1.0 AS count, o_orderstatus AS data_source FROM orders)
"""


@register('A8_session_totals', f"""
WITH {SESSIONS_SQL}
SELECT sum(count) AS total_sessions, count(DISTINCT session_type) AS unique_session_types,
       count(DISTINCT month) AS months_active, count(DISTINCT data_source) AS data_sources FROM ses""")
def session_totals(spark, d):
    return M.session_totals(B.sessions(spark, d))


@register('A9_sessions_by_type', f"""
WITH {SESSIONS_SQL} SELECT session_type, sum(count) AS total FROM ses GROUP BY 1""")
def sessions_by_type(spark, d):
    return M.sum_by(B.sessions(spark, d), 'session_type')


@register('A10_sessions_by_source', f"""
WITH {SESSIONS_SQL} SELECT data_source, sum(count) AS total FROM ses GROUP BY 1""")
def sessions_by_source(spark, d):
    return M.sum_by(B.sessions(spark, d), 'data_source')


@register('A11_sessions_by_month', f"""
WITH {SESSIONS_SQL} SELECT month, sum(count) AS total FROM ses GROUP BY 1""")
def sessions_by_month(spark, d):
    return M.sum_by(B.sessions(spark, d), 'month', order_by_key=True)


# --------------------------------------------------------------------------- bookings

@register('A12_visit_summary', """
SELECT o_custkey AS site_key, count(*) AS visit_count, min(o_orderdate) AS first_visit,
       max(o_orderdate) AS last_visit,
       arg_max(o_orderpriority, (o_orderdate IS NULL, coalesce(o_orderdate, TIMESTAMP '1970-01-01'), o_orderkey))
         FILTER (WHERE o_orderpriority IS NOT NULL) AS how_heard,
       arg_max(o_orderstatus, (o_orderdate IS NULL, coalesce(o_orderdate, TIMESTAMP '1970-01-01'), o_orderkey))
         FILTER (WHERE o_orderstatus IS NOT NULL) AS contact_person
FROM orders GROUP BY o_custkey""")
def visit_summary(spark, d):
    """Visits, first/last visit, latest answer and contact per site."""
    return M.visit_summary(B.bookings(spark, d), 'site_key', 'submission_date', 'booking_ord',
                           {'how_heard': 'answer', 'contact_person': 'contact'})


@register('A15_visit_bands', """
WITH s AS (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1)
SELECT count(*) AS total_sites, count(*) FILTER (WHERE v = 1) AS one_visit, count(*) FILTER (WHERE v >= 2) AS two_plus,
       count(*) FILTER (WHERE v >= 3) AS three_plus, count(*) FILTER (WHERE v BETWEEN 2 AND 3) AS two_to_three,
       count(*) FILTER (WHERE v >= 4) AS four_plus FROM s""")
def visit_bands(spark, d):
    b = B.bookings(spark, d)
    return M.visit_bands(M.visit_summary(b, 'site_key', 'submission_date', 'booking_ord'))


@register('A16_repeat_bookings', f"""
SELECT count(*) AS total_bookings,
       count(*) FILTER (WHERE coalesce(o_orderpriority = '{B.REPEAT_ANSWER}', false)) AS repeat_bookings,
       count(*) FILTER (WHERE NOT coalesce(o_orderpriority = '{B.REPEAT_ANSWER}', false)) AS new_bookings,
       count(*) FILTER (WHERE coalesce(o_orderpriority = '{B.REPEAT_ANSWER}', false)) * 100.0 / count(*) AS repeat_pct,
       count(*) FILTER (WHERE NOT coalesce(o_orderpriority = '{B.REPEAT_ANSWER}', false)) * 100.0 / count(*) AS new_pct
FROM orders""")
def repeat_bookings(spark, d):
    return M.repeat_bookings(B.bookings(spark, d), 'answer', B.REPEAT_ANSWER)


@register('W4_booking_sources', """
SELECT o_orderpriority AS answer, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM orders) AS pct
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def booking_sources(spark, d):
    """A16 source breakdown: count and share of all bookings per answer."""
    return M.share_of_total(B.bookings(spark, d), 'answer')


@register('A17_booking_overview', """
SELECT count(DISTINCT o_custkey) AS unique_sites, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
FROM orders""")
def booking_overview(spark, d):
    return M.booking_overview(B.bookings(spark, d), 'site_key', 'submission_date')


@register('A36_registry_quality', f"""
WITH {S.REGISTRY}
SELECT count(*) AS rows, count(*) FILTER (WHERE gias_lat IS NOT NULL AND gias_lon IS NOT NULL) AS with_coordinates,
       count(*) FILTER (WHERE fsm_percentage IS NOT NULL) AS with_fsm FROM reg""")
def registry_quality(spark, d):
    return M.registry_quality(B.registry(spark, d))


@register('A36_trust_counts', f"""
WITH {S.REGISTRY} SELECT trust_name, count(*) AS count FROM reg WHERE trust_name IS NOT NULL GROUP BY 1""")
def trust_counts(spark, d):
    """Value counts of the registry's grouping column."""
    return M.value_counts(B.registry(spark, d), 'trust_name')


@register('S12_profile_labels', """
WITH t AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_labels' AS table_name, (SELECT count(*) FROM t) AS rows, column_name, dtype, position, non_null
FROM (VALUES ('doc_id', 'bigint', 0), ('lang', 'string', 1), ('source', 'string', 2), ('n_chars', 'bigint', 3),
             ('quality', 'int', 4), ('toxic', 'int', 5)) v(column_name, dtype, position)
JOIN (SELECT count(doc_id) AS c0, count(lang) AS c1, count(source) AS c2, count(n_chars) AS c3,
             count(quality) AS c4, count(toxic) AS c5 FROM t) c ON true
CROSS JOIN LATERAL (SELECT CASE position WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3
                                         WHEN 4 THEN c4 ELSE c5 END AS non_null)""")
def profile_labels(spark, d):
    """S12 on documents left-joined to labels (real nulls)."""
    docs = B.table(spark, d, 'documents').select('doc_id', 'lang', 'source', 'n_chars')
    lab = B.table(spark, d, 'labels').select('doc_id', 'quality', 'toxic')
    return M.table_profile(docs.join(lab, 'doc_id', 'left'), 'doc_labels')


@register('S13_load_summary', """
SELECT 'orders' AS table_name, count(*) AS rows, 6 AS columns, min(o_orderdate) AS date_start,
       max(o_orderdate) AS date_end FROM orders
UNION ALL SELECT 'lineitem', count(*), 11, min(l_shipdate), max(l_shipdate) FROM lineitem
UNION ALL SELECT 'customer', count(*), 5, NULL, NULL FROM customer""")
def load_summary(spark, d):
    names = ['orders', 'lineitem', 'customer']
    return M.load_summary({n: B.table(spark, d, n) for n in names})


def _lab(m: str) -> str:
    return ' '.join(w[:1].upper() + w[1:] for w in m.split('_'))


def _long_sql(section: str, src: str, key: str | None, metrics: list[str]) -> str:
    k = f'CAST({key} AS VARCHAR)' if key else 'CAST(NULL AS VARCHAR)'
    return ' UNION ALL '.join(
        f"SELECT '{section}' AS section, {k} AS key, '{m}' AS metric, '{_lab(m)}' AS label, CAST({m} AS DOUBLE) AS value "
        f"FROM ({src})" for m in metrics)


@register('L10_effectiveness_report', f"""
WITH {SURVEY_SQL},
kpi AS (SELECT count(*) AS total_responses, avg(effectiveness_score) AS avg_effectiveness_score,
               count(*) FILTER (WHERE effectiveness_rating IN ('Excellent', 'Good')) * 100.0 / count(*) AS satisfaction_rate,
               CASE WHEN count(would_recommend) > 0
                    THEN count(*) FILTER (WHERE would_recommend = 'Yes') * 100.0 / count(would_recommend) END
                 AS recommendation_rate, count(DISTINCT school_name) AS unique_schools FROM svs),
age AS (SELECT age_group, round_even(avg(effectiveness_score), 2) AS mean, count(effectiveness_score) AS count,
               round_even(stddev_samp(effectiveness_score), 2) AS std FROM svs WHERE age_group IS NOT NULL GROUP BY 1),
gen AS (SELECT gender, round_even(avg(effectiveness_score), 2) AS mean, count(effectiveness_score) AS count,
               round_even(stddev_samp(effectiveness_score), 2) AS std FROM svs WHERE gender IS NOT NULL GROUP BY 1),
mon AS (SELECT CAST(date_trunc('month', submission_date) AS DATE) AS month, round_even(avg(effectiveness_score), 2) AS mean,
               count(effectiveness_score) AS count FROM svs WHERE submission_date IS NOT NULL GROUP BY 1),
spk AS (SELECT external_speaker_engaging, round_even(avg(effectiveness_score), 2) AS mean,
               count(effectiveness_score) AS count FROM svs WHERE external_speaker_engaging IS NOT NULL GROUP BY 1),
lo AS (SELECT avg(confident_identifying_dangers) AS identifying_dangers, avg(understanding_grooming) AS understanding_grooming,
              avg(understanding_online_vs_real) AS online_vs_real_friends FROM svs)
{_long_sql('overall_metrics', 'SELECT * FROM kpi', None, ['total_responses', 'avg_effectiveness_score', 'satisfaction_rate', 'recommendation_rate', 'unique_schools'])}
UNION ALL {_long_sql('by_age_group', 'SELECT * FROM age', 'age_group', ['mean', 'count', 'std'])}
UNION ALL {_long_sql('by_gender', 'SELECT * FROM gen', 'gender', ['mean', 'count', 'std'])}
UNION ALL {_long_sql('temporal_trends', 'SELECT * FROM mon', 'month', ['mean', 'count'])}
UNION ALL {_long_sql('external_speaker', 'SELECT * FROM spk', 'external_speaker_engaging', ['mean', 'count'])}
UNION ALL {_long_sql('learning_outcomes', 'SELECT * FROM lo', None, ['identifying_dangers', 'understanding_grooming', 'online_vs_real_friends'])}""")
def effectiveness_report(spark, d):
    """Effectiveness report (A1-A6) as one long metric table."""
    from sitescope.operators.reports import effectiveness_report as rep
    return rep(survey(spark, d))


@register('L11_session_report', f"""
WITH {SESSIONS_SQL},
tot AS (SELECT sum(count) AS total_sessions, count(DISTINCT session_type) AS unique_session_types,
               count(DISTINCT month) AS months_active, count(DISTINCT data_source) AS data_sources FROM ses),
bt AS (SELECT session_type, sum(count) AS total FROM ses GROUP BY 1),
bs AS (SELECT data_source, sum(count) AS total FROM ses GROUP BY 1),
bm AS (SELECT month, sum(count) AS total FROM ses GROUP BY 1)
{_long_sql('totals', 'SELECT * FROM tot', None, ['total_sessions', 'unique_session_types', 'months_active', 'data_sources'])}
UNION ALL {_long_sql('by_type', 'SELECT * FROM bt', 'session_type', ['total'])}
UNION ALL {_long_sql('by_source', 'SELECT * FROM bs', 'data_source', ['total'])}
UNION ALL {_long_sql('monthly', 'SELECT * FROM bm', 'month', ['total'])}""")
def session_report(spark, d):
    """Session delivery report (A8-A11) as one long metric table."""
    from sitescope.operators.reports import session_report as rep
    return rep(B.sessions(spark, d))


@register('S12_first_rows', f"""
WITH {S.REGISTRY}
SELECT gias_urn, gias_name, trust_name, fsm_percentage FROM reg ORDER BY gias_urn LIMIT 10""")
def first_rows(spark, d):
    """The first ten registry rows (profile preview; the limit is the feature)."""
    r = B.registry(spark, d).select('gias_urn', 'gias_name', 'trust_name', 'fsm_percentage')
    return M.head_rows(r, ['gias_urn'], 10)


CATEGORY_TERMS = ('nation_1', 'nation_7')   # substring terms: 'nation_1' also matches NATION_10..19


@register('P6_category_filter', f"""
WITH {S.REGISTRY}
SELECT gias_urn, gias_name, trust_name FROM reg
WHERE {' OR '.join(f"coalesce(contains(lower(trust_name), '{t}'), false)" for t in CATEGORY_TERMS)}""")
def category_filter(spark, d):
    """Registry rows whose grouping value contains any of a term list (case-insensitive)."""
    from sitescope.functions.clean import contains_any
    r = B.registry(spark, d)
    return r.filter(contains_any('trust_name', CATEGORY_TERMS)).select('gias_urn', 'gias_name', 'trust_name')


@register('C9_bookings_per_year', """
SELECT year(o_orderdate) AS year, count(*) AS bookings FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def bookings_per_year(spark, d):
    """Bookings per calendar year."""
    from sitescope.functions.clean import year_part
    b = B.bookings(spark, d).filter(F.col('submission_date').isNotNull())
    return b.groupBy(year_part('submission_date').alias('year')).agg(F.count(F.lit(1)).alias('bookings'))
