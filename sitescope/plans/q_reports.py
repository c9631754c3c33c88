"""Composite reports (L13, A23, L14, L15, V6); their SQL joins the oracles of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import lexicons as lx
from sitescope.operators import composites as K
from sitescope.plans import bindings as B
from sitescope.operators import reports as R
from sitescope.plans.q_geo import CLUSTERS_SQL, points
from sitescope.plans import q_misc  # noqa: F401 - registers the parts first
from sitescope.plans.q_survey import survey  # noqa: F401 - registers the parts first
from sitescope.plans.q_text import convs, docs
from sitescope.plans.registry import ORACLE, QUERIES, register


def _part(section: str, key: str, item: str) -> str:
    return f"SELECT '{section}' AS section, {item} AS item, count FROM ({ORACLE[key]})"


A23_SQL = f"""
SELECT 'overview' AS section, 'total_responses' AS item, count(text) AS count FROM documents
UNION ALL {_part('keywords', 'A18_keywords', 'word')}
UNION ALL {_part('bigrams', 'A19_bigrams', 'ngram')}
UNION ALL {_part('themes', 'A20_positive_themes', 'theme')}"""


@register('A23_positive_summary', A23_SQL)
def positive_summary(spark, d):
    """Keywords, bigrams and themes of the positive-feedback text."""
    return K.positive_summary(docs(spark, d), 'text', 'doc_id', lx.POSITIVE_THEMES)


@register('L13_text_report', f"""{A23_SQL}
UNION ALL SELECT 'suggestions', item, count FROM (
  UNPIVOT ({ORACLE['A22_suggestion_summary']}) ON COLUMNS(*) INTO NAME item VALUE count)
UNION ALL {_part('improvement_themes', 'A21_improvement_themes', 'theme')}""")
def text_report(spark, d):
    """Positive summary, suggestion summary and improvement themes."""
    return K.text_report(docs(spark, d), convs(spark, d), 'text', 'doc_id', lx.POSITIVE_THEMES, lx.IMPROVEMENT_THEMES)


def _metrics(section: str, key: str, names: list[str]) -> str:
    rows = ', '.join(f"('{n}', CAST({n} AS DOUBLE))" for n in names)
    return (f"SELECT '{section}' AS section, CAST(NULL AS VARCHAR) AS key, m AS metric, v AS value "
            f"FROM ({ORACLE[key]}) t, LATERAL (VALUES {rows}) AS x(m, v)")


@register('L14_geo_report', ' UNION ALL '.join([
    _metrics('geographic_metrics', 'A29_extent_metrics', ['total_points', 'lat_min', 'lat_max', 'lat_span', 'lon_min', 'lon_max',
                                                          'lon_span', 'centroid_lat', 'centroid_lon']),
    _metrics('coverage', 'A30_hull_area', ['hull_vertices', 'coverage_area_km2']),
    _metrics('coverage_gaps', 'A31_coverage_gaps', ['avg_nearest_distance_km', 'max_nearest_distance_km', 'schools_beyond_target'])]))
def geo_report(spark, d):
    """Extent, hull area and coverage gaps of all sites."""
    return K.geo_report(points(spark, d), 'school_name').drop('label')


@register('L15_booking_report', f"""
WITH s AS ({ORACLE['A12_visit_summary']}),
g AS (SELECT c_custkey, c_name, 49.0 + (CAST(100000 + (c_custkey * 104729) % 400000 AS DOUBLE) + 100000.0) / 111000.0 AS latitude,
             CAST(300000 + (c_custkey * 7919) % 300000 AS DOUBLE) AS easting FROM customer)
SELECT c_name AS school_name, s.*, latitude,
       -2.0 + (easting - 400000.0) / (111000.0 * cos(radians(latitude))) AS longitude
FROM s LEFT JOIN g ON g.c_custkey = s.site_key""")
def booking_report(spark, d):
    """Every site's visits, latest answers and coordinates."""
    sites = B.registry(spark, d).select(F.col('gias_urn').alias('site_key'), F.col('gias_name').alias('school_name'),
                                        F.col('gias_lat').alias('latitude'), F.col('gias_lon').alias('longitude'))
    return K.booking_report(B.bookings(spark, d), sites, 'site_key', 'submission_date', 'booking_ord',
                            {'how_heard': 'answer', 'contact_person': 'contact'}, 'school_name')


@register('V6_clustered_export', f"""{CLUSTERS_SQL}
SELECT a.school_name, a.latitude, a.longitude, a.cluster, v.visit_count, c.x AS centroid_lat, c.y AS centroid_lon
FROM assigned a JOIN centres c USING (cluster) JOIN visg v USING (school_name)""")
def clustered_export(spark, d):
    """V6: sites with cluster and centroid."""
    return K.clustered_export(points(spark, d))


_NO = "list_position(['data_collection', 'workshop_content', 'delivery_optimization', 'geographic_expansion'], category)"
LINES_SQL = f"""
SELECT DISTINCT {_NO} AS section_no, 0 AS line_no, upper(replace(category, '_', ' ')) AS line FROM ({ORACLE['L16_recommendations']})
UNION ALL SELECT {_NO}, rank, CAST(rank AS VARCHAR) || '. ' || recommendation FROM ({ORACLE['L16_recommendations']})"""


@register('S10_recommendations', LINES_SQL)
def recommendation_document(spark, d):
    """Lines of the numbered recommendations document."""
    return R.recommendation_lines(QUERIES['L16_recommendations'](spark, d))


@register('S10_summary', f"""
WITH k AS ({ORACLE['A1_survey_kpis']}), s AS ({ORACLE['A8_session_totals']}), l AS ({LINES_SQL})
SELECT 101 AS section_no, n AS line_no, line FROM k, LATERAL (VALUES
  (0, 'Youth Feedback:'), (1, '  - Total responses: ' || total_responses),
  (2, '  - Average effectiveness: ' || printf('%.2f', avg_effectiveness_score) || '/5'),
  (3, '  - Satisfaction rate: ' || printf('%.1f', satisfaction_rate) || '%'), (4, '  - Unique schools: ' || unique_schools)) AS x(n, line)
UNION ALL
SELECT 102, n, line FROM s, LATERAL (VALUES (0, 'Session Delivery:'), (1, '  - Total sessions: ' || printf('%.0f', CAST(total_sessions AS DOUBLE))),
  (2, '  - Session types: ' || CAST(unique_session_types AS BIGINT))) AS x(n, line)
UNION ALL
SELECT section_no + 200, line_no, CASE WHEN line_no = 0 THEN
         array_to_string(list_transform(string_split(lower(line), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ':'
       ELSE regexp_replace(line, '^[0-9]+\\. ', '  - ') END FROM l WHERE line_no <= 3""")
def summary_document(spark, d):
    """Lines of the summary document, three recommendations a category."""
    return R.summary_lines(QUERIES['A1_survey_kpis'](spark, d), QUERIES['A8_session_totals'](spark, d),
                           QUERIES['L16_recommendations'](spark, d))
