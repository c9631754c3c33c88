"""Reshaping, top-k views, reports, rules and map feature tables
(R1, U1, U3, O4, O5, O7, L12, L16, V1, V2, V5, S14, P15, P16, P19, C29, C30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import clean as C
from sitescope.functions import lexicons as lx
from sitescope.operators import geo as G
from sitescope.operators import leads as L
from sitescope.operators import metrics as M
from sitescope.operators import reports as R
from sitescope.operators import textagg as X
from sitescope.plans import bindings as B
from sitescope.plans import sqlparts as S
from sitescope.plans import sqlrules as SR
from sitescope.plans.q_geo import CLUSTERS_SQL, GAPS_SQL, points
from sitescope.plans.q_leads import ALL_LEADS, CFG
from sitescope.plans.q_survey import SURVEY_SQL, _SURVEY_OUT, survey
from sitescope.plans.q_text import CONVS, DOCS, NOT_SUBST, convs, themes_sql
from sitescope.plans.registry import register
from sitescope.sources import reshape as RS
from sitescope.sources import sinks as K


def _wide_orders(spark, d, name, type_col):
    o = B.table(spark, d, 'orders').select(F.trunc('o_orderdate', 'month').alias('month'),
                                           F.col(type_col).alias('t'), F.lit(1).alias('n'))
    return RS.wide_sheet(o, name, 'month', 't', 'n')


@register('R1_sessions_from_wide', """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, o_orderpriority AS session_type,
       CAST(count(*) AS DOUBLE) AS count, 'sessions_by_priority' AS data_source
FROM orders GROUP BY 1, 2""")
def sessions_from_wide(spark, d):
    """A wide monthly session sheet (rendered from orders) parsed back to long facts."""
    return RS.sessions_from_wide(_wide_orders(spark, d, 'sessions_by_priority', 'o_orderpriority'))


@register('U1_union_sessions', """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, o_orderpriority AS session_type,
       CAST(count(*) AS DOUBLE) AS count, 'sessions_by_priority' AS data_source FROM orders GROUP BY 1, 2
UNION ALL
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP), o_orderstatus, CAST(count(*) AS DOUBLE), 'sessions_by_status'
FROM orders GROUP BY 1, 2""")
def union_sessions(spark, d):
    """Two session sheets parsed and unioned with their source tag."""
    raw = _wide_orders(spark, d, 'sessions_by_priority', 'o_orderpriority').unionByName(
        _wide_orders(spark, d, 'sessions_by_status', 'o_orderstatus'))
    return RS.union_sessions([RS.sessions_from_wide(raw)])


@register('U3_site_names', f"""
WITH {S.REGISTRY}, {S.SITES}
SELECT DISTINCT name FROM (SELECT school_name AS name FROM vis UNION ALL SELECT s_name FROM supplier)
WHERE name IS NOT NULL AND length(name) >= 4 ORDER BY name""")
def site_names(spark, d):
    """Sorted distinct plausible names from two tables."""
    a = B.sites(spark, d).select(F.col('school_name').alias('name'))
    b = B.table(spark, d, 'supplier').select(F.col('s_name').alias('name'))
    return a.unionByName(b).filter(C.plausible_name('name')).distinct().orderBy('name')


@register('O4_last_months', """
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(count(*) AS DOUBLE) AS total
FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 6""")
def last_months(spark, d):
    """The last six months of delivery."""
    return M.sum_by(B.sessions(spark, d), 'month', order_by_key=True).orderBy(F.col('month').desc()).limit(6)


@register('O5_top_sites', """
SELECT c_name AS school_name, count(*) AS visit_count FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_custkey, c_name ORDER BY visit_count DESC, school_name LIMIT 10""")
def top_sites(spark, d):
    """Top ten sites by bookings (ties by name)."""
    s = M.visit_summary(B.bookings(spark, d), 'site_key', 'submission_date', 'booking_ord')
    c = B.table(spark, d, 'customer').select(F.col('c_custkey').alias('site_key'), F.col('c_name').alias('school_name'))
    return (s.join(c, 'site_key').select('school_name', 'visit_count')
             .orderBy(F.col('visit_count').desc(), 'school_name').limit(10))


@register('L12_data_gaps', f"""
WITH {SURVEY_SQL}, t AS (SELECT {_SURVEY_OUT} FROM svs),
u AS (UNPIVOT (SELECT {', '.join(f'avg(CASE WHEN {c.strip()} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS {c.strip()}'
                                for c in _SURVEY_OUT.split(','))} FROM t)
      ON COLUMNS(*) INTO NAME field VALUE missing_percentage)
SELECT 'low_response_fields' AS section, field AS item, CAST(round(missing_percentage, 6) AS VARCHAR) AS detail
FROM u WHERE missing_percentage > 20.0
UNION ALL SELECT * FROM ({SR.gap_rows(False)})""")
def data_gaps(spark, d):
    """Low-response fields (A7) plus the fixed missing-data and suggestion rules."""
    return R.data_gap_report(survey(spark, d))


@register('L12_data_gaps_with_baseline', f"""
WITH {SURVEY_SQL}, t AS (SELECT {_SURVEY_OUT} FROM svs),
u AS (UNPIVOT (SELECT {', '.join(f'avg(CASE WHEN {c.strip()} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS {c.strip()}'
                                for c in _SURVEY_OUT.split(','))} FROM t)
      ON COLUMNS(*) INTO NAME field VALUE missing_percentage)
SELECT 'low_response_fields' AS section, field AS item, CAST(round(missing_percentage, 6) AS VARCHAR) AS detail
FROM u WHERE missing_percentage > 20.0
UNION ALL SELECT * FROM ({SR.gap_rows(True)})""")
def data_gaps_with_baseline(spark, d):
    """L12 where a pre-assessment table exists: no pre-assessment gap."""
    return R.data_gap_report(survey(spark, d), pre_assessment=B.bookings(spark, d))


@register('L16_recommendations', SR.recommendations(
    themes_sql(CONVS, lx.IMPROVEMENT_THEMES, where=f'NOT {NOT_SUBST}'), themes_sql(DOCS, lx.POSITIVE_THEMES), GAPS_SQL,
    "SELECT count(*) AS n_responses, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS n_speaker FROM orders"))
def recommendations(spark, d):
    """Rule table from improvement themes, the top positive theme, coverage gaps and the survey."""
    return _recommendations(spark, d, survey(spark, d))


@register('L16_recommendations_no_speaker', SR.recommendations(
    themes_sql(CONVS, lx.IMPROVEMENT_THEMES, where=f'NOT {NOT_SUBST}'), themes_sql(DOCS, lx.POSITIVE_THEMES), GAPS_SQL,
    "SELECT count(*) AS n_responses, 0 AS n_speaker FROM orders"))
def recommendations_no_speaker(spark, d):
    """L16 over a survey whose speaker column has no answer: no external-speaker rule."""
    return _recommendations(spark, d, survey(spark, d).withColumn('external_speaker_engaging', F.lit(None).cast('string')))


def _recommendations(spark, d, answers):
    improve = X.theme_counts(X.substantive(convs(spark, d), 'text'), 'text', lx.IMPROVEMENT_THEMES)
    positive = X.theme_counts(B.documents(spark, d), 'text', lx.POSITIVE_THEMES)
    _, gaps = G.coverage_gaps(points(spark, d), 'school_name', 50.0)
    return R.recommendations(improve, positive, gaps, answers)


@register('V1_site_markers', f"""
WITH {S.REGISTRY}, {S.SITES}
SELECT school_name, latitude, longitude, visit_count,
       CASE WHEN visit_count IS NULL THEN 'unknown' WHEN visit_count <= 1 THEN 'single'
            WHEN visit_count <= 3 THEN 'repeat' ELSE 'frequent' END AS visit_band,
       CASE WHEN visit_count IS NULL THEN 'unknown' WHEN visit_count >= 2 THEN 'champion' ELSE 'visited' END AS layer,
       concat_ws(chr(10), school_name, 'Approach: ' || how_heard, 'Visits: ' || CAST(visit_count AS VARCHAR)) AS popup
FROM visg LEFT JOIN (
  SELECT c_name AS school_name, arg_max(o_orderpriority, (o_orderdate IS NULL, coalesce(o_orderdate, TIMESTAMP '1970-01-01'), o_orderkey))
           FILTER (WHERE o_orderpriority IS NOT NULL) AS how_heard
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name) USING (school_name)
WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def site_markers(spark, d):
    """V1 + P16 + C30: visited-site marker table (band, layer, popup)."""
    heard = M.visit_summary(B.bookings(spark, d), 'site_key', 'submission_date', 'booking_ord', {'how_heard': 'answer'})
    names = B.table(spark, d, 'customer').select(F.col('c_custkey').alias('site_key'), F.col('c_name').alias('school_name'))
    heard = heard.join(names, 'site_key').select('school_name', 'how_heard')
    return R.site_markers(B.sites(spark, d).join(heard, 'school_name', 'left'))


V2_SQL = f"""
WITH n AS ({S.leads_normal(CFG.hotspot_radius_km, top_n=None)}), dep AS ({S.leads_deprived(top_n=None)}),
both_layers AS (SELECT * RENAME (priority_score AS score) FROM n UNION ALL SELECT * RENAME (impact_score AS score) FROM dep)
SELECT gias_urn, gias_name, gias_lat, gias_lon, lead_category AS layer,
       concat_ws(chr(10), gias_name, 'Trust: ' || trust_name, 'Type: ' || lead_type, 'Source: ' || lead_source, 'FSM: ' || printf('%.1f', fsm_percentage) || '%',
                 'Nearest champion: ' || nearest_champion || ' (' || printf('%.1f', distance_to_champion_km) || ' km)',
                 'Score: ' || printf('%.1f', score)) AS popup
FROM both_layers WHERE gias_lat IS NOT NULL AND gias_lon IS NOT NULL"""


@register('V2_lead_markers', V2_SQL)
def lead_markers(spark, d):
    """V2 + C30: marker table for both lead layers."""
    r, v = B.registry(spark, d), B.visited_sites(spark, d)
    normal = L.normal_leads(r, v, ALL_LEADS).withColumnRenamed('priority_score', 'score')
    deprived = L.deprived_area_leads(r, v, ALL_LEADS).withColumnRenamed('impact_score', 'score')
    return R.lead_markers(normal).unionByName(R.lead_markers(deprived))


@register('V5_cluster_scatter', f"""{CLUSTERS_SQL}
SELECT longitude, latitude, cluster, ({list(lx.CLUSTER_PALETTE)})[cluster % {len(lx.CLUSTER_PALETTE)} + 1] AS colour FROM assigned""")
def cluster_scatter(spark, d):
    """V5 + P19: scatter data (lon, lat, cluster colour) of k-means clusters."""
    assigned, _ = G.kmeans_clusters(points(spark, d), 5)
    return assigned.select('longitude', 'latitude', 'cluster', C.cluster_colour('cluster').alias('colour'))


@register('S14_lead_features')
def lead_features(spark, d):
    """GeoJSON feature lines for the normal leads (rows-only)."""
    leads = L.normal_leads(B.registry(spark, d), B.visited_sites(spark, d), ALL_LEADS)
    return K.geojson_features(leads, 'gias_lat', 'gias_lon',
                              ['gias_urn', 'gias_name', 'lead_type', 'nearest_champion', 'priority_score'])
