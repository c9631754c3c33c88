"""Report and rule tables (L10-L12, L16) and map feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitescope.functions import clean as C
from sitescope.functions import lexicons as lx
from sitescope.operators import metrics as M

# ---------------------------------------------------------------------------
# Data-collection gap rules and recommendation texts
# ---------------------------------------------------------------------------
MISSING_DATA_POINTS = (
    ('Pre-assessment', 'No baseline knowledge assessment before workshops', 'Cannot measure knowledge gain'),
    ('Follow-up', 'No 3-month or 6-month follow-up surveys', 'Cannot measure behavior change or knowledge retention'),
    ('Geographic', 'School locations not geocoded', 'Cannot create heat maps or analyze geographic patterns'),
    ('Behavioral', 'No data on actual behavior change (reporting incidents, changing privacy settings)',
     'Cannot measure real-world application of learnings'),
)
SUGGESTED_ADDITIONS = (
    "Implement pre/post matched surveys with unique IDs",
    "Add 3-month follow-up survey to measure behavior change",
    "Collect school postcodes for geographic analysis",
    "Add questions about specific actions taken (e.g., 'Have you changed your privacy settings?')",
    "Include parental feedback surveys",
    "Track incident reporting rates in participating schools",
    "Add more demographic variables (ethnicity, SEN status) for equity analysis",
    "Include questions about specific online platforms used",
)
IMPROVEMENT_MESSAGE = "Address '{theme}' feedback - mentioned by {count} students"
STRENGTH_MESSAGE = "Continue emphasizing '{theme}' - most appreciated aspect"
DELIVERY_MESSAGES = (
    "Consider age-specific workshop adaptations based on effectiveness variations",
    "Prioritize external speaker delivery - shows positive impact on engagement",
)
ISOLATED_MESSAGE = "Identify {n} isolated schools for targeted outreach"
BEST_PRACTICES = (
    "Increase interactive elements (quiz, role-play scenarios)",
    "Add more visual content and real case examples",
    "Extend Q&A time for deeper discussion",
)


def data_gap_report(survey: DataFrame, min_missing_pct: float = 20.0,
                    pre_assessment: DataFrame | None = None) -> DataFrame:
    """(section, item, detail): low-response fields from A7, then the
    missing-data rules and suggested additions. The pre-assessment rule applies
    only where no pre-assessment table is given."""
    low = M.completeness(survey, min_missing_pct).select(
        F.lit('low_response_fields').alias('section'), F.col('field').alias('item'),
        F.round('missing_percentage', 6).cast('string').alias('detail'))
    spark = survey.sparkSession
    fixed = [('missing_data_points', c, f'{d} - {i}') for c, d, i in MISSING_DATA_POINTS
             if pre_assessment is None or c != 'Pre-assessment']
    fixed += [('suggested_additions', str(k + 1), t) for k, t in enumerate(SUGGESTED_ADDITIONS)]
    return low.unionByName(spark.createDataFrame(fixed, 'section string, item string, detail string'))


def recommendations(improve_themes: DataFrame, positive_themes: DataFrame, gaps: DataFrame,
                    survey: DataFrame | None = None, top_improvements: int = 3) -> DataFrame:
    """(category, rank, recommendation) from the metric tables.

    Top improvement themes (count desc, then name), the single most frequent
    positive theme, the delivery rules, the isolated-site rule when any site is
    beyond the target, the fixed best practices and suggested additions.
    The age rule needs an effectiveness table (``survey``, cleaned), the
    external-speaker rule some non-null answer about the speaker in it.
    """
    spark = improve_themes.sparkSession
    imp = (improve_themes.orderBy(F.col('count').desc(), 'theme').limit(top_improvements)
           .select(F.lit('workshop_content').alias('category'), F.lit(1).alias('_g'),
                   F.col('count').alias('_c'), F.col('theme').alias('_k'),
                   F.format_string(IMPROVEMENT_MESSAGE.replace('{theme}', '%s').replace('{count}', '%d'),
                                   'theme', 'count').alias('recommendation')))
    pos = (positive_themes.orderBy(F.col('count').desc(), 'theme').limit(1)
           .select(F.lit('workshop_content').alias('category'), F.lit(2).alias('_g'),
                   F.col('count').alias('_c'), F.col('theme').alias('_k'),
                   F.format_string(STRENGTH_MESSAGE.replace('{theme}', '%s'), 'theme').alias('recommendation')))
    geo = (gaps.filter(F.col('schools_beyond_target') > 0)
           .select(F.lit('geographic_expansion').alias('category'), F.lit(1).alias('_g'), F.lit(0).cast('long').alias('_c'),
                   F.lit('').alias('_k'),
                   F.format_string(ISOLATED_MESSAGE.replace('{n}', '%d'), 'schools_beyond_target')
                   .alias('recommendation')))
    fixed = [('workshop_content', 3, 0, f'{i:02d}', t) for i, t in enumerate(BEST_PRACTICES)]
    fixed += [('data_collection', 1, 0, f'{i:02d}', t) for i, t in enumerate(SUGGESTED_ADDITIONS)]
    const = spark.createDataFrame(fixed, 'category string, _g int, _c long, _k string, recommendation string')
    allr = imp.unionByName(pos).unionByName(geo).unionByName(const)
    if survey is not None:
        has = survey.agg(F.lit(True).alias('age'), (F.count('external_speaker_engaging') > 0).alias('speaker'))
        for i, (flag, message) in enumerate(zip(('age', 'speaker'), DELIVERY_MESSAGES)):
            allr = allr.unionByName(has.filter(flag).select(
                F.lit('delivery_optimization').alias('category'), F.lit(1).alias('_g'), F.lit(0).cast('long').alias('_c'),
                F.lit(f'{i:02d}').alias('_k'), F.lit(message).alias('recommendation')))
    w = Window.partitionBy('category').orderBy('_g', F.col('_c').desc(), '_k')
    return allr.withColumn('rank', F.row_number().over(w)).select('category', 'rank', 'recommendation')


def site_markers(visited: DataFrame, min_visits: int = 2) -> DataFrame:
    """V1 + P16 + C30: marker rows for visited sites with coordinates.

    The popup also has how the site heard of the programme and its cluster,
    where ``visited`` has these columns; null fields drop out.
    """
    lines = [F.concat(F.lit(label), F.col(c).cast('string'))
             for c, label in (('how_heard', 'Approach: '), ('visit_count', 'Visits: '), ('cluster', 'Cluster: '))
             if c in visited.columns]
    popup = F.concat_ws('\n', F.col('school_name'), *lines)
    return (visited.filter(F.col('latitude').isNotNull() & F.col('longitude').isNotNull())
                   .select('school_name', 'latitude', 'longitude', 'visit_count',
                           C.visit_band('visit_count').alias('visit_band'),
                           C.champion_band('visit_count', min_visits).alias('layer'),
                           popup.alias('popup')))


def lead_markers(leads: DataFrame) -> DataFrame:
    """V2 + C30: marker rows for one lead layer (``score`` column), numbers as %.1f;
    null fields drop out of the popup."""
    f1 = lambda c: F.format_string('%.1f', F.col(c))
    popup = F.concat_ws(
        '\n', F.col('gias_name'), F.concat(F.lit('Trust: '), F.col('trust_name')),
        F.concat(F.lit('Type: '), F.col('lead_type')), F.concat(F.lit('Source: '), F.col('lead_source')),
        F.concat(F.lit('FSM: '), f1('fsm_percentage'), F.lit('%')),
        F.concat(F.lit('Nearest champion: '), F.col('nearest_champion'), F.lit(' ('),
                 f1('distance_to_champion_km'), F.lit(' km)')),
        F.concat(F.lit('Score: '), f1('score')))
    return (leads.filter(F.col('gias_lat').isNotNull() & F.col('gias_lon').isNotNull())
                 .select('gias_urn', 'gias_name', 'gias_lat', 'gias_lon', F.col('lead_category').alias('layer'),
                         popup.alias('popup')))


#: Section of the one group of all rows.
ALL = 'all'


def _grouped_once(df: DataFrame, sections: dict[str, str | Column], **aggs: Column) -> DataFrame:
    """(section, key, aggregates): all groupings of one table from one scan and one shuffle.

    Every row counts once in each section, under its key there; rows without a
    key stay out. The section ``ALL`` is one group of all rows.
    Partial aggregation leaves a task with at most one row a group.
    """
    cells = [F.struct(F.lit(s).alias('section'), (F.col(by) if isinstance(by, str) else by).cast('string').alias('key'))
             for s, by in [(ALL, F.lit('')), *sections.items()]]
    used = df.select('*', F.explode(F.array(*cells)).alias('_g'))
    return (used.filter(F.col('_g.key').isNotNull()).groupBy(F.col('_g.section').alias('section'), F.col('_g.key').alias('key'))
            .agg(*[c.alias(name) for name, c in aggs.items()]))


def _long(groups: DataFrame, parts: list[tuple], always: list[tuple]) -> DataFrame:
    """Metric table (section, key, metric, label, value) of grouped rows.

    ``parts``: (section of ``groups``, section of the table, metrics); with a
    dict of metrics each group is a row, with a list of them each group adds
    one (a count of distinct keys) to a row without a key. ``always``: (section,
    metric, value) of the rows there are without any input.
    """
    def rows(own: str, section: str, metrics: dict[str, Column] | list[str]) -> Column:
        counted = isinstance(metrics, list)
        found = dict.fromkeys(metrics, F.lit(1.0)) if counted else metrics
        key = F.lit(None).cast('string') if counted or own == ALL else F.col('key')
        cells = [F.struct(F.lit(section).alias('section'), key.alias('key'), F.lit(m).alias('metric'), v.cast('double').alias('value'))
                 for m, v in found.items()]
        return F.when(F.col('section') == own, F.array(*cells)).otherwise(F.array().cast(
            'array<struct<section:string,key:string,metric:string,value:double>>'))

    spine = groups.sparkSession.createDataFrame([(s, None, m, v) for s, m, v in always],
                                                'section string, key string, metric string, value double')
    table = groups.select(F.inline(F.concat(*[rows(*p) for p in parts]))).unionByName(spine)
    return (table.groupBy('section', 'key', 'metric').agg(F.sum('value').alias('value'))
            .select('section', 'key', 'metric', C.label_title(F.col('metric')).alias('label'), 'value'))


def metric_rows(df: DataFrame, section: str, metrics: list[str]) -> DataFrame:
    """Rows (section, key, metric, label, value) of the metric columns of a table of one row, without a key."""
    cells = [F.struct(F.lit(m).alias('metric'), F.col(m).cast('double').alias('value')) for m in metrics]
    return df.select(F.inline(F.array(*cells))).select(
        F.lit(section).alias('section'), F.lit(None).cast('string').alias('key'), 'metric',
        C.label_title(F.col('metric')).alias('label'), 'value')


def effectiveness_report(survey: DataFrame) -> DataFrame:
    """A1-A6 as one long metric table (section, key, metric, label, value), from one pass over the survey."""
    n, answered = F.count(F.lit(1)), F.count('would_recommend')
    outcomes = {'identifying_dangers': 'confident_identifying_dangers', 'understanding_grooming': 'understanding_grooming',
                'online_vs_real_friends': 'understanding_online_vs_real'}
    groups = _grouped_once(
        survey, {'by_age_group': 'age_group', 'by_gender': 'gender',
                 'temporal_trends': C.month_bucket('submission_date'), 'external_speaker': 'external_speaker_engaging',
                 'school': 'school_name'},
        n=n, mean=F.avg('effectiveness_score'), count=F.count('effectiveness_score'), std=F.stddev_samp('effectiveness_score'),
        satisfied=F.count_if(F.col('effectiveness_rating').isin(list(lx.SATISFIED_RATINGS))) * 100.0 / n,
        recommended=F.when(answered > 0, F.count_if(F.col('would_recommend') == 'Yes') * 100.0 / answered),
        **{name: F.avg(source) for name, source in outcomes.items()})
    score = {'mean': C.half_even('mean'), 'count': F.col('count')}
    with_std = score | {'std': C.half_even('std')}
    overall = {'total_responses': F.col('n'), 'avg_effectiveness_score': F.col('mean'), 'satisfaction_rate': F.col('satisfied'),
               'recommendation_rate': F.col('recommended')}
    return _long(groups, [
        (ALL, 'overall_metrics', overall), ('school', 'overall_metrics', ['unique_schools']),
        (ALL, 'learning_outcomes', {name: F.col(name) for name in outcomes}),
        ('by_age_group', 'by_age_group', with_std), ('by_gender', 'by_gender', with_std),
        ('temporal_trends', 'temporal_trends', score), ('external_speaker', 'external_speaker', score),
    ], [('overall_metrics', m, 0.0 if m in ('total_responses', 'unique_schools') else None) for m in [*overall, 'unique_schools']]
        + [('learning_outcomes', m, None) for m in outcomes])


def session_report(sessions: DataFrame) -> DataFrame:
    """A8-A11 as one long metric table (section, key, metric, label, value), from one pass over the sessions."""
    groups = _grouped_once(sessions, {'by_type': 'session_type', 'by_source': 'data_source', 'monthly': 'month'},
                           total=F.sum('count'))
    total, distinct = {'total': F.col('total')}, {'by_type': 'unique_session_types', 'monthly': 'months_active', 'by_source': 'data_sources'}
    return _long(groups, [(ALL, 'totals', {'total_sessions': F.col('total')})]
                 + [(s, 'totals', [m]) for s, m in distinct.items()] + [(s, s, total) for s in distinct],
                 [('totals', 'total_sessions', None)] + [('totals', m, 0.0) for m in distinct.values()])


#: Colour, width, opacity and dashes of the lines of each kind of edge.
LINE_STYLES = {
    'trust': ('green', 2.0, 0.8, None),
    'cluster': ('orange', 1.5, 0.6, None),
    'champion': (None, 2.0, 0.4, '5, 10'),
}
NORMAL_LEAD_COLOUR, DEPRIVED_LEAD_COLOUR = '#4169E1', '#DC143C'
CHAMPION_LABEL = 'Connection to {name} ({km} km)'


def connection_lines(edges: DataFrame, kind: str, name_col: str, colour: str | None = None) -> DataFrame:
    """V4: map lines of edges (J10, J13, J14): ends, style and distance label.

    ``edges`` has gias_urn, gias_lat, gias_lon, ``name_col``, latitude,
    longitude, distance_km and rank. Lines to champions have the colour of the
    leads' layer (``colour``) and say name and kilometres; the others say nothing.
    """
    own, width, opacity, dashes = LINE_STYLES[kind]
    label = F.format_string(CHAMPION_LABEL.format(name='%s', km='%.1f'), F.col(name_col), F.col('distance_km'))
    return edges.select(
        'gias_urn', F.lit(kind).alias('edge_type'), 'rank', F.col('gias_lat').alias('from_lat'), F.col('gias_lon').alias('from_lon'),
        F.col('latitude').alias('to_lat'), F.col('longitude').alias('to_lon'), F.col(name_col).alias('to_name'),
        F.lit(own or colour).alias('colour'), F.lit(width).alias('width'), F.lit(opacity).alias('opacity'),
        F.lit(dashes).cast('string').alias('dashes'), (label if kind == 'champion' else F.lit(None).cast('string')).alias('label'))


#: Order of the recommendation categories in the two documents.
CATEGORIES = ('data_collection', 'workshop_content', 'delivery_optimization', 'geographic_expansion')


def _category_no() -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col('category')).cast('int')


def recommendation_lines(recs: DataFrame) -> DataFrame:
    """S10, the numbered list: (section_no, line_no, line) from the table of L16, every item of every category."""
    heads = recs.groupBy('category').agg(F.lit(0).cast('long').alias('line_no')).select(
        _category_no().alias('section_no'), 'line_no', F.upper(F.replace('category', F.lit('_'), F.lit(' '))).alias('line'))
    items = recs.select(_category_no().alias('section_no'), F.col('rank').cast('long').alias('line_no'),
                        F.concat(F.col('rank').cast('string'), F.lit('. '), F.col('recommendation')).alias('line'))
    return heads.unionByName(items)


def summary_lines(kpis: DataFrame, totals: DataFrame, recs: DataFrame, per_category: int = 3) -> DataFrame:
    """S10, the summary: (section_no, line_no, line) with the survey's and sessions' key figures
    (rows of A1 and A8) and the first recommendations of each category."""
    def rows(df: DataFrame, section: int, *lines: Column) -> DataFrame:
        return df.select(F.posexplode(F.array(*lines)).alias('line_no', 'line')).select(
            F.lit(section).alias('section_no'), F.col('line_no').cast('long').alias('line_no'), 'line')

    text = F.format_string
    survey = rows(kpis, 101, F.lit('Youth Feedback:'), text('  - Total responses: %d', F.col('total_responses')),
                  text('  - Average effectiveness: %.2f/5', F.col('avg_effectiveness_score')),
                  text('  - Satisfaction rate: %.1f%%', F.col('satisfaction_rate')),
                  text('  - Unique schools: %d', F.col('unique_schools')))
    sessions = rows(totals, 102, F.lit('Session Delivery:'), text('  - Total sessions: %.0f', F.col('total_sessions').cast('double')),
                    text('  - Session types: %d', F.col('unique_session_types').cast('long')))
    first = recommendation_lines(recs).filter(F.col('line_no') <= per_category)
    first = first.select(F.col('section_no') + 200, 'line_no', F.when(
        F.col('line_no') == 0, F.concat(F.initcap('line'), F.lit(':'))).otherwise(
        F.regexp_replace('line', r'^\d+\. ', '  - ')).alias('line')).toDF('section_no', 'line_no', 'line')
    return survey.unionByName(sessions).unionByName(first)
