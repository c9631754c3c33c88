"""Oracle SQL of the rule reports (L12, L16): texts and conditions stated apart from the operators."""

from __future__ import annotations

# The rule texts of the reports.
PRE_ASSESSMENT = """
SELECT 'missing_data_points', 'Pre-assessment', 'No baseline knowledge assessment before workshops - Cannot measure knowledge gain'"""
OTHER_GAPS = """
SELECT 'missing_data_points', 'Follow-up', 'No 3-month or 6-month follow-up surveys - Cannot measure behavior change or knowledge retention'
UNION ALL SELECT 'missing_data_points', 'Geographic', 'School locations not geocoded - Cannot create heat maps or analyze geographic patterns'
UNION ALL SELECT 'missing_data_points', 'Behavioral', 'No data on actual behavior change (reporting incidents, changing privacy settings) - Cannot measure real-world application of learnings'"""
ADDITIONS = """(VALUES
  (1, 'Implement pre/post matched surveys with unique IDs'),
  (2, 'Add 3-month follow-up survey to measure behavior change'),
  (3, 'Collect school postcodes for geographic analysis'),
  (4, 'Add questions about specific actions taken (e.g., ''Have you changed your privacy settings?'')'),
  (5, 'Include parental feedback surveys'),
  (6, 'Track incident reporting rates in participating schools'),
  (7, 'Add more demographic variables (ethnicity, SEN status) for equity analysis'),
  (8, 'Include questions about specific online platforms used')) AS additions(n, message)"""


def gap_rows(pre_assessment_given: bool) -> str:
    rules = OTHER_GAPS if pre_assessment_given else f'{PRE_ASSESSMENT} UNION ALL {OTHER_GAPS}'
    return f"{rules} UNION ALL SELECT 'suggested_additions', CAST(n AS VARCHAR), message FROM {ADDITIONS}"


def recommendations(improve: str, positive: str, gaps: str, answers: str) -> str:
    """``answers``: SQL for one row (n_responses, n_speaker) of the cleaned survey."""
    return f"""
WITH imp AS ({improve}), pos AS ({positive}), {gaps.strip()[4:]},
g AS (SELECT count(*) FILTER (WHERE nearest_km > 50.0) AS n FROM nn),
answers AS ({answers}),
allr(category, g, c, k, recommendation) AS (
  SELECT * FROM (SELECT 'workshop_content', 1, count, theme,
                        'Address \'\'' || theme || '\'\' feedback - mentioned by ' || CAST(count AS VARCHAR) || ' students'
                 FROM imp ORDER BY count DESC, theme LIMIT 3)
  UNION ALL
  SELECT * FROM (SELECT 'workshop_content', 2, count, theme,
                        'Continue emphasizing \'\'' || theme || '\'\' - most appreciated aspect'
                 FROM pos ORDER BY count DESC, theme LIMIT 1)
  UNION ALL SELECT 'workshop_content', 3, 0, '00', 'Increase interactive elements (quiz, role-play scenarios)'
  UNION ALL SELECT 'workshop_content', 3, 0, '01', 'Add more visual content and real case examples'
  UNION ALL SELECT 'workshop_content', 3, 0, '02', 'Extend Q&A time for deeper discussion'
  UNION ALL SELECT 'delivery_optimization', 1, 0, '00', 'Consider age-specific workshop adaptations based on effectiveness variations'
  UNION ALL SELECT 'delivery_optimization', 1, 0, '01', 'Prioritize external speaker delivery - shows positive impact on engagement'
            FROM answers WHERE n_speaker > 0
  UNION ALL SELECT 'geographic_expansion', 1, 0, '', 'Identify ' || CAST(n AS VARCHAR) || ' isolated schools for targeted outreach'
            FROM g WHERE n > 0
  UNION ALL SELECT 'data_collection', 1, 0, printf('%02d', n - 1), message FROM {ADDITIONS})
SELECT category, row_number() OVER (PARTITION BY category ORDER BY g, c DESC, k) AS rank, recommendation FROM allr"""
