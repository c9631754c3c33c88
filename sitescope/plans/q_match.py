"""Matching, lookup and lead-track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import lexicons as lx
from sitescope.operators import leads as L
from sitescope.operators import match as MT
from sitescope.plans import bindings as B
from sitescope.plans import sqlparts as S
from sitescope.plans.q_leads import CFG, QUERY_RADIUS_KM
from sitescope.plans.registry import register

BASE = f"WITH {S.REGISTRY}, {S.VISITED}"
ALL_SITES = f"WITH {S.REGISTRY}, {S.SITES}"
CHAMP = "champ AS (SELECT * FROM visg WHERE visit_count >= 2)"
CAND = f"""cand AS (SELECT * FROM reg r WHERE NOT EXISTS (
           SELECT 1 FROM vis v WHERE {S.norm('v.school_name')} = r.norm_name))"""
FIRST = "first_reg AS (SELECT norm_name, arg_min(trust_name, reg_ord) AS trust_name FROM reg GROUP BY norm_name)"
TRUSTS = f"""trusts AS (SELECT DISTINCT f.trust_name FROM champ c JOIN first_reg f ON f.norm_name = {S.norm('c.school_name')}
           WHERE f.trust_name IS NOT NULL AND lower(trim(f.trust_name)) <> 'not applicable')"""
OUT = S.LEAD_COLS + ', lead_type, lead_category, lead_source'


def reg(spark, d):
    return B.registry(spark, d)


def vis(spark, d):
    return B.visited_sites(spark, d)


def every_site(spark, d):
    return B.sites(spark, d)


@register('J5_exact_match', f"""{BASE}, {CHAMP}, {FIRST}
SELECT c.school_name, CASE WHEN f.trust_name IS NOT NULL THEN 'exact' END AS match_type,
       CASE WHEN f.trust_name IS NOT NULL THEN 100.0 END AS match_score, f.trust_name
FROM (SELECT DISTINCT school_name FROM champ WHERE school_name IS NOT NULL AND school_name <> '') c
LEFT JOIN first_reg f ON f.norm_name = {S.norm('c.school_name')}""")
def exact_match(spark, d):
    """J5 (exact leg): champions matched to the registry by normalised name."""
    champs = L.champions_of(vis(spark, d), CFG.champion_min_visits)
    return MT.match_to_registry(champs, 'school_name', reg(spark, d), fuzzy=False)


def _part_names(spark, d):
    p = B.table(spark, d, 'part')
    return p.groupBy('p_name').agg(F.min('p_partkey').alias('reg_ord')).select(
        F.col('p_name').alias('gias_name'), 'reg_ord',
        F.upper(F.col('p_name')).alias('trust_name'))


def _typed_names(spark, d):
    """Names as typed by hand: token-reversed for even part keys, a dropped
    letter for odd ones (derived from every part row)."""
    p = B.table(spark, d, 'part')
    rev = F.array_join(F.reverse(F.split('p_name', ' ')), ' ')
    drop = F.concat(F.substring('p_name', 1, 2), F.expr('substring(p_name, 4)'))
    return p.select(F.when(F.pmod('p_partkey', F.lit(2)) == 0, rev).otherwise(drop).alias('typed_name'))


PART_SQL = f"""WITH RECURSIVE regp AS (SELECT p_name AS gias_name, min(p_partkey) AS reg_ord, upper(p_name) AS trust_name FROM part GROUP BY p_name),
typed AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ')
                               ELSE substr(p_name, 1, 2) || substr(p_name, 4) END AS typed_name FROM part),
ex AS (SELECT t.typed_name, arg_min(r.trust_name, r.reg_ord) AS trust_name FROM typed t
       JOIN regp r ON {S.norm('r.gias_name')} = {S.norm('t.typed_name')} GROUP BY 1),
{S.fuzzy('SELECT typed_name AS name FROM typed WHERE typed_name NOT IN (SELECT typed_name FROM ex)',
         'SELECT gias_name AS name, reg_ord AS ord FROM regp', 80.0)}
SELECT t.typed_name, CASE WHEN ex.trust_name IS NOT NULL THEN 'exact' WHEN fz.name IS NOT NULL THEN 'fuzzy' END AS match_type,
       CASE WHEN ex.trust_name IS NOT NULL THEN 100.0 ELSE fz.score END AS match_score, coalesce(ex.trust_name, r.trust_name) AS trust_name
FROM typed t LEFT JOIN ex USING (typed_name) LEFT JOIN fz ON fz.name = t.typed_name LEFT JOIN regp r ON r.reg_ord = fz.ord"""


@register('J5_fuzzy_match', PART_SQL)
def fuzzy_match(spark, d):
    """J5 cascade on typed part names (exact, else token-sort >= 80)."""
    names = _part_names(spark, d).withColumn('norm_name', MT.norm_name('gias_name'))
    return MT.match_to_registry(_typed_names(spark, d), 'typed_name', names, threshold=80.0)


def _typed_sites(spark, d, sites):
    """Distinct site names as typed by hand: of every third customer a character is lost, others differ in case and blanks.

    Each name is joined once with each way it is typed: a name of n customers has n * n rows in ``sites``
    (their coordinates), which must not meet its n customers again.
    """
    names = sites.select('school_name').distinct()
    kinds = B.table(spark, d, 'customer').select(F.col('c_name').alias('school_name'), F.pmod('c_custkey', F.lit(3)).alias('kind')).distinct()
    lost = F.concat(F.substring('school_name', 1, 12), F.expr('substring(school_name, 14)'))
    kind = F.col('kind')
    typed = F.when(kind == 0, lost).when(kind == 1, F.concat(F.lit(' '), F.upper('school_name'))).otherwise(F.col('school_name'))
    return names.join(kinds, 'school_name').select(typed.alias('school_name')).distinct()


TYPED_SITE = """CASE WHEN c_custkey % 3 = 0 THEN substr(school_name, 1, 12) || substr(school_name, 14)
                  WHEN c_custkey % 3 = 1 THEN ' ' || upper(school_name) ELSE school_name END"""


def _typed_cascade(source: str, threshold: float) -> str:
    """CTEs from the sites of ``source`` to matched(school_name, match_type, match_score, trust_name)."""
    usable = "trust_name IS NOT NULL AND lower(trim(trust_name)) <> 'not applicable'"
    rest = 'SELECT school_name AS name FROM names WHERE school_name NOT IN (SELECT school_name FROM ex)'
    return f"""
names AS (SELECT DISTINCT {TYPED_SITE} AS school_name FROM {source} JOIN customer ON c_name = school_name),
ex AS (SELECT n.school_name, f.trust_name FROM names n JOIN first_reg f ON f.norm_name = {S.norm('n.school_name')} WHERE {usable}),
{S.fuzzy(rest, 'SELECT gias_name AS name, reg_ord AS ord FROM reg', threshold)},
fm AS (SELECT fz.name AS school_name, fz.score, r.trust_name FROM fz JOIN reg r ON r.reg_ord = fz.ord WHERE {usable}),
matched AS (SELECT n.school_name, CASE WHEN ex.school_name IS NOT NULL THEN 'exact' WHEN fm.school_name IS NOT NULL THEN 'fuzzy' END AS match_type,
                   CASE WHEN ex.school_name IS NOT NULL THEN 100.0 ELSE fm.score END AS match_score,
                   coalesce(ex.trust_name, fm.trust_name) AS trust_name
            FROM names n LEFT JOIN ex USING (school_name) LEFT JOIN fm USING (school_name))"""


@register('J15_trust_enrichment', f"""{ALL_SITES.replace('WITH', 'WITH RECURSIVE', 1)}, {FIRST}, {_typed_cascade('vis', 85.0)}
SELECT * FROM matched""")
def trust_enrichment(spark, d):
    """Trust of every visited site as typed by hand (exact name, else fuzzy at 85)."""
    return MT.match_to_registry(_typed_sites(spark, d, every_site(spark, d)), 'school_name', reg(spark, d), threshold=85.0,
                                usable=MT.usable_trust('trust_name'))


@register('J18_typed_champion_trusts', f"""{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, {CHAMP}, {FIRST}, {_typed_cascade('champ', 80.0)}
SELECT trust_name, count(*) AS champions, count(*) FILTER (WHERE match_type = 'fuzzy') AS fuzzy_champions
FROM matched WHERE trust_name IS NOT NULL GROUP BY trust_name""")
def typed_champion_trusts(spark, d):
    """J5 -> J18 with names as typed by hand: usable trusts, and how many champions led to each, also by fuzzy match."""
    champs = _typed_sites(spark, d, L.champions_of(vis(spark, d), CFG.champion_min_visits))
    m = MT.match_to_registry(champs, 'school_name', reg(spark, d), usable=MT.usable_trust('trust_name'), threshold=80.0)
    return m.where(MT.usable_trust('trust_name')).groupBy('trust_name').agg(
        F.count('*').alias('champions'), F.count_if(F.col('match_type') == 'fuzzy').alias('fuzzy_champions'))


@register('J18_champion_trusts', f"{BASE}, {CHAMP}, {FIRST}, {TRUSTS} SELECT trust_name FROM trusts")
def champion_trusts(spark, d):
    """Distinct usable trusts of the champions."""
    champs = L.champions_of(vis(spark, d), CFG.champion_min_visits)
    return MT.champion_trusts(champs, reg(spark, d))


@register('J4_lookup_by_name', f"""{ALL_SITES},
r AS (SELECT norm_name, arg_max(fsm_percentage, reg_ord) AS fsm_percentage, arg_max(postcode, reg_ord) AS postcode
      FROM reg GROUP BY norm_name)
SELECT v.school_name, v.visit_count, r.fsm_percentage, r.postcode FROM vis v LEFT JOIN r ON r.norm_name = {S.norm('v.school_name')}""")
def lookup_by_name(spark, d):
    """Registry attributes looked up by normalised name (last duplicate wins)."""
    v = every_site(spark, d).select('school_name', 'visit_count')
    return MT.lookup_by_name(v, 'school_name', reg(spark, d), 'gias_name', ['fsm_percentage', 'postcode'], 'reg_ord')


GAZ_SQL = """gaz AS (
  SELECT CASE WHEN gias_urn % 3 = 0 THEN gias_name || ', United Kingdom'
              WHEN gias_urn % 3 = 1 THEN gias_name || ' School, UK' ELSE gias_name || ', England' END AS query_key,
         gias_lat AS latitude, gias_lon AS longitude,
         gias_name || ', ' || trust_name || CASE WHEN gias_urn % 2 = 0 THEN ' Academy Road' ELSE ' High Street' END AS address,
         'gazetteer' AS source
  FROM reg)"""


def gazetteer(spark, d):
    """Gazetteer derived from the registry: one entry per site under one query variant."""
    r = reg(spark, d)
    m = F.pmod('gias_urn', F.lit(3))
    key = (F.when(m == 0, F.concat('gias_name', F.lit(', United Kingdom')))
            .when(m == 1, F.concat('gias_name', F.lit(' School, UK')))
            .otherwise(F.concat('gias_name', F.lit(', England'))))
    addr = F.concat('gias_name', F.lit(', '), 'trust_name',
                    F.when(F.pmod('gias_urn', F.lit(2)) == 0, F.lit(' Academy Road')).otherwise(F.lit(' High Street')))
    return r.select(key.alias('query_key'), F.col('gias_lat').alias('latitude'), F.col('gias_lon').alias('longitude'),
                    addr.alias('address'), F.lit('gazetteer').alias('source'))


@register('J16_geocode', f"""{ALL_SITES}, {GAZ_SQL},
q AS (SELECT s.school_name, t.priority, t.query_key FROM (SELECT DISTINCT school_name FROM vis) s,
      (SELECT 0 AS priority, s.school_name || ', United Kingdom' AS query_key UNION ALL
       SELECT 1, s.school_name || ', England' UNION ALL SELECT 2, s.school_name || ' School, UK' UNION ALL
       SELECT 3, s.school_name || ', School, United Kingdom') t),
best AS (SELECT q.school_name, arg_min(g.latitude, q.priority) AS latitude, arg_min(g.longitude, q.priority) AS longitude,
                arg_min(g.address, q.priority) AS address, arg_min(g.source, q.priority) AS geocode_source
         FROM q JOIN gaz g ON g.query_key = q.query_key GROUP BY q.school_name)
SELECT v.school_name, v.visit_count, b.latitude, b.longitude, b.address, b.geocode_source,
       CASE WHEN b.latitude IS NOT NULL THEN
         CASE WHEN contains(lower(b.address), 'school') OR contains(lower(b.address), 'academy')
                OR contains(lower(b.address), 'college') OR contains(lower(b.address), 'education')
              THEN 'high' ELSE 'medium' END END AS geocode_confidence,
       b.latitude IS NOT NULL AS geocoded
FROM vis v LEFT JOIN best b ON b.school_name = v.school_name""")
def geocode(spark, d):
    """J16 + C26 + C27: geocode cascade over query variants against a gazetteer table."""
    v = every_site(spark, d).select('school_name', 'visit_count')
    return MT.geocode_sites(v, gazetteer(spark, d))


@register('A33_geocode_stats', f"""{ALL_SITES}, {GAZ_SQL},
q AS (SELECT s.school_name, t.priority, t.query_key FROM (SELECT DISTINCT school_name FROM vis) s,
      (SELECT 0 AS priority, s.school_name || ', United Kingdom' AS query_key UNION ALL
       SELECT 1, s.school_name || ', England' UNION ALL SELECT 2, s.school_name || ' School, UK' UNION ALL
       SELECT 3, s.school_name || ', School, United Kingdom') t),
best AS (SELECT q.school_name, arg_min(g.address, q.priority) AS address FROM q JOIN gaz g ON g.query_key = q.query_key
         GROUP BY q.school_name),
x AS (SELECT b.address IS NOT NULL AS ok,
             CASE WHEN b.address IS NOT NULL THEN CASE WHEN contains(lower(b.address), 'school') OR contains(lower(b.address), 'academy')
               OR contains(lower(b.address), 'college') OR contains(lower(b.address), 'education') THEN 'high' ELSE 'medium' END END AS conf
      FROM vis v LEFT JOIN best b ON b.school_name = v.school_name)
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS geocoded, count(*) - count(*) FILTER (WHERE ok) AS failed,
       count(*) FILTER (WHERE ok) * 100.0 / count(*) AS success_pct, count(*) FILTER (WHERE conf = 'high') AS high_confidence,
       count(*) FILTER (WHERE conf = 'medium') AS medium_confidence FROM x""")
def geocode_stats(spark, d):
    """Geocoding success and confidence counts."""
    from sitescope.operators.metrics import geocode_stats as gs
    v = every_site(spark, d).select('school_name', 'visit_count')
    return gs(MT.geocode_sites(v, gazetteer(spark, d)))


@register('J17_postcode_lookup', f"""{ALL_SITES},
pc AS (SELECT upper(replace(trim(postcode), ' ', '')) AS k, avg(gias_lat) AS pc_latitude, avg(gias_lon) AS pc_longitude,
              min(trust_name) AS region FROM reg WHERE postcode IS NOT NULL GROUP BY 1)
SELECT r.gias_urn, r.postcode, pc.pc_latitude, pc.pc_longitude, pc.region
FROM reg r JOIN pc ON pc.k = upper(replace(trim(r.postcode), ' ', ''))
WHERE r.gias_urn IN (SELECT r2.gias_urn FROM reg r2 JOIN vis v ON v.school_name = r2.gias_name)""")
def postcode_lookup(spark, d):
    """Postcode reference lookup for the visited sites' registry rows (misses dropped)."""
    r = reg(spark, d)
    from sitescope.functions.clean import postcode_key
    pcs = (r.filter(F.col('postcode').isNotNull())
            .groupBy(F.upper(postcode_key('postcode')).alias('postcode'))
            .agg(F.avg('gias_lat').alias('pc_latitude'), F.avg('gias_lon').alias('pc_longitude'),
                 F.min('trust_name').alias('region')))
    visited = r.join(every_site(spark, d).select(F.col('school_name').alias('gias_name')), 'gias_name', 'left_semi')
    return MT.postcode_lookup(visited.select('gias_urn', 'postcode'), 'postcode', pcs)


def _group_sql() -> str:
    stop = ', '.join(f"'{w}'" for w in lx.GROUP_STOPWORDS)
    aca = "lower(p_name)"
    for sfx in lx.ACADEMY_SUFFIXES:
        aca = f"trim(replace({aca}, '{sfx}', ''))"
    return f"""
WITH n AS (SELECT p_name FROM part),
k AS (SELECT p_name, 'academy_' || {aca} AS group_key FROM n WHERE contains(lower(p_name), 'academy')
      UNION ALL
      SELECT p_name, w AS group_key FROM (SELECT p_name, unnest(string_split_regex(trim(lower(p_name)), '\\s+')) AS w FROM n)
      WHERE length(w) >= 5 AND w NOT IN ({stop})),
s AS (SELECT group_key, count(*) AS n_sites FROM k GROUP BY 1 HAVING count(*) >= 2)
SELECT k.group_key, s.n_sites, k.p_name AS school_name FROM k JOIN s USING (group_key)"""


@register('A34_site_groups', _group_sql())
def site_groups(spark, d):
    """A34 + C24 + C25: inverted group index (long form) over part names."""
    names = B.table(spark, d, 'part').select(F.col('p_name').alias('school_name'))
    return MT.site_groups(names, 'school_name')


# --------------------------------------------------------------------------- lead tracks

@register('L1_trust_leads', f"""{BASE}, {CHAMP}, {CAND}, {FIRST}, {TRUSTS}
SELECT {S.LEAD_COLS}, 'Trust Lead' AS lead_type, 'normal' AS lead_category,
       'Same trust as champion school' AS lead_source
FROM cand WHERE trust_name IN (SELECT trust_name FROM trusts)""")
def trust_leads(spark, d):
    """Every trust lead (not capped)."""
    r, v = reg(spark, d), vis(spark, d)
    champs = L.champions_of(v, CFG.champion_min_visits)
    return L.trust_leads(L.unvisited(r, v), champs, r, CFG).select(*L.STANDARD_COLS, *L.TAG_COLS)


@register('L2_hotspot_leads', f"""{BASE}, {CHAMP}, {CAND}
SELECT {S.LEAD_COLS}, 'Hotspot Lead' AS lead_type, 'normal' AS lead_category,
       'Within {float(QUERY_RADIUS_KM)}km of champion' AS lead_source
FROM cand c WHERE c.gias_lat IS NOT NULL AND c.gias_lon IS NOT NULL AND EXISTS (
  SELECT 1 FROM champ h WHERE h.latitude IS NOT NULL AND h.longitude IS NOT NULL
    AND {S.gc('c.gias_lat', 'c.gias_lon', 'h.latitude', 'h.longitude')} <= {float(QUERY_RADIUS_KM)})""")
def hotspot_leads(spark, d):
    """Every registry site within 25 km of a champion, not visited."""
    r, v = reg(spark, d), vis(spark, d)
    champs = L.champions_of(v, CFG.champion_min_visits)
    return L.hotspot_leads(L.unvisited(r, v), champs, CFG).select(*L.STANDARD_COLS, *L.TAG_COLS)


@register('L3_deprived_leads', f"""{BASE}, {CAND}
SELECT {S.LEAD_COLS}, 'Deprived Area' AS lead_type, 'deprived' AS lead_category,
       'FSM >= 30.0% (high deprivation)' AS lead_source FROM cand WHERE fsm_percentage >= 30.0""")
def deprived_leads(spark, d):
    """Every unvisited site with FSM >= 30 %."""
    r, v = reg(spark, d), vis(spark, d)
    return L.deprived_leads(L.unvisited(r, v), CFG).select(*L.STANDARD_COLS, *L.TAG_COLS)


V1_SQL = f"""{BASE}, {CHAMP}, {CAND}, {FIRST}, {TRUSTS},
tl AS (SELECT *, 0 AS t, 'Trust Lead' AS lead_type, 'normal' AS lead_category,
              'Same trust as champion school' AS lead_source FROM cand WHERE trust_name IN (SELECT trust_name FROM trusts)),
hl AS (SELECT *, 1 AS t, 'Hotspot Lead' AS lead_type, 'normal' AS lead_category,
              'Within {float(QUERY_RADIUS_KM)}km of champion' AS lead_source
       FROM cand c WHERE c.gias_lat IS NOT NULL AND c.gias_lon IS NOT NULL AND EXISTS (
         SELECT 1 FROM champ h WHERE h.latitude IS NOT NULL AND h.longitude IS NOT NULL
           AND {S.gc('c.gias_lat', 'c.gias_lon', 'h.latitude', 'h.longitude')} <= {float(QUERY_RADIUS_KM)})),
u AS (SELECT * FROM tl UNION ALL SELECT * FROM hl),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY gias_urn ORDER BY t, reg_ord) AS rn FROM u)
       WHERE rn = 1)"""


@register('L7_v1_leads', V1_SQL + f"\nSELECT {OUT} FROM dd")
def v1_leads(spark, d):
    """Trust U hotspot leads, deduplicated by URN (trust first), unscored."""
    return L.normal_leads(reg(spark, d), vis(spark, d), CFG, score=False)


@register('A37_lead_counts', V1_SQL + """,
dl AS (SELECT * FROM cand WHERE fsm_percentage >= 30.0),
allv AS (SELECT lead_type, 'normal' AS lead_category FROM dd UNION ALL SELECT 'Deprived Area', 'deprived' FROM dl)
SELECT lead_category, lead_type, count(*) AS count FROM allv GROUP BY 1, 2""")
def lead_counts(spark, d):
    """Lead counts per track and type (before the top-100 cut)."""
    r, v = reg(spark, d), vis(spark, d)
    normal = L.normal_leads(r, v, CFG, score=False)
    deprived = L.deprived_leads(L.unvisited(r, v), CFG)
    both = normal.select('lead_category', 'lead_type').unionByName(deprived.select('lead_category', 'lead_type'))
    return both.groupBy('lead_category', 'lead_type').agg(F.count(F.lit(1)).alias('count'))
