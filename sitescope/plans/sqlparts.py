"""SQL fragments shared by the oracle queries (DuckDB dialect).

They restate the bindings and formulas in plain SQL so the oracle is an
independent formulation of each query.
"""

from __future__ import annotations

GC_RADIUS = 6371.009
HAV_RADIUS = 6371.0


def gc(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = GC_RADIUS) -> str:
    p1, p2 = f'radians({lat1})', f'radians({lat2})'
    dl = f'(radians({lon2}) - radians({lon1}))'
    y = f'sqrt(pow(cos({p2}) * sin({dl}), 2) + pow(cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({dl}), 2))'
    x = f'(sin({p1}) * sin({p2}) + cos({p1}) * cos({p2}) * cos({dl}))'
    return f'({radius} * atan2({y}, {x}))'


def hav(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = HAV_RADIUS) -> str:
    a = (f'(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))'
         f' * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))')
    return f'({2.0 * radius} * asin(sqrt(least(1.0, {a}))))'


def norm(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '^\\s+|\\s+$', '', 'g')"


REGISTRY = """
reg0 AS (
  SELECT c_custkey AS gias_urn, c_name AS gias_name, n_name AS trust_name,
         CAST(300000 + (c_custkey * 7919) % 300000 AS DOUBLE) AS easting,
         CAST(100000 + (c_custkey * 104729) % 400000 AS DOUBLE) AS northing,
         printf('%s%02d %03d', upper(substr(n_name, 1, 2)), c_nationkey, c_custkey % 1000) AS postcode,
         c_acctbal / 100.0 AS fsm_percentage, c_custkey AS reg_ord
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
reg1 AS (SELECT *, 49.0 + (northing - (-100000.0)) / 111000.0 AS gias_lat FROM reg0),
reg AS (SELECT gias_urn, gias_name, trust_name, easting, northing, postcode, fsm_percentage, gias_lat,
               -2.0 + (easting - 400000.0) / (111000.0 * cos(radians(gias_lat))) AS gias_lon,
               NORM_NAME AS norm_name, reg_ord
        FROM reg1)
""".replace('NORM_NAME', norm('gias_name'))

VISITED = """
vis0 AS (SELECT o_custkey, count(*) AS visit_count FROM orders
         WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY o_custkey),
vis AS (SELECT c_name AS school_name, visit_count FROM vis0 JOIN customer ON o_custkey = c_custkey),
visg AS (SELECT v.school_name, v.visit_count, g.gias_lat AS latitude, g.gias_lon AS longitude
         FROM vis v LEFT JOIN reg g ON g.gias_name = v.school_name)
"""

#: Every site with any order, for queries that have no visited / unvisited split.
SITES = VISITED.replace("WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ", '')

LEAD_COLS = ('gias_urn, gias_name, trust_name, easting, northing, postcode, fsm_percentage, '
             'gias_lat, gias_lon, norm_name')


def leads_normal(radius_km: float, min_visits: int = 2, top_n: int | None = 100) -> str:
    src = f'Within {float(radius_km)}km of champion'
    return f"""
WITH {REGISTRY}, {VISITED},
champ AS (SELECT * FROM visg WHERE visit_count >= {min_visits}),
cand AS (SELECT * FROM reg r WHERE NOT EXISTS (
           SELECT 1 FROM vis v WHERE {norm('v.school_name')} = r.norm_name)),
first_reg AS (SELECT norm_name, arg_min(trust_name, reg_ord) AS trust_name FROM reg GROUP BY norm_name),
trusts AS (SELECT DISTINCT f.trust_name FROM champ c JOIN first_reg f ON f.norm_name = {norm('c.school_name')}
           WHERE f.trust_name IS NOT NULL AND lower(trim(f.trust_name)) <> 'not applicable'),
tl AS (SELECT *, 0 AS t, 'Trust Lead' AS lead_type, 'normal' AS lead_category,
              'Same trust as champion school' AS lead_source
       FROM cand WHERE trust_name IN (SELECT trust_name FROM trusts)),
hl AS (SELECT *, 1 AS t, 'Hotspot Lead' AS lead_type, 'normal' AS lead_category, '{src}' AS lead_source
       FROM cand c WHERE c.gias_lat IS NOT NULL AND c.gias_lon IS NOT NULL AND EXISTS (
         SELECT 1 FROM champ h WHERE h.latitude IS NOT NULL AND h.longitude IS NOT NULL
           AND {gc('c.gias_lat', 'c.gias_lon', 'h.latitude', 'h.longitude')} <= {float(radius_km)})),
u AS (SELECT * FROM tl UNION ALL SELECT * FROM hl),
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY gias_urn ORDER BY t, reg_ord) AS rn
                                  FROM u) WHERE rn = 1),
pairs AS (SELECT d.gias_urn, h.school_name, {gc('d.gias_lat', 'd.gias_lon', 'h.latitude', 'h.longitude')} AS dist,
                 h.latitude AS hlat, h.longitude AS hlon
          FROM d JOIN champ h ON h.latitude IS NOT NULL AND h.longitude IS NOT NULL
          WHERE d.gias_lat IS NOT NULL AND d.gias_lon IS NOT NULL),
nn AS (SELECT gias_urn, school_name AS nearest_champion, dist AS distance_to_champion_km FROM (
         SELECT *, row_number() OVER (PARTITION BY gias_urn ORDER BY dist, school_name, hlat, hlon) AS rn FROM pairs)
       WHERE rn = 1),
s AS (SELECT d.*, nn.nearest_champion, nn.distance_to_champion_km FROM d LEFT JOIN nn USING (gias_urn)),
m AS (SELECT max(distance_to_champion_km) AS maxd FROM s),
sc AS (SELECT s.*, CASE WHEN m.maxd > 0
                        THEN (CASE WHEN lead_type = 'Trust Lead' THEN 10.0 ELSE 0.0 END)
                             + 5.0 * (1.0 - distance_to_champion_km / m.maxd)
                        ELSE (CASE WHEN lead_type = 'Trust Lead' THEN 10.0 ELSE 0.0 END) END AS priority_score
       FROM s CROSS JOIN m)
SELECT {LEAD_COLS}, lead_type, lead_category, lead_source, nearest_champion, distance_to_champion_km,
       priority_score
FROM sc ORDER BY priority_score DESC NULLS LAST, gias_urn {f'LIMIT {top_n}' if top_n else ''}
"""


def leads_deprived(threshold: float = 30.0, min_visits: int = 2, top_n: int | None = 100) -> str:
    src = f'FSM >= {float(threshold)}% (high deprivation)'
    return f"""
WITH {REGISTRY}, {VISITED},
champ AS (SELECT * FROM visg WHERE visit_count >= {min_visits}),
cand AS (SELECT * FROM reg r WHERE NOT EXISTS (
           SELECT 1 FROM vis v WHERE {norm('v.school_name')} = r.norm_name)),
dl AS (SELECT *, 'Deprived Area' AS lead_type, 'deprived' AS lead_category, '{src}' AS lead_source
       FROM cand WHERE fsm_percentage >= {float(threshold)}),
m AS (SELECT max(fsm_percentage) AS maxf FROM dl),
sc AS (SELECT dl.*, CASE WHEN m.maxf > 0 THEN 10.0 * fsm_percentage / m.maxf ELSE 0.0 END AS impact_score
       FROM dl CROSS JOIN m),
top AS (SELECT * FROM sc ORDER BY impact_score DESC NULLS LAST, gias_urn {f'LIMIT {top_n}' if top_n else ''}),
pairs AS (SELECT t.gias_urn, h.school_name, {gc('t.gias_lat', 't.gias_lon', 'h.latitude', 'h.longitude')} AS dist,
                 h.latitude AS hlat, h.longitude AS hlon
          FROM top t JOIN champ h ON h.latitude IS NOT NULL AND h.longitude IS NOT NULL
          WHERE t.gias_lat IS NOT NULL AND t.gias_lon IS NOT NULL),
nn AS (SELECT gias_urn, school_name AS nearest_champion, dist AS distance_to_champion_km FROM (
         SELECT *, row_number() OVER (PARTITION BY gias_urn ORDER BY dist, school_name, hlat, hlon) AS rn FROM pairs)
       WHERE rn = 1)
SELECT {LEAD_COLS}, lead_type, lead_category, lead_source, nearest_champion, distance_to_champion_km,
       impact_score
FROM top LEFT JOIN nn USING (gias_urn)
"""


def fuzzy(names: str, registry: str, threshold: float) -> str:
    """CTEs ``fz_*``: fz(name, score, ord) is the best registry row per name with a score of at least the threshold.

    ``names`` selects (name), ``registry`` selects (name, ord). The common
    subsequence of every pair of keys is counted one character of the registry
    name a step, as a row of bits.
    """
    key = r"array_to_string(list_sort(string_split_regex(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' ')), ' ')"
    return f"""
fz_a AS (SELECT DISTINCT name, {key} AS k FROM ({names}) WHERE name IS NOT NULL),
fz_b AS (SELECT {key} AS k, min(ord) AS ord FROM ({registry}) WHERE name IS NOT NULL GROUP BY 1),
fz_mask AS (SELECT k, ch, sum(1::BIGINT << (i - 1))::BIGINT AS m
            FROM (SELECT k, i, substr(k, i, 1) AS ch FROM (SELECT k, unnest(range(1, length(k) + 1)) AS i FROM (SELECT DISTINCT k FROM fz_a)))
            GROUP BY k, ch),
fz_lcs(a, b, j, v) AS (
  SELECT x.k, y.k, 0, (1::BIGINT << length(x.k)) - 1 FROM (SELECT DISTINCT k FROM fz_a) x, fz_b y
  WHERE 200.0 * least(length(x.k), length(y.k)) >= {threshold} * (length(x.k) + length(y.k))
  UNION ALL
  SELECT l.a, l.b, l.j + 1, ((l.v + (l.v & coalesce(m.m, 0))) | (l.v - (l.v & coalesce(m.m, 0)))) & ((1::BIGINT << length(l.a)) - 1)
  FROM fz_lcs l LEFT JOIN fz_mask m ON m.k = l.a AND m.ch = substr(l.b, l.j + 1, 1) WHERE l.j < length(l.b)),
fz_score AS (SELECT a, b, 200.0 * (length(a) - bit_count(v)) / (length(a) + length(b)) AS score FROM fz_lcs WHERE j = length(b)),
fz_best AS (SELECT s.a, s.score, y.ord, row_number() OVER (PARTITION BY s.a ORDER BY s.score DESC, y.ord) AS n
            FROM fz_score s JOIN fz_b y ON y.k = s.b WHERE s.score >= {threshold} - 1e-9),
fz AS (SELECT x.name, t.score, t.ord FROM fz_a x JOIN fz_best t ON t.a = x.k WHERE t.n = 1)"""


def kmeans(points: str, k: int = 5) -> str:
    """CTEs ``centres`` (cluster, x, y) and ``assigned`` (columns of ``points``, cluster) for WITH RECURSIVE.

    ``points`` names a CTE with latitude and longitude. Eight starts, farthest
    first from the outermost places; Lloyd rounds until no centre moves; the
    lowest cost wins, clusters are numbered by centroid.
    """
    def gap(c: str) -> str:
        return f'((p.x - {c}.x) * (p.x - {c}.x) + (p.y - {c}.y) * (p.y - {c}.y))'
    gaps = f"list_transform(cs, lambda c: {gap('c')})"
    place = "{'x': p.x, 'y': p.y}"
    return f"""
place AS (SELECT latitude AS x, longitude AS y, count(*) AS w,
                 CAST(latitude AS DECIMAL(13, 10)) AS fx, CAST(longitude AS DECIMAL(13, 10)) AS fy
          FROM {points} WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY latitude, longitude),
side(r, a, b) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)),
far(r, cs) AS (
  SELECT r, [arg_max({place}, (p.x * a + p.y * b, -p.x, -p.y))] FROM side, place p GROUP BY r
  UNION ALL
  SELECT r, list_append(cs, arg_max({place}, (list_min({gaps}), -p.x, -p.y)))
  FROM far, place p WHERE len(cs) < {k} GROUP BY r, cs),
near_of(r, step, cs, ended) AS (
  SELECT r, 0, cs, false FROM far WHERE len(cs) = {k}
  UNION ALL
  SELECT r, step + 1, news, news = cs
  FROM (SELECT r, step, cs, list_transform(range({k}), lambda i: coalesce(
               list_extract(list_filter(list(m), lambda e: e.j = i + 1), 1).c, list_extract(cs, i + 1))) AS news
        FROM (SELECT r, step, cs, {{'j': j, 'c': {{'x': CAST(sum(fx * w) AS DOUBLE) / sum(w), 'y': CAST(sum(fy * w) AS DOUBLE) / sum(w)}}}} AS m
              FROM (SELECT r, step, cs, fx, fy, w, list_position({gaps}, list_min({gaps})) AS j
                    FROM near_of, place p WHERE NOT ended) GROUP BY r, step, cs, j)
        GROUP BY r, step, cs)),
best AS (SELECT r, cs FROM near_of n, place p WHERE ended GROUP BY r, cs ORDER BY round(sum(list_min({gaps}) * w), 6), r LIMIT 1),
centres AS (SELECT CAST(row_number() OVER (ORDER BY c.x, c.y) - 1 AS INTEGER) AS cluster, c.x AS x, c.y AS y
            FROM (SELECT unnest(cs) AS c FROM best)),
assigned AS (SELECT p.*, (SELECT arg_min(c.cluster, (pow(p.latitude - c.x, 2) + pow(p.longitude - c.y, 2), c.cluster)) FROM centres c) AS cluster
             FROM {points} p)"""
