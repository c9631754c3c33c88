"""Geographic queries.

Points are all sites with coordinates (bindings.sites).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.operators import geo as G
from sitescope.operators import leads as L
from sitescope.operators import reports as R
from sitescope.operators.nearest import nearest_join
from sitescope.plans import bindings as B
from sitescope.plans import sqlparts as S
from sitescope.plans.q_leads import ALL_LEADS, CFG, QUERY_RADIUS_KM
from sitescope.plans.registry import ORACLE, register
from sitescope.session import cut_lineage

POINTS_SQL = f"""{S.REGISTRY}, {S.SITES},
pts AS (SELECT school_name, latitude, longitude FROM visg WHERE latitude IS NOT NULL AND longitude IS NOT NULL)"""


def points(spark, d):
    v = B.sites(spark, d)
    return v.filter(F.col('latitude').isNotNull() & F.col('longitude').isNotNull()).select(
        'school_name', 'latitude', 'longitude', 'visit_count')


@register('A29_extent_metrics', f"""
WITH {POINTS_SQL}
SELECT count(*) AS total_points, min(latitude) AS lat_min, max(latitude) AS lat_max,
       max(latitude) - min(latitude) AS lat_span, min(longitude) AS lon_min, max(longitude) AS lon_max,
       max(longitude) - min(longitude) AS lon_span, avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon
FROM pts""")
def extent_metrics(spark, d):
    """Extent of the visited sites."""
    return G.extent_metrics(points(spark, d))


@register('A32_map_centre', f"""
WITH {POINTS_SQL},
allp AS (SELECT latitude AS lat, longitude AS lon FROM pts UNION ALL SELECT gias_lat, gias_lon FROM reg)
SELECT coalesce(avg(lat), 52.5) AS center_lat, coalesce(avg(lon), -1.5) AS center_lon FROM allp
WHERE lat IS NOT NULL AND lon IS NOT NULL""")
def map_centre(spark, d):
    """Map centre over visited sites and the registry."""
    return G.map_centre([(points(spark, d), 'latitude', 'longitude'),
                         (B.registry(spark, d), 'gias_lat', 'gias_lon')])


@register('V3_density_grid', f"""
WITH {POINTS_SQL}
SELECT CAST(floor(latitude / 0.1) AS BIGINT) AS lat_bin, CAST(floor(longitude / 0.1) AS BIGINT) AS lon_bin,
       count(*) AS points, (floor(latitude / 0.1) + 0.5) * 0.1 AS cell_lat, (floor(longitude / 0.1) + 0.5) * 0.1 AS cell_lon
FROM pts GROUP BY 1, 2, 4, 5""")
def density_grid(spark, d):
    """V3: heat-map bins of the visited sites (0.1 degree cells)."""
    return G.density_grid(points(spark, d), 0.1)


GAPS_SQL = f"""
WITH {POINTS_SQL},
nn AS (SELECT a.school_name, min({S.hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) AS nearest_km
       FROM pts a JOIN pts b ON a.school_name <> b.school_name GROUP BY a.school_name)"""


@register('J11_nearest_site', GAPS_SQL + """
SELECT school_name, nearest_km, nearest_km > 50.0 AS isolated FROM nn""")
def nearest_site(spark, d):
    """Distance from each visited site to its nearest other site."""
    per_point, _ = G.coverage_gaps(points(spark, d), 'school_name', 50.0)
    return per_point


@register('A31_coverage_gaps', GAPS_SQL + """
SELECT avg(nearest_km) AS avg_nearest_distance_km, max(nearest_km) AS max_nearest_distance_km,
       count(*) FILTER (WHERE nearest_km > 50.0) AS schools_beyond_target FROM nn""")
def coverage_gaps(spark, d):
    """Coverage-gap summary at a 50 km target radius."""
    _, summary = G.coverage_gaps(points(spark, d), 'school_name', 50.0)
    return summary


# Gift wrapping: from the lowest point, always to the point with the smallest turn (the farthest of equals).
HULL_SQL = f"""
WITH RECURSIVE {POINTS_SQL},
p AS (SELECT DISTINCT latitude AS x, longitude AS y FROM pts),
h(step, x, y, x0, y0, dir) AS (
  (SELECT 0, x, y, x, y, 0.0::DOUBLE FROM p ORDER BY y, x LIMIT 1)
  UNION ALL
  (SELECT h.step + 1, n.x, n.y, h.x0, h.y0, atan2(n.y - h.y, n.x - h.x)
   FROM h, p n
   WHERE (n.x <> h.x OR n.y <> h.y) AND (h.step = 0 OR h.x <> h.x0 OR h.y <> h.y0)
   ORDER BY (atan2(n.y - h.y, n.x - h.x) - h.dir + 4 * pi()) % (2 * pi()), pow(n.x - h.x, 2) + pow(n.y - h.y, 2) DESC
   LIMIT 1)),
e AS (SELECT step, x, y, lag(x) OVER (ORDER BY step) AS px, lag(y) OVER (ORDER BY step) AS py FROM h)
SELECT (SELECT count(*) FROM pts) AS total_points, count(px) AS hull_vertices,
       abs(sum(px * y - x * py)) / 2 AS hull_area_deg2, abs(sum(px * y - x * py)) / 2 * 12321.0 AS coverage_area_km2
FROM e"""


@register('A30_hull_area', HULL_SQL)
def hull_area(spark, d):
    """Convex-hull coverage area of all sites."""
    return G.hull_area(points(spark, d))


CLUSTERS_SQL = f"WITH RECURSIVE {POINTS_SQL}, {S.kmeans('pts')}"


@register('M1_kmeans', f'{CLUSTERS_SQL} SELECT school_name, latitude, longitude, cluster FROM assigned')
def kmeans(spark, d):
    """M1: k-means (k=5, eight starts) over all sites."""
    assigned, _ = G.kmeans_clusters(points(spark, d), 5)
    return assigned.select('school_name', 'latitude', 'longitude', 'cluster')


@register('M1_kmeans_violations', 'SELECT 0 AS misplaced, 0 AS off_centre, 0 AS unassigned')
def kmeans_violations(spark, d):
    """M1 invariants over every point: none is nearer to another centroid than its own, each
    centroid is the mean of its members (to MLlib's tolerance), and none lacks a cluster."""
    assigned, cent = G.kmeans_clusters(points(spark, d), 5)
    gap = lambda a, b: F.pow(F.col('latitude') - F.col(a), 2) + F.pow(F.col('longitude') - F.col(b), 2)
    other = F.broadcast(cent.select(F.col('cluster').alias('_o'), F.col('centroid_lat').alias('_la'), F.col('centroid_lon').alias('_lo')))
    best = (assigned.crossJoin(other).groupBy('school_name', 'latitude', 'longitude', 'cluster')
            .agg(F.min(gap('_la', '_lo')).alias('_best'), F.min(F.when(F.col('_o') == F.col('cluster'), gap('_la', '_lo'))).alias('_own')))
    misplaced = best.agg(F.count_if(F.col('_own') > F.col('_best') + 1e-9).alias('misplaced'),
                         F.count_if(F.col('_own').isNull()).alias('unassigned'))
    means = G.cluster_centroids(assigned).select('cluster', F.col('centroid_lat').alias('_la'), F.col('centroid_lon').alias('_lo'))
    off = cent.join(means, 'cluster', 'left').agg(F.count_if(~F.coalesce(
        (F.abs(F.col('centroid_lat') - F.col('_la')) < 1e-3) & (F.abs(F.col('centroid_lon') - F.col('_lo')) < 1e-3),
        F.lit(False))).alias('off_centre'))
    return misplaced.crossJoin(off).select(*[F.col(c).cast('int').alias(c) for c in ('misplaced', 'off_centre', 'unassigned')])


@register('A27_cluster_sizes', f'{CLUSTERS_SQL} SELECT cluster, count(*) AS size FROM assigned GROUP BY cluster')
def cluster_sizes(spark, d):
    """K-means cluster sizes."""
    assigned, _ = G.kmeans_clusters(points(spark, d), 5)
    return G.cluster_sizes(assigned)


MEANS_SQL = 'SELECT cluster, avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon FROM assigned GROUP BY cluster'


@register('A28_cluster_centroids', f'{CLUSTERS_SQL} {MEANS_SQL}')
def cluster_centroids(spark, d):
    """Cluster centroids (mean latitude / longitude)."""
    assigned, _ = G.kmeans_clusters(points(spark, d), 5)
    return G.cluster_centroids(assigned)


def _nearest_cluster_sql(columns: str) -> str:
    """Each normal lead's nearest centroid by great-circle distance, after CTEs ``leads`` and ``means``."""
    return f"""SELECT {columns}, arg_min(m.cluster, (d, m.cluster)) AS nearest_cluster, min(d) AS centroid_km
FROM (SELECT l.*, m.cluster, {S.hav('l.gias_lat', 'l.gias_lon', 'm.centroid_lat', 'm.centroid_lon')} AS d FROM leads l, means m) m
WHERE gias_lat IS NOT NULL AND gias_lon IS NOT NULL GROUP BY {columns}"""


@register('J12_nearest_centroid', f"""{CLUSTERS_SQL}, leads AS ({S.leads_normal(QUERY_RADIUS_KM, top_n=None)}), means AS ({MEANS_SQL})
{_nearest_cluster_sql('gias_urn, gias_lat, gias_lon')}""")
def nearest_centroid(spark, d):
    """Nearest k-means centroid of each normal lead."""
    assigned, _ = G.kmeans_clusters(points(spark, d), 5)
    cent = G.cluster_centroids(assigned)
    leads = L.normal_leads(B.registry(spark, d), B.visited_sites(spark, d), ALL_LEADS)
    return G.nearest_centroid(leads, 'gias_urn', cent, 'gias_lat', 'gias_lon')


@register('M2_dbscan', f"""
WITH RECURSIVE {S.REGISTRY},
p AS (SELECT gias_urn, gias_lat, gias_lon FROM reg WHERE gias_lat IS NOT NULL AND gias_lon IS NOT NULL),
near AS (SELECT a.gias_urn AS a, b.gias_urn AS b FROM p a JOIN p b ON abs(a.gias_lat - b.gias_lat) < 0.02
         AND {S.hav('a.gias_lat', 'a.gias_lon', 'b.gias_lat', 'b.gias_lon')} <= 2.0),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
label AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
edge AS (SELECT n.a AS id, min(l.c) AS c FROM near n JOIN label l ON l.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT p.gias_urn, p.gias_lat, p.gias_lon, CAST(coalesce(l.c, e.c, -1) AS BIGINT) AS cluster
FROM p LEFT JOIN label l ON l.id = p.gias_urn LEFT JOIN edge e ON e.id = p.gias_urn""")
def dbscan(spark, d):
    """M2: DBSCAN (eps 2 km, min_samples 3) over all registry sites."""
    reg = B.registry(spark, d).select('gias_urn', 'gias_lat', 'gias_lon')
    return G.dbscan(reg, 'gias_urn', eps_km=2.0, min_samples=3, lat='gias_lat', lon='gias_lon')


def _normal_leads_sql() -> str:
    return S.leads_normal(QUERY_RADIUS_KM, top_n=None)


def _champions_sql(leads: str) -> str:
    """J10's SQL over the leads of any track."""
    return f"""
WITH leads AS ({leads}), {S.REGISTRY}, {S.VISITED},
champ AS (SELECT * FROM visg WHERE visit_count >= 2 AND latitude IS NOT NULL AND longitude IS NOT NULL),
p AS (SELECT l.gias_urn, c.school_name AS champion, {S.gc('l.gias_lat', 'l.gias_lon', 'c.latitude', 'c.longitude')} AS distance_km,
             c.latitude AS clat, c.longitude AS clon
      FROM leads l JOIN champ c ON true WHERE l.gias_lat IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY gias_urn ORDER BY distance_km, champion, clat, clon) AS rank FROM p)
SELECT gias_urn, champion, distance_km, rank FROM r WHERE rank <= 2"""


@register('J10_champion_edges', _champions_sql(_normal_leads_sql()))
def champion_edges(spark, d):
    """The two nearest champions of each normal lead (map connections)."""
    return _champion_edges(spark, d, _every_lead(spark, d)).select('gias_urn', 'champion', 'distance_km', 'rank')


def _every_lead(spark, d):
    """All normal leads as joins need them, written once: several joins read them."""
    leads = L.normal_leads(B.registry(spark, d), B.visited_sites(spark, d), ALL_LEADS)
    return cut_lineage(leads.select('gias_urn', 'gias_lat', 'gias_lon', 'trust_name'))


def _every_deprived_lead(spark, d):
    """All deprived-area leads as joins need them, written once; rows of one lead count once."""
    leads = L.deprived_leads(L.unvisited(B.registry(spark, d), B.visited_sites(spark, d)), ALL_LEADS)
    return cut_lineage(leads.select('gias_urn', 'gias_lat', 'gias_lon').distinct())


def _champion_edges(spark, d, leads):
    champ = (L.champions_of(B.visited_sites(spark, d), CFG.champion_min_visits)
             .select(F.col('school_name').alias('champion'), F.col('latitude').alias('_clat'),
                     F.col('longitude').alias('_clon')))
    return nearest_join(leads.select('gias_urn', 'gias_lat', 'gias_lon'), champ, 2, 'gias_urn',
                        ['champion', '_clat', '_clon'], 'gias_lat', 'gias_lon', '_clat', '_clon',
                        distance='great_circle')


TRUSTS_SQL = f"""
WITH leads AS ({_normal_leads_sql()}), {S.REGISTRY}, {S.VISITED},
site AS (SELECT v.school_name, v.latitude, v.longitude, r.trust_name FROM visg v JOIN reg r ON r.gias_name = v.school_name
         WHERE v.latitude IS NOT NULL AND v.longitude IS NOT NULL),
sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trust_name, latitude, longitude ORDER BY school_name) AS k
                      FROM site) WHERE k = 1),
p AS (SELECT l.gias_urn, s.school_name AS site, {S.gc('l.gias_lat', 'l.gias_lon', 's.latitude', 's.longitude')} AS distance_km,
             s.latitude AS slat, s.longitude AS slon
      FROM leads l JOIN sd s ON s.trust_name = l.trust_name WHERE l.gias_lat IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY gias_urn ORDER BY distance_km, site, slat, slon) AS rank FROM p)"""


@register('J13_trust_edges', f"""{TRUSTS_SQL}
SELECT gias_urn, site, distance_km, rank FROM r WHERE rank <= 5""")
def trust_edges(spark, d):
    """Up to 5 visited sites of the same trust per normal lead, nearest first,
    one site per distinct coordinate. A same-trust k-nearest grid search, so a
    large trust never emits all its lead x site pairs."""
    return _trust_edges(spark, d, _every_lead(spark, d)).select('gias_urn', 'site', 'distance_km', 'rank')


def _trust_edges(spark, d, leads):
    reg = B.registry(spark, d).select(F.col('gias_name').alias('school_name'), F.col('trust_name').alias('_st'))
    sites = (B.visited_sites(spark, d).join(reg, 'school_name', 'inner')
             .filter(F.col('latitude').isNotNull() & F.col('longitude').isNotNull()))
    sites = (sites.groupBy('_st', 'latitude', 'longitude').agg(F.min('school_name').alias('site'))
                  .select('site', F.col('latitude').alias('_slat'), F.col('longitude').alias('_slon'), '_st'))
    return nearest_join(leads, sites, 5, 'gias_urn',
                        ['site', '_slat', '_slon'], 'gias_lat', 'gias_lon', '_slat', '_slon',
                        distance='great_circle', keys=[('trust_name', '_st')])


#: J14's cluster edges with their places, after J13's trust edges: five connections a lead in all.
CLUSTER_LINES_SQL = f"""{CLUSTERS_SQL}, leads AS ({_normal_leads_sql()}), means AS ({MEANS_SQL}),
trust AS (SELECT * FROM ({TRUSTS_SQL} SELECT gias_urn, slat, slon FROM r WHERE rank <= 5)),
taken AS (SELECT gias_urn, count(*) AS n FROM trust GROUP BY gias_urn),
member AS (SELECT cluster, latitude, longitude, min(school_name) AS site FROM assigned GROUP BY ALL),
toward AS ({_nearest_cluster_sql('gias_urn, gias_lat, gias_lon')}),
pairs AS (SELECT t.gias_urn, s.site, s.latitude, s.longitude, {S.gc('t.gias_lat', 't.gias_lon', 's.latitude', 's.longitude')} AS distance_km
          FROM toward t JOIN member s ON s.cluster = t.nearest_cluster
          WHERE NOT EXISTS (SELECT 1 FROM trust x WHERE x.gias_urn = t.gias_urn AND x.slat = s.latitude AND x.slon = s.longitude)),
after AS (SELECT p.*, coalesce(n, 0) + row_number() OVER (PARTITION BY gias_urn ORDER BY distance_km, site, latitude, longitude) AS rank
          FROM pairs p LEFT JOIN taken USING (gias_urn))
SELECT gias_urn, site, distance_km, rank, latitude, longitude FROM after WHERE rank <= 5"""

PLACE_OF_NAME = 'JOIN visg v ON v.school_name = e.{name}'


def _lines_sql(kind: str, name: str, edges: str, colour: str, width: float, opacity: float, dashes: str, label: str,
               place: str = PLACE_OF_NAME) -> str:
    return (f"SELECT e.gias_urn, '{kind}' AS edge_type, e.rank, g.gias_lat AS from_lat, g.gias_lon AS from_lon, "
            f"v.latitude AS to_lat, v.longitude AS to_lon, e.{name} AS to_name, '{colour}' AS colour, "
            f"CAST({width} AS DOUBLE) AS width, CAST({opacity} AS DOUBLE) AS opacity, {dashes} AS dashes, {label} AS label "
            f"FROM ({edges}) e JOIN reg g ON g.gias_urn = e.gias_urn {place.format(name=name)}")


def _champion_lines_sql(edges: str, colour: str) -> str:
    return _lines_sql('champion', 'champion', edges, colour, 2, 0.4, "'5, 10'",
                      "'Connection to ' || e.champion || ' (' || printf('%.1f', e.distance_km) || ' km)'")


NO_TEXT = 'CAST(NULL AS VARCHAR)'
DEPRIVED_SQL = f'SELECT DISTINCT gias_urn, gias_lat, gias_lon FROM ({S.leads_deprived(top_n=None)})'


@register('V4_connection_lines', f"""
WITH {S.REGISTRY}, {S.VISITED}
{_champion_lines_sql(ORACLE['J10_champion_edges'], '#4169E1')}
UNION ALL {_champion_lines_sql(_champions_sql(DEPRIVED_SQL), '#DC143C')}
UNION ALL {_lines_sql('trust', 'site', ORACLE['J13_trust_edges'], 'green', 2, 0.8, NO_TEXT, NO_TEXT)}
UNION ALL {_lines_sql('cluster', 'site', CLUSTER_LINES_SQL, 'orange', 1.5, 0.6, NO_TEXT, NO_TEXT,
                      'JOIN LATERAL (SELECT e.latitude, e.longitude) v ON true')}""")
def connection_lines(spark, d):
    """V4: map lines with style and distance label: from normal and deprived-area leads to champions, and from
    normal leads to sites of their trust and, up to five in all, to members of their nearest cluster."""
    starts = B.registry(spark, d).select('gias_urn', 'gias_lat', 'gias_lon')
    leads = _every_lead(spark, d)
    trust = cut_lineage(_trust_edges(spark, d, leads))
    assigned, _ = G.kmeans_clusters(points(spark, d), 5)
    members = (assigned.groupBy('cluster', 'latitude', 'longitude').agg(F.min('school_name').alias('site'))
               .select('site', F.col('latitude').alias('_slat'), F.col('longitude').alias('_slon'), F.col('cluster').alias('_sc')))
    cluster = G.cluster_edges(leads, 'gias_urn', members, G.cluster_centroids(assigned), trust, cap=5)

    def lines(edges, kind, name, place, colour=None):
        edges = edges.withColumnsRenamed({place + 'lat': 'latitude', place + 'lon': 'longitude'})
        return R.connection_lines(edges.join(starts, 'gias_urn'), kind, name, colour)

    normal = lines(_champion_edges(spark, d, leads), 'champion', 'champion', '_c', R.NORMAL_LEAD_COLOUR)
    deprived = lines(_champion_edges(spark, d, _every_deprived_lead(spark, d)), 'champion', 'champion', '_c', R.DEPRIVED_LEAD_COLOUR)
    return normal.unionByName(deprived).unionByName(lines(trust, 'trust', 'site', '_s')).unionByName(lines(cluster, 'cluster', 'site', '_s'))


@register('J14_connection_edges', f"""{CLUSTERS_SQL}, leads AS ({_normal_leads_sql()}), means AS ({MEANS_SQL}),
site AS (SELECT r.trust_name, a.cluster, a.latitude, a.longitude, min(a.school_name) AS site
         FROM assigned a JOIN reg r ON r.gias_name = a.school_name GROUP BY ALL),
toward AS ({_nearest_cluster_sql('gias_urn, gias_lat, gias_lon')}),
pairs AS (
  SELECT l.gias_urn, s.site, s.latitude, s.longitude, 'trust' AS edge_type, {S.gc('l.gias_lat', 'l.gias_lon', 's.latitude', 's.longitude')} AS distance_km
  FROM leads l JOIN site s ON s.trust_name = l.trust_name WHERE l.gias_lat IS NOT NULL AND l.gias_lon IS NOT NULL
  UNION ALL
  SELECT t.gias_urn, s.site, s.latitude, s.longitude, 'cluster', {S.gc('t.gias_lat', 't.gias_lon', 's.latitude', 's.longitude')}
  FROM toward t JOIN site s ON s.cluster = t.nearest_cluster),
first5 AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY gias_urn, edge_type ORDER BY distance_km, site, latitude, longitude) <= 5),
edges AS (SELECT *, row_number() OVER (PARTITION BY gias_urn ORDER BY edge_type = 'cluster', distance_km, site) AS edge_rank
          FROM first5 f WHERE edge_type = 'trust' OR NOT EXISTS (
            SELECT 1 FROM first5 t WHERE t.edge_type = 'trust' AND t.gias_urn = f.gias_urn AND t.latitude = f.latitude AND t.longitude = f.longitude))
SELECT gias_urn, site, distance_km, edge_type, edge_rank FROM edges WHERE edge_rank <= 5""")
def connection_edges(spark, d):
    """J13 + J14 + W5: trust then nearest-cluster connections per lead, 5 in all."""
    assigned, _ = G.kmeans_clusters(points(spark, d), 5)
    cent = G.cluster_centroids(assigned)
    reg = B.registry(spark, d).select(F.col('gias_name').alias('school_name'), F.col('trust_name').alias('_st'))
    sites = assigned.join(reg, 'school_name', 'inner').select(
        F.col('school_name').alias('site'), 'latitude', 'longitude', '_st', 'cluster')
    leads = L.normal_leads(B.registry(spark, d), B.visited_sites(spark, d), ALL_LEADS)
    return G.connection_edges(leads.select('gias_urn', 'gias_lat', 'gias_lon', 'trust_name'), 'gias_urn',
                              sites, cent, cap=5)
