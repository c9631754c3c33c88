"""Operator fixtures and equivalence properties (grid joins, hull, DBSCAN, matching, leads)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitescope.functions.geo import great_circle_km, haversine_km
from sitescope.operators import geo as G
from sitescope.operators import leads as L
from sitescope.operators import match as MT
from sitescope.operators import metrics as M
from sitescope.operators import textagg as X
from sitescope.operators.nearest import FEW, FEW_PER_K, candidates, nearest_join, nearest_other
from sitescope.operators.spatial import radius_join


def _points(spark, n, seed, name):
    rnd = random.Random(seed)
    rows = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(n)]
    rows += [(n + i, rnd.uniform(84, 90), rnd.uniform(-180, 180)) for i in range(n // 10)]
    rows += [(2 * n + i, rnd.uniform(-5, 5), rnd.choice([-1, 1]) * rnd.uniform(179, 180)) for i in range(n // 10)]
    return spark.createDataFrame(rows, f'{name}id long, {name}lat double, {name}lon double')


@pytest.mark.parametrize('radius', [0.5, 80.0, 900.0, 7000.0])
def test_radius_join_equals_brute_force(spark, radius):
    left, right = _points(spark, 400, 1, 'l'), _points(spark, 60, 2, 'r')
    got = {tuple(r) for r in radius_join(left, right, radius, 'llat', 'llon', 'rlat', 'rlon')
           .select('lid', 'rid').collect()}
    bf = {tuple(r) for r in left.crossJoin(right).filter(great_circle_km('llat', 'llon', 'rlat', 'rlon') <= radius)
          .select('lid', 'rid').collect()}
    assert got == bf
    semi = {r.lid for r in radius_join(left, right, radius, 'llat', 'llon', 'rlat', 'rlon', how='left_semi').collect()}
    assert semi == {a for a, _ in bf}


def test_radius_join_salted_same(spark):
    left, right = _points(spark, 300, 3, 'l'), _points(spark, 40, 4, 'r')
    a = radius_join(left, right, 500.0, 'llat', 'llon', 'rlat', 'rlon').select('lid', 'rid').collect()
    b = radius_join(left, right, 500.0, 'llat', 'llon', 'rlat', 'rlon', salt=4).select('lid', 'rid').collect()
    assert sorted(a) == sorted(b)


def test_radius_join_boundary_inclusive(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], 'lid long, llat double, llon double')
    right = spark.createDataFrame([(1, 0.0, 1.0)], 'rid long, rlat double, rlon double')
    d = left.crossJoin(right).select(great_circle_km('llat', 'llon', 'rlat', 'rlon')).first()[0]
    assert radius_join(left, right, d, 'llat', 'llon', 'rlat', 'rlon').count() == 1


def test_knn_equals_brute_force(spark):
    left, right = _points(spark, 300, 5, 'l'), _points(spark, 50, 6, 'r')
    got = {(r.lid, r.rid, r['rank']) for r in nearest_join(left, right, 3, 'lid', ['rid'], 'llat', 'llon', 'rlat', 'rlon').collect()}
    w = Window.partitionBy('lid').orderBy('d', 'rid')
    bf = {(r.lid, r.rid, r.k) for r in left.crossJoin(right)
          .withColumn('d', great_circle_km('llat', 'llon', 'rlat', 'rlon'))
          .withColumn('k', F.row_number().over(w)).filter('k <= 3').collect()}
    assert got == bf


def test_knn_keyed(spark):
    rnd = random.Random(7)
    left = spark.createDataFrame([(i, rnd.uniform(50, 55), rnd.uniform(-3, 1), i % 3) for i in range(120)],
                                 'lid long, llat double, llon double, g int')
    right = spark.createDataFrame([(i, rnd.uniform(50, 55), rnd.uniform(-3, 1), i % 4) for i in range(40)],
                                  'rid long, rlat double, rlon double, rg int')
    got = {(r.lid, r.rid) for r in nearest_join(left, right, 2, 'lid', ['rid'], 'llat', 'llon', 'rlat', 'rlon', keys=[('g', 'rg')]).collect()}
    w = Window.partitionBy('lid').orderBy('d', 'rid')
    bf = {(r.lid, r.rid) for r in left.join(right, left.g == right.rg)
          .withColumn('d', great_circle_km('llat', 'llon', 'rlat', 'rlon'))
          .withColumn('k', F.row_number().over(w)).filter('k <= 2').collect()}
    assert got == bf


def test_nearest_other_duplicates_and_alone(spark):
    pts = spark.createDataFrame([(1, 51.0, 0.0), (2, 51.0, 0.0), (3, 52.0, 0.0)], 'id long, lat double, lon double')
    got = {r.id: r.nearest_km for r in nearest_other(pts, 'id', 'lat', 'lon').collect()}
    assert got[1] == 0.0 and got[2] == 0.0
    assert got[3] == pytest.approx(111.19, abs=0.1)
    one = spark.createDataFrame([(1, 51.0, 0.0)], 'id long, lat double, lon double')
    assert nearest_other(one, 'id', 'lat', 'lon').first().nearest_km is None


def test_hull_matches_single_partition(spark):
    rnd = random.Random(11)
    pts = [(rnd.gauss(52, 1), rnd.gauss(-1, 1)) for _ in range(2000)]
    df = spark.createDataFrame(pts, 'latitude double, longitude double').repartition(16)
    r = G.hull_area(df).first()
    h = G._monotone_chain(np.array(pts))
    x, y = h[:, 0], h[:, 1]
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    assert r.hull_area_deg2 == pytest.approx(area)
    assert r.coverage_area_km2 == pytest.approx(area * 111 * 111)


def test_hull_degenerate(spark):
    two = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], 'latitude double, longitude double')
    assert G.hull_area(two).first().coverage_area_km2 is None
    line = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (3.0, 3.0)], 'latitude double, longitude double')
    assert G.hull_area(line).first().coverage_area_km2 is None


def _naive_dbscan(pts, eps, min_samples):
    n = len(pts)
    d = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = pts[i], pts[j]
            p1, p2 = math.radians(a[1]), math.radians(b[1])
            h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
            d[i][j] = 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))
    core = [sum(1 for j in range(n) if d[i][j] <= eps) >= min_samples for i in range(n)]
    comp = list(range(n))

    def find(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x
    for i in range(n):
        for j in range(n):
            if core[i] and core[j] and d[i][j] <= eps:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    label = {}
    for i in range(n):
        if core[i]:
            label[i] = min(pts[k][0] for k in range(n) if core[k] and find(k) == find(i))
    out = {}
    for i in range(n):
        if core[i]:
            out[pts[i][0]] = label[i]
        else:
            ls = [label[j] for j in range(n) if core[j] and d[i][j] <= eps]
            out[pts[i][0]] = min(ls) if ls else -1
    return out


def test_dbscan_equals_naive(spark):
    rnd = random.Random(13)
    pts = [(i, 52 + rnd.gauss(0, 0.05) * (1 + i % 3), -1 + rnd.gauss(0, 0.05)) for i in range(150)]
    pts += [(150, 52.0, -1.0), (151, 52.0, -1.0)]  # duplicates
    df = spark.createDataFrame(pts, 'id long, latitude double, longitude double')
    got = {r.id: r.cluster for r in G.dbscan(df, 'id', eps_km=1.5, min_samples=4).collect()}
    assert got == _naive_dbscan(pts, 1.5, 4)


@pytest.mark.parametrize('gap_km', [0.95, 1.05])
def test_dbscan_of_crowded_cells_equals_naive(spark, gap_km):
    """Crowds on both sides of a gap near eps, a chain of lone points, and border points."""
    rnd = random.Random(17)
    deg = 1 / 111.195
    rows = []
    for side in (-1, 1):  # crowds whose facing borders are gap_km apart
        rows += [(52 + rnd.uniform(-1, 1) * deg, side * (gap_km / 2 + abs(rnd.gauss(0, 0.3))) * deg / math.cos(math.radians(52))) for _ in range(90)]
    rows += [(52 + 3 * deg + 0.9 * deg * i, 0.0) for i in range(6)] + [(52 + 1.8 * deg, 0.0), (40.0, 0.0), (52.0, 0.0005)]
    pts = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(pts, 'id long, latitude double, longitude double')
    got = {r.id: r.cluster for r in G.dbscan(df, 'id', eps_km=1.0, min_samples=4).collect()}
    assert got == _naive_dbscan(pts, 1.0, 4)


def test_dbscan_of_facing_crowds_equals_naive(spark):
    """Pairs of crowds at gaps near eps, turned in every direction, some of them closest away from their ends."""
    rnd = random.Random(23)
    deg = 1 / 111.195
    rows = []
    for g in range(24):
        turn, gap = rnd.uniform(0, 2 * math.pi), rnd.uniform(0.7, 1.1)
        for side in (-1, 1):
            for _ in range(14):
                u, v = rnd.uniform(-0.2, 0.2), side * (gap / 2 + abs(rnd.gauss(0, 0.1)))
                y, x = u * math.cos(turn) + v * math.sin(turn), v * math.cos(turn) - u * math.sin(turn)
                rows.append((50 + g * 0.2 + y * deg, x * deg / math.cos(math.radians(50 + g * 0.2))))
    pts = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(pts, 'id long, latitude double, longitude double')
    got = {r.id: r.cluster for r in G.dbscan(df, 'id', eps_km=1.0, min_samples=4).collect()}
    assert got == _naive_dbscan(pts, 1.0, 4)


def test_cells_of_one_crowd_compare_no_points(spark, monkeypatch):
    """Dense cells in one cluster by their outermost points: what is joined grows with cells, not with points."""
    rnd = random.Random(29)
    monkeypatch.setattr(G, 'nearest_join', None)
    n = 4000
    df = spark.createDataFrame([(i, 52 + rnd.uniform(0, 0.05), -1 + rnd.uniform(0, 0.05)) for i in range(n)], 'id long, latitude double, longitude double')
    assert G.dbscan(df, 'id', eps_km=2.0, min_samples=3).where('cluster = 0').count() == n


def test_points_within_one_eps_make_no_pairs(spark):
    rnd = random.Random(19)
    n = 5000
    df = spark.createDataFrame([(i, 52 + rnd.uniform(0, 0.01), -1 + rnd.uniform(0, 0.01)) for i in range(n)], 'id long, latitude double, longitude double')
    places = G._super_points(df, 'id', 2.0, 5, 'latitude', 'longitude')
    assert places.where('not _dense').count() < 20  # what is compared with neighbours
    assert G.dbscan(df, 'id', eps_km=2.0, min_samples=5).where('cluster = 0').count() == n


def test_fuzzy_blocking_is_lossless(spark):
    reg = spark.createDataFrame([('Oak Hill School', 1, 'T1'), ('Hill Oak Schol', 2, 'T2'), ('Elm Primary', 3, 'T3'),
                                 ('Oak Hill Schools', 4, 'T4')], 'gias_name string, reg_ord long, trust_name string')
    reg = reg.withColumn('norm_name', MT.norm_name('gias_name'))
    names = spark.createDataFrame([('School Hill Oak',), ('Elm Primry',), ('Nothing Alike At All',)], 'n string')
    got = {r.n: (r.trust_name, r.match_type) for r in MT.match_to_registry(names, 'n', reg).collect()}
    assert got['School Hill Oak'] == ('T1', 'fuzzy')
    assert got['Elm Primry'] == ('T3', 'fuzzy')
    assert got['Nothing Alike At All'] == (None, None)
    # brute force over all pairs gives the same best rows
    from sitescope.functions.fuzzy import indel_ratio
    regs = [(r.gias_name, r.reg_ord, r.trust_name) for r in reg.collect()]
    for q in ['School Hill Oak', 'Elm Primry']:
        key = lambda s: ' '.join(sorted(s.split()))
        best = max(regs, key=lambda t: (indel_ratio(key(q), key(t[0])), -t[1]))
        assert got[q][0] == best[2]


def test_exact_match_unusable_trust_falls_through(spark):
    # exact (normalised) hit is row 1 without a usable trust; the case-sensitive
    # fuzzy leg then finds row 2 (score 100) which has one
    reg = spark.createDataFrame([('OAK SCHOOL', 1, 'Not Applicable'), ('oak school', 2, 'Real Trust')],
                                'gias_name string, reg_ord long, trust_name string')
    reg = reg.withColumn('norm_name', MT.norm_name('gias_name'))
    champs = spark.createDataFrame([('oak school',)], 'school_name string')
    assert [r.trust_name for r in MT.champion_trusts(champs, reg).collect()] == ['Real Trust']
    # the best fuzzy row is taken even when its trust is unusable (no second choice)
    reg2 = spark.createDataFrame([('Oak School', 1, 'Not Applicable'), ('Oak Schools', 2, 'Real Trust')],
                                 'gias_name string, reg_ord long, trust_name string')
    reg2 = reg2.withColumn('norm_name', MT.norm_name('gias_name'))
    champs2 = spark.createDataFrame([('oak school x',)], 'school_name string')
    assert MT.champion_trusts(champs2, reg2).count() == 0


def _registry(spark, rows):
    df = spark.createDataFrame(rows, 'gias_urn long, gias_name string, trust_name string, gias_lat double, '
                                     'gias_lon double, fsm_percentage double')
    return (df.withColumn('easting', F.lit(None).cast('double')).withColumn('northing', F.lit(None).cast('double'))
              .withColumn('postcode', F.lit(None).cast('string')).withColumn('norm_name', MT.norm_name('gias_name'))
              .withColumn('reg_ord', F.col('gias_urn')))


def test_lead_pipeline_fixture(spark):
    reg = _registry(spark, [
        (1, 'Champ A', 'T1', 51.0, 0.0, 10.0),
        (2, 'Lead Same Trust', 'T1', 53.0, 0.0, 40.0),
        (3, 'Lead Near', 'T9', 51.01, 0.0, 35.0),
        (4, 'Far Away', 'T8', 60.0, 5.0, 50.0),
        (5, 'Visited Once', 'T1', 51.0, 0.001, 20.0),
        (6, None, 'T1', None, None, 31.0),
    ])
    visited = spark.createDataFrame([(' champ a', 3, 51.0, 0.0), ('VISITED ONCE', 1, 51.0, 0.001)],
                                    'school_name string, visit_count long, latitude double, longitude double')
    cfg = L.LeadConfig(hotspot_radius_km=5.0, top_n=100)
    normal = {r.gias_urn: r for r in L.normal_leads(reg, visited, cfg).collect()}
    assert set(normal) == {2, 3, 6}                    # visited names (case/space-insensitive) excluded
    assert normal[2].lead_type == 'Trust Lead'         # trust first
    assert normal[3].lead_type == 'Hotspot Lead'
    assert normal[6].priority_score is None            # no coordinates -> null score, sorted last
    assert normal[6].nearest_champion is None
    maxd = max(normal[2].distance_to_champion_km, normal[3].distance_to_champion_km)
    assert normal[2].priority_score == pytest.approx(10 + 5 * (1 - normal[2].distance_to_champion_km / maxd))
    order = [r.gias_urn for r in L.normal_leads(reg, visited, cfg).collect()]
    assert order[-1] == 6
    dep = {r.gias_urn: r.impact_score for r in L.deprived_area_leads(reg, visited, cfg).collect()}
    assert dep == {2: pytest.approx(8.0), 3: pytest.approx(7.0), 4: pytest.approx(10.0), 6: pytest.approx(6.2)}


def test_first_per_key_prefers_trust(spark):
    df = spark.createDataFrame([(1, 1, 5, 'h'), (1, 0, 5, 't'), (None, 1, 7, 'x'), (None, 1, 6, 'y')],
                               'gias_urn long, _t int, reg_ord long, v string')
    got = {r.gias_urn: r.v for r in L.first_per_key(df, 'gias_urn', ['_t', 'reg_ord']).collect()}
    assert got == {1: 't', None: 'y'}


def test_score_by_single_row_and_null_key(spark):
    df = spark.createDataFrame([('a', 5), ('a', 3), ('b', 4), (None, 2), ('c', None)], 'g string, effectiveness_score int')
    got = {r.g: (r.mean, r['count'], r.std) for r in M.score_by(df, 'g').collect()}
    assert got['a'] == (4.0, 2, pytest.approx(1.41))
    assert got['b'] == (4.0, 1, None)
    assert got['c'] == (None, 0, None)
    assert None not in got


def test_visit_summary_latest_non_null(spark):
    rows = [('s', '2024-01-01', 'x', 1), ('s', '2024-02-01', None, 2), ('s', None, 'late', 3), ('t', '2024-01-01', None, 4)]
    df = spark.createDataFrame(rows, 'site string, d string, a string, o long').withColumn('d', F.col('d').cast('timestamp'))
    got = {r.site: r for r in M.visit_summary(df, 'site', 'd', 'o', {'latest': 'a'}).collect()}
    assert got['s'].visit_count == 3 and got['s'].latest == 'late'
    assert got['t'].latest is None


def test_completeness(spark):
    df = spark.createDataFrame([(1, None, 'x'), (2, None, None), (3, 'a', 'y'), (4, None, 'z'), (5, None, 'w')],
                               'a int, b string, c string')
    assert {r.field: r.missing_percentage for r in M.completeness(df).collect()} == {'b': 80.0}


def test_sentiment_summary_empty_and_even(spark):
    empty = spark.createDataFrame([], 'id long, t string')
    r = X.sentiment_summary(empty, 't', 'id').first()
    assert (r.mean_sentiment, r.median_sentiment, r.std_sentiment, r.positive) == (0.0, 0.0, 0.0, 0)
    df = spark.createDataFrame([(1, 'great'), (2, 'boring'), (3, 'good stuff'), (4, 'nothing')], 'id long, t string')
    r = X.sentiment_summary(df, 't', 'id').first()
    assert r.median_sentiment == pytest.approx(0.5)
    assert r.mean_sentiment == pytest.approx(0.25)
    assert r.std_sentiment == pytest.approx(float(np.std([1, -1, 1, 0])))
    assert (r.positive, r.neutral, r.negative) == (2, 1, 1)


def test_keyword_ties_first_seen(spark):
    df = spark.createDataFrame([(1, 'zebra apple'), (2, 'apple zebra mango')], 'id long, t string')
    got = [(r.word, r['count']) for r in X.keyword_counts(df, 't', 'id', 3).collect()]
    assert got == [('zebra', 2), ('apple', 2), ('mango', 1)]


def test_site_groups_repeated_word_counts_twice(spark):
    df = spark.createDataFrame([('Riverside Riverside School',), ('Oak Academy Primary',), ('Oak Academy Junior',)],
                               'school_name string')
    got = sorted((r.group_key, r.n_sites) for r in MT.site_groups(df).collect())
    assert ('riverside', 2) in got
    assert ('academy_oak academy', 2) in got


def test_hot_keys_stay_whole(spark):
    """One key holding a third of all rows: results are whole and equal to brute force."""
    n = 3000
    # group index: a third of all names share one long word
    names = spark.createDataFrame([(f'Hotword School {i}' if i % 3 == 0 else f'Name{i} Place{i % 50}',)
                                   for i in range(n)], 'school_name string')
    groups = MT.site_groups(names)
    assert groups.filter(F.col('group_key') == 'hotword').count() == n // 3
    assert groups.filter(F.col('group_key') == 'hotword').select(F.max('n_sites')).first()[0] == n // 3
    # dedupe: a third of all rows share one URN (null)
    rows = [(None if i % 3 == 0 else i, i % 2, i, f'v{i}') for i in range(n)]
    df = spark.createDataFrame(rows, 'gias_urn long, _t int, reg_ord long, v string')
    got = {r.gias_urn: r.v for r in L.first_per_key(df, 'gias_urn', ['_t', 'reg_ord']).collect()}
    assert len(got) == n - n // 3 + 1 and got[None] == 'v0'
    # radius join: a third of the probe side in one grid cell, salted and unsalted agree
    rnd = random.Random(5)
    pts = [(i, 51.5 + rnd.uniform(-0.001, 0.001), -0.1 + rnd.uniform(-0.001, 0.001)) if i % 3 == 0
           else (i, rnd.uniform(50, 55), rnd.uniform(-4, 1)) for i in range(n)]
    left = spark.createDataFrame(pts, 'lid long, llat double, llon double')
    right = spark.createDataFrame([(j, 51.5 + 0.01 * j, -0.1) for j in range(5)], 'rid long, rlat double, rlon double')
    a = radius_join(left, right, 3.0, 'llat', 'llon', 'rlat', 'rlon').count()
    b = radius_join(left, right, 3.0, 'llat', 'llon', 'rlat', 'rlon', salt=8).count()
    bf = left.crossJoin(right).filter(great_circle_km('llat', 'llon', 'rlat', 'rlon') <= 3.0).count()
    assert a == b == bf and bf >= n // 3


def test_kmeans_separated_clusters(spark):
    rnd = random.Random(21)
    centres = [(50.0, -3.0), (52.0, 0.0), (54.0, -2.0)]
    rows = [(f'p{c}_{i}', cy + rnd.uniform(-0.05, 0.05), cx + rnd.uniform(-0.05, 0.05), c)
            for c, (cy, cx) in enumerate(centres) for i in range(40)]
    df = spark.createDataFrame(rows, 'school_name string, latitude double, longitude double, truth int')
    assigned, cent = G.kmeans_clusters(df, 3)
    pairs = {(r.truth, r.cluster) for r in assigned.select('truth', 'cluster').distinct().collect()}
    assert pairs == {(0, 0), (1, 1), (2, 2)}          # ids follow centroid order (latitude first)
    sizes = {r.cluster: r.size for r in G.cluster_sizes(assigned).collect()}
    assert sizes == {0: 40, 1: 40, 2: 40}
    got = sorted((round(r.centroid_lat), round(r.centroid_lon)) for r in G.cluster_centroids(assigned).collect())
    assert got == [(50, -3), (52, 0), (54, -2)]


def test_kmeans_equals_plain_lloyd_whatever_the_partitions(spark):
    rnd = random.Random(5)
    rows = [(f'p{i}', round(rnd.uniform(50, 52), 2), round(rnd.uniform(-2, 0), 2)) for i in range(150)] * 2 + [('n', None, 1.0)]
    df = spark.createDataFrame(rows, 'school_name string, latitude double, longitude double')
    best = None
    pts = [(x, y) for _, x, y in rows if x is not None]
    gap = lambda p, c: (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2
    for a, b in G.KMEANS_STARTS:
        cs = [max(pts, key=lambda p: (p[0] * a + p[1] * b, -p[0], -p[1]))]
        while len(cs) < 4:
            cs.append(max(pts, key=lambda p: (min(gap(p, c) for c in cs), -p[0], -p[1])))
        while True:
            own = [min(range(4), key=lambda j: (gap(p, cs[j]), j)) for p in pts]
            moved = [tuple(sum(p[i] for p, o in zip(pts, own) if o == j) / own.count(j) for i in (0, 1)) for j in range(4)]
            if max(gap(m, c) for m, c in zip(moved, cs)) < 1e-20:
                break
            cs = moved
        cost = round(sum(min(gap(p, c) for c in cs) for p in pts), 6)
        if best is None or cost < best[0]:
            best = cost, sorted(cs)
    fits = []
    for n in (1, 7):
        assigned, cent = G.kmeans_clusters(df.repartition(n), 4)
        fits.append(sorted(map(tuple, cent.collect())))
        assert assigned.count() == 300
    assert fits[0] == fits[1]
    assert [(round(x, 9), round(y, 9)) for _, x, y in fits[0]] == [(round(x, 9), round(y, 9)) for x, y in best[1]]


def test_kmeans_few_and_no_places(spark):
    schema = 'school_name string, latitude double, longitude double'
    assigned, cent = G.kmeans_clusters(spark.createDataFrame([('a', 1.0, 2.0), ('b', 1.0, 2.0), ('c', 3.0, 1.0)], schema), 5)
    assert {r.school_name: r.cluster for r in assigned.collect()} == {'a': 0, 'b': 0, 'c': 1} and cent.count() == 2
    assigned, cent = G.kmeans_clusters(spark.createDataFrame([('a', None, None)], schema), 5)
    assert assigned.columns[-1] == 'cluster' and assigned.count() == cent.count() == 0


def test_head_rows_and_profile(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f'v{i}') for i in range(30, 0, -1)], 'k long, v string')
    assert [r.k for r in M.head_rows(df, ['k'], 10).collect()] == list(range(1, 11))
    prof = {r.column_name: (r.rows, r.non_null, r.dtype) for r in M.table_profile(df, 't').collect()}
    assert prof == {'k': (30, 30, 'bigint'), 'v': (30, 23, 'string')}


@pytest.mark.parametrize('k', [1, 3])
def test_rows_far_from_a_dense_cluster_make_few_pairs(spark, k):
    rnd = random.Random(11)
    n, far = 20_000, 300
    cluster = [(i, 52 + rnd.gauss(0, 0.05), -1 + rnd.gauss(0, 0.05)) for i in range(n)]
    near = [(i, 52 + rnd.gauss(0, 0.05), -1 + rnd.gauss(0, 0.05)) for i in range(far)]
    away = [(far + i, 47.5 + rnd.random(), -1 + rnd.random()) for i in range(far)]  # some 500 km off
    left = spark.createDataFrame(near + away, 'lid long, llat double, llon double')
    right = spark.createDataFrame(cluster, 'rid long, rlat double, rlon double')
    pairs = candidates(left, right, k, ('llat', 'llon'), ('rlat', 'rlon'))
    assert pairs.count() <= 2 * far * (FEW + FEW_PER_K * k)
    got = {(r.lid, r.rid, r['rank']) for r in nearest_join(left, right, k, 'lid', ['rid'], 'llat', 'llon', 'rlat', 'rlon').collect()}
    w = Window.partitionBy('lid').orderBy('d', 'rid')
    want = {(r.lid, r.rid, r.n) for r in left.crossJoin(right).withColumn('d', great_circle_km('llat', 'llon', 'rlat', 'rlon'))
            .withColumn('n', F.row_number().over(w)).where(F.col('n') <= k).select('lid', 'rid', 'n').collect()}
    assert got == want


def test_nearest_of_one_crowded_place(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 89.9, 10.0), (3, None, 1.0)], 'lid long, llat double, llon double')
    right = spark.createDataFrame([(i, 0.0, 180.0) for i in range(5000, 0, -1)], 'rid long, rlat double, rlon double')
    got = sorted((r.lid, r.rid, r['rank']) for r in nearest_join(left, right, 2, 'lid', ['rid'], 'llat', 'llon', 'rlat', 'rlon').collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
    assert candidates(left, right.limit(2), 2, ('llat', 'llon'), ('rlat', 'rlon')).count() == 4


def test_first_occurrence_breaks_ties_for_any_order_key(spark):
    from sitescope.operators.textagg import keyword_counts
    rows = [(-1, 'zebra'), (5, 'apple zebra'), (2, 'apple'), (1 << 60, 'mango mango')]
    df = spark.createDataFrame(rows, 'ord long, text string')
    got = [r.word for r in keyword_counts(df, 'text', 'ord', 2, stopwords=None).collect()]
    assert got == ['zebra', 'apple']
    named = spark.createDataFrame([('b', 'one two'), ('a', 'two one'), ('c', 'three')], 'ord string, text string')
    assert [r.word for r in keyword_counts(named, 'text', 'ord', 3, stopwords=None).collect()] == ['two', 'one', 'three']


def test_hull_is_a_tree_with_an_exchange_per_level(spark):
    from sitescope.operators.geo import HULL_LEVELS, hull_vertices
    pts = spark.range(0, 4000, 1, 32).selectExpr('cos(id) as latitude', 'sin(id) * 2 as longitude')
    plan = hull_vertices(pts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count('Exchange') == len(HULL_LEVELS) and 'Coalesce' not in plan


def test_no_cartesian_product_in_plans(spark):
    import __spark_entry__ as E
    for key in ('J8_radius', 'L2_hotspot_leads', 'J4_lookup_by_name', 'A18_keywords'):
        if key in E.queries():
            plan = E.queries()[key](spark, '/root/testdata/sf0.001')._jdf.queryExecution().executedPlan().toString()
            assert 'CartesianProduct' not in plan


def test_checkpoint_tables_go_when_dropped(spark):
    import os
    from sitescope.session import _tables_folder, cut_lineage, drop_tables
    assert cut_lineage(spark.range(3)).count() == 3
    folder = _tables_folder(spark).removeprefix('file:')
    assert os.listdir(folder)
    drop_tables(spark)
    assert not os.path.exists(folder)


# reports from one pass

def _report_rows(df):
    return {(r.section, r.key, r.metric): r.value for r in df.collect()}


SURVEY_TYPES = ('effectiveness_score double, effectiveness_rating string, would_recommend string, school_name string, age_group string, '
                'gender string, submission_date timestamp_ntz, external_speaker_engaging string, confident_identifying_dangers double, '
                'understanding_grooming double, understanding_online_vs_real double')


def test_effectiveness_report_equals_its_parts_in_one_scan(spark, tmp_path):
    import datetime as dt

    from sitescope.operators import metrics as M
    from sitescope.operators import reports as R
    rows = [(float(i % 5) if i % 7 else None, ('Excellent', 'Poor', None)[i % 3], ('Yes', 'No', None, None)[i % 4], f's{i % 6}' if i % 9 else None,
             ('', 'a', None)[i % 3], 'g' if i % 2 else None, dt.datetime(2024, 1 + i % 3, 5) if i % 5 else None, ('Yes', None)[i % 2],
             float(i), None, 2.0) for i in range(60)]
    spark.createDataFrame(rows, SURVEY_TYPES).write.parquet(str(tmp_path / 'survey'))
    survey = spark.read.parquet(str(tmp_path / 'survey'))
    report = R.effectiveness_report(survey)
    got = _report_rows(report)
    kpis, outcomes = M.survey_kpis(survey).first().asDict(), M.learning_outcomes(survey).first().asDict()
    want = {('overall_metrics', None, k): v for k, v in kpis.items()} | {('learning_outcomes', None, k): v for k, v in outcomes.items()}
    for section, df in (('by_age_group', M.score_by(survey, 'age_group')), ('by_gender', M.score_by(survey, 'gender')),
                        ('temporal_trends', M.score_by_month(survey)),
                        ('external_speaker', M.score_by(survey, 'external_speaker_engaging', with_std=False))):
        for r in df.collect():
            want |= {(section, str(r[0]), m): r[m] for m in df.columns[1:]}
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if v is None} == {k: v for k, v in want.items() if v is None}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want if want[k] is not None)
    plan = R.effectiveness_report(survey)._jdf.queryExecution().executedPlan().toString()  # not run yet: one plan
    assert plan.count('FileScan parquet') == 1
    empty = _report_rows(R.effectiveness_report(survey.limit(0)))
    assert empty == {k: 0.0 if k[2] in ('total_responses', 'unique_schools') else None for k in want if k[1] is None}


def test_session_report_equals_its_parts(spark):
    from sitescope.operators import metrics as M
    from sitescope.operators import reports as R
    sessions = spark.createDataFrame([(f'm{i % 3}', f't{i % 4}' if i % 5 else None, float(i), ('x', None)[i % 2]) for i in range(40)],
                                     'month string, session_type string, count double, data_source string')
    want = {('totals', None, k): float(v) for k, v in M.session_totals(sessions).first().asDict().items()}
    for section, key in (('by_type', 'session_type'), ('by_source', 'data_source'), ('monthly', 'month')):
        want |= {(section, r[0], 'total'): r[1] for r in M.sum_by(sessions, key).collect()}
    assert _report_rows(R.session_report(sessions)) == want
    assert _report_rows(R.session_report(sessions.limit(0))) == {('totals', None, m): None if m == 'total_sessions' else 0.0 for m in (
        'total_sessions', 'unique_session_types', 'months_active', 'data_sources')}


def test_geo_report_equals_its_parts(spark):
    from sitescope.operators import composites as K
    pts = spark.createDataFrame([('a', 50.0, 0.0), ('b', 51.0, 0.5), ('c', 50.2, 1.5), ('d', 50.1, 0.2), ('far', 58.0, -3.0)],
                                'id string, latitude double, longitude double')
    want = {}
    for section, df in (('geographic_metrics', G.extent_metrics(pts)), ('coverage', G.hull_area(pts).drop('total_points', 'hull_area_deg2')),
                        ('coverage_gaps', G.coverage_gaps(pts, 'id', 50.0)[1])):
        want |= {(section, None, m): float(v) for m, v in df.first().asDict().items()}
    report = K.geo_report(pts, 'id', 50.0)
    assert report.columns == ['section', 'key', 'metric', 'label', 'value']
    got = _report_rows(report)
    assert got.keys() == want.keys() and len(got) == 14
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got[('coverage_gaps', None, 'schools_beyond_target')] == 3.0
