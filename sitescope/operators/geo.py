"""Point-set analytics.

Points are rows with an id and (latitude, longitude) in degrees.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitescope.functions import lexicons as lx
from sitescope.functions.geo import haversine_km
from sitescope.operators.nearest import nearest_join, nearest_other
from sitescope.operators.spatial import radius_join
from sitescope.session import cut_lineage


# --------------------------------------------------------------------------- extent, centre, density

def extent_metrics(points: DataFrame, lat: str = 'latitude', lon: str = 'longitude') -> DataFrame:
    """N, min / max / span of latitude and longitude, centroid (one pass)."""
    return points.agg(
        F.count(F.lit(1)).alias('total_points'),
        F.min(lat).alias('lat_min'), F.max(lat).alias('lat_max'), (F.max(lat) - F.min(lat)).alias('lat_span'),
        F.min(lon).alias('lon_min'), F.max(lon).alias('lon_max'), (F.max(lon) - F.min(lon)).alias('lon_span'),
        F.avg(lat).alias('centroid_lat'), F.avg(lon).alias('centroid_lon'))


def map_centre(tables: Sequence[tuple[DataFrame, str, str]], default=(52.5, -1.5)) -> DataFrame:
    """Mean of all coordinates across tables; the default when there are none."""
    parts = [df.select(F.col(la).alias('lat'), F.col(lo).alias('lon')) for df, la, lo in tables]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    allp = allp.filter(F.col('lat').isNotNull() & F.col('lon').isNotNull())
    return allp.agg(F.coalesce(F.avg('lat'), F.lit(default[0])).alias('center_lat'),
                    F.coalesce(F.avg('lon'), F.lit(default[1])).alias('center_lon'))


def density_grid(points: DataFrame, cell_deg: float = 0.1, lat: str = 'latitude',
                 lon: str = 'longitude') -> DataFrame:
    """V3: heat-map data as grid bins (cell centre and point count)."""
    b = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.floor(F.col(lat) / cell_deg).alias('lat_bin'), F.floor(F.col(lon) / cell_deg).alias('lon_bin'))
    return (b.groupBy('lat_bin', 'lon_bin').agg(F.count(F.lit(1)).alias('points'))
             .withColumn('cell_lat', (F.col('lat_bin') + 0.5) * cell_deg)
             .withColumn('cell_lon', (F.col('lon_bin') + 0.5) * cell_deg))


# --------------------------------------------------------------------------- convex hull

def _monotone_chain(xy: np.ndarray) -> np.ndarray:
    """Convex hull vertices (counter-clockwise, no collinear points)."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) >= 2:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) <= 0:
                    out.pop()
                else:
                    break
            out.append(tuple(p))
        return out

    lower, upper = half(pts), half(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def _hull_partition(it):
    """Hull of a partition's points, batch by batch: only the hull so far is held."""
    hull = np.zeros((0, 2))
    for pdf in it:
        pts = np.vstack((hull, pdf[['x', 'y']].to_numpy(dtype=float)))
        if len(pts):
            hull = _monotone_chain(pts).reshape(-1, 2)
    yield pd.DataFrame({'x': hull[:, 0], 'y': hull[:, 1]})


HULL_LEVELS = (64, 8, 1)


def hull_vertices(points: DataFrame, lat: str = 'latitude', lon: str = 'longitude',
                  levels: Sequence[int] = HULL_LEVELS) -> DataFrame:
    """Convex hull of all points by a tree of hulls.

    Every input partition is reduced to its hull; then only vertices are
    shuffled, at each level to fewer partitions that reduce them again, until
    one partition holds the hull of hulls.
    """
    cur = points.select(F.col(lat).cast('double').alias('x'), F.col(lon).cast('double').alias('y')) \
                .filter(F.col('x').isNotNull() & F.col('y').isNotNull())
    cur = cur.mapInPandas(_hull_partition, 'x double, y double')
    for n in levels:
        cur = cur.repartition(n).mapInPandas(_hull_partition, 'x double, y double')
    return cur


def _shoelace(it):
    chunks = [pdf[['x', 'y']].to_numpy(dtype=float) for pdf in it]
    pts = np.vstack(chunks) if chunks else np.zeros((0, 2))
    h = _monotone_chain(pts) if len(pts) else pts
    if len(h) < 3:
        area = None
    else:
        x, y = h[:, 0], h[:, 1]
        area = float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2.0)
    yield pd.DataFrame({'hull_vertices': [int(len(h))], 'hull_area_deg2': [area]})


def hull_area(points: DataFrame, lat: str = 'latitude', lon: str = 'longitude',
              km2_per_deg2: float = lx.HULL_KM2_PER_DEG2) -> DataFrame:
    """Convex-hull coverage area (deg² × 111²); null for < 3 points or a degenerate hull."""
    pts = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    n = pts.agg(F.count(F.lit(1)).alias('total_points'))
    area = (hull_vertices(pts, lat, lon)
            .mapInPandas(_shoelace, 'hull_vertices long, hull_area_deg2 double'))
    return (n.crossJoin(area)
             .withColumn('coverage_area_km2',
                         F.when(F.col('total_points') >= 3, F.col('hull_area_deg2') * F.lit(float(km2_per_deg2)))))


# --------------------------------------------------------------------------- coverage gaps

def coverage_gaps(points: DataFrame, point_id: str, target_radius_km: float = 50.0,
                  lat: str = 'latitude', lon: str = 'longitude'):
    """Nearest-other-point distances (haversine, R = 6371) and the summary.

    Returns (per_point, summary): per_point has point_id, nearest_km and
    ``isolated`` (> target); summary has mean / max nearest distance and the
    count beyond the target.
    """
    near = nearest_other(points, point_id, lat, lon, distance='haversine', dist_col='nearest_km')
    per_point = near.withColumn('isolated', F.col('nearest_km') > F.lit(float(target_radius_km)))
    summary = per_point.agg(F.avg('nearest_km').alias('avg_nearest_distance_km'),
                            F.max('nearest_km').alias('max_nearest_distance_km'),
                            F.count_if('isolated').alias('schools_beyond_target'))
    return per_point, summary


# --------------------------------------------------------------------------- k-means

#: Rounds after which a fit counts as not converging (an error, not a result).
KMEANS_ROUNDS = 10_000

#: Decimal places of summed coordinates, and the units of the high part of a sum (a power of two).
PLACES, SPLIT = 10, 1 << 20

#: First centres of the restarts: the outermost point in each of these directions (latitude, longitude).
KMEANS_STARTS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _centre_distances(centres: Sequence[Column]) -> Column:
    """Smallest (squared distance, position) of a row's ``_x``, ``_y`` to centres, structs with x and y."""
    def gap(c):
        return (F.col('_x') - c['x']) * (F.col('_x') - c['x']) + (F.col('_y') - c['y']) * (F.col('_y') - c['y'])
    gaps = [gap(c) for c in centres]
    least = gaps[0] if len(gaps) == 1 else F.least(*gaps)
    first = F.lit(len(gaps) - 1)
    for j in reversed(range(len(gaps) - 1)):  # the first of equals
        first = F.when(gaps[j] == least, F.lit(j)).otherwise(first)
    return F.struct(least.alias('d'), first.alias('j'))


def _whole_parts(value: Column, weight: Column, name: str) -> dict[str, Column]:
    """A coordinate to ten places times a weight, as two whole numbers whose sums are exact and fast.

    The value is ``high * SPLIT + low`` in units of the tenth place; the sums of
    both parts stay far within 64 bits.
    """
    units = (value.cast('decimal(13,10)') * F.lit(10 ** PLACES).cast('decimal(11,0)')).cast('long')
    return {name + 'h': F.floor(units / F.lit(SPLIT)).cast('long') * weight, name + 'l': F.pmod(units, F.lit(SPLIT)) * weight}


def _per_start(places: DataFrame, starts: dict) -> DataFrame:
    """``places`` once for every start that still runs, with the start's centres as columns c0, c1, ...

    The centres are rows of a small side (starts x k numbers, both parameters),
    not literals, so all rounds share one generated code.
    """
    k = len(next(iter(starts.values())))
    centre = [pa.array([{'x': cs[j][0], 'y': cs[j][1]} for cs in starts.values()]) for j in range(k)]
    side = places.sparkSession.createDataFrame(pa.table([pa.array(list(starts), pa.int32()), *centre], ['r', *[f'c{j}' for j in range(k)]]))
    return places.crossJoin(F.broadcast(side)).withColumn('_near', _centre_distances([F.col(f'c{j}') for j in range(k)]))


def _farthest_starts(places: DataFrame, k: int) -> dict[int, list[tuple[float, float]]]:
    """Farthest-first centres of every start: each next centre is the place farthest from those chosen.

    Ties go to the smaller latitude, then longitude. Places that all lie on
    chosen centres end the choice, so there are at most as many centres as places.
    """
    place = F.struct(-F.col('_x'), -F.col('_y'))
    first = places.agg(*[F.max(F.struct(F.col('_x') * a + F.col('_y') * b, place.alias('p'))).alias(f's{r}')
                         for r, (a, b) in enumerate(KMEANS_STARTS)]).first()
    if first[0] is None:
        return {}
    starts = {r: [(-first[r]['p'][0], -first[r]['p'][1])] for r in range(len(KMEANS_STARTS))}
    for _ in range(1, k):
        far = (_per_start(places, starts).groupBy('r')
               .agg(F.max(F.struct(F.col('_near.d').alias('d'), place.alias('p'))).alias('m')).collect())
        if far[0]['m']['d'] == 0:
            break
        for row in far:
            starts[row['r']].append((-row['m']['p'][0], -row['m']['p'][1]))
    return starts


def kmeans_clusters(points: DataFrame, k: int = 5, lat: str = 'latitude', lon: str = 'longitude'):
    """M1: k-means on raw degrees, the best of eight deterministic restarts (lowest cost).

    Equal coordinates are one weighted place. Every restart begins farthest
    first from another edge of the points and runs Lloyd rounds until no centre
    moves; all restarts share one aggregate a round, of which starts x k rows
    reach the driver. Sums are of whole numbers (ten places), exact in any order,
    so a fit does not depend on how rows lie in partitions. A centre without
    members stays where it is. A fit that does not end raises. Cluster ids are
    by centroid order (latitude, then longitude). Rows without coordinates take
    no part; no rows give no centroids. Returns (assignments, centroids).
    """
    spark = points.sparkSession
    pts = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    weight = F.col('_w')
    places = cut_lineage(pts.groupBy(F.col(lat).cast('double').alias('_x'), F.col(lon).cast('double').alias('_y'))
                         .agg(F.count(F.lit(1)).alias('_w'))
                         .withColumns(_whole_parts(F.col('_x'), weight, '_wx') | _whole_parts(F.col('_y'), weight, '_wy')))
    running, ended = _farthest_starts(places, k), {}
    for _ in range(KMEANS_ROUNDS):
        if not running:
            break
        means = (_per_start(places, running).groupBy('r', F.col('_near.j').alias('j'))
                 .agg(*[F.sum(c).alias(c) for c in ('_w', '_wxh', '_wxl', '_wyh', '_wyl')]).collect())
        moved = {r: list(cs) for r, cs in running.items()}
        for row in means:
            moved[row['r']][row['j']] = tuple((row[c + 'h'] * SPLIT + row[c + 'l']) / 10 ** PLACES / row['_w'] for c in ('_wx', '_wy'))
        ended |= {r: cs for r, cs in moved.items() if cs == running[r]}
        running = {r: cs for r, cs in moved.items() if cs != running[r]}
    if running:
        raise RuntimeError(f'k-means did not end in {KMEANS_ROUNDS} rounds')
    if not ended:
        return pts.withColumn('cluster', F.lit(None).cast('int')), spark.createDataFrame(
            [], 'cluster int, centroid_lat double, centroid_lon double')
    cost = (_per_start(places, ended).groupBy('r').agg(F.round(F.sum(F.col('_near.d') * F.col('_w')), 6).alias('cost'))
            .orderBy('cost', 'r').first())
    centres = sorted(ended[cost['r']])
    cent = spark.createDataFrame([(j, *c) for j, c in enumerate(centres)], 'cluster int, centroid_lat double, centroid_lon double')
    at = [F.struct(F.lit(x).alias('x'), F.lit(y).alias('y')) for x, y in centres]
    assigned = (pts.withColumns({'_x': F.col(lat).cast('double'), '_y': F.col(lon).cast('double')})
                .withColumn('cluster', _centre_distances(at)['j']).drop('_x', '_y'))
    return assigned, cent


def cluster_sizes(assigned: DataFrame, cluster_col: str = 'cluster') -> DataFrame:
    """A27."""
    return assigned.groupBy(cluster_col).agg(F.count(F.lit(1)).alias('size')).orderBy(cluster_col)


def cluster_centroids(assigned: DataFrame, cluster_col: str = 'cluster', lat: str = 'latitude',
                      lon: str = 'longitude') -> DataFrame:
    """Mean latitude / longitude per cluster."""
    return (assigned.filter(F.col(cluster_col).isNotNull())
                    .groupBy(cluster_col).agg(F.avg(lat).alias('centroid_lat'), F.avg(lon).alias('centroid_lon')))


def nearest_centroid(leads: DataFrame, lead_id: str, centroids: DataFrame, lat: str, lon: str,
                     cluster_col: str = 'cluster') -> DataFrame:
    """Nearest cluster centroid per lead (haversine)."""
    c = centroids.select(F.col(cluster_col).alias('nearest_cluster'),
                         F.col('centroid_lat').alias('_cla'), F.col('centroid_lon').alias('_clo'))
    # one row per cluster: k is a parameter, so the side is bounded, and each lead keeps one row
    near = (leads.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(lead_id, lat, lon)
                 .crossJoin(F.broadcast(c))
                 .withColumn('centroid_km', haversine_km(lat, lon, '_cla', '_clo'))
                 .groupBy(lead_id, lat, lon)
                 .agg(F.min(F.struct('centroid_km', 'nearest_cluster')).alias('_n')))
    return near.select(lead_id, lat, lon, '_n.nearest_cluster', '_n.centroid_km')


# --------------------------------------------------------------------------- DBSCAN (M2)

def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component label (smallest node id) per node: ``_v`` -> ``_p``.

    Shiloach-Vishkin style on DataFrames: every round hooks each tree root onto
    the smallest label seen across its edges (parents only ever decrease, so no
    cycles), then shortcuts parent pointers until every tree is a star. Each
    round is checkpointed; rounds grow with log(n), not with the diameter.
    ``nodes``: (_v); ``edges``: (_a, _b), both directions not required.
    """
    und = edges.select('_a', '_b').unionByName(edges.select(F.col('_b').alias('_a'), F.col('_a').alias('_b')))
    und = cut_lineage(und.filter(F.col('_a') != F.col('_b')).distinct())
    par = cut_lineage(nodes.select('_v').distinct().withColumn('_p', F.col('_v')))
    while True:
        la = par.select(F.col('_v').alias('_a'), F.col('_p').alias('_pa'))
        lb = par.select(F.col('_v').alias('_b'), F.col('_p').alias('_pb'))
        hooks = (und.join(la, '_a').join(lb, '_b').filter(F.col('_pa') < F.col('_pb'))
                    .groupBy(F.col('_pb').alias('_v')).agg(F.min('_pa').alias('_h')))
        hooked = (par.join(hooks, '_v', 'left')
                     .select('_v', F.least('_p', F.coalesce('_h', '_p')).alias('_p'),
                             F.col('_h').isNotNull().alias('_moved')))
        hooked = cut_lineage(hooked)
        moved = hooked.filter('_moved').limit(1).count()
        par = hooked.drop('_moved')
        while True:   # shortcut to stars
            up = par.select(F.col('_v').alias('_p'), F.col('_p').alias('_gp'))
            nxt = cut_lineage(par.join(up, '_p', 'left')
                                 .select('_v', F.coalesce('_gp', '_p').alias('_p'), F.col('_p').alias('_old')))
            changed = nxt.filter(F.col('_p') != F.col('_old')).limit(1).count()
            par = nxt.drop('_old')
            if changed == 0:
                break
        if moved == 0:
            break
    return par


#: Points of two crowded cells that are compared pair by pair; larger products take the nearest-point search.
CLOSE_PAIRS = 64


def _chord(eps_km: float) -> float:
    """Straight distance through the unit sphere of two points eps apart on the earth."""
    return 2.0 * math.sin(min(eps_km / (2.0 * lx.HAVERSINE_RADIUS_KM), math.pi / 2))


def _on_sphere(lat: str, lon: str) -> tuple[Column, Column, Column]:
    la, lo = F.radians(F.col(lat)), F.radians(F.col(lon))
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def _super_points(points: DataFrame, point_id: str, eps_km: float, min_samples: int, lat: str, lon: str) -> DataFrame:
    """Distinct places with id (_loc, the smallest), weight, cell, and whether the cell alone makes all its points core.

    Cells are cubes around the sphere whose diagonal is just below eps, so any
    two points of a cell are neighbours.
    """
    side = max(_chord(eps_km) / math.sqrt(3.0) * (1 - 1e-9), 1e-9)
    axes = _on_sphere(lat, lon)
    places = points.groupBy(lat, lon).agg(F.min(point_id).alias('_loc'), F.count(F.lit(1)).alias('_w'))
    cell = F.struct(*[F.floor((x + 1.0) / F.lit(side)).alias(n) for x, n in zip(axes, 'xyz')])
    places = cut_lineage(places.withColumn('_cell', cell))
    sizes = places.groupBy('_cell').agg(F.sum('_w').alias('_cw'), F.count('*').alias('_cn'))
    return cut_lineage(places.join(sizes, '_cell').withColumn('_dense', F.col('_cw') >= min_samples).drop('_cw'))


def _dense_pairs(dense: DataFrame, eps_km: float, lat: str, lon: str) -> DataFrame:
    """Pairs of dense cells that may hold points within eps of each other, one row a pair.

    Only cells up to two apart can, and only if the boxes around their points
    are near enough. ``_linked``: their outermost points towards each other are
    within eps; of the others only the points can tell. A cell is named by its
    smallest _loc (``_a``, ``_b``); ``_na``, ``_nb`` are its places, ``_box2``
    the box of the second cell.
    """
    ends = [F.struct(x.alias('at'), F.col(lat).alias('la'), F.col(lon).alias('lo')) for x in _on_sphere(lat, lon)]
    low, high = ([agg(e).alias(side + n) for e, n in zip(ends, 'xyz')] for agg, side in ((F.min, 'l'), (F.max, 'h')))
    cells = cut_lineage(dense.groupBy('_cell').agg(F.min('_loc').alias('_node'), F.first('_cn').alias('_cn'), *low, *high))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    around = F.explode(F.array(*[F.struct(*[(F.col('_cell')[n] + d).alias(n) for n, d in zip('xyz', step)]) for step in steps]))
    box = F.struct(*[side + n for side in 'lh' for n in 'xyz'])
    there = cells.select(F.col('_cell').alias('_cell2'), F.col('_node').alias('_b'), F.col('_cn').alias('_nb'), box.alias('_box2'))
    pairs = cells.select('_cell', around.alias('_cell2')).join(there.select('_cell2'), '_cell2')
    pairs = (pairs.join(cells.select('_cell', F.col('_node').alias('_a'), F.col('_cn').alias('_na'), box.alias('_box')), '_cell')
             .join(there, '_cell2'))
    pairs = pairs.where(_box_gap([(F.col('_box')['l' + n]['at'], F.col('_box')['h' + n]['at']) for n in 'xyz']) <= _farthest(eps_km))

    def towards(n: str) -> Column:
        """Distance of the two ends that face each other along an axis."""
        ahead = F.col('_cell2')[n] >= F.col('_cell')[n]
        one = F.when(ahead, F.col('_box')['h' + n]).otherwise(F.col('_box')['l' + n])
        two = F.when(ahead, F.col('_box2')['l' + n]).otherwise(F.col('_box2')['h' + n])
        return haversine_km(one['la'], one['lo'], two['la'], two['lo'])

    return pairs.select('_a', '_b', '_cell', '_cell2', '_na', '_nb', '_box', '_box2',
                        (F.least(*[towards(n) for n in 'xyz']) <= eps_km).alias('_linked'))


def _farthest(eps_km: float) -> float:
    """The chord of eps, with room for rounding."""
    return _chord(eps_km) * (1 + 1e-9) + 1e-12


def _box_gap(sides: Sequence[tuple[Column, Column]], box: str = '_box2') -> Column:
    """Least straight distance of a box, given by its sides along x, y and z, from the box of a column."""
    gaps = [F.greatest(F.col(box)['l' + n]['at'] - high, low - F.col(box)['h' + n]['at'], F.lit(0.0)) for n, (low, high) in zip('xyz', sides)]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def _closest_links(pairs: DataFrame, dense: DataFrame, eps_km: float, lat: str, lon: str) -> DataFrame:
    """(_a, _b) of the pairs of dense cells whose closest points are within eps.

    Only points near the other cell's box take part. Few points are compared
    directly; of larger pairs the closest points are found by the nearest-point
    search, keyed by the pair.
    """
    def near(own: str, to: str) -> DataFrame:
        """The points of a pair's own cell within eps of the other cell's box."""
        rows = dense.select(F.col('_cell').alias(own), F.col(lat).alias('_la'), F.col(lon).alias('_lo'))
        here = [(x, x) for x in _on_sphere('_la', '_lo')]
        return pairs.join(rows, own).where(_box_gap(here, to) <= _farthest(eps_km)).select('_a', '_b', '_na', '_nb', '_la', '_lo')

    left = cut_lineage(near('_cell', '_box2'))
    right = cut_lineage(near('_cell2', '_box').withColumnsRenamed({'_la': '_rla', '_lo': '_rlo'}))
    small = F.col('_na') * F.col('_nb') <= CLOSE_PAIRS
    gap = haversine_km('_la', '_lo', '_rla', '_rlo')
    direct = (left.where(small).join(right.where(small).drop('_na', '_nb'), ['_a', '_b']).where(gap <= eps_km)
              .select('_a', '_b').distinct())
    many = left.where(~small)
    if many.isEmpty():
        return direct
    name = F.concat_ws(':', '_a', '_b')
    a = many.select('_a', '_b', '_la', '_lo', name.alias('_pair'), F.struct('_a', '_b', '_la', '_lo').alias('_row'))
    b = right.where(~small).select('_rla', '_rlo', name.alias('_rpair'))
    closest = nearest_join(a, b, 1, '_row', ['_rla', '_rlo'], '_la', '_lo', '_rla', '_rlo', distance='haversine',
                           dist_col='_d', keys=[('_pair', '_rpair')])
    far = closest.where(F.col('_d') <= eps_km).select('_row._a', '_row._b').distinct()
    return direct.unionByName(far)


def _cell_labels(nodes: DataFrame, links: DataFrame, dense: DataFrame, eps_km: float, lat: str, lon: str) -> DataFrame:
    """(_node, _lab): clusters of cells with core points, by ``links`` (_a, _b) and those among dense cells.

    Dense cells are linked by their outermost points first. Points are only
    compared for pairs of cells that are still in different clusters then.
    """
    pairs = cut_lineage(_dense_pairs(dense, eps_km, lat, lon))
    links = cut_lineage(links.unionByName(pairs.where('_linked').select('_a', '_b')).distinct())
    labels = connected_components(nodes.select(F.col('_node').alias('_v')), links).select(F.col('_v').alias('_node'), F.col('_p').alias('_lab'))
    side = lambda n: labels.select(F.col('_node').alias('_' + n), F.col('_lab').alias('_lab' + n))
    apart = cut_lineage(pairs.where('not _linked').join(side('a'), '_a').join(side('b'), '_b').where('_laba <> _labb'))
    if apart.isEmpty():
        return labels
    found = _closest_links(apart.drop('_laba', '_labb'), dense, eps_km, lat, lon)
    joined = found.join(side('a'), '_a').join(side('b'), '_b').select(F.col('_laba').alias('_a'), F.col('_labb').alias('_b'))
    merged = connected_components(labels.select(F.col('_lab').alias('_v')), joined)
    return labels.join(merged, F.col('_lab') == F.col('_v')).select('_node', F.col('_p').alias('_lab'))


def dbscan(points: DataFrame, point_id: str, eps_km: float = 0.5, min_samples: int = 3,
           lat: str = 'latitude', lon: str = 'longitude') -> DataFrame:
    """M2: DBSCAN with haversine distance (R = 6371), eps in km; noise = -1.

    1. Identical coordinates are one place with a weight, and places fall into
       cells whose diagonal is within eps. A cell of weight ``min_samples`` is
       dense: all its points are core and one cluster, without any pair.
    2. Only places of the other cells, fewer than ``min_samples`` a cell, are
       compared with their neighbours (grid radius join), so pairs grow with
       the points and ``min_samples``; their weighted counts tell which are core.
    3. Clusters are connected components over cells with core points: linked by
       those pairs, or, of two dense cells, by their outermost points; by their
       closest points where the clusters are still apart.
    4. Border points take the smallest cluster among their core neighbours.
    Cluster id = smallest point id among the cluster's core points.
    """
    pts = points.select(point_id, lat, lon).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    places = _super_points(pts, point_id, eps_km, min_samples, lat, lon)
    dense, sparse = places.where('_dense'), places.where('not _dense')
    other = places.select(F.col('_loc').alias('_nb'), F.col(lat).alias('_nlat'), F.col(lon).alias('_nlon'),
                          F.col('_w').alias('_nw'), F.col('_cell').alias('_ncell'), F.col('_dense').alias('_ndense'))
    near = radius_join(sparse.select('_loc', '_cell', lat, lon), other, eps_km, lat, lon, '_nlat', '_nlon', distance='haversine', dist_col='_d')
    # all points of a dense cell are one neighbour: what they are to the place is the cell's
    nb = F.when(F.col('_ndense'), F.lit(None)).otherwise(F.col('_nb')).alias('_nb')
    near = cut_lineage(near.groupBy('_loc', '_cell', '_ncell', '_ndense', nb).agg(F.sum('_nw').alias('_nw')))
    core = cut_lineage(near.groupBy('_loc', '_cell').agg(F.sum('_nw').alias('_cnt')).where(F.col('_cnt') >= min_samples).drop('_cnt'))
    nodes = cut_lineage(dense.select('_cell', '_loc').unionByName(core.select('_cell', '_loc'))
                        .groupBy('_cell').agg(F.min('_loc').alias('_node')))
    is_core = core.select(F.col('_loc').alias('_nb'), F.lit(True).alias('_ncore'))
    met = cut_lineage(near.join(is_core, '_nb', 'left').where('_ndense or _ncore')
                      .join(nodes.select(F.col('_cell').alias('_ncell'), F.col('_node').alias('_nnode')), '_ncell')
                      .select('_loc', '_cell', '_nnode').distinct())
    links = (met.join(core, ['_loc', '_cell'], 'left_semi').join(nodes, '_cell')
             .select(F.col('_node').alias('_a'), F.col('_nnode').alias('_b')).where('_a <> _b'))
    labels = _cell_labels(nodes, links, dense, eps_km, lat, lon)
    of_cell = cut_lineage(nodes.join(labels, '_node').select('_cell', '_node', '_lab'))
    inside = dense.select('_loc', '_cell').unionByName(core.select('_loc', '_cell')).join(of_cell, '_cell').select('_loc', '_lab')
    border = (met.join(core, '_loc', 'left_anti').join(of_cell.select(F.col('_node').alias('_nnode'), '_lab'), '_nnode')
              .groupBy('_loc').agg(F.min('_lab').alias('_lab')))
    found = places.select('_loc', F.col(lat).alias('_plat'), F.col(lon).alias('_plon')).join(inside.unionByName(border), '_loc')
    return (pts.join(found, (pts[lat] == F.col('_plat')) & (pts[lon] == F.col('_plon')), 'left')
            .select(point_id, lat, lon, F.coalesce(F.col('_lab'), F.lit(-1)).cast('long').alias('cluster')))


def cluster_edges(leads: DataFrame, lead_id: str, members: DataFrame, centroids: DataFrame, trust: DataFrame,
                  cap: int = 5, lat: str = 'gias_lat', lon: str = 'gias_lon') -> DataFrame:
    """Connections to the nearest members of each lead's nearest cluster, after its trust edges.

    ``members``: site, _slat, _slon, cluster (``_sc``). ``trust``: lead_id, _slat,
    _slon, a row for each trust edge (at most ``cap`` a lead); places reached by
    them are skipped, ranks go on after them up to ``cap``. A lead whose trust
    edges are ``cap`` has no room and is not searched for.
    Output: lead_id, site, _slat, _slon, distance_km, rank.
    """
    taken = trust.groupBy(lead_id).agg(F.count(F.lit(1)).cast('int').alias('_taken'))
    room = leads.select(lead_id, lat, lon).join(taken, lead_id, 'left').withColumn('_taken', F.coalesce('_taken', F.lit(0)))
    room = cut_lineage(room.where(F.col('_taken') < cap))
    toward = room.join(nearest_centroid(room, lead_id, centroids, lat, lon).select(lead_id, 'nearest_cluster'), lead_id)
    near = nearest_join(toward, members, cap, lead_id, ['site', '_slat', '_slon'], lat, lon,
                        '_slat', '_slon', keys=[('nearest_cluster', '_sc')], rank_col='_near')
    near = near.join(trust.select(lead_id, '_slat', '_slon'), [lead_id, '_slat', '_slon'], 'left_anti')
    after = F.row_number().over(Window.partitionBy(lead_id).orderBy('_near'))
    near = near.join(room.select(lead_id, '_taken'), lead_id).withColumn('rank', F.col('_taken') + after)
    return near.where(F.col('rank') <= cap).select(lead_id, 'site', '_slat', '_slon', 'distance_km', 'rank')


def connection_edges(leads: DataFrame, lead_id: str, sites: DataFrame, centroids: DataFrame,
                     cap: int = 5, lat: str = 'gias_lat', lon: str = 'gias_lon') -> DataFrame:
    """J13 + J14 + W5: up to ``cap`` map connections per lead, trust edges first.

    ``leads``: lead_id, lat, lon, trust_name. ``sites``: site, latitude,
    longitude, trust (``_st``), cluster. Trust edges are the nearest sites of
    the same trust (one per coordinate); cluster edges are the nearest members
    of the lead's nearest cluster that are not already trust edges; the cap
    applies to both together (exactly ``cap``, never one more). Both legs are
    keyed k-nearest grid searches, so no group ever emits all its pairs.
    """
    s = (sites.groupBy('_st', 'cluster', 'latitude', 'longitude').agg(F.min('site').alias('site'))
              .select('site', F.col('latitude').alias('_slat'), F.col('longitude').alias('_slon'), '_st',
                      F.col('cluster').alias('_sc')))
    trust = cut_lineage(nearest_join(leads.select(lead_id, lat, lon, 'trust_name'), s.drop('_sc'), cap, lead_id,
                                     ['site', '_slat', '_slon'], lat, lon, '_slat', '_slon', keys=[('trust_name', '_st')]))
    clus = cluster_edges(leads, lead_id, s.drop('_st'), centroids, trust, cap, lat, lon)
    out = [lead_id, 'site', 'distance_km']
    return (trust.select(*out, F.lit('trust').alias('edge_type'), F.col('rank').alias('edge_rank'))
            .unionByName(clus.select(*out, F.lit('cluster').alias('edge_type'), F.col('rank').alias('edge_rank'))))
