"""Exact k-nearest joins (J9-J11, J13, M3, W2): a ring around every row, then two pyramids of cells.

Ring. The right side's density where most of its rows are gives a radius that
holds a few times k rows; a grid join finds the right rows within it, and a row
with enough of them is done. Grid cells in which a row would meet too many
right rows are left out beforehand, so pairs stay linear in the rows.

Pyramids, for rows whose ring is empty or too full. Points are placed on the
unit sphere, and the cube around it is halved again and again; the cells of a
level that hold points form one floor of a side's pyramid. Distances on the
sphere grow with those through it, so the gap between two cells bounds every
pair of their points from below and their far corners bound it from above;
there are no poles or date lines. For each left cell the search keeps the right
cells that may hold one of the k nearest of any of its points: those not
farther off than the cells that surely hold k. Kept pairs of cells descend to
the next floor until a left cell sees few right points, its candidates. Far
from a dense cluster only the cluster's near side is followed down: the rows
grow with the left points and k, not with the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitescope.functions.geo import distance_fn
from sitescope.operators.spatial import cover_cells, probe_cells
from sitescope.session import cut_lineage

#: Halvings of the cube down to the finest cells (about 12 m on the earth).
FINEST = 20
#: The search starts on the finest floor with at most so many pairs of cells, and goes down STEP halvings at a time.
FIRST_PAIRS = 1 << 20
COARSEST, STEP = 4, 2
#: Right points that a left cell may see when its points are compared one by one.
FEW, FEW_PER_K = 256, 64


def with_cells(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    """Add the finest cell of every point (three whole numbers)."""
    la, lo = F.radians(F.col(lat)), F.radians(F.col(lon))
    axes = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
    side = 1 << FINEST
    cells = [F.least(F.floor((a + 1.0) * (side / 2)), F.lit(side - 1)).cast('int').alias(prefix + n) for a, n in zip(axes, 'xyz')]
    return df.select('*', *cells)


def _at(prefix: str, level: int, name: str | None = None) -> list[Column]:
    """The cell's numbers on a floor, named ``name`` + axis."""
    return [F.shiftright(prefix + n, FINEST - level).alias((name or prefix) + n) for n in 'xyz']


def _gaps(a: str, b: str) -> tuple[Column, Column]:
    """Squares of the least and the largest distance of two cells of one floor, in cells."""
    apart = [F.abs(F.col(a + n) - F.col(b + n)).cast('long') for n in 'xyz']
    least = sum((F.pow(F.greatest(d - 1, F.lit(0)), F.lit(2)) for d in apart[1:]), F.pow(F.greatest(apart[0] - 1, F.lit(0)), F.lit(2)))
    most = sum((F.pow(d + 1, F.lit(2)) for d in apart[1:]), F.pow(apart[0] + 1, F.lit(2)))
    return least, most


def _kept(pairs: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Pairs of cells that may hold one of the k nearest; adds the right points that a left cell still sees."""
    own = [*groups, 'ax', 'ay', 'az']
    least, most = _gaps('a', 'b')
    ordered = Window.partitionBy(*own).orderBy('most').rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*own)
    seen = pairs.select('*', least.alias('least'), most.alias('most')).withColumn('held', F.sum('n').over(ordered))
    bound = F.min(F.when(F.col('held') >= k, F.col('most'))).over(whole)
    kept = seen.withColumn('bound', bound).where(F.col('bound').isNull() | (F.col('least') <= F.col('bound')))
    return kept.withColumn('sees', F.sum('n').over(whole)).select(*own, 'bx', 'by', 'bz', 'n', 'sees')


def _first_level(left: DataFrame, right: DataFrame, groups: list[str]) -> int:
    """The floor to start on; the coarsest has some thousand cells at most on the whole sphere."""
    levels = range(COARSEST, FINEST - 1, STEP)

    def cells(df: DataFrame, prefix: str):
        numbers = [F.approx_count_distinct(F.xxhash64(*groups, *_at(prefix, level))).alias(str(level)) for level in levels]
        return df.agg(*numbers).first()

    a, b = cells(left, 'a'), cells(right, 'b')
    return max([level for level in levels if a[str(level)] * b[str(level)] <= FIRST_PAIRS], default=COARSEST)


def _search(left: DataFrame, right: DataFrame, groups: list[str], k: int):
    """(level, pairs of cells) for each floor on which left cells are settled."""
    few = FEW + FEW_PER_K * k
    level, state = _first_level(left, right, groups), None
    while True:
        a = left.select(*groups, *_at('a', level), *(_at('a', level - STEP, 'pa') if state is not None else [])).distinct()
        b = right.select(*groups, *_at('b', level), *(_at('b', level - STEP, 'pb') if state is not None else []))
        b = b.groupBy(*b.columns).agg(F.count('*').alias('n'))
        if state is None:
            # the first floor has a bounded number of cells
            pairs = a.join(b, groups) if groups else a.crossJoin(b)
        else:
            parents = state.select(*groups, *[F.col(s + n).alias('p' + s + n) for s in 'ab' for n in 'xyz'])
            pairs = parents.join(a, [*groups, 'pax', 'pay', 'paz']).join(b, [*groups, 'pbx', 'pby', 'pbz'])
        state = cut_lineage(_kept(pairs, groups, k))
        settled = (F.col('sees') <= few) | F.lit(level >= FINEST)
        yield level, state.where(settled)
        state = state.where(~settled)
        if level >= FINEST or state.isEmpty():
            return
        level += STEP


def candidates(left: DataFrame, right: DataFrame, k: int, left_pos: tuple[str, str], right_pos: tuple[str, str],
               keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of rows among which every left row's k nearest right rows are (fewer only where the right side has fewer).

    Right rows of one place must be at most k. Columns of both sides must differ.
    """
    groups = [f'_g{i}' for i in range(len(keys))]
    has = lambda df, cols: df.dropna(subset=list(cols))
    l_rows = has(left, [*left_pos, *(a for a, _ in keys)]).select('*', *[F.col(a).alias(g) for (a, _), g in zip(keys, groups)])
    r_rows = has(right, [*right_pos, *(b for _, b in keys)]).select('*', *[F.col(b).alias(g) for (_, b), g in zip(keys, groups)])
    l_rows = cut_lineage(with_cells(l_rows, *left_pos, 'a'))
    r_rows = cut_lineage(with_cells(r_rows, *right_pos, 'b'))
    found = None
    for level, cells in _search(l_rows, r_rows, groups, k):
        a = l_rows.drop('ax', 'ay', 'az').columns
        near = l_rows.select(*a, *_at('a', level)).join(cells, [*groups, 'ax', 'ay', 'az'])
        near = near.drop('ax', 'ay', 'az', 'n', 'sees').join(
            r_rows.select(*r_rows.drop('bx', 'by', 'bz').columns, *_at('b', level)), [*groups, 'bx', 'by', 'bz'])
        near = near.select(*left.columns, *right.columns)
        found = near if found is None else found.unionByName(near)
    return found


#: Sides of the cells, in degrees, that the ring's radius measures density on.
DENSITY_CELLS = (0.01, 0.05, 0.25, 1.0)
#: Rows per wanted neighbour that a ring holds at that density, and the multiple that is too many.
RING_ROWS, TOO_MANY = 12, 32
#: Rings tried, each of twice the radius of the one before, ahead of the pyramids.
RINGS = 2


def _ring_radius(right: DataFrame, lat: str, lon: str, k: int) -> tuple[int, float]:
    """Row count of the right side and the first ring's radius in km.

    A circle of that radius holds about ``RING_ROWS * k`` rows at the density
    where most rows are: rows per cell, averaged over rows rather than cells, on
    the finest cells that hold as many (one aggregate, one row a cell size).
    """
    cells = right.select(F.explode(F.array(*[F.struct(
        F.lit(side).alias('side'), F.floor(F.col(lat) / side).alias('a'), F.floor(F.col(lon) / side).alias('b'))
        for side in DENSITY_CELLS])).alias('cell')).groupBy('cell').agg(F.count(F.lit(1)).cast('double').alias('c'))
    sizes = cells.groupBy('cell.side').agg(
        F.sum('c').alias('n'), (F.sum(F.col('c') * F.col('c')) / F.sum('c')).alias('dense'),
        F.avg((F.col('cell.a') + 0.5) * F.col('cell.side')).alias('mid')).orderBy('side').collect()
    if not sizes:
        return 0, 1.0
    best = next((x for x in sizes if x['dense'] >= RING_ROWS * k), sizes[-1])
    side_km = best['side'] * 111.2
    area = side_km * side_km * max(math.cos(math.radians(best['mid'])), 0.01)
    return int(sizes[0]['n']), min(max(math.sqrt(RING_ROWS * k * area / (math.pi * best['dense'])), 0.05), 2000.0)


def ring_pairs(left: DataFrame, right: DataFrame, radius_km: float, most: int, left_pos: tuple[str, str],
               right_pos: tuple[str, str], keys: Sequence[tuple[str, str]], distance: str, dist_col: str) -> DataFrame:
    """Pairs within the radius, of the left rows whose grid cell meets at most ``most`` right rows."""
    fn, earth = distance_fn(distance)
    probe = probe_cells(left, *left_pos, radius_km, earth, '_lb', '_lc')
    cover = cover_cells(right, *right_pos, radius_km, earth, '_rb', '_rc')
    groups = [('_lb', '_rb'), ('_lc', '_rc'), *keys]
    met = cover.groupBy(*[F.col(b).alias(f'_m{i}') for i, (_, b) in enumerate(groups)]).agg(F.count('*').alias('_met')).where(F.col('_met') <= most)
    on = [F.col(a) == F.col(f'_m{i}') for i, (a, _) in enumerate(groups)]
    light = probe.join(met, on).select(*probe.columns)
    pairs = light.join(cover, [F.col(a) == F.col(b) for a, b in groups]).withColumn(dist_col, fn(*left_pos, *right_pos))
    return pairs.where(F.col(dist_col) <= radius_km).select(*left.columns, *right.columns, dist_col)


def _first_of_each_place(right: DataFrame, k: int, order: Sequence[str], place: Sequence[str]) -> DataFrame:
    """At most the first k right rows of a place can be among the k nearest; Spark limits them before the shuffle."""
    if k == 1:
        others = [c for c in right.columns if c not in place]
        first = F.min(F.struct(*order, *[F.col(c).alias('_c_' + c) for c in others]))
        return right.groupBy(*place).agg(first.alias('_f')).select(*place, *[F.col('_f._c_' + c).alias(c) for c in others])
    number = F.row_number().over(Window.partitionBy(*place).orderBy(*order))
    return right.withColumn('_n', number).where(F.col('_n') <= k).drop('_n')


def nearest_join(left: DataFrame, right: DataFrame, k: int, left_id: str, right_order: list[str],
                 left_lat: str, left_lon: str, right_lat: str, right_lon: str,
                 distance: str = 'great_circle', dist_col: str = 'distance_km', rank_col: str = 'rank',
                 keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The ``k`` nearest right rows of every left row.

    Ties break on ``right_order`` (ascending). With ``keys`` (left column,
    right column) only right rows of equal keys count. Left rows without
    coordinates or key, or without any right row, are not returned.

    Output: ``left_id``, every right column, ``dist_col``, ``rank_col`` (1..k).
    """
    fn, _ = distance_fn(distance)
    lkeys = [a for a, _ in keys]
    place = list(dict.fromkeys([right_lat, right_lon, *(b for _, b in keys)]))
    right = right.dropna(subset=place)
    n, radius = _ring_radius(right, right_lat, right_lon, k)
    pending = left.select(*dict.fromkeys([left_id, left_lat, left_lon, *lkeys])).dropna(subset=[left_lat, left_lon, *lkeys])
    if keys:  # fewer than k are enough where the group has no more; rows of no group are out
        sizes = right.groupBy(*[F.col(b).alias(a) for a, b in keys]).agg(F.least(F.lit(k), F.count('*')).alias('_need'))
        pending = pending.join(sizes, lkeys)
    else:
        pending = pending.withColumn('_need', F.lit(min(k, n)))
    plain = [c for c in pending.columns if c != '_need']
    found, out = [], [left_id, *right.columns, dist_col, rank_col]

    def best_of(pairs: DataFrame) -> DataFrame:
        """The first k right rows of every left row, and how many it met."""
        if k == 1:
            first = F.min(F.struct(dist_col, *right_order, *[F.col(c).alias('_r_' + c) for c in right.columns]))
            best = pairs.groupBy(left_id).agg(first.alias('_b'), F.count('*').alias('_n'))
            return best.select(left_id, *[F.col('_b._r_' + c).alias(c) for c in right.columns],
                               F.col('_b.' + dist_col).alias(dist_col), F.lit(1).alias(rank_col), '_n')
        nearest = Window.partitionBy(left_id).orderBy(dist_col, *right_order)
        ranked = pairs.withColumn(rank_col, F.row_number().over(nearest)).where(F.col(rank_col) <= k)
        return ranked.withColumn('_n', F.count('*').over(Window.partitionBy(left_id)))

    for ring in range(RINGS if n else 0):
        near = ring_pairs(pending.select(*plain), right, radius * 2 ** ring, TOO_MANY * RING_ROWS * k, (left_lat, left_lon),
                          (right_lat, right_lon), keys, distance, dist_col)
        state = pending.join(best_of(near).select(*out, '_n'), left_id, 'left')
        state = cut_lineage(state.withColumn('_done', F.coalesce(F.col('_n') >= F.col('_need'), F.lit(False))))
        found.append(state.where('_done').select(*out))
        pending = state.where('not _done').select(*plain, '_need').distinct()
        if pending.isEmpty():
            break
    else:
        rows = _first_of_each_place(right, k, right_order, place).select(*right.columns)
        pairs = candidates(pending.select(*plain), rows, k, (left_lat, left_lon), (right_lat, right_lon), keys)
        found.append(best_of(pairs.withColumn(dist_col, fn(left_lat, left_lon, right_lat, right_lon))).select(*out))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def nearest_other(points: DataFrame, point_id: str, lat: str, lon: str, distance: str = 'haversine',
                  dist_col: str = 'nearest_km') -> DataFrame:
    """Distance from every point to its nearest *other* point.

    Of the two nearest points of any place at most one is the point itself.
    Points at one place are 0 apart; a point alone in the table gets null.
    Output: point_id, dist_col.
    """
    pts = points.select(point_id, lat, lon).dropna(subset=[lat, lon])
    other = pts.select(F.col(point_id).alias('_oid'), F.col(lat).alias('_olat'), F.col(lon).alias('_olon'))
    near = nearest_join(pts, other, 2, point_id, ['_oid'], lat, lon, '_olat', '_olon', distance=distance, dist_col='_d')
    best = near.where(F.col(point_id) != F.col('_oid')).groupBy(F.col(point_id).alias('_pid')).agg(F.min('_d').alias(dist_col))
    return pts.join(best, F.col(point_id) == F.col('_pid'), 'left').select(point_id, dist_col)
