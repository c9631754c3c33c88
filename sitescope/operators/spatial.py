"""Distance joins without a theta join: all pairs within a radius.

Spark has no spatial join; a bare ``distance <= r`` condition plans as a
broadcast nested-loop join. Here both sides are mapped to grid cells and joined
on the cell key (a hash / sort-merge equi-join), then the exact distance is
applied as a post-filter.

Cell scheme (lossless): with angular radius ``delta`` (degrees), the probe side
gets one cell ``(band = floor(lat/delta), cell = floor(lon / s(band)))`` where
the longitude width ``s(band)`` depends only on the band. The build side is
exploded over every cell of every band its search cap touches: bands covering
``lat +- delta`` and, per band, the longitude range ``lon +- dlon`` with
``dlon = asin(sin(r/R) / cos(lat))`` (the exact longitude half-width of a
spherical cap), repeated at ``lon +- 360`` for the antimeridian, and the whole
band when the cap holds a pole. Every pair within the radius therefore meets
on exactly one cell, so no de-duplication is needed.

Skew: the equi-join runs under AQE skew-join splitting; ``salt`` additionally
spreads each probe-side cell over ``salt`` sub-keys (the build side is
replicated per sub-key) for clusters that are hot even after the split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions.geo import distance_fn

_EPS = 1e-9


def _delta_deg(radius_km: float, earth_km: float) -> float:
    return math.degrees(radius_km / earth_km) * (1 + _EPS) + _EPS


def _band_width(band: Column, delta: float) -> Column:
    """Longitude width of the cells of one latitude band (depends on the band only)."""
    lo = band.cast('double') * F.lit(delta)
    hi = (band + 1).cast('double') * F.lit(delta)
    maxabs = F.least(F.lit(90.0), F.greatest(F.abs(lo), F.abs(hi)))
    return (F.when(maxabs >= 89.9, F.lit(360.0))
            .otherwise(F.least(F.lit(360.0), F.lit(delta) / F.cos(F.radians(maxabs)))))


def probe_cells(df: DataFrame, lat: str, lon: str, radius_km: float, earth_km: float,
                band_col: str = '_band', cell_col: str = '_cell') -> DataFrame:
    """One grid cell per row (the large side of a distance join)."""
    delta = _delta_deg(radius_km, earth_km)
    band = F.floor(F.col(lat) / F.lit(delta))
    return (df.withColumn(band_col, band)
              .withColumn(cell_col, F.floor(F.col(lon) / _band_width(F.col(band_col), delta))))


def cover_cells(df: DataFrame, lat: str, lon: str, radius_km: float, earth_km: float,
                band_col: str = '_band', cell_col: str = '_cell') -> DataFrame:
    """Every grid cell the radius cap around each row touches (the small side)."""
    delta = _delta_deg(radius_km, earth_km)
    theta = radius_km / earth_km
    theta_deg = math.degrees(theta) * (1 + _EPS) + _EPS
    la, lo = F.col(lat), F.col(lon)
    lo_band = F.floor(F.greatest(F.lit(-90.0), la - F.lit(delta)) / F.lit(delta))
    hi_band = F.floor(F.least(F.lit(90.0), la + F.lit(delta)) / F.lit(delta))
    # exact longitude half-width of the cap; whole circle once the cap holds a pole
    ratio = F.lit(math.sin(min(theta, math.pi / 2))) / F.cos(F.radians(la))
    dlon = (F.when((F.abs(la) + F.lit(theta_deg) >= 90.0) | (ratio >= 1.0) | (F.lit(theta) >= math.pi / 2),
                   F.lit(180.0))
            .otherwise(F.degrees(F.asin(ratio)) * (1 + _EPS) + _EPS))
    out = (df.withColumn(band_col, F.explode(F.sequence(lo_band, hi_band)))
             .withColumn('_s', _band_width(F.col(band_col), delta))
             .withColumn('_cmin', F.floor(F.lit(-180.0) / F.col('_s')))
             .withColumn('_cmax', F.floor(F.lit(180.0) / F.col('_s')))
             .withColumn('_dl', dlon))

    def span(shift: float) -> Column:
        a = F.greatest(F.col('_cmin'), F.floor((lo + F.lit(shift) - F.col('_dl')) / F.col('_s')))
        b = F.least(F.col('_cmax'), F.floor((lo + F.lit(shift) + F.col('_dl')) / F.col('_s')))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast('array<bigint>'))

    cells = (F.when(F.col('_dl') >= 180.0, F.sequence(F.col('_cmin'), F.col('_cmax')))
             .otherwise(F.array_distinct(F.concat(span(-360.0), span(0.0), span(360.0)))))
    return (out.withColumn(cell_col, F.explode(cells))
               .drop('_s', '_cmin', '_cmax', '_dl'))


def _salted(probe: DataFrame, build: DataFrame, salt: int, key_cols: list[str]):
    if salt <= 1:
        return probe, build, []
    probe = probe.withColumn('_salt', F.pmod(F.xxhash64(*[F.col(c) for c in key_cols]), F.lit(salt)))
    build = build.withColumn('_salt', F.explode(F.sequence(F.lit(0).cast('long'), F.lit(salt - 1).cast('long'))))
    return probe, build, ['_salt']


def radius_join(left: DataFrame, right: DataFrame, radius_km: float,
                left_lat: str, left_lon: str, right_lat: str, right_lon: str,
                how: str = 'inner', distance: str = 'great_circle',
                dist_col: str = 'distance_km', salt: int = 1,
                keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs (inner) or left rows (left_semi / left_anti) within ``radius_km``.

    ``keys`` adds equality conditions (left column, right column), e.g. "same
    trust", so the join only pairs rows of one group that are also near.

    ``left`` is the large side (one cell per row); ``right`` is exploded over
    its cover cells. Column names of the two sides must not overlap.
    Rows with a null coordinate never match.
    """
    fn, earth = distance_fn(distance)
    lp = probe_cells(left.filter(F.col(left_lat).isNotNull() & F.col(left_lon).isNotNull()),
                     left_lat, left_lon, radius_km, earth, '_lb', '_lc')
    rb = cover_cells(right.filter(F.col(right_lat).isNotNull() & F.col(right_lon).isNotNull()),
                     right_lat, right_lon, radius_km, earth, '_rb', '_rc')
    lp, rb, salt_cols = _salted(lp, rb, salt, list(left.columns))
    cond = (F.col('_lb') == F.col('_rb')) & (F.col('_lc') == F.col('_rc'))
    for lk, rk in keys:
        cond = cond & (F.col(lk) == F.col(rk))
    if salt_cols:
        rb = rb.withColumnRenamed('_salt', '_rsalt')
        cond = cond & (F.col('_salt') == F.col('_rsalt'))
    dist = fn(F.col(left_lat), F.col(left_lon), F.col(right_lat), F.col(right_lon))
    drop = ['_lb', '_lc', '_rb', '_rc', '_salt', '_rsalt']
    if how in ('left_semi', 'semi'):
        return lp.join(rb, cond & (dist <= F.lit(radius_km)), 'left_semi').drop(*drop)
    if how in ('left_anti', 'anti'):
        far = lp.join(rb, cond & (dist <= F.lit(radius_km)), 'left_anti').drop(*drop)
        no_coords = left.filter(F.col(left_lat).isNull() | F.col(left_lon).isNull())
        return far.unionByName(no_coords)
    pairs = lp.join(rb, cond, 'inner').withColumn(dist_col, dist)
    return pairs.filter(F.col(dist_col) <= F.lit(radius_km)).drop(*drop)
