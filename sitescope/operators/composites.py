"""Composite reports (L13 / A23, L14, L15, V6): existing operators put together into one table each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.operators import geo as G
from sitescope.operators import metrics as M
from sitescope.operators import textagg as X
from sitescope.operators.reports import metric_rows
from sitescope.sources.sinks import write_csv


def _items(df: DataFrame, section: str, item: str) -> DataFrame:
    return df.select(F.lit(section).alias('section'), F.col(item).alias('item'), F.col('count'))


def positive_summary(df: DataFrame, text_col: str, order_col: str, themes: Mapping[str, Sequence[str]],
                     top_words: int = 25, top_pairs: int = 15) -> DataFrame:
    """(section, item, count): responses, keywords (A18), bigrams (A19) and themes."""
    total = df.filter(F.col(text_col).isNotNull()).agg(F.count(F.lit(1)).alias('count'))
    return (_items(total.withColumn('item', F.lit('total_responses')), 'overview', 'item')
            .unionByName(_items(X.keyword_counts(df, text_col, order_col, top_words), 'keywords', 'word'))
            .unionByName(_items(X.ngram_counts(df, text_col, order_col, 2, top_pairs), 'bigrams', 'ngram'))
            .unionByName(_items(X.theme_counts(df, text_col, themes), 'themes', 'theme')))


def text_report(liked: DataFrame, suggestions: DataFrame, text_col: str, order_col: str,
                positive_themes: Mapping[str, Sequence[str]], improvement_themes: Mapping[str, Sequence[str]]) -> DataFrame:
    """The positive summary (A23) and the suggestion summary with its themes."""
    counts = X.suggestion_summary(suggestions, text_col)
    names = ['total_responses', 'nothing_responses', 'substantive_responses']
    pairs = ', '.join(f"'{n}', {n}" for n in names)
    improve = X.theme_counts(X.substantive(suggestions, text_col), text_col, improvement_themes)
    return (positive_summary(liked, text_col, order_col, positive_themes)
            .unionByName(_items(counts.selectExpr(f'stack({len(names)}, {pairs}) AS (item, count)'), 'suggestions', 'item'))
            .unionByName(_items(improve, 'improvement_themes', 'theme')))


def geo_report(points: DataFrame, point_id: str, target_radius_km: float = 50.0) -> DataFrame:
    """Extent (A29), hull area (A30) and coverage gaps (A31) as one long metric table.

    Clusters (A27, A28) are tables of their own: their numbers are of the fit.
    """
    _, gaps = G.coverage_gaps(points, point_id, target_radius_km)
    return (metric_rows(G.extent_metrics(points), 'geographic_metrics',
                        ['total_points', 'lat_min', 'lat_max', 'lat_span', 'lon_min', 'lon_max', 'lon_span', 'centroid_lat', 'centroid_lon'])
            .unionByName(metric_rows(G.hull_area(points), 'coverage', ['hull_vertices', 'coverage_area_km2']))
            .unionByName(metric_rows(gaps, 'coverage_gaps',
                                    ['avg_nearest_distance_km', 'max_nearest_distance_km', 'schools_beyond_target'])))


def booking_report(bookings: DataFrame, geocodes: DataFrame, site: str, date_col: str, order_col: str, latest: Mapping[str, str],
                   name: str) -> DataFrame:
    """The visit summary of every site (A12-A14) with its coordinates (J2); ``geocodes`` has one row per site."""
    summary = M.visit_summary(bookings, site, date_col, order_col, dict(latest))
    return summary.join(geocodes, site, 'left').select(name, *summary.columns, 'latitude', 'longitude')


def clustered_export(points: DataFrame, path: str | None = None, k: int = 5) -> DataFrame:
    """V6: points with their k-means cluster and its centroid (M1), written as CSV (S8) where a path is given."""
    assigned, cent = G.kmeans_clusters(points, k)
    out = assigned.join(F.broadcast(cent), 'cluster')  # k rows
    if path:
        write_csv(out, path)
    return out
