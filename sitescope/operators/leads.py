"""Lead generation (L1-L7) with its filters, joins, dedupe, scoring and top-k.

Registry schema (standard): gias_urn, gias_name, trust_name, easting, northing,
postcode, fsm_percentage, gias_lat, gias_lon, norm_name, reg_ord (registry
order, used for deterministic tie-breaks).
Visited-site schema: school_name, visit_count, latitude, longitude.

Plan shape: every track is a semi/anti join of the registry (no per-row loop);
hotspots use the grid radius join; the nearest champion uses the exact grid
ring search; global normalisers are one-row aggregates cross-joined back
(a one-row broadcast); top-k is sort+limit (TakeOrderedAndProject).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.functions.clean import norm_name
from sitescope.operators.match import champion_trusts
from sitescope.operators.nearest import nearest_join
from sitescope.operators.spatial import radius_join
from sitescope.session import cut_lineage

STANDARD_COLS = ['gias_urn', 'gias_name', 'trust_name', 'easting', 'northing', 'postcode',
                 'fsm_percentage', 'gias_lat', 'gias_lon', 'norm_name']
TAG_COLS = ['lead_type', 'lead_category', 'lead_source']
CONNECTION_COLS = ['nearest_champion', 'distance_to_champion_km']


@dataclass(frozen=True)
class LeadConfig:
    champion_min_visits: int = 2
    hotspot_radius_km: float = 5.0
    fsm_threshold: float = 30.0
    fuzzy_threshold: float = 80.0
    top_n: int | None = 100
    salt: int = 1


def _fmt_num(x: float) -> str:
    """Python's str() of a float parameter, as it appears in the source text."""
    return str(float(x))


def champions_of(visited: DataFrame, min_visits: int) -> DataFrame:
    """Visited sites with visit_count >= min_visits."""
    return visited.filter(F.col('visit_count') >= F.lit(min_visits))


def unvisited(registry: DataFrame, visited: DataFrame) -> DataFrame:
    """Registry rows whose normalised name was never visited (null names stay)."""
    names = visited.select(norm_name('school_name').alias('norm_name')).filter(F.col('norm_name').isNotNull())
    return registry.join(names.distinct(), 'norm_name', 'left_anti')


def tag(df: DataFrame, lead_type: str, category: str, source: str) -> DataFrame:
    """Constant tag columns."""
    return (df.withColumn('lead_type', F.lit(lead_type))
              .withColumn('lead_category', F.lit(category))
              .withColumn('lead_source', F.lit(source)))


def trust_leads(candidates: DataFrame, champions: DataFrame, registry: DataFrame,
                cfg: LeadConfig) -> DataFrame:
    """L1: J5 -> J18 -> J6 (semi join on trust) -> tags; ``candidates`` already passed J7."""
    trusts = champion_trusts(champions, registry, threshold=cfg.fuzzy_threshold)
    leads = candidates.join(trusts, 'trust_name', 'left_semi')
    return tag(leads, 'Trust Lead', 'normal', 'Same trust as champion school')


def hotspot_leads(candidates: DataFrame, champions: DataFrame, cfg: LeadConfig) -> DataFrame:
    """L2: P9 -> J8 (grid radius semi join) -> tags."""
    champ = champions.select(F.col('latitude').alias('_clat'), F.col('longitude').alias('_clon'))
    near = radius_join(candidates, champ, cfg.hotspot_radius_km, 'gias_lat', 'gias_lon', '_clat', '_clon',
                       how='left_semi', distance='great_circle', salt=cfg.salt)
    return tag(near, 'Hotspot Lead', 'normal', f'Within {_fmt_num(cfg.hotspot_radius_km)}km of champion')


def deprived_leads(candidates: DataFrame, cfg: LeadConfig) -> DataFrame:
    """L3: P8 (fsm >= threshold; null dropped) -> tags."""
    leads = candidates.filter(F.col('fsm_percentage') >= F.lit(float(cfg.fsm_threshold)))
    return tag(leads, 'Deprived Area', 'deprived', f'FSM >= {_fmt_num(cfg.fsm_threshold)}% (high deprivation)')


def first_per_key(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Keep the first row per key in ``order_cols`` order (null keys form one group).

    An aggregate (``min`` of a struct led by the order columns) rather than a
    window: partial aggregation keeps a hot key from landing whole in one task.
    """
    others = [c for c in df.columns if c != key and c not in order_cols]
    best = F.min(F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in others]))
    return (df.groupBy(key).agg(best.alias('_b'))
              .select(key, *[F.col('_b.' + c).alias(c) for c in order_cols + others]))


def nearest_champion(leads: DataFrame, champions: DataFrame, cfg: LeadConfig,
                     lead_id: str = 'reg_ord') -> DataFrame:
    """Nearest champion name and great-circle km per lead (first champion wins ties).

    Leads without coordinates, or no champion with coordinates, get nulls.
    """
    champ = (champions.filter(F.col('latitude').isNotNull() & F.col('longitude').isNotNull())
                      .select(F.col('school_name').alias('nearest_champion'),
                              F.col('latitude').alias('_clat'), F.col('longitude').alias('_clon')))
    near = nearest_join(leads.select(lead_id, 'gias_lat', 'gias_lon'), champ, 1, lead_id,
                        ['nearest_champion', '_clat', '_clon'], 'gias_lat', 'gias_lon', '_clat', '_clon',
                        distance='great_circle', dist_col='distance_to_champion_km')
    return leads.join(near.select(lead_id, 'nearest_champion', 'distance_to_champion_km'), lead_id, 'left')


def score_normal(leads: DataFrame) -> DataFrame:
    """L4 + A35: 10 for trust leads + 5 * (1 - d / max d) when max d > 0.

    A null distance gives a null score (sorted last); the max is a one-row
    aggregate joined back.
    """
    mx = leads.agg(F.max('distance_to_champion_km').alias('_maxd'))
    base = F.when(F.col('lead_type') == 'Trust Lead', F.lit(10.0)).otherwise(F.lit(0.0))
    bonus = F.lit(5.0) * (F.lit(1.0) - F.col('distance_to_champion_km') / F.col('_maxd'))
    score = F.when(F.coalesce(F.col('_maxd') > 0, F.lit(False)), base + bonus).otherwise(base)
    return leads.crossJoin(F.broadcast(mx)).withColumn('priority_score', score).drop('_maxd')


def score_deprived(leads: DataFrame) -> DataFrame:
    """L5 + A35: 10 * fsm / max fsm when max fsm > 0, else 0."""
    mx = leads.agg(F.max('fsm_percentage').alias('_maxf'))
    score = F.when(F.coalesce(F.col('_maxf') > 0, F.lit(False)),
                   F.lit(10.0) * F.col('fsm_percentage') / F.col('_maxf')).otherwise(F.lit(0.0))
    return leads.crossJoin(F.broadcast(mx)).withColumn('impact_score', score).drop('_maxf')


def top_by(df: DataFrame, score: str, n: int | None, tie: str = 'gias_urn') -> DataFrame:
    """O1: top n by score descending, nulls last, ties by ``tie`` ascending."""
    ordered = df.orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_last())
    return ordered.limit(n) if n else ordered


def normal_leads(registry: DataFrame, visited: DataFrame, cfg: LeadConfig = LeadConfig(),
                 tracks: tuple[str, ...] = ('trust', 'hotspot'), score: bool = True) -> DataFrame:
    """L6 track 1 (and L7 when ``score=False``): trust U hotspot -> W1 -> J9 -> L4 -> O1."""
    visited = cut_lineage(visited.select('school_name', 'visit_count', 'latitude', 'longitude'))
    champions = champions_of(visited, cfg.champion_min_visits)
    cand = unvisited(registry, visited)
    parts = []
    if 'trust' in tracks:
        parts.append(trust_leads(cand, champions, registry, cfg).withColumn('_t', F.lit(0)))
    if 'hotspot' in tracks:
        parts.append(hotspot_leads(cand, champions, cfg).withColumn('_t', F.lit(1)))
    leads = parts[0]
    for p in parts[1:]:
        leads = leads.unionByName(p)
    leads = first_per_key(leads, 'gias_urn', ['_t', 'reg_ord']).drop('_t')
    # reused by the nearest-champion rounds and the final join: materialise once
    leads = cut_lineage(leads)
    if not score:
        return leads.select(*STANDARD_COLS, *TAG_COLS)
    leads = nearest_champion(leads, champions, cfg)
    leads = score_normal(leads)
    return top_by(leads, 'priority_score', cfg.top_n).select(
        *STANDARD_COLS, *TAG_COLS, *CONNECTION_COLS, 'priority_score')


def deprived_area_leads(registry: DataFrame, visited: DataFrame, cfg: LeadConfig = LeadConfig()) -> DataFrame:
    """L6 track 2: L3 -> L5 -> O1 -> J9.

    The impact score does not depend on the champion distance, so the top n
    are chosen first and only those are connected to their nearest champion.
    """
    visited = cut_lineage(visited.select('school_name', 'visit_count', 'latitude', 'longitude'))
    champions = champions_of(visited, cfg.champion_min_visits)
    leads = score_deprived(deprived_leads(unvisited(registry, visited), cfg))
    top = top_by(leads, 'impact_score', cfg.top_n)
    top = nearest_champion(top, champions, cfg)
    return top.select(*STANDARD_COLS, *TAG_COLS, *CONNECTION_COLS, 'impact_score')


def generate_leads(registry: DataFrame, visited: DataFrame, cfg: LeadConfig = LeadConfig()):
    """(normal leads, deprived-area leads)."""
    return normal_leads(registry, visited, cfg), deprived_area_leads(registry, visited, cfg)
