"""Entity matching and lookup joins.

Exact matches are equi-joins on a normalised name. The fuzzy leg, for names
without a usable exact match, is the inverted index of ``operators.names``: it
finds each name's best registry row without comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions import lexicons as lx
from sitescope.functions.clean import norm_name, strip
from sitescope.operators.names import fuzzy_best_match
from sitescope.session import cut_lineage


def dedupe_last(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """J4 helper: one row per key, the last one in ``order_col`` order wins."""
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.col(order_col))
    return df.groupBy(key).agg(best.alias('_r')).select(key, *[F.col('_r.' + c).alias(c) for c in others])


def lookup_by_name(left: DataFrame, left_name: str, right: DataFrame, right_name: str,
                   value_cols: Sequence[str], order_col: str) -> DataFrame:
    """Left join on normalised name; duplicate right names keep the last row."""
    r = right.select(norm_name(right_name).alias('_nk'), order_col, *value_cols)
    r = dedupe_last(r, '_nk', order_col).drop(order_col)
    return left.join(r, norm_name(left_name) == F.col('_nk'), 'left').drop('_nk')


def attach_coordinates(sites: DataFrame, geocodes: DataFrame, key: str = 'school_name',
                       lat: str = 'latitude', lon: str = 'longitude') -> DataFrame:
    """J1 + P14: left join geocodes (suffix ``_geo``) and prefer the geocoded values."""
    g = geocodes.select(key, F.col(lat).alias(lat + '_geo'), F.col(lon).alias(lon + '_geo'))
    out = sites.join(g, key, 'left')
    for c in (lat, lon):
        if c in sites.columns:
            out = out.withColumn(c, F.coalesce(F.col(c + '_geo'), F.col(c))).drop(c + '_geo')
        else:
            out = out.withColumnRenamed(c + '_geo', c)
    return out


def usable_trust(c) -> Column:
    """A trust value that counts: not null, not 'Not applicable' (any case)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (F.lower(strip(col)) != F.lit(lx.NO_TRUST_VALUE))


def match_to_registry(names: DataFrame, name_col: str, registry: DataFrame,
                      reg_name: str = 'gias_name', reg_norm: str = 'norm_name',
                      reg_order: str = 'reg_ord', reg_cols: Sequence[str] = ('trust_name',),
                      usable: Column | None = None, threshold: float = 80.0, fuzzy: bool = True) -> DataFrame:
    """J5 cascade: exact on normalised name (first registry row), else fuzzy.

    ``usable`` (a predicate over ``reg_cols``) makes an exact hit fall through
    to the fuzzy leg when it is not usable (e.g. no trust). Output: distinct
    input names with ``match_type`` ('exact' | 'fuzzy'), ``match_score`` and
    ``reg_cols``; unmatched names keep nulls.
    """
    src = (names.select(F.col(name_col).alias('_name'))
                .filter(F.col('_name').isNotNull() & (F.col('_name') != ''))
                .distinct())
    reg = registry.select(F.col(reg_norm).alias('_nk'), F.col(reg_order).alias('_ro'), *reg_cols)
    first = (reg.groupBy('_nk')
                .agg(F.min(F.struct('_ro', *[F.col(c) for c in reg_cols])).alias('_f'))
                .select('_nk', *[F.col('_f.' + c).alias(c) for c in reg_cols]))
    exact = src.join(first, norm_name(F.col('_name')) == F.col('_nk'), 'left').drop('_nk')
    if fuzzy:
        # materialised once, every name once: it feeds the names, the exact output, the remainder check and the final join
        exact = cut_lineage(exact)
        src = exact.select('_name')
    if usable is not None:
        matched_exact = exact.filter(usable)
    else:
        matched_exact = exact.filter(F.col(reg_cols[0]).isNotNull()) if reg_cols else exact
    exact_out = matched_exact.select('_name', F.lit('exact').alias('match_type'),
                                     F.lit(100.0).alias('match_score'), *reg_cols)
    if not fuzzy:
        out = exact_out
    else:
        # exact holds every name once; the names without a usable match go on
        hit = usable if usable is not None else (F.col(reg_cols[0]).isNotNull() if reg_cols else F.lit(True))
        remainder = exact.filter(~F.coalesce(hit, F.lit(False))).select('_name')
        fz = fuzzy_best_match(remainder, '_name', '_name', registry, reg_name, reg_order, list(reg_cols), threshold)
        if usable is not None:
            fz = fz.filter(usable)
        fuzzy_out = fz.select('_name', F.lit('fuzzy').alias('match_type'), 'match_score', *reg_cols)
        out = exact_out.unionByName(fuzzy_out)
    result = src.join(out, '_name', 'left')
    return result.withColumnRenamed('_name', name_col)


def champion_trusts(champions: DataFrame, registry: DataFrame, name_col: str = 'school_name',
                    threshold: float = 80.0, fuzzy: bool = True) -> DataFrame:
    """J5 -> J18: distinct usable trusts of the champions."""
    m = match_to_registry(champions, name_col, registry, usable=usable_trust('trust_name'),
                          threshold=threshold, fuzzy=fuzzy)
    return m.filter(usable_trust('trust_name')).select('trust_name').distinct()


# ---------------------------------------------------------------------------
# Geocoding as lookups
# ---------------------------------------------------------------------------

def geocode_queries(sites: DataFrame, name_col: str = 'school_name',
                    templates: Sequence[str] = ('{name}, United Kingdom', '{name}, England',
                                                '{name} School, UK', '{name}, School, United Kingdom')
                    ) -> DataFrame:
    """Candidate query strings per site, in priority order (``priority`` 0..)."""
    exprs = [F.format_string(t.replace('{name}', '%s'), F.col(name_col)) for t in templates]
    return sites.select(name_col, F.posexplode(F.array(*exprs)).alias('priority', 'query_key'))


def geocode_confidence(address_col) -> Column:
    """C27: 'high' if the address mentions a school-like word, else 'medium'."""
    low = F.lower(F.col(address_col) if isinstance(address_col, str) else address_col)
    cond = F.lit(False)
    for w in lx.HIGH_CONFIDENCE_WORDS:
        cond = cond | F.coalesce(low.contains(w), F.lit(False))
    return F.when(cond, F.lit('high')).otherwise(F.lit('medium'))


def geocode_sites(sites: DataFrame, gazetteer: DataFrame, name_col: str = 'school_name',
                  templates: Sequence[str] | None = None) -> DataFrame:
    """First query variant found in the gazetteer wins; misses keep nulls.

    ``gazetteer``: (query_key, latitude, longitude, address, source).
    Adds latitude, longitude, address, geocode_source, geocode_confidence, geocoded.
    """
    q = geocode_queries(sites.select(name_col).distinct(), name_col, *( [templates] if templates else []))
    hits = q.join(gazetteer, 'query_key', 'inner')
    best = (hits.groupBy(name_col)
                .agg(F.min(F.struct('priority', 'latitude', 'longitude', 'address', 'source')).alias('_b'))
                .select(name_col, F.col('_b.latitude').alias('latitude'),
                        F.col('_b.longitude').alias('longitude'), F.col('_b.address').alias('address'),
                        F.col('_b.source').alias('geocode_source')))
    out = sites.join(best, name_col, 'left')
    return (out.withColumn('geocode_confidence',
                           F.when(F.col('latitude').isNotNull(), geocode_confidence('address')))
               .withColumn('geocoded', F.col('latitude').isNotNull()))


def postcode_lookup(df: DataFrame, postcode_col: str, postcodes: DataFrame) -> DataFrame:
    """Inner join to a postcode table on the cleaned key (misses dropped)."""
    from sitescope.functions.clean import postcode_key
    left = df.withColumn('_pk', F.upper(postcode_key(postcode_col))).filter(F.col('_pk').isNotNull())
    right = postcodes.withColumn('_pk', F.upper(postcode_key('postcode'))).drop('postcode')
    return left.join(right, '_pk', 'inner').drop('_pk')


# ---------------------------------------------------------------------------
# Group index
# ---------------------------------------------------------------------------

def group_keys(name_col) -> Column:
    """C24 + C25: group keys of a name (academy key first, then long words).

    A word repeated within a name yields the key twice (it counts twice).
    """
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    low = F.lower(c)
    academy = low
    for suffix in lx.ACADEMY_SUFFIXES:
        academy = strip(F.replace(academy, F.lit(suffix), F.lit('')))
    academy_key = F.when(low.contains(lx.GROUP_KEY_WORD), F.concat(F.lit('academy_'), academy))
    stop = F.array(*[F.lit(w) for w in lx.GROUP_STOPWORDS])
    ws = F.filter(F.split(strip(low), r'(?U)\s+'),
                  lambda w: (F.length(w) >= lx.GROUP_MIN_WORD_LEN) & ~F.array_contains(stop, w))
    return F.concat(F.array_compact(F.array(academy_key)), ws)


def site_groups(names: DataFrame, name_col: str = 'school_name', min_size: int = 2) -> DataFrame:
    """Inverted group index in long form, groups with >= min_size members.

    Output: one row per membership (group_key, n_sites, name_col); a name holding
    a key twice appears twice, as it counts twice. Group sizes are a partial
    aggregate and memberships are joined back, so a hot key (one word shared by
    a third of all names) is never collected into a single list or task.
    """
    keyed = names.select(F.col(name_col), F.explode(group_keys(name_col)).alias('group_key'))
    sizes = (keyed.groupBy('group_key').agg(F.count(F.lit(1)).alias('n_sites'))
                  .filter(F.col('n_sites') >= min_size))
    return keyed.join(sizes, 'group_key', 'inner').select('group_key', 'n_sites', name_col)
