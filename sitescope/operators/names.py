"""Best fuzzy match of names against a registry without comparing all pairs (J5's fuzzy leg).

Names are matched by their token-sorted keys; equal keys are one. The score is
``200 * LCS / (la + lb)``, that is 100 less the share of inserted and deleted
characters (the Indel distance d).

Pigeonhole. An edit touches at most one of several disjoint pieces of a name,
so of any d + 1 disjoint pieces at least one is found verbatim in a name at
distance d, shifted by no more places than characters were lost or are new. An
inverted index holds the registry's pieces of up to ``GRAM`` characters with
their places; for every name the d + 1 pieces to look up are the rarest ones,
so pieces that all names share cost nothing.

Rounds. Budgets of 1, 2, 4, ... edits are tried in turn. A name is settled as
soon as its best score beats what any name beyond the budget could reach, or
once the budget is all that the threshold allows. Most names settle in the
first round; the result is that of the comparison with every registry name.

The first round needs no pieces: a key at distance 1 is the name after one lost
character, or the name is the key after one. An equi-join on the strings with
one character left out meets these keys alone, so its pairs do not grow with
the registry, however alike its names are. Pieces serve the wider rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.functions.fuzzy import indel_within, token_sort_key
from sitescope.session import cut_lineage

#: Longest piece that is looked up.
GRAM = 4
_EPS = 1e-9


def reach(length: Column, threshold: float) -> Column:
    """Largest distance at which a name of this length can still score the threshold.

    d <= r (la + lb) with lb <= la + d, where r is the share of edits allowed.
    """
    r = 1.0 - threshold / 100.0
    return F.floor(length * F.lit(2.0 * r / (1.0 - r)) + F.lit(_EPS)).cast('int')


def piece_index(registry: DataFrame) -> DataFrame:
    """(piece, place, rs, lb, ro) of all pieces of the registry's keys.

    A key also has one row for its length, which names too short for pieces
    look up.
    """
    sized = registry.select('rs', 'lb', 'ro', F.explode(F.sequence(F.lit(1), F.lit(GRAM))).alias('q')).where('lb >= q')
    pieces = F.transform(F.sequence(F.lit(1), F.col('lb') - F.col('q') + 1), lambda p: F.substr('rs', p, F.col('q')))
    placed = sized.select(F.posexplode(pieces).alias('place', 'piece'), 'rs', 'lb', 'ro')
    whole = registry.select(F.lit(0).alias('place'), _length_piece(F.col('lb')).alias('piece'), 'rs', 'lb', 'ro')
    return placed.unionByName(whole)


def piece_sizes(index: DataFrame) -> DataFrame:
    """How many registry keys hold a piece at a place."""
    return index.groupBy('piece', 'place').agg(F.count('*').alias('size'))


def sizes_around(sizes: DataFrame, budget: int) -> DataFrame:
    """How many index rows a lookup of a piece meets within ``budget`` places of a place."""
    around = F.explode(F.sequence(F.col('place') - budget, F.col('place') + budget))
    return sizes.select('piece', around.alias('place'), 'size').groupBy('piece', 'place').agg(F.sum('size').alias('size'))


def _length_piece(length: Column) -> Column:
    return F.concat(F.lit('\x00'), length.cast('string'))


def rarest_pieces(names: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ls, la, limit, piece, place, at): what to look up, limit + 1 disjoint pieces of every name at all shifts.

    A name is cut into pieces of one length, one after another from one of its
    first places; of all lengths and starts the one whose limit + 1 rarest
    pieces have the fewest registry keys wins. Rarity is only a choice: any
    limit + 1 disjoint pieces find every key within the limit.
    """
    limit, lookup = F.col('limit'), ['ls', 'la', 'limit', 'piece', 'place']
    longest = F.least(F.lit(GRAM), F.floor(F.col('la') / (limit + 1)).cast('int'))
    sized = names.withColumn('longest', longest)
    aligned = sized.where('longest >= 1').withColumn('q', F.explode(F.sequence(F.lit(1), F.col('longest'))))
    aligned = aligned.withColumn('first', F.explode(F.sequence(F.lit(0), F.col('q') - 1)))
    aligned = aligned.where(F.floor((F.col('la') - F.col('first')) / F.col('q')) > limit)
    cut = aligned.withColumn('place', F.explode(F.sequence(F.col('first'), F.col('la') - F.col('q'), F.col('q'))))
    cut = cut.withColumn('piece', F.substr('ls', F.col('place') + 1, F.col('q')))
    weighed = cut.join(sizes, ['piece', 'place'], 'left').withColumn('size', F.coalesce('size', F.lit(0)))
    pieces = F.slice(F.sort_array(F.collect_list(F.struct('size', 'place', 'piece'))), 1, limit + 1)
    one = weighed.groupBy('ls', 'la', 'limit', 'q', 'first').agg(pieces.alias('pieces'))
    total = F.aggregate('pieces', F.lit(0).cast('long'), lambda s, p: s + p['size'])
    best = one.groupBy('ls', 'la', 'limit').agg(F.min(F.struct(total.alias('total'), 'q', 'first', 'pieces')).alias('best'))
    found = best.select('ls', 'la', 'limit', F.inline('best.pieces')).withColumnRenamed('place', 'at')
    around = F.sequence(F.greatest(F.col('at') - limit, F.lit(0)), F.col('at') + limit)
    shifted = found.withColumn('place', F.explode(around))
    lengths = F.sequence(F.greatest(F.col('la') - limit, F.lit(0)), F.col('la') + limit)
    short = sized.where('longest < 1').select('ls', 'la', 'limit', F.explode(F.transform(lengths, _length_piece)).alias('piece'),
                                              F.lit(0).alias('place'))
    return shifted.select(*lookup, 'at').unionByName(short.select(*lookup, F.lit(None).cast('int').alias('at')))


def candidate_pairs(names: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct (ls, la, limit, rs, lb, ro) that may lie within each name's limit.

    With lengths la and lb, at most (limit + la - lb) / 2 characters are lost
    and (limit - la + lb) / 2 are new, which bounds a piece's shift both ways.
    """
    longer, shift = F.col('lb') - F.col('la'), F.col('place') - F.col('at')
    near = F.coalesce((shift >= -F.floor((F.col('limit') - longer) / 2)) & (shift <= F.floor((F.col('limit') + longer) / 2)), F.lit(True))
    pairs = rarest_pieces(names, sizes).join(index, ['piece', 'place']).where(near & (F.abs(longer) <= F.col('limit')))
    return pairs.select('ls', 'la', 'limit', 'rs', 'lb', 'ro').distinct()


def _without_one(text: Column) -> Column:
    """The distinct strings left of a text when one character is lost."""
    n = F.length(text)
    lost = F.transform(F.sequence(F.lit(1), n), lambda p: F.concat(F.substr(text, F.lit(1), p - 1), F.substr(text, p + 1, n)))
    return F.when(n > 0, F.array_distinct(lost)).otherwise(F.array().cast('array<string>'))


def pairs_one_edit_apart(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(ls, la, limit, rs, lb, ro, d): the keys at a distance d of at most ``limit`` (0 or 1) from every name.

    ``lost`` says of which texts a string of the join is: of whole keys, or of
    keys with a character lost. Names with a character lost only meet whole
    keys, so no pair is two edits apart, and none comes twice.
    """
    def strings(rows: DataFrame, *kinds: tuple[Column, bool]) -> DataFrame:
        parts = [rows.select('*', F.explode(texts).alias('text'), F.lit(lost).alias('lost')) for texts, lost in kinds]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    known = strings(registry.select('rs', 'lb', 'ro'), (F.array('rs'), False), (_without_one(F.col('rs')), True))
    whole = strings(names, (F.array('ls'), False))
    edited = names.where('limit >= 1')
    looked_up = whole.unionByName(strings(edited, (F.array('ls'), True), (_without_one(F.col('ls')), False)))
    pairs = looked_up.join(known, ['text', 'lost'])
    return pairs.select('ls', 'la', 'limit', 'rs', 'lb', 'ro', F.abs(F.col('la') - F.col('lb')).alias('d'))


def best_keys(names: DataFrame, registry: DataFrame, threshold: float) -> DataFrame:
    """(ls, score, rs): the registry key of the highest score >= threshold of every name key.

    ``names``: ls; ``registry``: rs, ro (its order, which settles ties), both
    distinct. Names without a match are absent.
    """
    todo = names.select('ls', F.length('ls').alias('la'))
    todo = cut_lineage(todo.withColumn('far', reach(F.col('la'), threshold)))
    registry = registry.select('rs', 'ro', F.length('rs').alias('lb'))
    results, budget, index = [], 1, None
    while not todo.isEmpty():
        limited = todo.withColumn('limit', F.least('far', F.lit(budget)))
        if budget == 1:
            pairs = pairs_one_edit_apart(limited.drop('far'), registry)
        else:
            if index is None:
                index = cut_lineage(piece_index(registry))
                sizes = cut_lineage(piece_sizes(index))
            pairs = candidate_pairs(limited.drop('far'), index, sizes_around(sizes, budget)).withColumn('d', indel_within('ls', 'rs', 'limit'))
        total = F.col('la') + F.col('lb')
        score = F.when(total == 0, F.lit(100.0)).otherwise(100.0 * (total - F.col('d')) / total)
        best = (pairs.where('d is not null').groupBy(F.col('ls').alias('ls2'))
                .agg(F.min(F.struct((-score).alias('less'), 'ro', 'rs')).alias('b')))
        beyond = F.lit(100.0) * (1 - (F.col('limit') + 1) / (2 * F.col('la') + F.col('limit') + 1))
        settled = (F.col('limit') >= F.col('far')) | F.coalesce(-F.col('b.less') > beyond + _EPS, F.lit(False))
        state = cut_lineage(limited.join(best, F.col('ls') == F.col('ls2'), 'left')
                            .select('ls', 'la', 'far', 'b', settled.alias('settled')))
        results.append(state.where('settled and b is not null').select('ls', (-F.col('b.less')).alias('score'), F.col('b.rs').alias('rs')))
        todo, budget = state.where('not settled').select('ls', 'la', 'far'), budget * 2
    found = results[0] if results else names.select('ls', F.lit(0.0).alias('score'), F.col('ls').alias('rs')).limit(0)
    for more in results[1:]:
        found = found.unionByName(more)
    return found.where(F.col('score') >= threshold - _EPS)


def fuzzy_best_match(left: DataFrame, left_key: str, left_name: str, registry: DataFrame, reg_name: str,
                     reg_order: str, reg_cols: Sequence[str], threshold: float = 80.0) -> DataFrame:
    """Best registry row with score >= threshold per left row.

    Output: ``left_key``, ``match_score`` and ``reg_cols`` of the best row
    (highest score, then lowest ``reg_order``). Left rows without a match, and
    null names, are absent.
    """
    if not 0 < threshold <= 100:
        raise ValueError('the threshold must lie above 0 and be at most 100')
    typed = left.select(F.col(left_key), token_sort_key(left_name).alias('ls')).where(F.col('ls').isNotNull())
    known = (registry.select(token_sort_key(reg_name).alias('rs'), F.col(reg_order).alias('ro'),
                             *[F.col(c).alias('_m_' + c) for c in reg_cols]).where(F.col('rs').isNotNull())
             .groupBy('rs').agg(F.min(F.struct('ro', *['_m_' + c for c in reg_cols])).alias('row')))
    best = best_keys(typed.select('ls').distinct(), known.select('rs', F.col('row.ro').alias('ro')), float(threshold))
    rows = best.join(known, 'rs').select('ls', F.col('score').alias('match_score'),
                                         *[F.col('row._m_' + c).alias(c) for c in reg_cols])
    return typed.join(rows, 'ls').select(left_key, 'match_score', *reg_cols)
