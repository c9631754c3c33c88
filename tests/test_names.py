"""Fuzzy name matching (J5, C22): equal to the comparison with every registry name, on few pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescope.functions import fuzzy as Z
from sitescope.operators import names as N


def sort_key(text):
    return ' '.join(sorted(text.split()))


def misspell(rng, name, edits):
    for _ in range(edits):
        at = rng.randrange(len(name) + 1)
        kind = rng.random()
        name = name[:at] + (rng.choice('aeiou #0189é') if kind < 0.6 else '') + name[at + (kind > 0.3):]
    return name


def brute_force(typed, registry, threshold):
    out = {}
    for i, name in typed:
        if name is None:
            continue
        scored = [(-Z.indel_ratio(sort_key(name), sort_key(r)), o, t) for r, o, t in registry if r is not None]
        best = min(scored, default=None)
        if best and -best[0] >= threshold - 1e-9:
            out[i] = (pytest.approx(-best[0]), best[2])
    return out


@pytest.mark.parametrize('threshold', [60.0, 80.0, 95.0, 100.0])
def test_best_match_equals_brute_force(spark, threshold):
    rng = random.Random(int(threshold))
    words = ['oak', 'hill', 'school', 'st', 'mary', 'primary', 'academy', 'north', 'élan', 'a', 'of', 'x' * 70]
    registry = [(' '.join(rng.choices(words, k=rng.randint(1, 4))), i, f'T{i}') for i in range(80)]
    registry += [('Customer#%09d' % i, 100 + i, f'C{i}') for i in range(80)] + [(None, 900, 'none'), ('', 901, 'empty'), ('a', 902, 'one')]
    typed = [(i, misspell(rng, rng.choice(registry[:160])[0], rng.randint(0, 5))) for i in range(150)]
    typed += [(200, None), (201, ''), (202, '   '), (203, 'b'), (204, 'qqqqqqqqqqqq'), (205, typed[0][1]), (206, 'x' * 69)]
    left = spark.createDataFrame(typed, 'id long, n string')
    reg = spark.createDataFrame(registry, 'name string, ord long, trust string').repartition(4)
    got = {r['id']: (r['match_score'], r['trust']) for r in N.fuzzy_best_match(left, 'id', 'n', reg, 'name', 'ord', ['trust'], threshold).collect()}
    assert got == brute_force(typed, registry, threshold)


def test_an_empty_side_matches_nothing(spark):
    left = spark.createDataFrame([(1, 'abc')], 'id long, n string')
    reg = spark.createDataFrame([], 'name string, ord long, trust string')
    assert N.fuzzy_best_match(left, 'id', 'n', reg, 'name', 'ord', ['trust']).count() == 0
    some = spark.createDataFrame([('abc', 1, 't')], reg.schema)
    assert N.fuzzy_best_match(left.limit(0), 'id', 'n', some, 'name', 'ord', ['trust']).count() == 0


def test_common_pieces_make_few_pairs(spark):
    """Names that share most of their characters: a lost character meets few of the registry."""
    n = 2000
    reg = spark.createDataFrame([('Customer#%09d' % i, i) for i in range(n)], 'rs string, ro long').withColumn('lb', F.length('rs'))
    index = N.piece_index(reg)
    sizes = N.sizes_around(N.piece_sizes(index), 1).cache()
    names = spark.createDataFrame([('Customer#%08d' % i, 1) for i in range(0, n, 5)], 'ls string, limit int').withColumn('la', F.length('ls'))
    pairs = N.candidate_pairs(names, index.cache(), sizes).count()
    assert pairs < 0.1 * n * (n // 5), pairs / (n * (n // 5))
    assert N.candidate_pairs(names.limit(1), index, sizes).groupBy('ls', 'rs').count().where('count > 1').isEmpty()


def test_names_one_edit_away_meet_only_such_keys(spark):
    """Pairs of the first round are those within one edit, each once, however many names share their characters."""
    keys = ['Customer#%06d' % i for i in range(0, 3000, 7)] + ['', 'a', 'ab', 'ba', 'aab', 'école']
    typed = ['Customer#%05d' % i for i in range(0, 300)] + ['', 'a', 'b', 'aa', 'ab', 'cole', 'écolee', keys[5]]
    reg = spark.createDataFrame([(k, i, len(k)) for i, k in enumerate(keys)], 'rs string, ro long, lb int')
    left = spark.createDataFrame([(t, len(t), limit) for t in typed for limit in (0, 1)], 'ls string, la int, limit int')
    got = [(r.ls, r.limit, r.rs, r.d) for r in N.pairs_one_edit_apart(left, reg).collect()]
    gap = {(t, k): len(t) + len(k) - 2 * Z.lcs_length(t, k) for t in typed for k in keys}
    want = [(t, limit, k, gap[t, k]) for t in typed for k in keys for limit in (0, 1) if gap[t, k] <= limit]
    assert sorted(got) == sorted(want)


def test_settled_in_the_first_round_without_pieces(spark, monkeypatch):
    """A lost character in names of one dense range of numbers: no piece is looked up, so pairs stay linear."""
    monkeypatch.setattr(N, 'piece_index', None)
    reg = spark.createDataFrame([('Customer#%09d' % i, i) for i in range(500)], 'name string, ord long')
    typed = spark.createDataFrame([('Customer#%08d' % i,) for i in range(0, 50)], 'n string')
    got = {r.n: r.ord for r in N.fuzzy_best_match(typed, 'n', 'n', reg, 'name', 'ord', ['ord'], 85.0).collect()}
    assert got == {'Customer#%08d' % i: i for i in range(50)}


def test_array_distances_equal_the_plain_ones():
    rng = random.Random(4)
    strings = [''.join(rng.choices('abcde é', k=rng.choice([0, 1, 5, 20, 61, 62, 63, 80]))) for _ in range(120)]
    pairs = [(rng.choice(strings), rng.choice(strings)) for _ in range(800)]
    limit = np.array([rng.randint(0, 160) for _ in pairs])
    plain = [len(a) + len(b) - 2 * Z.lcs_length(a, b) for a, b in pairs]
    got = Z.distances_within([a for a, _ in pairs], [b for _, b in pairs], limit)
    assert got.tolist() == [d if d <= m else -1 for d, m in zip(plain, limit.tolist())]
