"""Importance resampling, De Bruijn deduplication and lexical search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescope.llm import debruijn, resample, search
from sitescope.llm.terms import split_terms

EXTRA = 'doc_id long, text string, n_words string, `the text` string, part int, own int, id2 int, rank int, `a.b` int'
FILL = ('x', 'y', 1, 2, 3, 4, 5)


def texts(n, seed=1, words=40):
    rng = random.Random(seed)
    vocabulary = ['w%d' % i for i in range(60)] + ['É', 'naïve', 'Ab', 'ab', '42']
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, words))]
        if i % 3 == 0:
            a = rng.randint(0, 10)
            own = own[:5] + passage[a:a + rng.randint(13, 20)] + own[5:]
        rows.append((i, rng.choice([' ', '  ', '\n']).join(own)))
    rows += [(n, None), (n + 1, ''), (n + 2, ' \t\n'), (n + 3, rows[0][1]), (n + 3, rows[0][1]), (n + 4, 'x' * 300_000),
             (n + 5, 'same ' * 200), (n + 6, 'same ' * 150), (n + 7, 'p q ' * 60), (n + 8, 'p q ' * 30), (None, rows[3][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *FILL) for r in rows], EXTRA)


# --------------------------------------------------------------------------- op11

TERM = re.compile('[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
LOWER = str.maketrans('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')


def words_of(text):
    return TERM.findall((text or '').translate(LOWER))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(' '.join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected_draw(rows, target, percent, min_words):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        b = buckets_of(text)
        h = int(hashlib.sha256(f'42:{"" if i is None else i}'.encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        out.append([i, len(words_of(text)), len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= min_words),
                    key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[3], r[2]))
    for place, row in enumerate(enough[:percent * len(enough) // 100], 1):
        row[5] = place
    return Counter(tuple(r) for r in out)


@pytest.mark.parametrize('percent, min_words', [(5, 20), (40, 5), (100, 0), (0, 0)])
def test_resample_equals_brute_force(spark, percent, min_words):
    rows, target = texts(150), [t for _, t in texts(20, seed=9)] + [None]
    aim = spark.createDataFrame([(t,) for t in target], 'text string')
    got = resample.resample(frame(spark, rows), aim, percent, min_words)
    names = ['doc_id', 'n_words', 'n_features', 'weight', 'score', 'rank']
    assert set(got.columns) == {*names, 'text', 'the text', 'part', 'own', 'id2', 'a.b'}
    assert Counter(tuple(r) for r in got.select(*names).collect()) == expected_draw(rows, target, percent, min_words)


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame([], 'doc_id long, text string')
    one = spark.createDataFrame([(1, 'a b ' * 20)], 'doc_id long, text string')
    assert resample.resample(docs, one).count() == 0
    assert resample.resample(one, docs, percent=100).first()['rank'] == 1


def test_joined_crc_equals_crc_of_the_joined_bytes():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(n)) for n in [*range(20), 255, 256, 70_001]]
    left, right = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    got = resample.joined_crc(left, right, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize('last', [1, 40])
def test_cutoff_is_the_exact_kth_key(spark, last):
    rng = random.Random(5)
    rows = [(rng.randint(-9, 9), rng.randint(0, 50)) for _ in range(700)]
    keys = spark.createDataFrame(rows, 'score long, key long').repartition(7)
    for k in (1, 2, 350, 699, 700):
        assert tuple(resample.cutoff(keys, k, last)) == sorted(rows)[k - 1]


def test_weighted_median_leaves_a_quarter_out():
    rng = random.Random(2)
    parts = [sorted((rng.randint(0, 999), 0) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    pivot = resample.weighted_median([(p[(len(p) - 1) // 2], len(p)) for p in parts])
    flat = [x for p in parts for x in p]
    assert sum(x <= pivot for x in flat) >= len(flat) / 4 and sum(x >= pivot for x in flat) >= len(flat) / 4


# --------------------------------------------------------------------------- op12

def expected_removal(rows):
    firsts: dict = {}
    low = debruijn.NO_ID
    split = [(low if i is None else i, (t or '').encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - 12):
            key = tuple(w[p:p + 13])
            firsts[key] = min(firsts.get(key, i), i)
    out = []
    for (i, _), (key_id, w) in zip(rows, split):
        covered = set()
        for p in range(len(w) - 12):
            if firsts[tuple(w[p:p + 13])] < key_id:
                covered.update(range(p, p + 13))
        kept = b' '.join(x for p, x in enumerate(w) if p not in covered)
        out.append((i, len(w), len(covered), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize('seed', [1, 2, 3])
def test_dedup_substrings_equals_brute_force(spark, seed):
    rows = texts(120, seed=seed)
    random.Random(seed).shuffle(rows)
    rows += [(7, 'another text of an id that is taken ' * 4), (8, 'another text of an id that is taken ' * 5)]
    got = debruijn.dedup_substrings(frame(spark, rows).repartition(5))
    assert set(got.columns) == {'doc_id', 'text', 'n_words', 'the text', 'part', 'own', 'id2', 'rank', 'a.b', 'n_removed', 'kept_sha256'}
    found = got.select('doc_id', 'n_words', 'n_removed', 'kept_sha256', 'text', 'own').collect()
    assert Counter(tuple(r)[:4] for r in found) == expected_removal(rows)
    whole = Counter((i, t) for i, t in rows)
    for r in found:
        assert r['own'] == 2
        if r['n_removed']:
            assert hashlib.sha256(r['text'].encode()).hexdigest() == r['kept_sha256']
        else:
            assert whole[r['doc_id'], r['text']]


def test_dedup_substrings_in_small_blocks_of_many_tasks(spark, monkeypatch):
    rows = texts(60, seed=8)
    one = debruijn.dedup_substrings(frame(spark, rows).coalesce(1), keep=['doc_id']).collect()
    many = debruijn.dedup_substrings(frame(spark, rows).repartition(20), keep=['doc_id']).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, many)) == expected_removal(rows)


def test_dedup_substrings_of_an_empty_table(spark):
    assert debruijn.dedup_substrings(spark.createDataFrame([], 'doc_id long, text string')).count() == 0


def test_compaction_makes_maximal_unbranched_paths(spark):
    """A chain over three documents, a branch, and a ring."""
    chain = [(10 + i, 11 + i, i // 4, i % 4) for i in range(12)]            # nodes 10..22 over documents 0, 1, 2
    branch = [(22, 100, 5, 0), (22, 200, 6, 0), (100, 101, 5, 1)]           # node 22 has two ways out
    ring = [(300, 301, 7, 0), (301, 302, 8, 0), (302, 300, 9, 0)]
    edges = spark.createDataFrame([*chain, *branch, *ring], '`from` long, `to` long, sid long, sat long')
    paths: dict = {}
    for r in debruijn.compact(edges).collect():
        paths.setdefault(r['path'], []).append((r['offset'], r['from'], r['to']))
    found = sorted(sorted(p) for p in paths.values())
    assert [(o, a, b) for o, (a, b, _, _) in enumerate(chain)] in found
    assert [(0, 22, 100), (1, 100, 101)] in found and [(0, 22, 200)] in found
    assert sum(len(p) for p in found) == 18


def test_only_spans_with_the_digest_of_their_source_go():
    words = [b'w%d' % i for i in range(30)]
    good = {'start': 2, 'n': 13, 'digest': debruijn.span_digest(words[2:15])}
    assert debruijn.kept_words(words, False, [good]) == words[:2] + words[15:]
    assert debruijn.kept_words(words, False, [good | {'start': 3}]) == words
    assert debruijn.kept_words(words, True, None) == []


# --------------------------------------------------------------------------- op13

def expected_ranking(rows, items, top):
    split = [(i, words_of(t)) for i, t in rows]
    split = [(i, w, Counter(w)) for i, w in split if w]
    n_docs, n_words = len(split), sum(len(w) for _, w, _ in split)
    out = []
    for item, text in items:
        scores = []
        for i, w, tf in split:
            m = 100 - 25 + (25 * len(w) * n_docs) // n_words
            score = 0
            for term in words_of(text):
                df = sum(term in c for _, _, c in split)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += weight * ((1000000000 * tf[term]) // (1000 * tf[term] + 12 * m)) if tf[term] else 0
            if score > 0:
                scores.append((-score, math.inf if i is None else i, i))
        out += [(item, place, i, -s) for place, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:top], 1)]
    return Counter(out)


ITEMS = [(1, 'w1 w2 W3 w3 naïve'), (2, 'É 42 unknown'), (3, None), (4, '...'), (None, 'ab same'), (6, 'unknown'), (6, 'p q w5 ' * 9)]


@pytest.mark.parametrize('top, at_a_time', [(20, 500), (3, 2), (1000, 500)])
def test_search_equals_brute_force(spark, top, at_a_time):
    rows = texts(90, seed=4)
    items = spark.createDataFrame([(*i, 0, 'z') for i in ITEMS], 'item_id long, text string, item int, rank string')
    got = search.search(frame(spark, rows).repartition(3), items, top, at_a_time=at_a_time)
    assert got.columns == ['item_id', 'rank', 'doc_id', 'score']
    assert Counter(map(tuple, got.collect())) == expected_ranking(rows, ITEMS, top)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, '')], 'doc_id long, text string'), spark.createDataFrame(ITEMS, 'item_id long, text string')
    assert search.search(docs, items).count() == 0
    assert search.search(spark.createDataFrame([(1, 'w1')], docs.schema), items.limit(0)).count() == 0


def test_bounds_are_never_below_the_scores_and_exclude_most(spark):
    rows = [(i, t) for i, t in texts(400, seed=6) if i is not None]
    docs = spark.createDataFrame(rows, 'doc_id long, text string').coalesce(2)
    index = search.build_index(docs).cache()
    totals = index.select(F.sum(F.size('ids')), F.sum(F.aggregate('lengths', F.lit(0).cast('long'), lambda a, x: a + x))).first()
    block = search.read_block([(1, 'w1 w1 same'), (2, 'É 42')], docs, 'text', *totals)
    found = search.not_excluded(index, block, [1, 1]).collect()
    numbers = {w: i for i, w in enumerate(block.vocabulary)}
    by_id = {(r['item'], r['id']): r['bound'] for r in found}
    excluded = 0
    for i, text in rows:
        if split_terms(text or ''):
            for item, score in enumerate(search.exact_scores(block, numbers, split_terms(text), [0, 1])):
                excluded += (item, i) not in by_id
                assert by_id.get((item, i), 0) >= score
    assert excluded > 200
