"""Every operator against brute force or an exact round trip, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sitescope.llm import ann, bpe, chat, langid, line_dedup, packing, quality, queries, simhash, suffix_dedup, toxicity
from sitescope.session import ensure_checkpoint_dir, ship_package

SMALL, ORACLE = '/root/testdata/sf0.001', '/root/testdata/sf0.01'
RANKS = public_tokenizers.path('byte_bpe_multi_50k.tiktoken')
WORDS_FILE = public_tokenizers.path('word_bpe_49k.json')

LONG = ' '.join(f'lore{i % 97}m{i}' for i in range(30_000))
PASSAGE = ' '.join(f'passage{i}' for i in range(60))
DOCS = [
    (1, 'alpha beta gamma delta epsilon'), (2, None), (3, ''), (4, ' \n\t '), (5, 'one'), (None, 'alpha beta gamma delta epsilon'),
    (6, LONG), (7, 'Été ÄÖÜ naïve 日本語 🙂 it\'s <|endoftext|> 12 ½'), (7, 'Été ÄÖÜ naïve 日本語 🙂 it\'s <|endoftext|> 12 ½'),
    (8, 'a\nb\nc\nd\ne'), (9, 'x\na\nb\nc\ny'), (10, 'start here ' + PASSAGE + ' end here'), (11, PASSAGE + ' other tail'),
    (12, 'to to to to to to to to to to to to'), (13, 'to ' * 400), (14, None), (15, 'a\n\nb'),
]
#: Columns whose names meet those that operators use inside.
EXTRA = 'id long, own long, place int, fp long, row long, block int, __text string, n_lines long, ids string'


@pytest.fixture(scope='module')
def session(spark):
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


@pytest.fixture(scope='module')
def docs(session):
    rows = [(i, t, 'en', 'src', None if t is None else len(t)) + (1, 2, 3, 4, 5, 6, 'z', 7, 'q') for i, t in DOCS]
    return session.createDataFrame(rows, 'doc_id long, text string, lang string, source string, n_chars long, ' + EXTRA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def words(text):
    return re.findall(r'[^\x20\x09-\x0D]+', text or '')


# byte-level BPE

def test_bpe_equals_the_library(docs):
    import tiktoken
    vocabulary = bpe.load_vocabulary(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding('t', pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    got = rows_of(bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN), 'doc_id', 'n_tokens', 'ids_sha256', 'decoded_sha256')
    want = []
    for i, t in DOCS:
        ids = library.encode_ordinary(t or '')
        want.append((i, len(ids), hashlib.sha256(np.array(ids, '<u4').tobytes()).hexdigest(), hashlib.sha256((t or '').encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_bpe_round_trip_and_blocks(docs):
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_chars=10)
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    got = Counter((r[0], bytes(r[1]).decode()) for r in back.collect())
    assert got == Counter((i, t or '') for i, t in DOCS)
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_merges_of_lower_rank_that_come_late():
    # b+c is 5 and abc is 1: merging ab (9) twice in one word makes pairs of lower rank between.
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b'ab': 9, b'aba': 1, b'abab': 0, b'ba': 20, b'bab': 2}
    v = bpe.Vocabulary(ranks, r'\S+|\s+')
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.choice(list(b'abc'), rng.integers(1, 40))) for _ in range(300)]
    flat, sizes = v.encode_corpus(pieces)
    for piece, ids in zip(pieces, np.split(flat, np.cumsum(sizes)[:-1])):
        parts = [bytes([b]) for b in piece]
        while piece not in ranks:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert ids.tolist() == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


# native operators

@pytest.mark.parametrize('name', sorted(queries.ORACLE))
def test_queries_equal_their_sql(session, name):
    for t in ('documents', 'conversations'):
        duckdb.sql(f"create or replace view {t} as select * from '{ORACLE}/{t}.parquet'")
    relation = duckdb.sql(queries.ORACLE[name])
    assert rows_of(queries.QUERIES[name](session, ORACLE), *relation.columns) == sorted(relation.fetchall())


def test_native_operators_have_no_python(docs):
    for df in (line_dedup.dedup_lines(docs), quality.judge(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search('Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop', plan)


def test_line_dedup_awkward_rows(docs):
    done = line_dedup.dedup_lines(docs)
    assert set(done.columns) == set(docs.columns) | {'n_removed_lines'}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in done.collect()}
    assert got[9] == ('x\ny', 5, 3) and got[8][0] == 'a\nb\nc\nd\ne'
    assert got[2] == (None, 0, 0) and got[3] == ('', 1, 0) and got[15][0] == 'a\n\nb'
    assert done.count() == len(DOCS) and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_hot_window_keeps_first(session):
    rows = [(i, 'p\nq\nr' if i % 3 == 0 else f'a{i}\nb{i}\nc{i}\np\nq\nr') for i in range(300)] + [(999, 'z\nz\nz\nz\nz')]
    got = dict(line_dedup.dedup_lines(session.createDataFrame(rows, 'doc_id long, text string')).select('doc_id', 'text').collect())
    assert got[0] == 'p\nq\nr' and got[3] == '' and got[1] == 'a1\nb1\nc1' and got[999] == 'z'


def test_quality_awkward_rows_and_order(docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[13].n_repeat_words == 400 and got[13].base_failed
    assert got[6].kept and got[6].n_words == 30_000 and got[15].n_dup_lines == 0
    first, second = list(quality.RULES), list(reversed(quality.RULES))
    assert rows_of(quality.judge(docs, order=first), 'doc_id', 'kept') == rows_of(quality.judge(docs, order=second), 'doc_id', 'kept')
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_order_follows_rejection_per_cost(session):
    from pyspark.sql import functions as F
    rows = [(i, ' '.join(f'wort{j}x{i % 2}' for j in range(400)) + (' rare' if i % 50 == 0 else '')) for i in range(300)]
    docs = session.createDataFrame(rows, 'doc_id long, text string')
    half = F.col('__text').contains('x1')
    dear = F.lit(0)
    for k in range(12):  # twelve regex passes over the text, each with groups to find
        dear = dear + F.regexp_count(F.col('__text'), F.lit(f'(w|o|r)+t[0-9]*{k}x(1|2)'))
    rules = {'dear': lambda: (dear >= 0) & half, 'rare': lambda: F.col('n_words') > 400, 'cheap': lambda: half}
    sample = quality.add_counts(docs)
    measured = quality.measure_rules(sample, rules)
    assert measured['dear'][0] == measured['cheap'][0] == 0.5 and measured['rare'][0] == 0.02
    assert measured['dear'][1] > 2 * measured['cheap'][1]
    orders = [quality.order_rules(docs, sample_rows=300, rules=rules) for _ in range(2)]
    assert [o.index('cheap') for o in orders] == [0, 0]
    got = {r.doc_id: r.kept for r in quality.judge(docs, order=orders[0], rules=rules).collect()}
    assert got == {i: i % 2 == 0 and i % 50 != 0 for i in range(300)}


@pytest.mark.parametrize('text, kept', [
    ('das ist ein ganz gewöhnlicher Satz mit mehr als zehn Wörtern darin.', True),
    ('Das!! ist?? ein.. Satz dessen Wörter zur guten Hälfte mit:: Zeichen-- enden~~ hier', False),
    ('eins | zwei | drei | vier | fünf | sechs', False),
    ('1 2 3 4 5 6 7 8 9 eins zwei drei vier fünf sechs sieben acht', False),
    ('Das sagte sie: "Nun gut." und ging dann (wie immer) ohne ein Wort.', True)])
def test_quality_words(session, text, kept):
    docs = session.createDataFrame([(1, text)], 'doc_id long, text string')
    only = {k: quality.RULES[k] for k in ('decorated_words', 'letterless_words')}
    assert quality.judge(docs, order=list(only), rules=only).first().kept == kept


# chat

def test_chat_round_trip(session):
    rows = [(1, 0, 'user', 'hi </turn> ###'), (1, 1, 'assistant', '\\ ok'), (1, 1, 'assistant', 'again'), (2, None, None, None),
            (None, 0, 'a: b', 'x'), (3, 5, 'assistant', 'L' * 300_000), (3, 2, 'system', '### a: b</turn>\n'), (4, 0, '###\\', '\n\n')]
    turns = session.createDataFrame(rows, 'conv_id long, turn long, role string, text string')
    formatted = chat.format_chats(turns.withColumn('part', F.lit('clash')))
    texts = {}
    for r in formatted.orderBy('part', 'piece').collect():
        texts[r.conv_id] = texts.get(r.conv_id, '') + r.formatted
    want = {}
    for c, n, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        want.setdefault(c, []).append((role or '', text or ''))
    assert {c: chat.parse(t) for c, t in texts.items()} == want
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert back[3].loss_chars == 300_000 and back[1].loss_chars == 9 and back[2].n_turns == 1
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_chat_long_conversation_spreads(session):
    turns = session.range(30_000).select(F.lit(1).alias('conv_id'), F.col('id').alias('turn'), F.lit('assistant').alias('role'),
                                         F.col('id').cast('string').alias('text'))
    formatted = chat.format_chats(turns).cache()
    assert formatted.select('part').distinct().count() > 1
    row = chat.read_back(formatted).first()
    said = ''.join(map(str, range(30_000)))
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.n_turns == 30_000


# packing

def test_packing_pieces_and_sequences(docs):
    import tokenizers
    library = tokenizers.Tokenizer.from_file(WORDS_FILE)
    want = Counter()
    for i, t in DOCS:
        ids = np.array(library.encode(t or '', add_special_tokens=False).ids + [0], '<u4')
        for n, at in enumerate(range(0, len(ids), 2048)):
            want[i, n, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())] += 1
    packed = packing.pack(packing.cut_pieces(docs, WORDS_FILE), block_pieces=9).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.cut_pieces(docs.limit(0), WORDS_FILE)).count() == 0


def test_packing_is_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 2049, 3000)
    bin_of, _ = packing.pack_lengths(lengths)
    assert bin_of.max() + 1 <= np.ceil(lengths.sum() / 2048) * 1.02
    assert np.bincount(bin_of, lengths).max() <= 2048


def test_packing_search_empties_bins():
    bins = packing.Bins(np.array([1000, 1000, 1048, 1048, 500, 500]), 2048)
    bins.items, bins.fill = [[0, 1], [2], [3], [4], [5]], [2000, 1048, 1048, 500, 500]
    before = sum(f * f for f in bins.fill)
    bins.improve()
    assert sum(f * f for f in bins.fill) > before and sum(1 for x in bins.items if x) == 3


def test_packing_search_tries_all_pairs_of_a_bin():
    bins = packing.Bins(np.array([500, *range(21, 30), 400, 880, 1148]), 2048)
    bins.items, bins.fill = [list(range(11)), [11, 12]], [1125, 2028]
    bins.improve()  # 500 and 400, ten places apart, for 880
    assert max(bins.fill) == 2048
    sizes = np.random.default_rng(4).integers(1, 60, 40)
    bins = packing.Bins(sizes, 2048)
    bins.items = [list(range(40))]
    ones, twos = bins.choices(0)
    assert set(ones) == set(sizes.tolist())
    assert set(twos) == {int(a + b) for i, a in enumerate(sizes) for b in sizes[i + 1:]}


def fewest_bins(lengths, capacity):
    """By trying every partition, the fullest first."""
    best = [len(lengths)]

    def place(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= rest[0] and rooms[i] not in rooms[:i]:
                place(rest[1:], rooms[:i] + [rooms[i] - rest[0]] + rooms[i + 1:])
        place(rest[1:], rooms + [capacity - rest[0]])

    place(sorted(map(int, lengths), reverse=True), [])
    return best[0]


def test_packing_of_small_inputs_against_every_partition():
    rng = np.random.default_rng(6)
    found, fitted, fewest = [], [], []
    for _ in range(400):
        lengths = rng.integers(10, 60, 10)
        bins = packing.Bins(lengths, 100)
        bins.best_fit()
        fitted.append(len(bins.items))
        bin_of, offset = packing.pack_lengths(lengths, 100)
        found.append(bin_of.max() + 1)
        assert np.bincount(bin_of, lengths).max() <= 100
        fewest.append(fewest_bins(lengths, 100))
    found, fitted, fewest = map(np.array, (found, fitted, fewest))
    assert (found <= fitted).all() and (found >= fewest).all()
    assert (found < fitted).sum() >= 20 and (found - fewest).sum() <= 4  # best fit: 26


# suffix arrays

def brute_spans(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ws, covered = words(t), set()
        for s in range(len(ws) - suffix_dedup.LENGTH + 1):
            window = tuple(ws[s:s + suffix_dedup.LENGTH])
            if window in seen:
                covered.update(range(s, s + suffix_dedup.LENGTH))
            seen.add(window)
        start = None
        for p in [*sorted(covered), None]:
            if start is not None and (p is None or p != last + 1):
                out.append((i, start, last + 1))
                start = None
            if p is not None and start is None:
                start = p
            last = p
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_suffix_dedup_equals_brute_force(session):
    rng = np.random.default_rng(5)
    phrase = [[f'v{x}' for x in rng.integers(0, 50, n)] for n in (49, 50, 51, 70, 120, 300)]
    rows = []
    for i in range(60):
        parts = [[f'u{x}' for x in rng.integers(0, 10_000, rng.integers(0, 40))]]
        for _ in range(rng.integers(0, 4)):
            p = phrase[rng.integers(0, len(phrase))]
            cut = rng.integers(0, 30)
            parts += [p[cut:], [f'u{x}' for x in rng.integers(0, 10_000, rng.integers(0, 5))]]
        rows.append((i, ' '.join(w for p in parts for w in p)))
    rows += [(100 + i, rows[7][1]) for i in range(3)] + [(200, 'go ' * 130), (201, 'go ' * 60), (202, 'x y ' * 90), (203, None), (204, '')]
    got = rows_of(suffix_dedup.repeated_spans(session.createDataFrame(rows, 'doc_id long, text string').repartition(7)), 'id', 'start', 'stop')
    assert got == brute_spans(rows)


def test_suffix_dedup_awkward_rows(docs):
    done = suffix_dedup.dedup_passages(docs)
    assert done.columns == docs.columns and done.count() == len(DOCS)
    got = {r.doc_id: r.text for r in done.collect()}
    assert got[11] == 'other tail' and got[10].endswith(PASSAGE + ' end here') and got[6] == LONG and got[2] is None
    assert [r.text for r in done.where('doc_id = 7').collect()] == [DOCS[7][1]] * 2
    assert suffix_dedup.dedup_passages(docs.limit(0)).count() == 0


# nearest neighbours

def test_ann_recall_ties_and_unusable_vectors(session):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).round(3)
    x[100:600] = x[0]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 24), (2200, [float('nan')] * 24), (2300, [None] + [1.0] * 23), (2400, [1.0, 2.0]), (None, [1.0] * 24),
             (2500, [float('inf')] * 24)]
    got = {}
    for r in ann.search(session.createDataFrame(rows, 'vec_id long, embedding array<double>'),
                        block_rows=200, block_queries=3).collect():
        got.setdefault(r.query_id, []).append((r['rank'], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        found = [f[1:] for f in sorted(found)]
        assert all(abs(s - d[v]) < 1e-9 for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
        hits += len(set(best) & {v for v, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in sorted(got[0])] == list(range(100, 110))  # ties to the smaller id


def test_ann_small_and_empty_tables(session):
    few = session.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0])], 'vec_id long, embedding array<double>')
    assert rows_of(ann.search(few), 'query_id', 'rank', 'vec_id') == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(few.limit(0)).count() == 0


def test_ann_repeated_ids_lengths_and_column_names(session):
    rows = [(0, [1.0, 0.0], 1, 1, 1), (0, [5.0, 5.0], 1, 1, 1), (1, [0.0, 1.0], 1, 1, 1), (2, [3.0, 3.0], 1, 1, 1), (2, [3.0, 3.0], 1, 1, 1),
            (100, [1.0, 2.0, 2.0], 1, 1, 1), (7, [1.0, 2.0, 0.0], 1, 1, 1)]
    frame = session.createDataFrame(rows, 'vec_id long, `e.mbedding` array<double>, v int, row int, VEC_ID2 int')
    got = ann.search(frame, vector_col='e.mbedding')
    want = []
    for i, (q, x, *_) in enumerate(rows):
        near = sorted((float(np.linalg.norm(np.subtract(x, y))), v) for j, (v, y, *_) in enumerate(rows) if i != j and len(x) == len(y))
        want += [(q, n + 1, v, d) for n, (d, v) in enumerate(near)] if q % 100 == 0 else []
    got, want = rows_of(got, 'query_id', 'rank', 'vec_id', 'score'), sorted(want)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_ann_widens_the_search_of_queries_with_few_candidates(session):
    rng = np.random.default_rng(5)
    crowd, far = rng.normal(size=(400, 4)), 100 + rng.normal(size=(3, 4))
    frame = session.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(crowd)] + [(100 * (i + 10), v.tolist()) for i, v in enumerate(far)],
                                    'vec_id long, embedding array<double>')
    index = ann.Index(np.eye(4), np.stack([crowd.mean(axis=0), far.mean(axis=0)]), 1, 1.0)
    counts = dict(tuple(r) for r in ann.search(frame, index=index).groupBy('query_id').count().collect())
    assert counts == dict.fromkeys([100, 200, 300, 400, 1000, 1100, 1200], 10)


# toxicity

def test_toxicity_held_out(session):
    scored = queries.op8_toxicity(session, '/root/testdata/sf0.1')
    labels = session.read.parquet('/root/testdata/sf0.1/labels.parquet').select('doc_id', 'toxic')
    held = scored.where('held_out').join(labels, 'doc_id').toPandas()
    assert (held.predicted == held.toxic).mean() > 0.92 and held.score.between(0, 1).all()


def test_toxicity_misspellings_and_awkward_rows(session, docs):
    rng = np.random.default_rng(0)
    clean = [' '.join(f'word{x}' for x in rng.integers(0, 300, 30)) for _ in range(200)]
    rows = [(i, t + (' horrible monster' if i % 2 else ''), i % 2) for i, t in enumerate(clean)]
    data = session.createDataFrame(rows, 'doc_id long, text string, toxic int')
    model = toxicity.fit(data.drop('toxic'), data.drop('text').withColumn('text', F.lit('clash')))
    spelt = session.createDataFrame([(0, clean[0]), (1, clean[0] + ' horribble monsterr')], 'doc_id long, text string')
    found = dict(spelt.select('doc_id', toxicity.score(spelt, model)).collect())
    assert found[1] > 0.5 > found[0]
    odd = docs.select('doc_id', toxicity.score(docs, model).alias('s')).collect()
    assert len(odd) == len(DOCS) and all(0 <= r.s <= 1 for r in odd)
    empty = toxicity.fit(docs.limit(0), data)
    assert all(r[0] == 0.5 for r in docs.where('text is null').select(toxicity.score(docs, empty)).collect())


# language identification

def test_language_held_out(session):
    found = queries.op9_language_id(session, ORACLE)
    truth = session.read.parquet(f'{ORACLE}/documents.parquet').select('doc_id', 'lang')
    held = found.where('held_out').join(truth, 'doc_id').toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.95 and held.score.between(0, 1).all()


def test_language_awkward_rows(session, docs):
    known = session.read.parquet(f'{SMALL}/documents.parquet')
    model = langid.fit(known)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == 'und' and got[2].score == 0
    assert len(langid.predict(docs, model, reject=False).where("lang_pred = 'und'").collect()) == sum(not langid.has_letter(t) for _, t in DOCS)
    assert langid.predict(docs, langid.fit(known.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(docs.limit(0), model).count() == 0


# SimHash

def brute_classes(rows, shingle=4, distance=4):
    fps = []
    for _, t in rows:
        ws = words(re.sub('[A-Z]', lambda m: m[0].lower(), t or ''))
        hs = [xxhash.xxh64_intdigest(' '.join(ws[i:i + shingle]).encode(), 42) for i in range(max(1, len(ws) - shingle + 1))] if ws else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= distance:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((i, f'{fp:016x}', least.get(r)) for (i, _), fp, r in zip(rows, fps, root)), key=lambda r: tuple((x is not None, x) for x in r))


def test_simhash_equals_brute_force(session, docs):
    table = session.read.parquet(f'{SMALL}/documents.parquet').select('doc_id', 'text')
    rows = [tuple(r) for r in table.collect()]
    assert rows_of(simhash.near_duplicates(table), 'doc_id', 'fingerprint', 'component_id') == brute_classes(rows)
    few = [r for r in DOCS if r[0] != 6]
    got = simhash.near_duplicates(docs.where('doc_id is null or doc_id <> 6'), block=1)
    assert rows_of(got, 'doc_id', 'fingerprint', 'component_id') == brute_classes(few)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chains_equal_the_plain_distance():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(6):
        y ^= np.where(rng.random(len(x)) < 0.8, np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64), np.uint64(0))
    for distance in (0, 1, 3, 4, 7):
        want = np.bitwise_count(x ^ y) <= distance
        assert (simhash.within_chain(x, y, distance) == want).all()
        assert (simhash.within_chain(y, x[0], distance) == (np.bitwise_count(y ^ x[0]) <= distance)).all()


def test_simhash_links_lose_nothing(session):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    for _ in range(6):  # chains of fingerprints a few bits apart, many under equal keys
        flips = np.zeros(len(fps), np.uint64)
        for _ in range(4):
            flips ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
        fps = np.unique(np.concatenate((fps, fps ^ flips)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    frame = session.createDataFrame([(int(np.int64(f.view(np.int64))),) for f in fps], 'fp long')
    for block in (5, 16384):
        found = dict(simhash.connected_components(simhash.links(frame, 4, block)).collect())
        root = np.array([found.get(int(f.view(np.int64)), int(f.view(np.int64))) for f in fps])
        _, a = np.unique(root, return_inverse=True)
        pairs = {(x, y) for x, y in zip(a, label)}
        assert len(pairs) == len(set(a)) == len(set(label))


# column names

def test_any_column_names(session):
    """Dotted ids, names that differ in case only, and the names that operators use inside."""
    names = ['doc.id', 'text', 'TEXT', '__id', '__own', '__places', '__spans', '__cut', '__drop', 'id', 'own', 'places', 'spans', 'cut', 'c0', 'c1']
    rows = [(i, t, 'upper', *range(13)) for i, t in DOCS if i != 6]
    frame = session.createDataFrame(rows, 'a long, b string, c string, ' + ', '.join(f'x{i} int' for i in range(13))).toDF(*names)
    plain = session.createDataFrame([r[:2] for r in rows], 'doc_id long, text string')
    for change in (line_dedup.dedup_lines, suffix_dedup.dedup_passages, simhash.keep_first):
        got, want = change(frame, id_col='doc.id'), change(plain)
        assert got.columns[:len(names)] == names
        got = got.toDF(*[f'n{i}' for i in range(len(got.columns))])
        assert rows_of(got, 'n0', 'n1') == rows_of(want, 'doc_id', 'text')
        assert {tuple(r)[2:len(names)] for r in got.collect()} == {('upper', *range(13))}
    pieces = ['piece', 'length', 'ids_crc32']
    assert rows_of(packing.cut_pieces(frame, WORDS_FILE, id_col='doc.id'), *pieces) == rows_of(packing.cut_pieces(plain, WORDS_FILE), *pieces)
    ids = bpe.encode_digests(frame, RANKS, public_tokenizers.PATTERN, id_col='doc.id')
    assert rows_of(ids, 'ids_sha256') == rows_of(bpe.encode_digests(plain, RANKS, public_tokenizers.PATTERN), 'ids_sha256')
