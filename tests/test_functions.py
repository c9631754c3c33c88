"""Golden fixtures for the column functions."""

import pytest
from pyspark.sql import functions as F

from sitescope.functions import clean as C
from sitescope.functions import text as T
from sitescope.functions import geo as G
from sitescope.functions import fuzzy as Z


def col1(spark, values, expr, typ='string'):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f'i int, v {typ}')
    return [r[0] for r in df.orderBy('i').select(expr(F.col('v'))).collect()]


def test_clean_age(spark):
    got = col1(spark, ['11 - 13 yrs', '14-16', '16+', '10 or under', 'Other', None], C.clean_age)
    assert got == ['11-13', '14-16', '16+', '10 or under', 'Other', None]


def test_clean_gender(spark):
    got = col1(spark, ['Male', 'female', 'Prefer not to say', 'other', 'non-binary', None], C.clean_gender)
    assert got == ['Male', 'Female', 'Prefer not to say', 'Other', 'Non-binary', None]


def test_clean_rating_and_score(spark):
    vals = ['Excellent!', 'Good', 'Fair', 'Very Poor', 'poor', None]
    assert col1(spark, vals, C.clean_rating) == ['Excellent', 'Good', 'Fair', 'Poor', None, None]
    assert col1(spark, vals, lambda c: C.rating_score(C.clean_rating(c))) == [5, 4, 3, 2, None, None]


def test_clean_binary(spark):
    got = col1(spark, ['Yes', "I don't know", 'NO', 'maybe', None], C.clean_binary)
    assert got == ['Yes', 'No', 'No', None, None]


def test_to_number(spark):
    got = col1(spark, [' 5 ', '5d', '5f', '0x1p3', '1,000', 'NaN', '', '1e3', '-.5'], C.to_number)
    assert got == [5.0, None, None, None, None, None, None, 1000.0, -0.5]


def test_to_timestamp_and_month(spark):
    got = col1(spark, ['2024-03-15 10:00:00', '15/03/2024', 'garbage', None],
               lambda c: C.month_bucket(C.to_timestamp_any(c)))
    assert [str(x) if x else None for x in got] == ['2024-03-01', '2024-03-01', None, None]


def test_strip_and_norm(spark):
    assert col1(spark, ['\t Oak School \n', None], C.norm_name) == ['oak school', None]
    assert col1(spark, [' AB1 2CD ', '  ', None], C.postcode_key) == ['AB12CD', None, None]


def test_half_even(spark):
    assert col1(spark, [0.125, 0.135], C.half_even, 'double') == [0.12, 0.14]


def test_cluster_colour(spark):
    assert col1(spark, [0, 11, None], C.cluster_colour, 'int') == ['red', 'blue', 'red']


def test_clean_text(spark):
    got = col1(spark, ["Héllo, WORLD!! it's  ok\tthere", None, 'the-end word.'], T.clean_text)
    assert got == ['héllo world!! it s ok there', '', 'the end word.']


def test_tokenize_and_ngrams(spark):
    c = lambda v: T.clean_text(v)
    assert col1(spark, ['The a cat. I know, the end x yy'], lambda v: T.tokenize(c(v)))[0] == ['cat.', 'end', 'yy']
    assert col1(spark, ['I was a big fan of it'], lambda v: T.ngram_keys(c(v)))[0] == \
        ['was big', 'big fan', 'fan of', 'of it']
    assert col1(spark, ['a'], lambda v: T.ngram_keys(c(v)))[0] == []


def test_sentiment(spark):
    vals = ['great and useful', 'boring boring', 'good but too long', 'nothing here', 'great great bad']
    got = col1(spark, vals, lambda v: T.sentiment_score(T.clean_text(v)))
    assert got == [1.0, -1.0, 0.0, 0.0, 0.0]
    cls = col1(spark, [0.2, 0.21, -0.2, -0.21], T.sentiment_class, 'double')
    assert cls == ['neutral', 'positive', 'neutral', 'negative']


def test_nothing_and_substantive(spark):
    vals = ['nothing', 'No', 'n/a', 'na', 'I know more', ' no ', 'no\n', 'no\n\n']
    assert col1(spark, vals, T.says_nothing) == [True, True, True, False, True, True, True, True]
    assert col1(spark, vals, T.is_substantive) == [False, False, False, False, True, True, False, True]


def test_themes(spark):
    themes = {'A': ['ai'], 'B': ['child abuse', 'zz']}
    got = col1(spark, ['He said so', 'child-abuse case', 'none'], lambda v: T.theme_labels(T.clean_text(v), themes))
    assert got == [['A'], ['B'], []]


def test_grid_conversion(spark):
    df = spark.createDataFrame([(400000.0, 0.0), (None, 5.0)], 'e double, n double')
    r = df.select(G.grid_to_lat('n').alias('lat'), G.grid_to_lon('e', 'n').alias('lon')).collect()
    assert r[0].lat == pytest.approx(49.0 + 100000 / 111000.0)
    assert r[0].lon == pytest.approx(-2.0)
    assert r[1].lon is None


def test_distances(spark):
    df = spark.createDataFrame([(51.5, -0.12, 48.85, 2.35)], 'a double, b double, c double, d double')
    r = df.select(G.great_circle_km('a', 'b', 'c', 'd').alias('g'), G.haversine_km('a', 'b', 'c', 'd').alias('h')).first()
    assert r.g == pytest.approx(343.5, abs=1.0)
    assert r.h == pytest.approx(r.g * 6371.0 / 6371.009, rel=1e-6)


def test_fuzzy_scorers():
    import random
    random.seed(3)
    for _ in range(300):
        a = ''.join(random.choice('abc ') for _ in range(random.randint(0, 12)))
        b = ''.join(random.choice('abc ') for _ in range(random.randint(0, 12)))
        # LCS by dynamic programming
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
        assert Z.lcs_length(a, b) == dp[-1][-1]
    assert Z.indel_ratio('', '') == 100.0


def test_token_sort_key(spark):
    assert col1(spark, ['  Oak  Hill\tSchool ', 'b a', None], Z.token_sort_key) == ['Hill Oak School', 'a b', None]


def test_dates_are_read_month_first(spark):
    from sitescope.functions.clean import to_timestamp_any
    texts = {'03/04/2024': '2024-03-04 00:00:00', '25/04/2024': '2024-04-25 00:00:00', '2024-03-04T10:11:12.500Z': '2024-03-04 10:11:12',
             '4 March 2024': '2024-03-04 00:00:00', '03/04/2024 10:30:00': '2024-03-04 10:30:00', '3/4/2024': '2024-03-04 00:00:00',
             '2024-03-04': '2024-03-04 00:00:00', 'soon': None, '': None}
    df = spark.createDataFrame([(t,) for t in texts], 't string')
    got = {r.t: r.d for r in df.select('t', to_timestamp_any('t').cast('string').alias('d')).collect()}
    assert got == texts
