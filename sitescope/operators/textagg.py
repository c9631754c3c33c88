"""Free-text aggregations.

Tokens are exploded and counted with a partial (map-side) aggregate, so a
document of 20,000 words or a corpus-wide hot word never gathers in one task;
stopwords are removed *after* the partial count by an anti join against a
fixed, size-bounded stopword table. Ties in top-k lists break on first
occurrence (row order, then position), carried as a ``min`` in the same
aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.functions import lexicons as lx
from sitescope.functions import text as T
from sitescope.session import spread


def _words_table(spark, words: Sequence[str], col: str = 'word') -> DataFrame:
    return spark.createDataFrame([(w,) for w in dict.fromkeys(words)], f'{col} string')


def _cleaned(df: DataFrame, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Cleaned text materialised once as ``_c`` (later expressions reference the
    column, so it is not recomputed inside every conditional branch)."""
    return spread(df.filter(F.col(text_col).isNotNull())).select(*keep, T.clean_text(text_col).alias('_c'))


def _exploded_tokens(df: DataFrame, text_col: str, order_col: str, min_length: int) -> DataFrame:
    """(_ord, _pos, word) for every whitespace token of the cleaned text with length >= min."""
    cleaned = spread(df.filter(F.col(text_col).isNotNull())).select(
        F.col(order_col).alias('_ord'), T.words(T.clean_text(text_col)).alias('_w'))
    # *_outer generators: a plain explode makes Catalyst infer a size(...) > 0
    # filter and push a second copy of the text expression down to the scan
    return (cleaned.select('_ord', F.posexplode_outer('_w').alias('_pos', 'word'))
                   .filter(F.length('word') >= min_length))


def _exploded_ngrams(df: DataFrame, text_col: str, order_col: str, n: int, min_length: int) -> DataFrame:
    keys = spread(df.filter(F.col(text_col).isNotNull())).select(
        F.col(order_col).alias('_ord'), T.ngram_keys(T.clean_text(text_col), n, min_length).alias('_g'))
    return (keys.select('_ord', F.posexplode_outer('_g').alias('_pos', 'ngram'))
                .filter(F.col('ngram').isNotNull()))


def _top_by_count(df: DataFrame, order_col: str, explode, key: str, top_k: int | None, stopwords=None) -> DataFrame:
    """Items by count, ties by first occurrence (row order, then position), for any order key.

    One aggregate has the count and the first row of every item. Positions only
    decide among items that share both, so they are looked up afterwards, in
    the rows where an item that can still reach the top k is first seen: at
    most k items and those of one more row.
    """
    counts = explode(df).groupBy(key).agg(F.count(F.lit(1)).alias('count'), F.min('_ord').alias('_first'))
    if stopwords:
        stop = _words_table(df.sparkSession, stopwords, key)
        counts = counts.join(F.broadcast(stop), key, 'left_anti')
    by = [F.col('count').desc(), F.col('_first').asc_nulls_last()]
    rank = F.struct(-F.col('count'), F.col('_first').isNull(), F.col('_first'))
    if top_k:
        last = counts.orderBy(*by).limit(top_k).agg(F.max(rank).alias('_last'))
        counts = F.broadcast(counts.crossJoin(F.broadcast(last)).filter(rank <= F.col('_last')).drop('_last'))
    rows = counts.select(F.col('_first').alias('_row')).distinct()
    rows = F.broadcast(rows) if top_k else rows
    own = df.join(rows, df[order_col].eqNullSafe(rows['_row']), 'left_semi')
    places = explode(own).groupBy(F.col(key).alias('_key'), F.col('_ord').alias('_row')).agg(F.min('_pos').alias('_place'))
    out = counts.join(places, counts[key].eqNullSafe(places['_key']) & counts['_first'].eqNullSafe(places['_row']))
    out = out.orderBy(*by, '_place')
    if top_k:
        out = out.limit(top_k)
    return out.select(key, 'count')


def keyword_counts(df: DataFrame, text_col: str, order_col: str, top_k: int | None = 25,
                   min_length: int = 2, stopwords: Sequence[str] | None = lx.STOPWORDS) -> DataFrame:
    """Keyword frequency (stopwords out), top k; ties by first occurrence."""
    return _top_by_count(df, order_col, lambda d: _exploded_tokens(d, text_col, order_col, min_length), 'word', top_k, stopwords)


def ngram_counts(df: DataFrame, text_col: str, order_col: str, n: int = 2, top_k: int | None = 15,
                 min_length: int = 2) -> DataFrame:
    """N-gram frequency over tokens that keep stopwords; ties by first occurrence."""
    return _top_by_count(df, order_col, lambda d: _exploded_ngrams(d, text_col, order_col, n, min_length), 'ngram', top_k)


def theme_counts(df: DataFrame, text_col: str, themes: Mapping[str, Sequence[str]],
                 label: str = 'theme') -> DataFrame:
    """Responses per theme (multi-label); themes with 0 are omitted."""
    labels = (_cleaned(df, text_col).select(F.explode_outer(T.theme_labels('_c', themes)).alias(label))
                                    .filter(F.col(label).isNotNull()))
    return (labels.groupBy(label).agg(F.count(F.lit(1)).alias('count'))
                  .orderBy(F.col('count').desc(), F.col(label)))


def suggestion_summary(df: DataFrame, text_col: str) -> DataFrame:
    """Total responses, 'nothing' responses (P10), substantive responses."""
    r = df.filter(F.col(text_col).isNotNull())
    return r.agg(F.count(F.lit(1)).alias('total_responses'),
                 F.count_if(T.says_nothing(text_col)).alias('nothing_responses'),
                 F.count_if(T.is_substantive(text_col)).alias('substantive_responses'))


def substantive(df: DataFrame, text_col: str) -> DataFrame:
    """Responses kept for the improvement keywords and themes."""
    return df.filter(F.col(text_col).isNotNull() & T.is_substantive(text_col))


def sentiment_rows(df: DataFrame, text_col: str, id_col: str,
                   positive: Sequence[str] = lx.POSITIVE_WORDS,
                   negative: Sequence[str] = lx.NEGATIVE_WORDS) -> DataFrame:
    """C17 + C18 per response."""
    s = T.sentiment_score('_c', positive, negative)
    return (_cleaned(df, text_col, [id_col])
              .select(id_col, s.alias('sentiment_score'))
              .withColumn('sentiment_class', T.sentiment_class('sentiment_score')))


def sentiment_summary(df: DataFrame, text_col: str, id_col: str,
                      positive: Sequence[str] = lx.POSITIVE_WORDS,
                      negative: Sequence[str] = lx.NEGATIVE_WORDS) -> DataFrame:
    """Mean, exact median, population std and class counts (0 when empty).

    The score takes few distinct values (a ratio of two small counts), so the
    exact median is a weighted percentile over the per-value histogram: exact,
    and no group ever holds the raw values.
    """
    rows = sentiment_rows(df, text_col, id_col, positive, negative)
    band = lx.SENTIMENT_BAND
    # one pass over the texts: every statistic is derived from the small histogram
    hist = rows.groupBy('sentiment_score').agg(F.count(F.lit(1)).alias('_n'))
    s, w = F.col('sentiment_score'), F.col('_n')
    n = F.sum(w)
    mean = F.sum(s * w) / n
    var = F.greatest(F.lit(0.0), F.sum(s * s * w) / n - mean * mean)
    return hist.agg(
        F.coalesce(mean, F.lit(0.0)).alias('mean_sentiment'),
        F.coalesce(F.percentile(s, F.lit(0.5), w), F.lit(0.0)).alias('median_sentiment'),
        F.coalesce(F.sqrt(var), F.lit(0.0)).alias('std_sentiment'),
        F.coalesce(F.sum(F.when(s > band, w)), F.lit(0)).alias('positive'),
        F.coalesce(F.sum(F.when((s >= -band) & (s <= band), w)), F.lit(0)).alias('neutral'),
        F.coalesce(F.sum(F.when(s < -band, w)), F.lit(0)).alias('negative'))


def article_topics(news: DataFrame, id_col: str = 'doc_id', title: str = 'title', content: str = 'content',
                   topics: Mapping[str, Sequence[str]] = lx.SAFETY_TOPICS) -> DataFrame:
    """Topic labels per article (title + ' ' + content), joined with ','."""
    c = spread(news).select(id_col, T.clean_text(T.article_text(title, content)).alias('_c'))
    labels = c.select(id_col, T.theme_labels('_c', topics).alias('_l'))
    return labels.select(id_col, F.array_join('_l', ',').alias('topics'), F.size('_l').alias('n_topics'))


def topic_frequency(news: DataFrame, title: str = 'title', content: str = 'content',
                    topics: Mapping[str, Sequence[str]] = lx.SAFETY_TOPICS) -> DataFrame:
    """Articles per topic, descending."""
    c = spread(news).select(T.clean_text(T.article_text(title, content)).alias('_c'))
    lab = c.select(F.explode_outer(T.theme_labels('_c', topics)).alias('topic')).filter(F.col('topic').isNotNull())
    return lab.groupBy('topic').agg(F.count(F.lit(1)).alias('count')).orderBy(F.col('count').desc(), 'topic')


def articles_per_month(news: DataFrame, date_col: str = 'date') -> DataFrame:
    """Article count per month (unparsable dates dropped)."""
    m = F.trunc(F.col(date_col), 'month')
    return (news.filter(F.col(date_col).isNotNull()).groupBy(m.alias('month'))
                .agg(F.count(F.lit(1)).alias('articles')).orderBy('month'))


def news_recommendations(topic_freq: DataFrame, top_n: int = 5,
                         messages: Mapping[str, str] = lx.NEWS_TOPIC_MESSAGES) -> DataFrame:
    """Messages for the topics among the top n (fixed message table, broadcast)."""
    top = topic_freq.orderBy(F.col('count').desc(), 'topic').limit(top_n)
    msg = topic_freq.sparkSession.createDataFrame(list(messages.items()), 'topic string, recommendation string')
    return top.join(F.broadcast(msg), 'topic', 'inner').select('topic', 'count', 'recommendation')


def emerging_topics(news: DataFrame, as_of: str, lookback_months: int = 6, date_col: str = 'date',
                    title: str = 'title', content: str = 'content',
                    topics: Mapping[str, Sequence[str]] = lx.SAFETY_TOPICS) -> DataFrame:
    """L18 (+P13): topic share among recent articles (date >= as_of - n months) vs earlier.

    The application selects the recent slice and stops there; this finishes the
    comparison with an explicit ``as_of`` date so runs are deterministic.
    """
    cutoff = F.add_months(F.lit(as_of).cast('date'), -lookback_months)
    cleaned = spread(news.filter(F.col(date_col).isNotNull())).select(
        (F.col(date_col) >= cutoff.cast('timestamp_ntz')).alias('recent'),
        T.clean_text(T.article_text(title, content)).alias('_c'))
    # a null topic stands for all articles, so that totals and topics come from one pass
    all_and = F.concat(F.array(F.lit(None).cast('string')), F.coalesce(T.theme_labels('_c', topics), F.array().cast('array<string>')))
    counts = (cleaned.select('recent', F.explode_outer(all_and).alias('topic')).groupBy('topic')
                     .agg(F.count_if('recent').alias('recent_articles'),
                          F.count_if(~F.col('recent')).alias('earlier_articles')))
    # one row a topic: gathered next to the totals
    whole = counts.agg(F.max(F.when(F.col('topic').isNull(), F.col('recent_articles'))).alias('_nr'),
                       F.max(F.when(F.col('topic').isNull(), F.col('earlier_articles'))).alias('_ne'),
                       F.collect_list(F.struct(*counts.columns)).alias('_topics'))
    share = whole.select('_nr', '_ne', F.inline('_topics')).filter(F.col('topic').isNotNull())
    return share.select('topic', 'recent_articles', 'earlier_articles',
                        F.try_divide(F.col('recent_articles') * 100.0, F.col('_nr')).alias('recent_pct'),
                        F.try_divide(F.col('earlier_articles') * 100.0, F.col('_ne')).alias('earlier_pct'))
