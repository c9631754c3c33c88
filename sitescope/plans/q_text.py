"""Free-text queries.

Bindings: positive feedback and sentiment read ``documents.text``; improvement
suggestions read ``conversations.text``; news reads ``documents`` (see
``bindings.news``). Whole texts are processed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.functions import lexicons as lx
from sitescope.functions import text as T
from sitescope.operators import textagg as X
from sitescope.plans import bindings as B
from sitescope.plans.registry import register

CLEAN = r"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_.!?]+', ' ', 'g'))"


def clean(x: str) -> str:
    return CLEAN.format(x=x)


def words(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({c}, ' ') END)"


def in_list(values) -> str:
    return '(' + ', '.join("'" + v.replace("'", "''") + "'" for v in values) + ')'


DOCS = f"d AS (SELECT doc_id AS ord, {clean('text')} AS c FROM documents WHERE text IS NOT NULL)"
CONVS = (f"d AS (SELECT conv_id * 100000 + turn AS ord, text AS raw, {clean('text')} AS c FROM conversations "
         f"WHERE text IS NOT NULL)")
NOT_SUBST = r"coalesce(regexp_matches(lower(raw), '^(nothing|no|none|n/?a)\n?\z'), false)"


def keyword_sql(src: str, top_k: int, where: str = 'true', stop=lx.STOPWORDS) -> str:
    return f"""
WITH {src},
w AS (SELECT ord, unnest({words('c')}) AS word, generate_subscripts({words('c')}, 1) AS pos FROM d WHERE {where}),
cnt AS (SELECT word, count(*) AS count, min({{'o': ord, 'p': pos}}) AS first FROM w
        WHERE length(word) >= 2 AND word NOT IN {in_list(stop)} GROUP BY word)
SELECT word, count FROM cnt ORDER BY count DESC, first LIMIT {top_k}"""


def themes_sql(src: str, themes, where: str = 'true', label: str = 'theme') -> str:
    parts = []
    for theme, kws in themes.items():
        cond = ' OR '.join(f"contains(c, '{k}')" for k in kws)
        parts.append(f"SELECT '{theme}' AS {label}, count(*) FILTER (WHERE {cond}) AS count FROM d WHERE {where}")
    return f"WITH {src}, t AS ({' UNION ALL '.join(parts)}) SELECT {label}, count FROM t WHERE count > 0"


def sentiment_rows_sql(src: str, pos, neg) -> str:
    return f"""
{src},
t AS (SELECT ord, list_distinct(list_filter({words('c')}, lambda x: length(x) >= 2)) AS tk FROM d),
pn AS (SELECT ord, len(list_filter(tk, lambda x: x IN {in_list(pos)})) AS p,
              len(list_filter(tk, lambda x: x IN {in_list(neg)})) AS n FROM t),
s AS (SELECT ord, CASE WHEN p + n > 0 THEN CAST(p - n AS DOUBLE) / (p + n) ELSE 0.0 END AS sentiment_score FROM pn)"""


def sentiment_summary_sql(pos, neg) -> str:
    return f"""
WITH {sentiment_rows_sql(DOCS, pos, neg)}
SELECT coalesce(avg(sentiment_score), 0.0) AS mean_sentiment, coalesce(median(sentiment_score), 0.0) AS median_sentiment,
       coalesce(stddev_pop(sentiment_score), 0.0) AS std_sentiment,
       count(*) FILTER (WHERE sentiment_score > 0.2) AS positive,
       count(*) FILTER (WHERE sentiment_score BETWEEN -0.2 AND 0.2) AS neutral,
       count(*) FILTER (WHERE sentiment_score < -0.2) AS negative FROM s"""


def docs(spark, d):
    return B.documents(spark, d)


def convs(spark, d):
    c = B.table(spark, d, 'conversations')
    return c.withColumn('ord', F.col('conv_id') * 100000 + F.col('turn'))


@register('C13_clean_text', f"WITH {DOCS} SELECT ord AS doc_id, c AS clean_text, length(c) AS n_chars_clean FROM d")
def clean_text(spark, d):
    """C13 on every document (whole text)."""
    c = T.clean_text('text')
    return docs(spark, d).filter(F.col('text').isNotNull()).select(
        'doc_id', c.alias('clean_text'), F.length(c).alias('n_chars_clean'))


@register('C14_token_stats', f"""
WITH {DOCS},
t AS (SELECT ord, list_filter({words('c')}, lambda x: length(x) >= 2 AND x NOT IN {in_list(lx.STOPWORDS)}) AS tk,
             list_filter({words('c')}, lambda x: length(x) >= 2) AS ta FROM d)
SELECT ord AS doc_id, len(tk) AS n_tokens, len(ta) AS n_tokens_with_stopwords,
       coalesce(tk[1], '') AS first_token, coalesce(tk[-1], '') AS last_token FROM t""")
def token_stats(spark, d):
    """C14 per document: token counts with and without stopwords, first/last token."""
    c = T.clean_text('text')
    tk = T.tokenize(c)
    ta = T.tokenize(c, stopwords=None)
    return docs(spark, d).filter(F.col('text').isNotNull()).select(
        'doc_id', F.size(tk).alias('n_tokens'), F.size(ta).alias('n_tokens_with_stopwords'),
        F.coalesce(F.get(tk, 0), F.lit('')).alias('first_token'),
        F.coalesce(F.element_at(F.when(F.size(tk) > 0, tk), -1), F.lit('')).alias('last_token'))


@register('A18_keywords', keyword_sql(DOCS, 25))
def keywords(spark, d):
    """Top-25 keywords of the positive-feedback text."""
    return X.keyword_counts(docs(spark, d), 'text', 'doc_id', 25)


@register('A18_word_cloud', keyword_sql(DOCS, 100).replace('SELECT word, count FROM cnt',
                                                          'SELECT word, count AS frequency FROM cnt'))
def word_cloud(spark, d):
    """Word-cloud data (top 100 words with frequency)."""
    return X.keyword_counts(docs(spark, d), 'text', 'doc_id', 100).withColumnRenamed('count', 'frequency')



@register('A19_bigrams', f"""
WITH {DOCS},
t AS (SELECT ord, list_filter({words('c')}, lambda x: length(x) >= 2) AS tk FROM d),
b AS (SELECT ord, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]) AS g FROM t WHERE len(tk) >= 2),
w AS (SELECT ord, unnest(g) AS ngram, generate_subscripts(g, 1) AS pos FROM b),
cnt AS (SELECT ngram, count(*) AS count, min({{'o': ord, 'p': pos}}) AS first FROM w GROUP BY ngram)
SELECT ngram, count FROM cnt ORDER BY count DESC, first LIMIT 15""")
def bigrams(spark, d):
    """Top-15 bigrams (stopwords kept, one-letter words skipped)."""
    return X.ngram_counts(docs(spark, d), 'text', 'doc_id', 2, 15)


@register('A20_positive_themes', themes_sql(DOCS, lx.POSITIVE_THEMES))
def positive_themes(spark, d):
    """A20 with the application's theme lexicon."""
    return X.theme_counts(docs(spark, d), 'text', lx.POSITIVE_THEMES)


@register('A20_doc_themes', themes_sql(DOCS, B.DOC_THEMES))
def doc_themes(spark, d):
    """A20 with a lexicon of substrings that occur in the invented prose."""
    return X.theme_counts(docs(spark, d), 'text', B.DOC_THEMES)


@register('A22_suggestion_summary', f"""
WITH {CONVS}
SELECT count(*) AS total_responses,
       count(*) FILTER (WHERE coalesce(regexp_matches(lower(raw), 'nothing|no|none|n/a'), false)) AS nothing_responses,
       count(*) FILTER (WHERE NOT {NOT_SUBST}) AS substantive_responses FROM d""")
def suggestion_summary(spark, d):
    """A22 counts over the suggestion text."""
    return X.suggestion_summary(convs(spark, d), 'text')


@register('A22_suggestion_keywords', keyword_sql(CONVS, 20, where=f'NOT {NOT_SUBST}'))
def suggestion_keywords(spark, d):
    """Top-20 keywords over substantive suggestions."""
    return X.keyword_counts(X.substantive(convs(spark, d), 'text'), 'text', 'ord', 20)


@register('A21_improvement_themes', themes_sql(CONVS, lx.IMPROVEMENT_THEMES, where=f'NOT {NOT_SUBST}'))
def improvement_themes(spark, d):
    """Improvement themes over substantive suggestions."""
    return X.theme_counts(X.substantive(convs(spark, d), 'text'), 'text', lx.IMPROVEMENT_THEMES)


@register('A24_sentiment_summary', sentiment_summary_sql(lx.POSITIVE_WORDS, lx.NEGATIVE_WORDS))
def sentiment_summary(spark, d):
    """A24 with the application's sentiment lexicon."""
    return X.sentiment_summary(docs(spark, d), 'text', 'doc_id')


@register('A24_doc_sentiment_summary', sentiment_summary_sql(B.DOC_POSITIVE, B.DOC_NEGATIVE))
def doc_sentiment_summary(spark, d):
    """A24 with a lexicon of words that occur in the invented prose."""
    return X.sentiment_summary(docs(spark, d), 'text', 'doc_id', B.DOC_POSITIVE, B.DOC_NEGATIVE)


@register('C17_sentiment_rows', f"""
WITH {sentiment_rows_sql(DOCS, B.DOC_POSITIVE, B.DOC_NEGATIVE)}
SELECT ord AS doc_id, sentiment_score,
       CASE WHEN sentiment_score > 0.2 THEN 'positive' WHEN sentiment_score < -0.2 THEN 'negative'
            ELSE 'neutral' END AS sentiment_class FROM s""")
def sentiment_rows(spark, d):
    """C17 + C18 per document."""
    return X.sentiment_rows(docs(spark, d), 'text', 'doc_id', B.DOC_POSITIVE, B.DOC_NEGATIVE)


def _news_clean() -> str:
    return clean("concat_ws(' ', title, content)")


NEWS = (f"n AS (SELECT doc_id, CAST(DATE '2023-01-01' + CAST((doc_id * 37) % 730 AS INTEGER) AS TIMESTAMP) AS date, "
        f"source AS title, text AS content FROM documents), "
        f"d AS (SELECT doc_id AS ord, date, {_news_clean()} AS c FROM n)")


def _topic_labels_sql() -> str:
    items = []
    for topic, kws in lx.SAFETY_TOPICS.items():
        cond = ' OR '.join(f"contains(c, '{k}')" for k in kws)
        items.append(f"CASE WHEN {cond} THEN '{topic}' END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


@register('L19_article_topics', f"""
WITH {NEWS}, t AS (SELECT ord, {_topic_labels_sql()} AS tl FROM d)
SELECT ord AS doc_id, array_to_string(tl, ',') AS topics, len(tl) AS n_topics FROM t""")
def article_topics(spark, d):
    """Safety-topic labels per article."""
    return X.article_topics(B.news(spark, d))


TOPIC_FREQ = themes_sql(NEWS, lx.SAFETY_TOPICS, label='topic')


@register('A25_topic_frequency', TOPIC_FREQ)
def topic_frequency(spark, d):
    """Articles per safety topic."""
    return X.topic_frequency(B.news(spark, d))


@register('A26_articles_per_month', f"""
WITH {NEWS} SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS articles FROM n
WHERE date IS NOT NULL GROUP BY 1""")
def articles_per_month(spark, d):
    """Articles per month."""
    return X.articles_per_month(B.news(spark, d))


_MSG = ' UNION ALL '.join(f"SELECT '{k}' AS topic, '{v}' AS recommendation" for k, v in lx.NEWS_TOPIC_MESSAGES.items())


@register('L17_news_recommendations', f"""
WITH tf AS ({TOPIC_FREQ}), top AS (SELECT * FROM tf ORDER BY count DESC, topic LIMIT 5), m AS ({_MSG})
SELECT top.topic, top.count, m.recommendation FROM top JOIN m ON top.topic = m.topic""")
def news_recommendations(spark, d):
    """Recommendations for the top-5 news topics."""
    return X.news_recommendations(X.topic_frequency(B.news(spark, d)))


AS_OF = '2024-12-31'


@register('L18_emerging_topics', f"""
WITH {NEWS}, t AS (SELECT date >= CAST(DATE '{AS_OF}' - INTERVAL 6 MONTH AS TIMESTAMP) AS recent, c FROM d
                   WHERE date IS NOT NULL),
tot AS (SELECT count(*) FILTER (WHERE recent) AS nr, count(*) FILTER (WHERE NOT recent) AS ne FROM t),
x AS ({' UNION ALL '.join(
    f"SELECT '{tp}' AS topic, count(*) FILTER (WHERE recent AND ({' OR '.join(f'contains(c, {chr(39)}{k}{chr(39)})' for k in kws)})) AS recent_articles, "
    f"count(*) FILTER (WHERE NOT recent AND ({' OR '.join(f'contains(c, {chr(39)}{k}{chr(39)})' for k in kws)})) AS earlier_articles FROM t"
    for tp, kws in lx.SAFETY_TOPICS.items())})
SELECT topic, recent_articles, earlier_articles,
       CASE WHEN nr > 0 THEN recent_articles * 100.0 / nr END AS recent_pct,
       CASE WHEN ne > 0 THEN earlier_articles * 100.0 / ne END AS earlier_pct
FROM x CROSS JOIN tot WHERE recent_articles + earlier_articles > 0""")
def emerging_topics(spark, d):
    """Topic share in the last 6 months before the as-of date vs earlier."""
    return X.emerging_topics(B.news(spark, d), AS_OF)
