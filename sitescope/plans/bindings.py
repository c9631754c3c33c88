"""Bindings: the driver's generic tables playing the application's roles.

Every role is a lazy DataFrame derived from the given parquet tables, so the
work of every query grows with them. Mappings:

registry        customer + nation  (urn = c_custkey, name = c_name, trust = n_name,
                FSM% = c_acctbal / 100, grid easting/northing derived from c_custkey)
visits          orders that are urgent and fulfilled (o_orderpriority = '1-URGENT'
                and o_orderstatus = 'F'): one delivered visit per such order
visited sites   visits per customer name, coordinates looked up by name (J1)
bookings        all orders: site = customer, date = o_orderdate,
                answer (how heard) = o_orderpriority, contact = o_clerk-like status
survey          orders + customer rendered as raw survey answers
sessions        orders as session facts (month, type = priority, source = status)
free text       documents.text, conversations.text
news            documents (title = source, content = text, date from doc_id)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.functions.clean import norm_name
from sitescope.functions.geo import grid_to_lat, grid_to_lon
from sitescope.operators.match import attach_coordinates

TABLES = ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
          'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f'{sf_dir.rstrip("/")}/{name}.parquet')


# ---------------------------------------------------------------------------
# Registry and visits (lead generation)
# ---------------------------------------------------------------------------

def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard registry schema (see ``operators.leads``) from customer + nation.

    ``nation`` is a fixed 25-row dimension, so broadcasting it is size-bounded.
    """
    c = table(spark, sf_dir, 'customer').select('c_custkey', 'c_name', 'c_nationkey', 'c_acctbal')
    n = table(spark, sf_dir, 'nation').select('n_nationkey', 'n_name')
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, 'left')
    easting = (F.lit(300000) + F.pmod(F.col('c_custkey') * 7919, F.lit(300000))).cast('double')
    northing = (F.lit(100000) + F.pmod(F.col('c_custkey') * 104729, F.lit(400000))).cast('double')
    postcode = F.format_string('%s%02d %03d', F.upper(F.substring('n_name', 1, 2)), F.col('c_nationkey'),
                               F.pmod(F.col('c_custkey'), F.lit(1000)))
    return (j.select(F.col('c_custkey').alias('gias_urn'),
                     F.col('c_name').alias('gias_name'),
                     F.col('n_name').alias('trust_name'),
                     easting.alias('easting'), northing.alias('northing'),
                     postcode.alias('postcode'),
                     (F.col('c_acctbal') / 100.0).alias('fsm_percentage'),
                     F.col('c_custkey').alias('reg_ord'))
              .withColumn('gias_lat', grid_to_lat('northing'))
              .withColumn('gias_lon', grid_to_lon('easting', 'northing'))
              .withColumn('norm_name', norm_name('gias_name'))
              .select('gias_urn', 'gias_name', 'trust_name', 'easting', 'northing', 'postcode',
                      'fsm_percentage', 'gias_lat', 'gias_lon', 'norm_name', 'reg_ord'))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered visits: one row per urgent, fulfilled order."""
    o = table(spark, sf_dir, 'orders')
    return (o.filter((F.col('o_orderpriority') == '1-URGENT') & (F.col('o_orderstatus') == 'F'))
             .select('o_custkey', 'o_orderdate'))


def geocodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer of site coordinates by name (stands in for the geocoding service)."""
    r = registry(spark, sf_dir)
    return r.select(F.col('gias_name').alias('school_name'), F.col('gias_lat').alias('latitude'),
                    F.col('gias_lon').alias('longitude'))


def visited_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """school_name, visit_count, latitude, longitude: the split that lead tracks are about."""
    return _located(spark, sf_dir, visits(spark, sf_dir))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As visited_sites, over all orders: for queries without a visited / unvisited split."""
    return _located(spark, sf_dir, table(spark, sf_dir, 'orders').select('o_custkey'))


def _located(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Orders are aggregated per site before the name join."""
    per_site = orders.groupBy('o_custkey').agg(F.count(F.lit(1)).alias('visit_count'))
    c = table(spark, sf_dir, 'customer').select('c_custkey', 'c_name')
    named = per_site.join(c, per_site.o_custkey == c.c_custkey, 'inner').select(
        F.col('c_name').alias('school_name'), 'visit_count')
    return attach_coordinates(named, geocodes(spark, sf_dir))


# ---------------------------------------------------------------------------
# Bookings, survey and sessions
# ---------------------------------------------------------------------------

REPEAT_ANSWER = '1-URGENT'  # the booking answer that marks a repeat booking


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """submission_date, site_key, answer, contact (all orders)."""
    o = table(spark, sf_dir, 'orders')
    return o.select(F.col('o_orderdate').alias('submission_date'),
                    F.col('o_custkey').alias('site_key'),
                    F.col('o_orderpriority').alias('answer'),
                    F.col('o_orderstatus').alias('contact'),
                    F.col('o_orderkey').alias('booking_ord'))


def survey_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw survey answers (strings), one per order, as a respondent would type them."""
    o = table(spark, sf_dir, 'orders')
    c = table(spark, sf_dir, 'customer').select('c_custkey', 'c_name', 'c_mktsegment')
    j = o.join(c, o.o_custkey == c.c_custkey, 'inner')
    seg = F.col('c_mktsegment')
    age = (F.when(seg == 'AUTOMOBILE', F.lit('11 - 13 years'))
            .when(seg == 'BUILDING', F.lit('14-16'))
            .when(seg == 'FURNITURE', F.lit('16+ (sixth form)'))
            .when(seg == 'HOUSEHOLD', F.lit('10 or under'))
            .otherwise(F.lit('Rather not say')))
    st = F.col('o_orderstatus')
    gender = (F.when(st == 'F', F.lit('female')).when(st == 'O', F.lit('Male'))
              .otherwise(F.lit('prefer not to say')))
    pr = F.col('o_orderpriority')
    rating = (F.when(pr == '1-URGENT', F.lit('Excellent - very effective'))
              .when(pr == '2-HIGH', F.lit('Good'))
              .when(pr == '3-MEDIUM', F.lit('Fair'))
              .when(pr == '4-NOT SPECIFIED', F.lit('Very Poor'))
              .otherwise(F.lit('no answer')))
    speaker = (F.when(st == 'F', F.lit('Yes, definitely')).when(st == 'O', F.lit("I don't know"))
               .otherwise(F.lit(None).cast('string')))
    likert = (F.pmod(F.col('o_orderkey'), F.lit(5)) + 1).cast('string')
    recommend = F.when(F.col('o_totalprice') > 150000, F.lit('yes')).otherwise(F.lit('No'))
    return j.select(F.col('o_orderkey').alias('response_id'),
                    F.col('o_orderdate').cast('string').alias('submission_date'),
                    age.alias('age_answer'), gender.alias('gender_answer'), rating.alias('rating_answer'),
                    speaker.alias('speaker_answer'), likert.alias('dangers_answer'),
                    F.when(pr != '5-LOW', likert).alias('grooming_answer'),
                    F.lit('n/a').alias('online_vs_real_answer'),
                    recommend.alias('recommend_answer'),
                    F.col('c_name').alias('school_answer'))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session facts: month, session_type, count, data_source."""
    o = table(spark, sf_dir, 'orders')
    return o.select(F.trunc('o_orderdate', 'month').cast('timestamp_ntz').alias('month'),
                    F.col('o_orderpriority').alias('session_type'),
                    F.lit(1.0).alias('count'),
                    F.col('o_orderstatus').alias('data_source'))


# ---------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, 'documents')


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, title, content, source; date spread over 2023-01 .. from doc_id."""
    d = documents(spark, sf_dir)
    date = F.date_add(F.lit('2023-01-01').cast('date'), F.pmod(F.col('doc_id') * 37, F.lit(730)).cast('int'))
    return d.select(F.col('doc_id'), date.cast('timestamp_ntz').alias('date'), F.col('source').alias('title'),
                    F.col('text').alias('content'), F.col('lang').alias('source'))


# Lexicons for the invented prose of the driver's documents (substrings that
# occur in it); the application's own lexicons are the operator defaults.
DOC_THEMES = {
    'nasal': ['on', 'an', 'en'],
    'liquid': ['re', 'le', 'er'],
    'suffix': ['tion', 'ment', 'ing'],
    'vowel_run': ['eau', 'oui', 'aie'],
    'accent': ['é', 'è', 'ê', 'ç'],
    'long_word': ['tiontion', 'mentment'],
}
DOC_POSITIVE = ('the', 'and', 'le', 'la', 'de', 'et', 'les', 'des')
DOC_NEGATIVE = ('of', 'is', 'on', 'en', 'un', 'une', 'du', 'que')
