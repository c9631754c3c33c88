"""Raw sheets, sinks and the lookup table.

Cells are rendered from the tables as a sheet would hold them; files are
written to the shared checkpoint folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitescope.plans import bindings as B
from sitescope.plans.registry import register
from sitescope.session import scratch_path
from sitescope.sources import lookup, rawcells, sinks
from sitescope.sources import readers as R

HEADERS = {
    'registry': (0, ['URN', 'EstablishmentName', 'EstablishmentStatus (code)', 'Trusts (name)', 'Postcode', 'PercentageFSM', None, 'URN']),
    'Feedback Adult': (2, ['Submission Date', 'Role', 'Comment']),
    'Feedback Class': (0, ['Submission Date', 'Class', 'Score']),
    'Non-Numerical Feedback': (0, ['Date', 'Feedback from', 'Feedback text']),
}


def raw_cells(spark, d):
    """(sheet, row_idx, cells): a registry sheet from customers, feedback sheets from orders and parts."""
    heads = [('Feedback Adult', 0, ['Adult feedback', None]), ('Feedback Adult', 1, [None])]
    heads += [(name, top, cells) for name, (top, cells) in HEADERS.items()]
    head = spark.createDataFrame(heads, 'sheet string, row_idx int, cells array<string>')

    def rows(df, name, key, cells, empty=None):
        values = F.array(*[c.cast('string') for c in cells])
        if empty is not None:
            values = F.when(empty, F.array(*[F.lit(None).cast('string')] * len(cells))).otherwise(values)
        return df.select(F.lit(name).alias('sheet'), (F.col(key) + 3).cast('int').alias('row_idx'), values.alias('cells'))

    c = B.table(spark, d, 'customer').join(F.broadcast(B.table(spark, d, 'nation')), F.col('c_nationkey') == F.col('n_nationkey'), 'left')
    o, p = B.table(spark, d, 'orders'), B.table(spark, d, 'part')
    status = F.when(F.pmod('c_custkey', F.lit(4)) == 0, F.lit('2')).otherwise(F.lit('1'))
    name = F.when(F.pmod('c_custkey', F.lit(9)) != 0, F.concat(F.lit(' '), F.col('c_name'), F.lit(' ')))
    sheets = [
        rows(c, 'registry', 'c_custkey', [F.col('c_custkey'), name, status, F.col('n_name'), F.lit('AB 12'), F.col('c_acctbal') / 100.0],
             F.pmod('c_custkey', F.lit(50)) == 7),
        rows(o, 'Feedback Adult', 'o_orderkey', [F.col('o_orderdate').cast('date'), F.col('o_orderpriority'), F.when(F.pmod('o_orderkey', F.lit(3)) == 0, F.lit('ok'))],
             F.pmod('o_orderkey', F.lit(7)) == 0),
        rows(o, 'Feedback Class', 'o_orderkey', [F.when(F.pmod('o_orderkey', F.lit(5)) == 0, F.lit('not known')).otherwise(F.date_format('o_orderdate', 'MM/dd/yyyy')),
                                                 F.col('o_orderstatus'), F.pmod('o_orderkey', F.lit(5))]),
        rows(p, 'Non-Numerical Feedback', 'p_partkey', [F.lit('2024-03-04'), F.when(F.pmod('p_partkey', F.lit(3)) != 0, F.col('p_name')), F.lit('fine')]),
    ]
    for s in sheets:
        head = head.unionByName(s)
    return head


@register('S2_sheet_columns', """
WITH a AS (
  SELECT 'registry' AS sheet, unnest(['URN', 'EstablishmentName', 'EstablishmentStatus (code)', 'Trusts (name)', 'Postcode', 'PercentageFSM', 'col_6', 'URN_1']) AS name,
         unnest([1, CASE WHEN c_custkey % 9 <> 0 THEN 1 ELSE 0 END, 1, CASE WHEN n_name IS NOT NULL THEN 1 ELSE 0 END, 1, CASE WHEN c_acctbal IS NOT NULL THEN 1 ELSE 0 END, 0, 0])
         * (CASE WHEN c_custkey % 50 = 7 THEN 0 ELSE 1 END) AS filled
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  UNION ALL
  SELECT 'Feedback Adult', unnest(['Submission Date', 'Role', 'Comment']),
         unnest([1, 1, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END]) * (CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END) FROM orders
  UNION ALL SELECT 'Feedback Class', unnest(['Submission Date', 'Class', 'Score']), 1 FROM orders
  UNION ALL SELECT 'Non-Numerical Feedback', unnest(['Date', 'Feedback from', 'Feedback text']), unnest([1, CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END, 1]) FROM part)
SELECT sheet, name, count(*) AS row_count, sum(filled)::BIGINT AS filled FROM a GROUP BY sheet, name""")
def sheet_columns(spark, d):
    """S2 + S3: all sheets promoted at once; rows and filled cells of every column."""
    records = R.sheet_records(raw_cells(spark, d), {name: top for name, (top, _) in HEADERS.items()})
    return records.select('sheet', F.explode('record').alias('name', 'cell')).groupBy('sheet', 'name').agg(
        F.count('*').alias('row_count'), F.count('cell').alias('filled'))


@register('S7_registry_from_cells', """
SELECT c_custkey AS gias_urn, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS gias_name, n_name AS trust_name,
       round(c_acctbal / 100.0, 6) AS fsm_percentage
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
WHERE c_custkey % 50 <> 7 AND c_custkey % 4 <> 0 AND c_custkey % 9 <> 0""")
def registry_from_cells(spark, d):
    """The registry sheet to the standard schema: open sites that have a name."""
    table = R.promote_header(R.sheet(raw_cells(spark, d), 'registry'), 0)
    std = R.standardize(R.open_only(R.drop_all_null(table)))
    return R.require_name(std, 'gias_name').select(F.col('gias_urn').try_cast('long').alias('gias_urn'), 'gias_name', 'trust_name',
                                                   F.col('fsm_percentage').try_cast('double').alias('fsm_percentage'))


@register('S6_found_cells', """
SELECT c_custkey AS gias_urn, n_name AS trust_name, CASE WHEN c_custkey % 4 = 0 THEN '2' ELSE '1' END AS status
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 50 <> 7""")
def found_cells(spark, d):
    """S6 on records: columns found by name patterns in the registry sheet, empty rows left out."""
    records = R.sheet_records(R.sheet(raw_cells(spark, d), 'registry'), {'registry': 0})
    found = {k: R.found_cell('record', v) for k, v in (('gias_urn', ['urn']), ('trust_name', ['no such', 'trust']), ('status', ['status']))}
    return records.select(*[c.alias(k) for k, c in found.items()]).where('gias_urn is not null').withColumn('gias_urn', F.col('gias_urn').try_cast('long'))


@register('L9_adult_feedback', """
SELECT (o_orderkey + 3)::INT AS row_idx, strftime(o_orderdate, '%Y-%m-%d') AS "Submission Date", o_orderpriority AS "Role",
       CASE WHEN o_orderkey % 3 = 0 THEN 'ok' END AS "Comment" FROM orders WHERE o_orderkey % 7 <> 0""")
def adult_feedback(spark, d):
    """L9 + P2: adult feedback rows that are not empty."""
    return R.clean_adult(raw_cells(spark, d))


@register('L9_class_feedback', """
SELECT (o_orderkey + 3)::INT AS row_idx, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS submitted,
       o_orderstatus AS class, (o_orderkey % 5)::VARCHAR AS score FROM orders""")
def class_feedback(spark, d):
    """L9 + C7: class feedback with its dates read."""
    df = R.clean_class(raw_cells(spark, d))
    return df.select('row_idx', F.date_format('Submission Date', 'yyyy-MM-dd').alias('submitted'), F.col('Class').alias('class'), F.col('Score').alias('score'))


@register('L9_qualitative_feedback', """
SELECT (p_partkey + 3)::INT AS row_idx, '2024-03-04' AS said, p_name AS feedback_from, 'fine' AS feedback_text FROM part WHERE p_partkey % 3 <> 0""")
def qualitative_feedback(spark, d):
    """L9 + P3: qualitative feedback with an entry in the first feedback column."""
    df = R.clean_qualitative(raw_cells(spark, d))
    return df.select('row_idx', F.date_format('Date', 'yyyy-MM-dd').alias('said'), F.col('Feedback from').alias('feedback_from'),
                     F.col('Feedback text').alias('feedback_text'))


@register('S1_raw_cells', """
SELECT c_custkey, 'a "' || c_name || '"' || chr(10) || 'é,' || c_mktsegment AS label, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, '') AS segment
FROM customer""")
def csv_cells(spark, d):
    """S8 -> S1 + S4: customers written as CSV with a byte-order mark, read back as raw cells; labels hold quotes and line breaks."""
    c = B.table(spark, d, 'customer')
    label = F.concat(F.lit('a "'), 'c_name', F.lit('"\né,'), 'c_mktsegment')
    path = scratch_path(spark)
    sinks.write_csv(c.select('c_custkey', label.alias('label'), F.when(F.pmod('c_custkey', F.lit(3)) != 0, F.col('c_mktsegment')).alias('segment')), path, only_if_nonempty=False)
    raw = rawcells.read_raw_sheets(spark, path, 'part-*').where('row_idx > 0')
    return raw.select(F.get('cells', 0).cast('long').alias('c_custkey'), F.get('cells', 1).alias('label'), F.get('cells', 2).alias('segment'))


@register('S9_json_lines', """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS ordered, o_orderstatus || '|' || o_orderpriority AS tags FROM orders""")
def json_lines(spark, d):
    """Orders as JSON lines, dates in nested values as strings, read back."""
    o = B.table(spark, d, 'orders')
    path = scratch_path(spark)
    sinks.write_json(o.select(F.col('o_orderkey').alias('id'), F.struct(F.col('o_orderdate').cast('date').alias('ordered'),
                                                                         F.array('o_orderstatus', 'o_orderpriority').alias('tags')).alias('order')), path)
    back = spark.read.schema('id long, order struct<ordered: string, tags: array<string>>').json(path)
    return back.select('id', 'order.ordered', F.array_join('order.tags', '|').alias('tags'))


@register('S11_lookup_cache', """
SELECT c_custkey AS key, c_name AS found, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS writer
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def lookup_cache(spark, d):
    """Two appends to a lookup table, the second with keys that are there already; one row a key."""
    c = B.table(spark, d, 'customer').select(F.col('c_custkey').alias('key'), F.col('c_name').alias('found'))
    path = scratch_path(spark)
    for writer, step in ((1, 2), (2, 3)):
        lookup.append_new(spark, c.where(F.pmod('key', F.lit(step)) == 0).withColumn('writer', F.lit(writer)), path, 'key')
    return lookup.read_lookup(spark, path)
