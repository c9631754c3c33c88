"""Reshaping (R1, U1): wide session sheets to long session facts.

Sheet layout: row 1 holds dates at columns 0, 3, 6, ...; rows from 3 hold a
session type in column 0 and counts at columns 1, 4, 7, .... The j-th date that
*parses* pairs with column 1 + 3j (unparsable dates are skipped, so later
columns shift - the application's behaviour); blank types and non-numeric
counts are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitescope.functions.clean import to_number, to_timestamp_any

SESSION_COLUMNS = ['month', 'session_type', 'count', 'data_source']


def sessions_from_wide(raw: DataFrame, date_row: int = 1, first_data_row: int = 3, stride: int = 3) -> DataFrame:
    """R1 over every sheet of a raw cell table (sheet, row_idx, cells).

    The parsed-date index is a row_number over one header row per sheet (a
    bounded list of months), joined to the exploded count cells on (sheet, j).
    """
    head = (raw.filter(F.col('row_idx') == date_row)
               .select('sheet', F.posexplode_outer('cells').alias('pos', 'cell'))
               .filter(F.pmod('pos', F.lit(stride)) == 0)
               .withColumn('month', to_timestamp_any('cell'))
               .filter(F.col('month').isNotNull()))
    dates = head.withColumn('j', F.row_number().over(Window.partitionBy('sheet').orderBy('pos')) - 1) \
                .select('sheet', 'j', 'month')
    body = (raw.filter(F.col('row_idx') >= first_data_row)
               .select('sheet', 'row_idx', F.get(F.col('cells'), 0).alias('session_type'), 'cells')
               .filter(F.col('session_type').isNotNull() & (F.col('session_type') != ''))
               .select('sheet', 'row_idx', 'session_type', F.posexplode_outer('cells').alias('pos', 'cell'))
               .filter((F.col('pos') >= 1) & (F.pmod(F.col('pos') - 1, F.lit(stride)) == 0))
               .withColumn('j', ((F.col('pos') - 1) / stride).cast('int'))
               .withColumn('count', to_number('cell'))
               .filter(F.col('count').isNotNull()))
    return (body.join(dates, ['sheet', 'j'], 'inner')
                .select('month', 'session_type', 'count', F.col('sheet').alias('data_source')))


def union_sessions(parts: Sequence[DataFrame], spark=None) -> DataFrame:
    """Union all of session tables; no input -> an empty typed table."""
    if not parts:
        return spark.createDataFrame([], 'month timestamp_ntz, session_type string, count double, data_source string')
    out = parts[0].select(*SESSION_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*SESSION_COLUMNS))
    return out


def wide_sheet(facts: DataFrame, sheet_name: str, month_col: str, type_col: str, count_col: str,
               stride: int = 3) -> DataFrame:
    """Render long facts as a wide raw sheet (the layout ``sessions_from_wide`` reads).

    Months are numbered by a row_number over the distinct months (one small
    list); each type row gathers at most one value per month.
    """
    months = facts.select(F.col(month_col).alias('m')).distinct()
    months = months.withColumn('j', F.row_number().over(Window.orderBy('m')) - 1)
    n = months.agg(F.count(F.lit(1)).alias('n'))
    per = (facts.groupBy(F.col(type_col).alias('t'), F.col(month_col).alias('m'))
                .agg(F.sum(count_col).alias('v'))
                .join(months, 'm'))
    rows = per.groupBy('t').agg(F.map_from_entries(F.collect_list(F.struct('j', 'v'))).alias('vals'))
    width = n.select((F.col('n') * stride).alias('w'))
    data = (rows.crossJoin(width)
                .select(F.lit(sheet_name).alias('sheet'),
                        F.transform(F.sequence(F.lit(0), F.col('w') - 1),
                                    lambda i: F.when(i == 0, F.col('t'))
                                               .when(F.pmod(i - 1, F.lit(stride)) == 0,
                                                     F.element_at(F.col('vals'), ((i - 1) / stride).cast('int'))
                                                     .cast('long').cast('string'))
                                    ).alias('cells'),
                        F.col('t')))
    data = data.withColumn('row_idx', (F.dense_rank().over(Window.orderBy('t')) + 2).cast('int')).drop('t')
    mlist = months.agg(F.map_from_entries(F.collect_list(F.struct('j', F.date_format('m', 'yyyy-MM-dd')))).alias('mm'))
    header = (mlist.crossJoin(width)
                   .select(F.lit(sheet_name).alias('sheet'), F.lit(1).alias('row_idx'),
                           F.transform(F.sequence(F.lit(0), F.col('w') - 1),
                                       lambda i: F.when(F.pmod(i, F.lit(stride)) == 0,
                                                        F.element_at(F.col('mm'), (i / stride).cast('int')))
                                       ).alias('cells')))
    title = facts.sparkSession.createDataFrame([(sheet_name, 0, [sheet_name]), (sheet_name, 2, ['Session type'])],
                                               'sheet string, row_idx int, cells array<string>')
    return title.unionByName(header).unionByName(data.select('sheet', 'row_idx', 'cells'))
