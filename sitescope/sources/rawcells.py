"""Raw cells of CSV files, read in byte ranges.

Spark's text source splits files, hands out a line's bytes as they are and
reads every store that Spark can. On top of it, all as DataFrame steps:

* encoding: a file whose every line is valid UTF-8 is read as such, any other
  as Latin-1; one aggregate decides for each file;
* records: a line begins a record if the quotes before it in its file are
  even in number. Quotes are summed by byte range, a running sum over the
  ranges (one row each) tells what lies before, and a running sum within a
  range does the rest, so a line break inside quotes survives, also where a
  range ends;
* only the lines of records that span several are gathered, by record. A file
  whose last quote is never closed has one long record, as for any CSV reader.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from sitescope.session import cut_lineage

BOM = '﻿'


@F.pandas_udf(ArrayType(StringType()))
def record_cells(records: pd.Series) -> pd.Series:
    """Cells of one record each; empty cells are null, a blank line has none."""
    def cells(text: str) -> list:
        return [c if c != '' else None for c in next(csv.reader(io.StringIO(text, newline='')), [])]
    return records.map(cells)


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, sheet, block, line, bytes, utf8, quotes): every line with its place; a block is a byte range of a file."""
    text = spark.read.option('pathGlobFilter', glob).option('lineSep', '\n').text(path)
    quotes = F.octet_length('value') - F.octet_length(F.replace('value', F.lit('"'), F.lit('')))
    return text.select(F.col('_metadata.file_path').alias('file'), F.regexp_replace('_metadata.file_name', r'\.[^.]*$', '').alias('sheet'),
                       F.col('_metadata.file_block_start').alias('block'), F.monotonically_increasing_id().alias('line'),
                       F.col('value').cast('binary').alias('bytes'), F.is_valid_utf8('value').alias('utf8'), quotes.alias('quotes'))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with the number of their record, and whether they are a whole record."""
    inside = Window.partitionBy('file', 'block').orderBy('line').rowsBetween(Window.unboundedPreceding, 0)
    even = F.pmod(F.col('before'), F.lit(2)) == 0
    within = (lines.withColumn('before', F.sum('quotes').over(inside) - F.col('quotes'))
              .withColumn('starts0', F.count_if(even).over(inside)).withColumn('starts1', F.count_if(~even).over(inside)))
    # starts0 and starts1: records begun in the range so far, for an even and an odd number of quotes ahead of it
    ahead = Window.partitionBy('file').orderBy('block').rowsBetween(Window.unboundedPreceding, -1)
    blocks = within.groupBy('file', 'block').agg(F.sum('quotes').alias('q'), F.max('starts0').alias('n0'), F.max('starts1').alias('n1'))
    blocks = blocks.withColumn('odd', F.pmod(F.coalesce(F.sum('q').over(ahead), F.lit(0)), F.lit(2)))
    blocks = blocks.withColumn('first', F.coalesce(F.sum(F.when(F.col('odd') == 0, F.col('n0')).otherwise(F.col('n1'))).over(ahead), F.lit(0)))
    placed = within.join(blocks.select('file', 'block', 'odd', 'first'), ['file', 'block'])
    begun = F.when(F.col('odd') == 0, F.col('starts0')).otherwise(F.col('starts1'))
    whole = (F.pmod(F.col('before') + F.col('odd'), F.lit(2)) == 0) & (F.pmod('quotes', F.lit(2)) == 0)
    return placed.select('file', 'sheet', 'block', 'line', 'bytes', (F.col('first') + begun - 1).cast('int').alias('row_idx'), whole.alias('whole'))


def read_raw_sheets(spark: SparkSession, path: str, glob: str = '*.csv') -> DataFrame:
    """S1 + S4: (sheet, row_idx, cells) of all CSV files under ``path``; a file is a sheet, named after it.

    Rows count records from 0, blank lines included. A file is UTF-8 (a
    byte-order mark is dropped) or else Latin-1, so a Latin-1 file is read
    right instead of silently getting U+FFFD. Empty cells become null.
    """
    lines = cut_lineage(_lines(spark, path, glob))
    encodings = lines.groupBy(F.col('file').alias('file2')).agg(F.bool_and('utf8').alias('utf8'))
    read = _numbered(lines).join(encodings, F.col('file') == F.col('file2'))
    text = F.when(F.col('utf8'), F.decode('bytes', 'UTF-8')).otherwise(F.decode('bytes', 'ISO-8859-1'))
    read = cut_lineage(read.select('file', 'sheet', 'block', 'line', 'row_idx', 'whole', text.alias('text')))
    parts = F.array_sort(F.collect_list(F.struct('block', 'line', 'text')))
    long = read.where('not whole').groupBy('file', 'sheet', 'row_idx').agg(
        F.array_join(F.transform(parts, lambda p: p['text']), '\n').alias('text'))
    records = read.where('whole').select('sheet', 'row_idx', 'text').unionByName(long.select('sheet', 'row_idx', 'text'))
    record = F.when(F.col('row_idx') == 0, F.ltrim('text', F.lit(BOM))).otherwise(F.col('text'))
    return records.select('sheet', 'row_idx', record_cells(record).alias('cells'))
