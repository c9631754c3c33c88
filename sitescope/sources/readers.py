"""Sheets and schema operators over raw cells.

Raw sheets are handled as a cell table ``(sheet, row_idx, cells array<string>)``
so row order is data, not partition order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sitescope.functions.clean import strip, to_timestamp_any

def sheet(raw: DataFrame, name: str) -> DataFrame:
    """One named sheet of the raw cell table."""
    return raw.filter(F.col('sheet') == name)


def _dedupe_names(names: Sequence[str | None]) -> list[str]:
    out, seen = [], {}
    for i, n in enumerate(names):
        n = (n or '').strip() or f'col_{i}'
        if n in seen:
            seen[n] += 1
            n = f'{n}_{seen[n]}'
        else:
            seen[n] = 0
        out.append(n)
    return out


def promote_header(raw_sheet: DataFrame, header_row: int = 0) -> DataFrame:
    """S3: row ``header_row`` becomes the column names; later rows become data.

    Only the header row's cells reach the driver (schema metadata); blank or
    duplicate names are made unique. ``row_idx`` is kept for ordering.
    """
    head = raw_sheet.filter(F.col('row_idx') == header_row).select('cells').first()
    names = _dedupe_names(list(head['cells']) if head else [])
    body = raw_sheet.filter(F.col('row_idx') > header_row)
    return body.select('row_idx', *[F.get(F.col('cells'), i).alias(n) for i, n in enumerate(names)])


def sheet_records(raw: DataFrame, header_rows: Mapping[str, int]) -> DataFrame:
    """S2 + S3 for many sheets at once: (sheet, row_idx, record), a record being column name to cell.

    Every sheet's header row is joined to its later rows, so no row passes
    through the driver and sheets may differ in their columns. Blank names
    become col_<position>, repeated ones get a number, as in promote_header.
    Sheets without an entry in ``header_rows`` are left out.
    """
    tops = raw.sparkSession.createDataFrame(list(header_rows.items()), 'sheet string, top int')
    marked = raw.join(F.broadcast(tops), 'sheet')
    cells = marked.where('row_idx = top').select('sheet', F.posexplode('cells').alias('at', 'cell'))
    named = cells.withColumn('name', F.coalesce(F.nullif(strip('cell'), F.lit('')), F.concat(F.lit('col_'), F.col('at').cast('string'))))
    nth = F.row_number().over(Window.partitionBy('sheet', 'name').orderBy('at'))  # header cells only
    named = named.withColumn('name', F.when(nth == 1, F.col('name')).otherwise(F.concat_ws('_', 'name', (nth - 1).cast('string'))))
    heads = named.groupBy('sheet').agg(F.transform(F.array_sort(F.collect_list(F.struct('at', 'name'))), lambda c: c['name']).alias('names'))
    body = marked.where('row_idx > top').join(heads, 'sheet')
    padded = F.transform('names', lambda n, i: F.get('cells', i))
    return body.select('sheet', 'row_idx', F.map_from_arrays('names', padded).alias('record'))


def found_cell(record, patterns: Sequence[str]) -> Column:
    """S6 on a record: the cell of the first pattern's first column whose lower-cased name contains it."""
    def first(pattern: str) -> Column:
        return F.get(F.filter(F.map_keys(record), lambda n: F.contains(F.lower(n), F.lit(pattern.lower()))), 0)

    return F.element_at(record, F.coalesce(*map(first, patterns)))


def clean_adult(raw: DataFrame, name: str = 'Feedback Adult') -> DataFrame:
    """Adult feedback: the third row names the columns, empty rows go."""
    return drop_all_null(promote_header(sheet(raw, name), 2))


def clean_class(raw: DataFrame, name: str = 'Feedback Class', date_col: str = 'Submission Date') -> DataFrame:
    """Class feedback: the first row names the columns; dates that cannot be read are null."""
    df = promote_header(sheet(raw, name), 0)
    return df.withColumn(date_col, to_timestamp_any(date_col)) if date_col in df.columns else df


def clean_qualitative(raw: DataFrame, name: str = 'Non-Numerical Feedback', date_col: str = 'Date') -> DataFrame:
    """Qualitative feedback: as class feedback, without rows that are null in the first feedback column."""
    return drop_null_in_first(clean_class(raw, name, date_col), 'feedback')


def read_optional(spark: SparkSession, path: str, schema: StructType, fmt: str = 'csv',
                  **options) -> DataFrame:
    """Read if the path exists, else an empty table with the schema."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def find_col(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """First pattern (in order), then first column (in order) whose
    lower-cased name contains it; metadata only, no job."""
    for p in patterns:
        for c in columns:
            if p.lower() in c.lower():
                return c
    return None


#: Parts of the registry's column names, by the standard name they stand for.
REGISTRY_PATTERNS = {
    'gias_urn': ['urn'],
    'gias_name': ['establishmentname', 'establishment name'],
    'trust_name': ['trusts (name)', 'trust'],
    'easting': ['easting'],
    'northing': ['northing'],
    'postcode': ['postcode'],
    'fsm_percentage': ['percentagefsm', 'fsm'],
}


def standardize(df: DataFrame, patterns: Mapping[str, Sequence[str]] = REGISTRY_PATTERNS) -> DataFrame:
    """Select and rename discovered columns to the standard names; pass
    through unchanged (with a warning) when nothing is found."""
    found = {std: find_col(df.columns, pats) for std, pats in patterns.items()}
    found = {k: v for k, v in found.items() if v is not None}
    if not found:
        import warnings
        warnings.warn('no standard columns found; table passed through unchanged')
        return df
    return df.select(*[F.col(f'`{src}`').alias(std) for std, src in found.items()])


def open_only(df: DataFrame, code_col: str | None = 'EstablishmentStatus (code)',
              status_col: str | None = None) -> DataFrame:
    """P5: status code == '1' when the code column exists, else status text contains 'open'."""
    if code_col and code_col in df.columns:
        return df.filter(F.col(f'`{code_col}`').cast('string') == '1')
    if status_col and status_col in df.columns:
        return df.filter(F.coalesce(F.lower(F.col(f'`{status_col}`').cast('string')).contains('open'),
                                    F.lit(False)))
    return df


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop rows null in every column (a raw sheet's row number does not count)."""
    return df.na.drop(how='all', subset=[c for c in df.columns if c != 'row_idx'])


def drop_null_in_first(df: DataFrame, pattern: str) -> DataFrame:
    """Drop rows null in the first column whose name contains ``pattern``."""
    c = find_col(df.columns, [pattern])
    return df.na.drop(subset=[c]) if c else df


def require_name(df: DataFrame, col: str) -> DataFrame:
    """Strip the name, then require non-null (an empty string survives)."""
    return df.withColumn(col, strip(col)).filter(F.col(col).isNotNull())
