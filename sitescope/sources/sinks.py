"""Sinks (S8-S10, S14): CSV, JSON lines, text reports, GeoJSON features."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitescope.sources.rawcells import BOM


def write_csv(df: DataFrame, path: str, only_if_nonempty: bool = True) -> bool:
    """CSV files (UTF-8) that each begin with a byte-order mark and the header.

    Rows are rendered by Spark and written by its text sink, whose commit keeps
    files of failed tasks out. Quotes are doubled; null is empty. Returns
    whether anything was written (nothing for a table without rows).
    """
    if only_if_nonempty and df.isEmpty():
        return False
    names = io.StringIO()
    csv.writer(names, lineterminator='').writerow(df.columns)
    header = BOM + names.getvalue()

    def headed(batches):
        first = True
        for pdf in batches:
            if len(pdf):
                yield pd.concat([pd.DataFrame({'value': [header]}), pdf]) if first else pdf
                first = False

    lines = df.select(F.to_csv(F.struct(*[F.col(f'`{c}`') for c in df.columns]), {'escape': '"'}).alias('value'))
    lines.mapInPandas(headed, 'value string').write.mode('overwrite').text(path)
    return True


def jsonable(col: Column, kind: T.DataType) -> Column:
    """``col`` with everything that JSON has no value for as a string, at any depth; map keys become strings."""
    if isinstance(kind, T.StructType):
        fields = F.struct(*[jsonable(col[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(col.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: jsonable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        values = F.transform_values(col, lambda k, v: jsonable(v, kind.valueType))
        return F.transform_keys(values, lambda k, v: k.cast('string'))
    if isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.NullType)):
        return col
    return col.cast('string')


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; values that JSON cannot hold are strings, in nested structs, arrays and maps as well."""
    cols = [jsonable(F.col(f'`{f.name}`'), f.dataType).alias(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode('overwrite').json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """S10 sink: one small text file, lines in (section, line) order.

    Reports are bounded summaries (metric tables), so one output file is fine.
    """
    lines.orderBy('section_no', 'line_no').select('line').coalesce(1).write.mode('overwrite').text(path)


def geojson_features(df: DataFrame, lat: str, lon: str, props: Sequence[str]) -> DataFrame:
    """One GeoJSON Feature (JSON string) per row with coordinates."""
    feat = F.struct(F.lit('Feature').alias('type'),
                    F.struct(F.lit('Point').alias('type'),
                             F.array(F.col(lon), F.col(lat)).alias('coordinates')).alias('geometry'),
                    F.struct(*[F.col(p) for p in props]).alias('properties'))
    return (df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
              .select(F.to_json(feat).alias('feature')))


def write_geojson_lines(df: DataFrame, path: str) -> None:
    """S14 sink: newline-delimited GeoJSON features."""
    df.select('feature').write.mode('overwrite').text(path)
