"""Readers, schema operators, reshaping and sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sitescope.sources import lookup as LK
from sitescope.sources import rawcells as RC
from sitescope.sources import readers as RD
from sitescope.sources import reshape as RS
from sitescope.sources import sinks as K


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix='sitescope-src-')


def test_raw_sheets_encoding_fallback_and_header(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, 'registry.csv'), 'wb') as f:
        f.write('URN,EstablishmentName,EstablishmentStatus (code),Trusts (name)\n'.encode('latin-1'))
        f.write('1,École Saint-Étienne,1,Trust A\n2,Oak School,2,\n'.encode('latin-1'))
    with open(os.path.join(tmpdir_path, 'bookings.csv'), 'w', encoding='utf-8') as f:
        f.write('Report title\nSubmission Date,School Name,Answer\n2024-01-02,Élan Academy,Repeat Booking\n')
    raw = RC.read_raw_sheets(spark, tmpdir_path)
    assert {r.sheet for r in raw.select('sheet').distinct().collect()} == {'registry', 'bookings'}
    reg = RD.promote_header(RD.sheet(raw, 'registry'), 0)
    names = [r.EstablishmentName for r in reg.orderBy('row_idx').collect()]
    assert names == ['École Saint-Étienne', 'Oak School']      # latin-1 decoded, no U+FFFD
    assert RD.open_only(reg).count() == 1                      # P5 by status code
    std = RD.standardize(reg)
    assert std.columns == ['gias_urn', 'gias_name', 'trust_name']
    assert [r.trust_name for r in std.orderBy('gias_urn').collect()] == ['Trust A', None]
    book = RD.promote_header(RD.sheet(raw, 'bookings'), 1)     # header on row 1 (S3)
    assert book.first()['School Name'] == 'Élan Academy'


def test_find_col_order():
    cols = ['Trust flag', 'Trusts (name)', 'URN']
    assert RD.find_col(cols, ['trusts (name)', 'trust']) == 'Trusts (name)'
    assert RD.find_col(cols, ['nothing']) is None


def test_duplicate_and_blank_header_names(spark):
    raw = spark.createDataFrame([('s', 0, ['a', None, 'a']), ('s', 1, ['1', '2', '3'])],
                                'sheet string, row_idx int, cells array<string>')
    assert RD.promote_header(raw, 0).columns == ['row_idx', 'a', 'col_1', 'a_1']


def test_drop_rules(spark):
    df = spark.createDataFrame([(None, None), ('x', None), (None, 'y')], 'a string, feedback_text string')
    assert RD.drop_all_null(df).count() == 2                   # P2
    assert RD.drop_null_in_first(df, 'feedback').count() == 1  # P3
    names = spark.createDataFrame([(' a ',), ('',), (None,)], 'n string')
    assert sorted(r.n for r in RD.require_name(names, 'n').collect()) == ['', 'a']   # P4


def test_read_optional_missing(spark, tmpdir_path):
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField('x', StringType())])
    df = RD.read_optional(spark, os.path.join(tmpdir_path, 'nope.csv'), schema)
    assert df.count() == 0 and df.columns == ['x']


def test_sessions_from_wide_quirks(spark):
    rows = [
        ('s', 0, ['Title']),
        ('s', 1, ['2024-01-01', None, None, 'not a date', None, None, '2024-03-01', None, None]),
        ('s', 2, ['Type']),
        ('s', 3, ['Assembly', '5', None, 'x', '7', None, '9']),   # j-th parsed date pairs with column 1+3j
        ('s', 4, [None, '1', None, '1']),                          # blank type skipped
        ('s', 5, ['Workshop', 'text', None, None, '2']),
    ]
    raw = spark.createDataFrame(rows, 'sheet string, row_idx int, cells array<string>')
    got = sorted((str(r.month)[:10], r.session_type, r['count']) for r in RS.sessions_from_wide(raw).collect())
    assert got == [('2024-01-01', 'Assembly', 5.0), ('2024-03-01', 'Assembly', 7.0), ('2024-03-01', 'Workshop', 2.0)]


def test_wide_round_trip(spark):
    facts = spark.createDataFrame([('2024-01-01', 'A', 2), ('2024-02-01', 'A', 1), ('2024-02-01', 'B', 3)],
                                  'm string, t string, n int').withColumn('m', F.col('m').cast('date'))
    back = RS.sessions_from_wide(RS.wide_sheet(facts, 'sheet1', 'm', 't', 'n'))
    got = sorted((str(r.month)[:10], r.session_type, r['count'], r.data_source) for r in back.collect())
    assert got == [('2024-01-01', 'A', 2.0, 'sheet1'), ('2024-02-01', 'A', 1.0, 'sheet1'),
                   ('2024-02-01', 'B', 3.0, 'sheet1')]
    empty = RS.union_sessions([], spark)
    assert empty.count() == 0 and empty.columns == RS.SESSION_COLUMNS


def test_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 'a', 51.0, -1.0)], 'id long, name string, lat double, lon double')
    assert K.write_csv(df, os.path.join(tmpdir_path, 'out_csv')) is True
    assert K.write_csv(df.limit(0), os.path.join(tmpdir_path, 'empty_csv')) is False
    assert not os.path.exists(os.path.join(tmpdir_path, 'empty_csv'))
    K.write_json(df.select('id', F.struct('name', 'lat').alias('nested')), os.path.join(tmpdir_path, 'out_json'))
    back = spark.read.json(os.path.join(tmpdir_path, 'out_json')).first()
    assert back.nested.name == 'a'
    feats = K.geojson_features(df, 'lat', 'lon', ['id', 'name'])
    f = json.loads(feats.first().feature)
    assert f['geometry']['coordinates'] == [-1.0, 51.0] and f['properties']['name'] == 'a'
    lines = spark.createDataFrame([(1, 1, 'rows: a'), (0, 0, 'Summary')], 'section_no int, line_no int, line string')
    K.write_report(lines, os.path.join(tmpdir_path, 'report'))
    txt = spark.read.text(os.path.join(tmpdir_path, 'report')).collect()
    assert [r.value for r in txt] == ['Summary', 'rows: a']


def test_raw_sheets_split_at_every_byte_range(spark, tmpdir_path):
    """Ranges of 40 bytes cut lines, quoted line breaks and characters; rows equal the csv module's."""
    import csv
    import random
    rnd = random.Random(5)
    cell = lambda: ''.join(rnd.choices(['a', 'é', '"', '\n', ',', ' ', 'word', '\r\n', ''], k=rnd.randint(0, 6)))
    for name, encoding, mark in (('one', 'utf-8', ''), ('two', 'latin-1', ''), ('marked', 'utf-8', '\ufeff')):
        with open(os.path.join(tmpdir_path, f'{name}.csv'), 'w', encoding=encoding, newline='') as f:
            f.write(mark)
            csv.writer(f, lineterminator='\r\n' if name == 'two' else '\n').writerows([[name, *(cell() for _ in range(4))] for _ in range(80)] + [[], ['end']])
    old = spark.conf.get('spark.sql.files.maxPartitionBytes')
    spark.conf.set('spark.sql.files.maxPartitionBytes', '40b')
    try:
        assert spark.read.text(tmpdir_path).rdd.getNumPartitions() > 30
        got = {(r.sheet, r.row_idx): r.cells for r in RC.read_raw_sheets(spark, tmpdir_path).collect()}
    finally:
        spark.conf.set('spark.sql.files.maxPartitionBytes', old)
    want = {}
    for name, encoding in (('one', 'utf-8'), ('two', 'latin-1'), ('marked', 'utf-8-sig')):
        with open(os.path.join(tmpdir_path, f'{name}.csv'), encoding=encoding, newline='') as f:
            want |= {(name, i): [c or None for c in rec] for i, rec in enumerate(csv.reader(f))}
    assert got == want


def test_csv_files_begin_with_a_mark_and_failed_writes_leave_nothing(spark, tmpdir_path):
    import glob
    path = os.path.join(tmpdir_path, 'marked')
    rows = [(1, 'a "b", c', None), (2, 'two\nlines', 1.5), (3, 'é', None)]
    df = spark.createDataFrame(rows, '`id, no` long, name string, x double').repartition(2)
    assert K.write_csv(df, path)
    files = glob.glob(path + '/part-*')
    assert files and all(open(f, 'rb').read().startswith('\ufeff"id, no",name,x\n'.encode()) for f in files)
    back = RC.read_raw_sheets(spark, path, 'part-*').where('row_idx > 0')
    assert sorted(tuple(r.cells) for r in back.collect()) == sorted((str(a), b, None if c is None else str(c)) for a, b, c in rows)
    broken = df.withColumn('name', F.raise_error(F.lit('no')).cast('string'))
    with pytest.raises(Exception):
        K.write_csv(broken, os.path.join(tmpdir_path, 'broken'), only_if_nonempty=False)
    assert not glob.glob(os.path.join(tmpdir_path, 'broken', 'part-*'))


def test_two_writers_add_each_key_once(spark, tmpdir_path):
    """A writer that has not seen the other's commit loses the number, looks again and adds only what is missing."""
    from concurrent.futures import ThreadPoolExecutor
    path = os.path.join(tmpdir_path, 'shared')
    parts = [spark.range(a, a + 60).selectExpr('id as k', f'{a} as writer') for a in (0, 30, 50, 30)]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda p: LK.append_new(spark, p, path, 'k').count(), parts))
    assert got == [60] * 4
    rows = LK.read_lookup(spark, path)
    assert rows.count() == rows.select('k').distinct().count() == 110
    assert LK.append_new(spark, parts[0], path, 'k').count() == 60 and LK.read_lookup(spark, path).count() == 110


def test_append_new_lookup(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, 'cache')
    a = spark.createDataFrame([('x', 1.0, True), ('y', None, False)], 'k string, v double, found boolean')
    LK.append_new(spark, a, path, 'k')
    b = spark.createDataFrame([('y', 9.0, True), ('z', 2.0, True)], 'k string, v double, found boolean')
    out = {r.k: r.v for r in LK.append_new(spark, b, path, 'k').collect()}
    assert out == {'y': None, 'z': 2.0}          # cached miss is kept, not re-looked-up
    assert LK.read_lookup(spark, path).count() == 3


def test_json_values_are_strings_at_any_depth(spark, tmpdir_path):
    import datetime
    import decimal
    import json
    import os
    from sitescope.sources import sinks as K
    df = spark.createDataFrame([(1, {'k': (datetime.date(2024, 3, 4), [decimal.Decimal('1.5'), None])}, bytearray(b'x'), None)],
                               'id int, m map<string, struct<d: date, a: array<decimal(3,1)>>>, b binary, s struct<x: int>')
    path = os.path.join(tmpdir_path, 'deep_json')
    K.write_json(df, path)
    line = next(r.value for r in spark.read.text(path).collect())
    assert json.loads(line) == {'id': 1, 'm': {'k': {'d': '2024-03-04', 'a': ['1.5', None]}}, 'b': 'x'}


def test_lookup_keeps_one_row_per_key(spark, tmpdir_path):
    import os
    from sitescope.sources import readers as RD
    path = os.path.join(tmpdir_path, 'lookup_once')
    new = spark.createDataFrame([('a', 1), ('a', 2), ('b', 3)], 'k string, v int')
    assert LK.append_new(spark, new, path, 'k').count() == 2
    assert LK.append_new(spark, new, path, 'k').count() == 2
