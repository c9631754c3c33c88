"""Line deduplication by overlapping windows of three lines, with DataFrame functions only.

Every three consecutive lines of a document are hashed (96 bits). Windows that
occur again anywhere are found by one aggregate, which partial aggregation
spreads however common a window is; the occurrence with the smallest
(id, place) stays. All lines that a later occurrence covers are removed; the
covered positions of a document are merged first, so overlapping windows
remove each line once.

Each removed line equals a line at an earlier place that some chain of windows
leads to and that stays, so no line's text vanishes from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import plain_names
from sitescope.llm.native import is_blank, let, lines

WINDOW = 3


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per window of a document's lines; a window of blank lines is none."""
    text = F.col(text_col)
    cut = docs.select(F.col(id_col).alias('id'), F.xxhash64(text).alias('own'), lines(text).alias('lines'))
    starts = F.greatest(F.size('lines') - (WINDOW - 1), F.lit(0))
    hashed = F.transform(
        F.arrays_zip(F.slice('lines', 1, starts).alias('a'), F.slice('lines', 2, starts).alias('b'),
                     F.slice('lines', 3, starts).alias('c')),
        lambda w: F.struct(F.xxhash64(w.a, w.b, w.c).alias('h'), F.hash(w.a, w.b, w.c).alias('g'),
                           (is_blank(w.a) & is_blank(w.b) & is_blank(w.c)).alias('blank')))
    rows = cut.where(F.size('lines') >= WINDOW).select('id', 'own', F.posexplode(hashed).alias('place', 'w'))
    return rows.where(~F.col('w.blank')).select('id', 'own', 'place', F.col('w.h').alias('h'), F.col('w.g').alias('g'))


def later_windows(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text') -> DataFrame:
    """Places of all but the first occurrence of every repeated window.

    Columns: id, own (the text's hash, which tells rows of one id apart),
    places array<int> (first line of each later occurrence).
    """
    windows = _windows(docs, id_col, text_col)
    at = F.struct('id', 'own', 'place')
    repeated = (windows.groupBy('h', 'g').agg(F.count('*').alias('n'), F.min(at).alias('first'))
                .where('n > 1').select('h', 'g', 'first'))
    later = windows.join(repeated, ['h', 'g']).where(~at.eqNullSafe(F.col('first')))
    return later.groupBy('id', 'own').agg(F.collect_list('place').alias('places'))


def _kept(all_lines: Column, places: Column) -> Column:
    """Positions that no window starting at one of ``places`` covers."""
    covered = F.flatten(F.transform(places, lambda p: F.sequence(p, p + (WINDOW - 1))))
    return F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), covered)


def dedup_lines(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text') -> DataFrame:
    """``docs`` with repeated line windows removed from ``text_col``.

    Adds n_lines (before) and n_removed_lines, in place of columns of these
    names. Documents without a repeat, and those of fewer than three lines,
    keep their text to the byte. A null text stays null with no lines; a text
    whose every line is removed becomes empty. Rows with the same id and text
    are one document and get the same text; a null id is an id of its own.
    All other columns stay as they are, whatever their names.
    """
    names = docs.columns
    docs, (id_, text_) = plain_names(docs, id_col, text_col)
    later = later_windows(docs, id_, text_)
    joined = docs.join(later, docs[id_].eqNullSafe(later['id']) & (F.xxhash64(docs[text_]) == later['own']), 'left')
    text, places = F.col(text_), F.col('places')
    cut = let(lines(text), lambda ls: let(_kept(ls, places), lambda kept: F.struct(
        F.array_join(F.transform(kept, lambda i: F.get(ls, i)), '\n').alias('text'),
        (F.size(ls) - F.size(kept)).alias('removed'))))
    done = joined.withColumn('cut', F.when(places.isNotNull(), cut))
    columns = [(F.coalesce('cut.text', text) if c == text_ else F.col(c)).alias(name)
               for c, name in zip(docs.columns, names) if name.lower() not in ('n_lines', 'n_removed_lines')]
    return done.select(*columns, F.size(lines(text)).cast('long').alias('n_lines'),
                       F.coalesce(F.col('cut.removed'), F.lit(0)).cast('long').alias('n_removed_lines'))


ORACLE = r"""
with cut as (
  select doc_id, text, case when text is null then [] else string_split(text, chr(10)) end as ls from documents),
windows as (
  select doc_id, i as place, list_slice(ls, i + 1, i + 3) as w
  from (select doc_id, ls, unnest(range(0, len(ls) - 2)) as i from cut where len(ls) >= 3)),
ranked as (
  select doc_id, place, row_number() over (partition by w order by doc_id, place) as nth
  from windows
  where trim(array_to_string(w, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
covered as (
  select distinct doc_id, unnest([place, place + 1, place + 2]) as line from ranked where nth > 1),
rows as (
  select doc_id, unnest(range(0, len(ls))) as line, unnest(ls) as content from cut),
kept as (
  select r.doc_id, count(*) as n, string_agg(r.content, chr(10) order by r.line) as text
  from rows r anti join covered c on r.doc_id = c.doc_id and r.line = c.line group by r.doc_id)
select cut.doc_id, len(cut.ls)::bigint as n_lines, (len(cut.ls) - coalesce(kept.n, 0))::bigint as n_removed_lines,
       case when cut.text is null then null else md5(coalesce(kept.text, '')) end as text_md5
from cut left join kept on kept.doc_id = cut.doc_id
"""
