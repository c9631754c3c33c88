"""Repeated passages by sparse suffix arrays.

A word is repeated if it lies in a window of ``LENGTH`` words that occurs at an
earlier place of the corpus, in the order of (id, place). Of all suffixes of a
text (by words) only those at minimiser positions are retained: the leftmost
smallest hash of the SEED-word grams that begin in the first words of a window.
The choice depends on the window's own words alone, so equal windows retain
equal suffixes, and each window belongs to exactly one of them.

1. Retained suffixes whose leading gram occurs once are dropped (one aggregate).
2. The others are sorted by their words over ranges of the whole corpus, and
   neighbours are compared. A suffix whose context equals its neighbour's is
   repeated as a whole. Otherwise the longest common prefix with either
   neighbour bounds how far a match extends to the right, and which of the
   suffix's windows, reaching left of it, can have a match at all.
3. Those windows are hashed (128 bits), which settles exactly how far a match
   extends left and right and where each window occurs first.

Exact copies of a whole text never enter the array: one aggregate on digests
finds them. Ranges split common passages over tasks, so no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import materialise, number_words, offsets, plain_names, text_blocks
from sitescope.llm.native import words

LENGTH = 50
SEED = 20
REACH = LENGTH - SEED + 1
MULTIPLIER = 0x9E3779B97F4A7C15


def split_words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, in UTF-8."""
    return text.encode().split()


class Hasher:
    """Hashes of word windows by a polynomial over the words' own hashes (wrapping at 64 bits)."""

    def __init__(self, longest: int):
        base = np.uint64(MULTIPLIER)
        back = np.uint64(pow(MULTIPLIER, -1, 1 << 64))
        self.power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(longest, base))))
        self.inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(longest, back))))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        sums = np.concatenate(([np.uint64(0)], np.cumsum(words * self.power[:len(words)], dtype=np.uint64)))
        n = len(words) - size + 1
        return mix((sums[size:] - sums[:n]) * self.inverse[:n])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def retained(words: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Retained suffixes of one text of at least LENGTH words.

    Returns (place, gram, first window, last window) of each suffix, and the
    windows that occur earlier in the same text. A suffix all of whose windows
    do is left out: its first occurrence stands for it.
    """
    grams = hasher.windows(words, SEED)
    least = np.lib.stride_tricks.sliding_window_view(grams, REACH).argmin(axis=1)
    owner = least + np.arange(len(least))  # of each window; never falls
    whole = hasher.windows(words, LENGTH)
    again = np.zeros(len(whole), bool)
    order = np.argsort(whole, kind='stable')
    again[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    fresh = np.add.reduceat(~again, first) > 0
    place = owner[first]
    return place[fresh], grams[place[fresh]], first[fresh], last[fresh], np.flatnonzero(again)


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    lists = [split_words(t) for t in texts]
    numbers, sizes, distinct = number_words(lists)
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)
    return hashed[numbers] if len(numbers) else np.zeros(0, np.uint64), offsets(sizes), lists


def _runs(places: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Merge [p, p + size) of ascending places into disjoint spans."""
    if not len(places):
        return []
    cut = np.flatnonzero(places[1:] > places[:-1] + size) + 1
    return [(int(p[0]), int(p[-1]) + size) for p in np.split(places, cut)]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, text) of rows with a text; own tells rows of one id apart."""
    text = F.col(text_col)
    return docs.where(text.isNotNull()).select(F.col(id_col).cast('long').alias('id'), F.xxhash64(text).alias('own'),
                                               text.alias('text'))


def _key_and_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    def paired():
        for b in batches:
            keys = pa.StructArray.from_arrays(b.columns[:-1], b.schema.names[:-1])
            yield pa.RecordBatch.from_arrays([keys, b.columns[-1]], ['k', 'text'])
    return text_blocks(paired())


SUFFIX = pa.schema([('id', pa.int64()), ('own', pa.int64()), ('gram', pa.int64()), ('place', pa.int32()), ('stop', pa.int32())])


def _scan(documents: DataFrame) -> DataFrame:
    """Retained suffixes (gram, place) of all texts, and spans repeated within a text (gram null, place to stop)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _key_and_text(batches):
            hashes, ends, _ = _word_hashes(texts)
            hasher = Hasher(int(np.diff(ends).max(initial=0)))
            parts: list[tuple] = []
            for row, key in enumerate(keys):
                own = hashes[ends[row]:ends[row + 1]]
                if len(own) < LENGTH:
                    continue
                place, gram, _, _, again = retained(own, hasher)
                spans = _runs(again, LENGTH)
                n = len(place) + len(spans)
                parts.append((np.full(n, row), np.concatenate((gram.view(np.int64), np.zeros(len(spans), np.int64))),
                              np.arange(n) >= len(place), np.concatenate((place, [a for a, _ in spans])),
                              np.concatenate((np.zeros(len(place), np.int64), [b for _, b in spans]))))
            if parts:
                row, gram, local, place, stop = (np.concatenate(c) for c in zip(*parts))
                ids = pa.array([k['id'] for k in keys], pa.int64()).take(pa.array(row))
                own = pa.array([k['own'] for k in keys], pa.int64()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, own, pa.array(gram, mask=local), pa.array(place.astype(np.int32)),
                                                  pa.array(stop.astype(np.int32))], schema=SUFFIX)

    return documents.mapInArrow(run, 'id long, own long, gram long, place int, stop int')


def _contexts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Suffixes with their words: rest (from the place on) and before (left to its first window)."""
    fields = [('id', pa.int64()), ('own', pa.int64()), ('place', pa.int32()), ('first', pa.int32()), ('last', pa.int32()),
              ('rest', pa.string()), ('before', pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _key_and_text(batches):
            hashes, ends, lists = _word_hashes(texts)
            hasher = Hasher(int(np.diff(ends).max(initial=0)))
            columns: list[list] = [[] for _ in fields]
            for row, key in enumerate(keys):
                place, _, first, last, _ = retained(hashes[ends[row]:ends[row + 1]], hasher)
                ws = lists[row]
                pick = np.isin(place, key['places'])
                for p, a, b in zip(place[pick].tolist(), first[pick].tolist(), last[pick].tolist()):
                    for column, value in zip(columns, (key['id'], key['own'], p, a, b, b' '.join(ws[p:b + LENGTH]).decode(),
                                                       b' '.join(ws[a:p]).decode())):
                        column.append(value)
                if len(columns[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=schema)
                    columns = [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=schema)

    grouped = wanted.groupBy('id', 'own').agg(F.collect_list('place').alias('places'))
    right = grouped.select(F.col('id').alias('id2'), F.col('own').alias('own2'), 'places')
    joined = documents.join(right, documents['id'].eqNullSafe(right['id2']) & (documents['own'] == right['own2']))
    return joined.select('id', 'own', 'places', 'text').mapInArrow(
        run, 'id long, own long, place int, first int, last int, rest string, before string')


def common_words(a: str, b: str) -> int:
    """How many leading words two suffixes share."""
    x, y = a.split(' '), b.split(' ')
    n = 0
    for p, q in zip(x, y):
        if p != q:
            break
        n += 1
    return n


MATCH = pa.schema([('id', pa.int64()), ('own', pa.int64()), ('start', pa.int32()), ('stop', pa.int32()),
                   ('h1', pa.int64()), ('h2', pa.int64())])


def _neighbours(contexts: DataFrame) -> DataFrame:
    """Sort the suffixes and compare neighbours.

    Rows: spans repeated as a whole (h1 null), and single windows with their
    hashes that may have a match. What lies across a range's border is taken
    for a full match, so borders lose nothing.
    """
    order = ['rest', 'before', 'id', 'own', 'place']
    ranged = contexts.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        seen = None
        current = None  # the last distinct context, and its common words with the one before

        def settle(row: dict, common: int) -> None:
            last = min(row['last'], row['place'] + common - LENGTH)
            if last < row['first']:
                return
            ws = (row['before'].split(' ') if row['before'] else []) + row['rest'].split(' ')
            for start in range(row['first'], last + 1):
                at = start - row['first']
                h = xxhash.xxh3_128_digest(' '.join(ws[at:at + LENGTH]).encode())
                out.append((row['id'], row['own'], start, start + LENGTH, int.from_bytes(h[:8], 'little', signed=True),
                            int.from_bytes(h[8:], 'little', signed=True)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(MATCH)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MATCH)], schema=MATCH)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row['id'], row['own'], row['place'])
                if key == seen:  # a repeated row
                    continue
                seen = key
                if current and row['rest'] == current[0]['rest'] and row['before'] == current[0]['before']:
                    out.append((row['id'], row['own'], row['first'], row['last'] + LENGTH, None, None))
                else:
                    common = LENGTH if current is None else common_words(current[0]['rest'], row['rest'])
                    if current:
                        settle(current[0], max(current[1], common))
                    current = (row, common)
                if len(out) > 50_000:
                    yield flush()
        if current:
            settle(current[0], LENGTH)
        yield flush()

    return ranged.mapInArrow(run, 'id long, own long, start int, stop int, h1 long, h2 long')


def repeated_spans(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text') -> DataFrame:
    """Spans of words [start, stop) that are repeated: (id, own, start, stop), disjoint and in no order.

    ``own`` is the hash of the text (rows that share id and text are one
    document); ``stop`` is never beyond the text's end. The first occurrence
    of every window stays out. Null, empty and short texts have no spans; null
    ids come before all others.
    """
    documents = _documents(docs, id_col, text_col)
    suffixes = materialise(_scan(documents))
    at = F.struct('id', 'own')
    texts = documents.select('id', 'own', F.md5('text').alias('digest'), F.size(words(F.col('text'))).alias('n'))
    texts = materialise(texts.where(F.col('n') >= LENGTH))
    originals = texts.groupBy('digest').agg(F.min(at).alias('original'), F.count('*').alias('c')).where('c > 1')
    copies = (texts.join(originals, 'digest').where(~at.eqNullSafe(F.col('original')))
              .select('id', 'own', F.lit(0).alias('start'), F.col('n').alias('stop')))
    copies = materialise(copies)
    grams = suffixes.where('gram is not null')
    where = F.struct('own', 'place')
    repeated = (grams.groupBy('gram').agg(F.min(where).alias('a'), F.max(where).alias('b'))
                .where('a <> b').select('gram'))
    copied = copies.select(F.col('id').alias('id2'), F.col('own').alias('own2')).distinct()
    wanted = grams.join(repeated, 'gram').select('id', 'own', 'place')
    wanted = wanted.join(copied, wanted['id'].eqNullSafe(copied['id2']) & (wanted['own'] == copied['own2']), 'left_anti')
    contexts = materialise(_contexts(documents, wanted))
    matches = materialise(_neighbours(contexts))
    windows = matches.where('h1 is not null').select('id', 'own', 'start', 'h1', 'h2')
    here = F.struct('id', 'own', 'start')
    firsts = windows.groupBy('h1', 'h2').agg(F.min(here).alias('first'), F.count('*').alias('c')).where('c > 1')
    later = (windows.join(firsts.select('h1', 'h2', 'first'), ['h1', 'h2']).where(~here.eqNullSafe(F.col('first')))
             .select('id', 'own', 'start', (F.col('start') + LENGTH).alias('stop')))
    spans = (later.unionByName(matches.where('h1 is null').select('id', 'own', 'start', 'stop'))
             .unionByName(suffixes.where('gram is null').select('id', 'own', F.col('place').alias('start'), 'stop'))
             .unionByName(copies))
    return _merged(spans)


def _merged(spans: DataFrame) -> DataFrame:
    """Unite overlapping and touching spans of each document."""
    sorted_ = F.sort_array(F.collect_set(F.struct('start', 'stop')))
    start = F.array().cast('array<struct<start:int,stop:int>>')

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last.start.alias('start'), F.greatest(last.stop, s.stop).alias('stop'))))
        return F.when((F.size(done) > 0) & (s.start <= F.get(done, F.size(done) - 1).stop), joined).otherwise(
            F.concat(done, F.array(s)))

    grouped = spans.groupBy('id', 'own').agg(sorted_.alias('spans'))
    return grouped.select('id', 'own', F.inline(F.aggregate('spans', start, add)))


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans, each taken with the white space after it."""
    raw = text.encode()
    ws = raw.split()
    starts, at = [], 0
    for w in ws:
        at = raw.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(raw))
    out, kept = [], 0
    for s in sorted((s['start'], s['stop']) for s in spans):
        out.append(raw[kept:starts[s[0]]])
        kept = starts[min(s[1], len(ws))]
    return b''.join([*out, raw[kept:]]).decode()


def dedup_passages(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text') -> DataFrame:
    """``docs`` without the repeated words of ``text_col``; all rows and columns stay.

    Texts without a repeat keep every byte; a text that is repeated as a whole
    becomes empty. Rows with the same id and text get the same text. Ids are
    whole numbers; all other columns stay as they are, whatever their names.
    """
    names = docs.columns
    docs, (id_, text_) = plain_names(docs, id_col, text_col)
    spans = repeated_spans(docs, id_, text_)
    found = spans.groupBy('id', 'own').agg(F.collect_list(F.struct('start', 'stop')).alias('spans'))

    @F.pandas_udf('string')
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or s is None else cut_spans(t, s) for t, s in zip(texts, lists)], dtype=object)

    joined = docs.join(found, docs[id_].cast('long').eqNullSafe(found['id'])
                       & (F.xxhash64(docs[text_]) == found['own']), 'left')
    hit = F.col('spans').isNotNull()
    done = joined.withColumn('cut', cut(F.when(hit, F.col(text_)), F.col('spans')))
    return done.select(*[(F.when(hit, F.col('cut')).otherwise(F.col(c)) if c == text_ else F.col(c)).alias(name)
                         for c, name in zip(docs.columns, names)])


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from documents where text is not null),
win as (
  select doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) as h
  from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as i from w where len(ws) >= 50)),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as nth from win) where nth > 1),
marked as (
  select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from later),
grouped as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as g from marked)
select doc_id, min(i)::int as span_start, (max(i) + 50)::int as span_end from grouped group by doc_id, g
"""
