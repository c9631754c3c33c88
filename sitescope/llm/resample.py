"""Importance resampling of documents towards a target corpus.

1. Features are runs of one to three words, hashed to ``BUCKETS`` buckets by
   their crc32. Every task counts its features; 10,000 sums per table are all
   that reaches the driver, where the log ratios become one gain a bucket.
2. A second scan scores the texts in arrays: a run's crc32 is put together from
   those of its words (a crc is linear, so moving it past n bytes is a table
   lookup for every bit of n), each distinct word of a block is hashed once,
   and gains are summed by row.
3. The exact cutoff is found by weighted medians of medians: every partition
   gives the median of its remaining keys, the median of these, weighted by the
   remaining sizes, is the pivot, and at least a quarter of all remaining keys
   falls away each round. Only the medians reach the driver. Keys up to the
   cutoff are sorted over ranges and numbered.

Rows: a null text has no features. A null id is hashed as an empty id and
comes last among equal scores. Repeated rows are drawn one by one, and where
the cutoff divides rows that are equal in score and id, those of smaller
weight and then of fewer features come first. All columns of the documents
are kept; columns named as a result are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sitescope.llm.common import BLOCK_CHARS, free_names, materialise, number_words
from sitescope.llm.terms import split_terms

BUCKETS = 10_000
RUN = 3
#: The last keys of the selection, sorted on the driver.
LAST_KEYS = 1_000
RESULTS = ('n_words', 'n_features', 'weight', 'score', 'rank')


def _one_byte(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[crc & 255] ^ (crc >> np.uint32(8))


def _apply(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _moves(powers: int = 31) -> np.ndarray:
    """[p, k, v]: what byte k of a crc, of value v, becomes after 2**p zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1)).astype(np.uint32)
    values = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    moves = [_one_byte(values, table)]
    for _ in range(powers - 1):
        moves.append(_apply(moves[-1], moves[-1]))
    return np.stack(moves)


MOVES = _moves()


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each left text followed by its right one, of ``length`` bytes."""
    left, p = left.copy(), 0
    while len(length) and int(length.max()) >> p:
        pick = np.flatnonzero(length >> p & 1)
        left[pick] = _apply(left[pick], MOVES[p])
        p += 1
    return left ^ right


def run_buckets(texts: Sequence[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and (row, bucket) of every feature, one pair of arrays for each length of run."""
    flat, sizes, distinct = number_words(split_terms(t or '') for t in texts)
    own = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    spaced = np.array([zlib.crc32(b' ' + w) for w in distinct], np.uint32)
    length = np.array([len(w) + 1 for w in distinct], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    found, crc = [], own[flat]
    for run in range(1, RUN + 1):
        same = row[:len(crc)] == row[run - 1:]
        found.append((row[:len(crc)][same], (crc[same] % np.uint32(BUCKETS)).astype(np.int64)))
        if run < RUN:
            crc = joined_crc(crc[:-1], spaced[flat[run:]], length[flat[run:]])
    return sizes, found


def _parts(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or '') > chars:
            yield start, i
            start, size = i, 0
        size += len(text or '')
    if start < len(texts):
        yield start, len(texts)


def bucket_counts(docs: DataFrame, text_col: str = 'text', chars: int = BLOCK_CHARS) -> np.ndarray:
    """How often each bucket is met in all texts."""
    schema = pa.schema([('bucket', pa.int64()), ('n', pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _parts(texts, chars):
                for _, bucket in run_buckets(texts[a:b])[1]:
                    total += np.bincount(bucket, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], schema=schema)

    counted = docs.select(F.col(f'`{text_col}`')).mapInArrow(run, 'bucket long, n long')
    counts = np.zeros(BUCKETS, np.int64)
    for r in counted.groupBy('bucket').agg(F.sum('n').alias('n')).collect():  # at most BUCKETS rows
        counts[r['bucket']] = r['n']
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of a thousand times the log ratio of each bucket's smoothed shares."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text_col: str = 'text', keep: Sequence[str] | None = None,
          chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with n_words, n_features and weight."""
    kept = [f for f in docs.schema.fields if f.name not in RESULTS and (keep is None or f.name in keep)]
    fields = [*kept, *(StructField(c, LongType()) for c in RESULTS[:3])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            measured = []
            for a, b in _parts(texts, chars):
                sizes, found = run_buckets(texts[a:b])
                weight = np.zeros(b - a, np.float64)  # whole numbers far below 2**53
                for row, bucket in found:
                    weight += np.bincount(row, gains[bucket], b - a)
                n = sum(np.maximum(sizes - k, 0) for k in range(RUN))
                measured.append((sizes, n, weight.astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*measured)] if measured else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, columns)], [f.name for f in fields])

    columns = [F.col(f'`{f.name}`').alias(f'c{i}') for i, f in enumerate(kept)]  # any names pass, the schema gives them back
    return docs.select(F.col(f'`{text_col}`').alias('text'), *columns).mapInArrow(run, StructType(fields))


def _median(score: np.ndarray, key: np.ndarray) -> tuple[int, int]:
    at = np.lexsort((key, score))[(len(score) - 1) // 2]
    return int(score[at]), int(key[at])


def weighted_median(rows: Sequence[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """The smallest key such that it and all before it hold half of the weight."""
    half, held = sum(n for _, n in rows) / 2, 0
    for key, n in sorted(rows):
        held += n
        if held >= half:
            return key
    raise ValueError('no rows')


def cutoff(keys: DataFrame, k: int, last: int = LAST_KEYS) -> tuple[int, int]:
    """The k-th smallest (score, key) of a table of these two long columns; 1 <= k <= rows.

    Each round reads the table twice, once for the partitions' medians and once
    for the pivot's place; at least a quarter of the remaining keys is
    discarded. The last few keys are sorted directly.
    """
    schema = pa.schema([('score', pa.int64()), ('key', pa.int64()), ('n', pa.int64())])

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        score, key = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        rows = [(*_median(score, key), len(score))] if len(score) else []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                                         [pa.array([], pa.int64())] * 3, schema=schema)

    at, place = F.struct('score', 'key'), k
    rest = keys.select('score', 'key')
    while True:
        found = rest.mapInArrow(medians, 'score long, key long, n long').collect()
        left = sum(r['n'] for r in found)
        if left <= last:
            row = sorted((r['score'], r['key']) for r in rest.collect())[place - 1]
            return row
        pivot = weighted_median([((r['score'], r['key']), r['n']) for r in found])
        value = F.struct(F.lit(pivot[0]).cast('long').alias('score'), F.lit(pivot[1]).cast('long').alias('key'))
        counts = rest.agg(F.count_if(at < value).alias('below'), F.count_if(at == value).alias('same')).first()
        if place <= counts['below']:
            rest = rest.where(at < value)
        elif place <= counts['below'] + counts['same']:
            return pivot
        else:
            rest, place = rest.where(at > value), place - counts['below'] - counts['same']


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = 'rank') -> DataFrame:
    """``rows`` with their place (from 1) in the order: sorted over ranges, numbered by partition."""
    place, part, start = free_names([*rows.columns, name], 'place', 'part', 'start')
    mid = F.monotonically_increasing_id()
    ranged = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, mid))
    sizes = ranged.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count('*').alias('n')).collect()  # one row a partition
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r[part]):
        before.append((r[part], total))
        total += r['n']
    first = rows.sparkSession.createDataFrame(before, f'{part} long, {start} long')
    number = F.col(start) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = ranged.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(first), part)
    return joined.select(*[F.col(f'`{c}`') for c in rows.columns], number.alias(name))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42,
             id_col: str = 'doc_id', text_col: str = 'text', target_col: str = 'text',
             keep: Sequence[str] | None = None) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``min_words`` words, likest to the target first.

    A document's score is its weight plus a Gumbel term from its id's hash, so
    the highest scores are a sample without replacement by importance. Returns
    ``docs`` (the columns ``keep``, or all) with n_words, n_features, weight,
    score and rank, which is null for what is not drawn.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    doc_id = F.col(f'`{id_col}`')
    digest = F.sha2(F.concat(F.lit(f'{seed}:'), F.coalesce(doc_id.cast('string'), F.lit(''))).cast('binary'), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast('double')
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast('long')
    scored = materialise(weigh(docs, gains, text_col, keep).withColumn('score', F.col('weight') + noise))
    enough = F.col('n_words') >= min_words
    k = percent * scored.where(enough).count() // 100
    columns = [F.col(f'`{c}`') for c in scored.columns]
    if not k:
        return scored.withColumn('rank', F.lit(None).cast('long'))
    key = F.coalesce(doc_id.cast('long'), F.lit((1 << 63) - 1))
    keys = scored.where(enough).select((-F.col('score')).alias('score'), key.alias('key'))
    last = cutoff(materialise(keys), k)
    ahead = (-F.col('score') < last[0]) | ((-F.col('score') == last[0]) & (key <= last[1]))
    drawn = numbered(scored.where(enough & ahead), [F.desc('score'), key, F.col('weight'), F.col('n_features')])
    drawn = drawn.withColumn('rank', F.when(F.col('rank') <= k, F.col('rank')))
    return drawn.unionByName(scored.where(~(enough & ahead)).select(*columns, F.lit(None).cast('long').alias('rank')))


# A crc32 is the xor of what every byte contributes by its distance from the end, and of a term for the length.
ORACLE = r"""
with recursive bits(b, k, v) as (
  select range, 0, range from range(256) union all
  select b, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
tab as (select b, v from bits where k = 8),
words as (
  select 'd' as side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
runs as (
  select side, doc_id, unnest(ws) as f from words union all
  select side, doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from words union all
  select side, doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) from words),
distinct_runs as (select f, hex(encode(f)) as h, octet_length(encode(f)) as n from (select distinct f from runs)),
most as (select max(n) as n from distinct_runs),
moved(d, b, v) as (
  select 0, b, v from tab union all
  select d + 1, m.b, xor(t.v, m.v >> 8) from moved m join tab t on t.b = m.v & 255 where d < (select n from most)),
empty(n, v) as (
  select 0, 4294967295 union all
  select n + 1, xor(t.v, e.v >> 8) from empty e join tab t on t.b = e.v & 255 where n < (select n from most)),
bytes as (select f, n, n - 1 - i as d, ('0x' || substr(h, 2 * i + 1, 2))::int as b from (select f, h, n, unnest(range(n)) as i from distinct_runs)),
hashed as (
  select f, xor(xor(bit_xor(m.v), any_value(e.v)), 4294967295) % 10000 as bucket
  from bytes join moved m using (d, b) join empty e using (n) group by f),
met as (select side, doc_id, bucket from runs join hashed using (f)),
per_bucket as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from met group by bucket),
totals as (select sum(s)::bigint as s_all, sum(t)::bigint as t_all from per_bucket),
gains as (
  select bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::double / ((s + 1) * (t_all + 10000))::double))::bigint as gain
  from per_bucket, totals),
weighed as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from met join gains using (bucket) where side = 'd' group by doc_id),
scored as (
  select w.doc_id, len(w.ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from words w left join weighed using (doc_id) where w.side = 'd'),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_words >= 20)
select s.doc_id, n_features, weight, score, case when place <= 5 * n // 100 then place end as rank from scored s left join placed using (doc_id)
"""
