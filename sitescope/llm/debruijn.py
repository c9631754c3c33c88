"""Substring deduplication by compaction of a De Bruijn graph.

A word goes if it lies in a window of ``K`` words whose word sequence also
starts in a document with a smaller id. Windows are the edges of a graph whose
nodes are sequences of ``K - 1`` words; an edge leads from its first to its last
``K - 1`` words.

1. Texts of the same words are one: all but the smallest id go whole, and only
   that one enters the graph.
2. Every window belongs to the smallest hash of its ``SEED``-word grams. Grams
   that no second text shares cannot lie in a repeated window; one shuffle of a
   row per text and gram finds the shared ones (grams met more than once in a
   task are settled there and sent once, so a common gram is never gathered).
3. Windows of shared grams become edges. One aggregate gives each edge the
   smallest document that holds it, its source, and keeps the edges with a later one.
4. Nodes with one way in and one way out join their edges. Most joins lead on
   to the source's next word, so a running maximum compacts them to segments;
   what is left is compacted to paths by joins that double their reach.
5. Occurrences that go along a path and its source coordinates together are
   spans. The source's words of every span are digested from its text, and only
   spans whose own words have the same digest are removed.

Rows: a null text has no words, a text of fewer than ``K`` words keeps all. A
null id is smaller than all others. Rows of one id are not smaller than each
other, whether their texts are equal or not. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from sitescope.llm.common import materialise, number_words, offsets, text_blocks
from sitescope.session import drop_table, free_shuffles

K = 13
SEED = 5
#: Requests for digests that one row of a document's text carries.
REQUESTS = 10_000
#: The smallest id there can be: that of a null.
NO_ID = -(1 << 63)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the words' hashes; runs double while they fit."""
    n = max(len(words) - size + 1, 0)
    h, done, step, factor = np.zeros(n, np.uint64), 0, words, _MULTIPLIER
    for bit in range(size.bit_length()):
        width = 1 << bit
        if size & width:
            h = h * factor + step[done:done + n]
            done += width
        if width * 2 <= size:
            step = step[:len(step) - width] * factor + step[width:]
            factor = np.uint64(int(factor) ** 2 % (1 << 64))
    return mix(h)


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every ``size`` consecutive values."""
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def windows(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a block's texts: row, place in the block's words, and the hash of the gram each belongs to."""
    if len(hashes) < K:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.flatnonzero(row[:len(hashes) - K + 1] == row[K - 1:])
    return row[at], at, sliding_least(gram_hashes(hashes, SEED), K - SEED + 1)[at]


def _hashed(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts, their hashes in a row, and where each text's begin."""
    lists = [t.encode().split() for t in texts]
    numbers, sizes, distinct = number_words(lists)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)
    return lists, hashes[numbers] if len(numbers) else np.zeros(0, np.uint64), offsets(sizes)


def _keyed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Blocks of rows (all columns but the last, the text) and their texts."""
    def paired():
        for b in batches:
            keys = pa.StructArray.from_arrays(b.columns[:-1], b.schema.names[:-1])
            yield pa.RecordBatch.from_arrays([keys, b.columns[-1]], ['k', 'text'])
    return text_blocks(paired())


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, text); own tells rows of one id apart."""
    text = F.coalesce(F.col(f'`{text_col}`'), F.lit(''))
    return docs.select(F.coalesce(F.col(f'`{id_col}`').cast('long'), F.lit(NO_ID)).alias('id'), F.xxhash64(text).alias('own'),
                       text.alias('text'))


def _on(left: DataFrame, right: DataFrame, how: str = 'inner') -> DataFrame:
    """Join by (id, own); ``right`` names them id2 and own2."""
    return left.join(right, (left['id'] == right['id2']) & (left['own'] == right['own2']), how)


# --------------------------------------------------------------------------- texts and shared grams

SEQUENCES = pa.schema([('id', pa.int64()), ('own', pa.int64()), ('n', pa.int64()), ('seq', pa.int64()), ('digest', pa.string())])


def _sequences(documents: DataFrame) -> DataFrame:
    """Number of words of every text, and a short and a long hash of their sequence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _keyed_blocks(batches):
            rows = []
            for key, text in zip(keys, texts):
                words = text.encode().split()
                joined = b' '.join(words)
                rows.append((key['id'], key['own'], len(words), xxhash.xxh64_intdigest(joined) - (1 << 63), xxhash.xxh3_128_hexdigest(joined)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SEQUENCES)], schema=SEQUENCES)

    return documents.mapInArrow(run, 'id long, own long, n long, seq long, digest string')


GRAMS = pa.schema([('key', pa.int64()), ('gram', pa.int64()), ('seq', pa.int64()), ('kind', pa.int8())])
SINGLE, SHARED, SETTLED = 0, 1, 2


def _gram_rows(documents: DataFrame) -> DataFrame:
    """Grams that windows belong to, one row a text and gram.

    kind SINGLE: the block holds the gram in one text. SHARED: one row for a
    gram that several of its texts hold; each of these has a SETTLED row,
    whose key deals it out by text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _keyed_blocks(batches):
            lists, hashes, ends = _hashed(texts)
            row, _, gram = windows(hashes, ends)
            if not len(row):
                continue
            new = np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]))
            own = np.array([xxhash.xxh64_intdigest(b' '.join(ws)) - (1 << 63) for ws in lists], np.int64)
            gram, seq = gram[new].view(np.int64), own[row[new]]
            order = np.lexsort((seq, gram))
            gram, seq = gram[order], seq[order]
            new = np.append(True, (gram[1:] != gram[:-1]) | (seq[1:] != seq[:-1]))
            gram, seq = gram[new], seq[new]
            first = np.append(True, gram[1:] != gram[:-1])
            size = np.diff(np.append(np.flatnonzero(first), len(gram)))
            shared = np.repeat(size, size) > 1
            parts = [(gram[~shared], gram[~shared], seq[~shared], SINGLE), (seq[shared], gram[shared], seq[shared], SETTLED),
                     (gram[shared & first], gram[shared & first], seq[shared & first], SHARED)]
            kinds = np.concatenate([np.full(len(p[0]), p[3], np.int8) for p in parts])
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in list(zip(*parts))[:3]), pa.array(kinds)], schema=GRAMS)

    return documents.mapInArrow(run, 'key long, gram long, seq long, kind byte')


def _shared(rows: DataFrame) -> DataFrame:
    """(seq, gram) of all grams that occur in two texts or more; one shuffle, then one pass over sorted rows."""
    schema = pa.schema([('seq', pa.int64()), ('gram', pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told = None, False  # the first row of the last batch's last run, and whether it was given out
        for batch in batches:
            gram, seq, kind = (batch.column(c).to_numpy() for c in (1, 2, 3))
            settled = kind == SETTLED
            out = [(seq[settled], gram[settled])]
            gram, seq, kind = gram[~settled], seq[~settled], kind[~settled]
            if len(gram):
                if first is not None:
                    gram, seq, kind = (np.insert(rest, 0, one) for rest, one in zip((gram, seq, kind), first))
                new = np.append(True, gram[1:] != gram[:-1])
                head, number = np.flatnonzero(new), np.cumsum(new) - 1
                differs = seq != seq[head][number]
                several = np.logical_or.reduceat(differs, head)
                pick = (differs | (kind[head] == SHARED)[number]) & (kind == SINGLE)
                pick[head] = several & (kind[head] == SINGLE)
                if first is not None:
                    pick[0] &= not told
                out.append((seq[pick], gram[pick]))
                told = bool(several[-1]) or (first is not None and told and len(head) == 1)
                first = gram[head[-1]], seq[head[-1]], kind[head[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    dealt = rows.repartition('key').sortWithinPartitions('gram', F.desc('kind'), 'seq')
    return dealt.mapInArrow(run, 'seq long, gram long')


# --------------------------------------------------------------------------- graph

EDGES = pa.schema([('from', pa.int64()), ('to', pa.int64()), ('id', pa.int64()), ('at', pa.int64()), ('again', pa.bool_())])


def _edges(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Windows of shared grams: nodes, id, place (with the text's part in the upper bits), whether the text has it before.

    ``wanted``: id2, own2, part, grams of every text of the graph.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _keyed_blocks(batches):
            _, hashes, ends = _hashed(texts)
            row, at, gram = windows(hashes, ends)
            asked = [np.array(k['grams'], np.int64).view(np.uint64) for k in keys]
            asked_row = np.repeat(np.arange(len(keys), dtype=np.uint64), [len(g) for g in asked])
            new = np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]))[:len(row)]
            own = row[new].astype(np.uint64) * _MULTIPLIER + gram[new]  # a text's grams, told apart from other texts'
            shared = np.isin(own, asked_row * _MULTIPLIER + np.concatenate(asked))
            pick = np.repeat(shared, np.diff(np.append(np.flatnonzero(new), len(row))))
            row, at = row[pick], at[pick]
            if not len(at):
                continue
            node = gram_hashes(hashes, K - 1)
            a, b = node[at], node[at + 1]
            again = np.ones(len(at), bool)
            again[np.unique(mix(a + row.astype(np.uint64) * _MULTIPLIER) + b, return_index=True)[1]] = False
            ids, parts = (np.array([k[c] for k in keys], np.int64) for c in ('id', 'part'))
            columns = a.view(np.int64), b.view(np.int64), ids[row], at - ends[row] + (parts[row] << 32), again
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=EDGES)

    return _on(documents, wanted).select('id', 'own', 'part', 'grams', 'text').mapInArrow(
        run, '`from` long, `to` long, id long, at long, again boolean')


def _sources(edges: DataFrame) -> DataFrame:
    """Distinct edges that documents of several ids hold, with the smallest id and its first place."""
    found = edges.groupBy('from', 'to').agg(F.min('id').alias('sid'), F.max('id').alias('last'),
                                            F.min_by('at', F.when(~F.col('again'), F.col('id'))).alias('sat'))
    return found.where('sid < last').drop('last')


def compact(sources: DataFrame) -> DataFrame:
    """Edges (from, to, sid, sat) with the path they lie on and their place in it.

    Paths are maximal runs of edges joined by nodes with one way in and one way
    out. A ring that leads through several documents stays cut at its segments.
    """
    ends = sources.select(F.inline(F.array(
        F.struct(F.col('from').alias('node'), F.lit(True).alias('out'), 'sid', 'sat'),
        F.struct(F.col('to').alias('node'), F.lit(False).alias('out'), 'sid', 'sat'))))
    out = F.col('out')
    links = ends.groupBy('node').agg(
        F.count_if(out).alias('n_out'), F.count_if(~out).alias('n_in'),
        *[F.max(F.when(side, F.col(c))).alias(name) for side, c, name in (
            (out, 'sid', 'next_id'), (out, 'sat', 'next_at'), (~out, 'sid', 'prev_id'), (~out, 'sat', 'prev_at'))])
    links = links.where('n_out = 1 and n_in = 1').select('next_id', 'next_at', 'prev_id', 'prev_at')
    joined = sources.join(links, (F.col('sid') == F.col('next_id')) & (F.col('sat') == F.col('next_at')), 'left')
    follows = F.coalesce((F.col('prev_id') == F.col('sid')) & (F.col('prev_at') == F.col('sat') - 1), F.lit(False))
    along = Window.partitionBy('sid').orderBy('sat').rowsBetween(Window.unboundedPreceding, 0)
    cut = materialise(joined.select('from', 'to', 'sid', 'sat', 'prev_id', 'prev_at',
                                    F.max(F.when(~follows, F.col('sat'))).over(along).alias('seg')))
    heads = cut.where('sat = seg and prev_id is not null').select('sid', 'seg', 'prev_id', 'prev_at')
    before = cut.select(F.col('sid').alias('root_id'), F.col('sat').alias('prev_at2'), F.col('seg').alias('root_seg'))
    reach = materialise(heads.join(before, (heads['prev_id'] == before['root_id']) & (heads['prev_at'] == before['prev_at2'])).select(
        'sid', 'seg', 'root_id', 'root_seg', (F.col('prev_at') - F.col('root_seg') + 1).alias('off')))
    rounds = max(reach.count(), 1).bit_length() + 1
    for left in range(rounds, -1, -1):  # each round doubles the segments that a row reaches back
        on = reach.select(F.col('sid').alias('root_id'), F.col('seg').alias('root_seg'), F.col('root_id').alias('id3'),
                          F.col('root_seg').alias('seg3'), F.col('off').alias('off3'))
        further = reach.join(on, ['root_id', 'root_seg'], 'left')
        moved = F.col('id3').isNotNull()
        if not left:  # what still moves runs in a ring
            reach = further.where(~moved).select('sid', 'seg', 'root_id', 'root_seg', 'off')
            break
        reach = materialise(further.select('sid', 'seg', F.coalesce('id3', 'root_id').alias('root_id'),
                                           F.coalesce('seg3', 'root_seg').alias('root_seg'),
                                           (F.col('off') + F.coalesce('off3', F.lit(0))).alias('off'), moved.alias('moved')))
        done = not reach.where('moved').limit(1).count()
        reach = reach.drop('moved')
        if done:
            break
    placed = cut.join(reach, ['sid', 'seg'], 'left')
    return placed.select('from', 'to', 'sid', 'sat',
                         F.xxhash64(F.coalesce('root_id', 'sid'), F.coalesce('root_seg', 'seg')).alias('path'),
                         (F.coalesce('off', F.lit(0)) + F.col('sat') - F.col('seg')).alias('offset'))


def _spans(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Later occurrences that follow a path and its source together: id, start, n (words), sid, source."""
    found = edges.join(placed, ['from', 'to']).where('id > sid').select('id', 'at', 'path', 'offset', 'sid', 'sat')
    order = Window.partitionBy('id').orderBy('at')
    goes_on = F.lit(True)
    for c, step in (('at', 1), ('path', 0), ('offset', 1), ('sid', 0), ('sat', 1)):
        goes_on = goes_on & (F.lag(c).over(order) == F.col(c) - step if step else F.lag(c).over(order) == F.col(c))
    begun = found.withColumn('new', (~F.coalesce(goes_on, F.lit(False))).cast('int')).withColumn('span', F.sum('new').over(order))
    return begun.groupBy('id', 'span').agg(F.min('at').alias('start'), (F.count('*') + (K - 1)).alias('n'),
                                           F.min('sid').alias('sid'), F.min('sat').alias('source')).drop('span')


DIGESTS = pa.schema([('sid', pa.int64()), ('source', pa.int64()), ('n', pa.int64()), ('digest', pa.string())])


def span_digest(words: list[bytes]) -> str:
    return xxhash.xxh3_128_hexdigest(b' '.join(words))


def _source_digests(documents: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Digest of the source's words of every span: sid, source, n, digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block in _keyed_blocks(batches):
            rows = []
            for key, text in zip(keys, block):
                words = text.encode().split()
                for r in key['asked']:
                    a = r['source'] & 0xFFFFFFFF
                    rows.append((key['id'], r['source'], r['n'], span_digest(words[a:a + r['n']])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DIGESTS)], schema=DIGESTS)

    asked = spans.select('sid', 'source', 'n').distinct().withColumn('part', F.shiftright('source', 32))
    rows = asked.groupBy('sid', 'part').agg(F.ceil(F.count('*') / REQUESTS).alias('rows'))
    dealt = asked.join(rows, ['sid', 'part']).groupBy('sid', 'part', F.pmod(F.xxhash64('source', 'n'), F.col('rows')).alias('row'))
    lists = dealt.agg(F.collect_list(F.struct('source', 'n')).alias('asked'))
    lists = lists.join(texts, (lists['sid'] == texts['id2']) & (lists['part'] == texts['part2'])).select('id2', 'own2', 'asked')
    return _on(documents, lists).select('id', 'own', 'asked', 'text').mapInArrow(
        run, 'sid long, source long, n long, digest string')


# --------------------------------------------------------------------------- removal

def marks(documents: DataFrame) -> DataFrame:
    """What to remove from each text: (id2, own2, whole, spans of start, n, digest); texts without repeats are absent."""
    spark = documents.sparkSession
    texts = materialise(_sequences(documents).withColumn('part', F.col('seq').bitwiseAND(F.lit(0x7FFFFFFF))).distinct())
    first = texts.groupBy('digest').agg(F.min(F.struct('id', 'own')).alias('f')).select('digest', F.col('f.id').alias('id2'), F.col('f.own').alias('own2'))
    classes = materialise(texts.join(first, 'digest').where(F.col('n') >= K))
    graph = classes.where('id = id2 and own = own2').select('id2', 'own2', F.col('part').alias('part2'), 'seq')
    shared = materialise(_shared(_gram_rows(documents)))
    free_shuffles(spark)
    wanted = shared.join(graph, 'seq').groupBy('id2', 'own2', F.col('part2').alias('part')).agg(F.collect_set('gram').alias('grams'))
    edges = materialise(_edges(documents, wanted))
    drop_table(shared)
    free_shuffles(spark)
    sources = materialise(_sources(edges))
    free_shuffles(spark)
    placed = materialise(compact(sources))
    drop_table(sources)
    free_shuffles(spark)
    spans = materialise(_spans(edges, placed))
    for done in (edges, placed):
        drop_table(done)
    free_shuffles(spark)
    digests = materialise(_source_digests(documents, spans, graph.drop('seq')))
    free_shuffles(spark)
    checked = spans.join(digests, ['sid', 'source', 'n'])
    lists = checked.groupBy(F.col('id').alias('id3'), F.shiftright('start', 32).alias('part3')).agg(F.collect_list(
        F.struct(F.col('start').bitwiseAND(F.lit(0xFFFFFFFF)).alias('start'), 'n', 'digest')).alias('spans'))
    joined = classes.join(lists, (classes['id'] == lists['id3']) & (classes['part'] == lists['part3'])
                          & (classes['id'] == classes['id2']), 'left')
    whole = F.col('id') > F.col('id2')
    return joined.where(whole | F.col('spans').isNotNull()).select(
        F.col('id').alias('id2'), F.col('own').alias('own2'), whole.alias('whole'), 'spans')


def kept_words(words: list[bytes], whole: bool | None, spans: list | None) -> list[bytes]:
    """The words that no checked span covers."""
    if whole:
        return []
    covered = np.zeros(len(words), bool)
    for s in spans or ():
        own = words[s['start']:s['start'] + s['n']]
        if span_digest(own) == s['digest']:
            covered[s['start']:s['start'] + s['n']] = True
    return [w for w, c in zip(words, covered.tolist()) if not c] if covered.any() else words


ADDED = ('n_words', 'n_removed', 'kept_sha256')


def dedup_substrings(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text', keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) without the repeated words of ``text_col``.

    Adds n_words (before), n_removed and kept_sha256 (of the kept words, joined
    by one space), in place of columns of these names. A text that loses words
    becomes its kept words joined by one space; all others stay to the byte.
    """
    documents = _documents(docs, id_col, text_col)
    kept = [f for f in docs.schema.fields if f.name not in ADDED and (keep is None or f.name in keep)]
    fields = [*kept, StructField('n_words', LongType()), StructField('n_removed', LongType()), StructField('kept_sha256', StringType())]
    text_at = next((i for i, f in enumerate(kept) if f.name == text_col), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wholes, lists = (batch.column(i).to_pylist() for i in range(3))
            new, rows = [], []
            for text, whole, spans in zip(texts, wholes, lists):
                words = (text or '').encode().split()
                left = kept_words(words, whole, spans) if whole or spans else words
                joined = b' '.join(left)
                rows.append((len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest()))
                if text_at is not None:
                    new.append(text if len(left) == len(words) else joined.decode())
            columns = batch.columns[3:]
            if text_at is not None:
                columns[text_at] = pa.array(new, columns[text_at].type)
            added = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(added, (pa.int64(), pa.int64(), pa.string())))],
                                             [f.name for f in fields])

    found = marks(documents)
    named = docs.select(F.struct(*[F.col(f'`{f.name}`') for f in kept]).alias('row'), F.coalesce(F.col(f'`{id_col}`').cast('long'), F.lit(NO_ID)).alias('id'),
                        F.col(f'`{text_col}`').alias('text'))
    named = named.withColumn('own', F.xxhash64(F.coalesce('text', F.lit(''))))
    joined = _on(named, found, 'left').select('text', 'whole', 'spans', *[F.col('row')[f.name].alias(f'c{i}') for i, f in enumerate(kept)])
    return joined.mapInArrow(run, StructType(fields))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (
  select doc_id, i, md5(array_to_string(ws[i + 1:i + 13], ' ')) as h
  from (select doc_id, ws, unnest(range(0, len(ws) - 12)) as i from w where len(ws) >= 13)),
firsts as (select h, min(doc_id) as first_id from win group by h),
covered as (
  select distinct doc_id, unnest(range(i, i + 13)) as place from win join firsts using (h) where first_id < doc_id),
words as (select doc_id, unnest(range(0, len(ws))) as place, unnest(ws) as word from w),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by place) as text
  from words anti join covered using (doc_id, place) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(kept.n, 0))::bigint as n_removed,
       sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""
