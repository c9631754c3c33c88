"""Ranked lexical search over bit-sliced Bloom signatures.

Index. Documents of similar size form a chunk of up to ``CHUNK`` rows. A
document sets ``HASHES`` bits for every term it holds, and as many for each
level 2, 4, 8, ... that the term's frequency reaches. Bits are kept by slice:
one bitmap over the chunk's documents for each bit position.

Search. The bitmaps of a term's bits, and-ed, hold every document with the
term and a few more; the levels bound its frequency from above. The weighted
sums of these bounds are an upper bound of every document's score.

1. The best bounds of each item give ``top`` documents whose exact scores are
   computed; the last of them is a score that the item's result surely reaches.
2. A second scan of the bitmaps keeps every document whose bound is not below
   that score. Their texts are read and scored exactly, so nothing is lost.

Items are searched in blocks of ``ITEMS``; what a block sends to the tasks is
its items' terms and at most ``ITEMS * top`` document ids.

Rows: a null text has no terms. Every row is a document of its own, also where
ids or texts repeat; a null id comes after all others among equal scores. An
item without a term, or one that no document matches, has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitescope.llm.common import BLOCK_CHARS, materialise, number_words, text_blocks
from sitescope.llm.terms import split_terms

CHUNK = 1024
HASHES = 3
BITS = 10
TOP = 20
ITEMS = 500
#: Terms of an item that are looked up at a time.
SLICE = 256

INDEX = pa.schema([('ids', pa.list_(pa.int64())), ('owns', pa.list_(pa.int64())), ('lengths', pa.list_(pa.int64())),
                   ('bits', pa.int64()), ('slices', pa.binary())])
INDEX_DDL = 'ids array<long>, owns array<long>, lengths array<long>, bits long, slices binary'


def bit_places(hashes: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """[HASHES, n]: the bit positions of terms at a level of frequency (0: once, 1: twice, 2: four times, ...)."""
    h = hashes + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(HASHES)])


def _chunks(tokens: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of similar numbers of tokens: at most twice the group's least."""
    order = np.argsort(tokens, kind='stable')
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or i - start == CHUNK or tokens[order[i]] > max(64, 2 * tokens[order[start]]):
            yield order[start:i]
            start = i


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, text); own tells rows of one id apart."""
    text = F.coalesce(F.col(f'`{text_col}`'), F.lit(''))
    return docs.select(F.col(f'`{id_col}`').cast('long').alias('id'), F.xxhash64(text).alias('own'), text.alias('text'))


def _keyed_blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """Blocks of (id, own, further columns) and texts."""
    def paired():
        for b in batches:
            keys = pa.StructArray.from_arrays(b.columns[:-1], b.schema.names[:-1])
            yield pa.RecordBatch.from_arrays([keys, b.columns[-1]], ['k', 'text'])
    return text_blocks(paired(), chars)


def build_index(docs: DataFrame, id_col: str = 'doc_id', text_col: str = 'text', chars: int = BLOCK_CHARS) -> DataFrame:
    """Signature chunks of all documents with a term: ids, owns, lengths (terms a document), bits, slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _keyed_blocks(batches, chars):
            flat, sizes, distinct = number_words(map(split_terms, texts))
            if not len(flat):
                continue
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pairs, tf = np.unique(row * len(distinct) + flat, return_counts=True)
            row, term = pairs // len(distinct), pairs % len(distinct)
            levels = np.floor(np.log2(tf)).astype(np.int64) + 1
            level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
            row, term = np.repeat(row, levels), np.repeat(term, levels)
            tokens = np.bincount(row, minlength=len(sizes))
            ends = np.concatenate(([0], np.cumsum(tokens)))
            for rows in _chunks(tokens):
                rows = rows[sizes[rows] > 0]
                if not len(rows):
                    continue
                bits = BITS * max(64, int(tokens[rows].max()))
                table = np.zeros((bits, len(rows)), bool)
                for at, r in enumerate(rows):
                    own = slice(ends[r], ends[r + 1])
                    table[bit_places(hashes[term[own]], level[own], bits), at] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([[keys[r]['id'] for r in rows]], INDEX.field(0).type), pa.array([[keys[r]['own'] for r in rows]], INDEX.field(1).type),
                     pa.array([sizes[rows].tolist()], INDEX.field(2).type), pa.array([bits], pa.int64()),
                     pa.array([np.packbits(table, axis=1).tobytes()], pa.binary())], schema=INDEX)

    return _documents(docs, id_col, text_col).mapInArrow(run, INDEX_DDL)


def document_counts(docs: DataFrame, vocabulary: Sequence[bytes], text_col: str = 'text', chars: int = BLOCK_CHARS) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""
    schema = pa.schema([('term', pa.int64()), ('n', pa.int64())])
    numbers = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wanted = Counter(), numbers.keys()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(wanted & set(split_terms(text or '')))
        yield pa.RecordBatch.from_arrays([pa.array([numbers[w] for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                         schema=schema)

    found = docs.select(F.col(f'`{text_col}`')).mapInArrow(run, 'term long, n long').groupBy('term').agg(F.sum('n').alias('n'))
    df = np.zeros(len(vocabulary), np.int64)
    for r in found.collect():  # at most one row a term
        df[r['term']] = r['n']
    return df


@dataclass
class Block:
    """Items whose terms are numbered together, with the corpus' figures."""
    ids: list
    terms: list[np.ndarray]    # of each item, its distinct terms
    factors: list[np.ndarray]  # weight times repeats
    vocabulary: list[bytes]
    hashes: np.ndarray
    documents: int
    words: int

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        """m of the contract: 75 and a part that grows with a document's length."""
        return 75 + (25 * lengths * self.documents) // self.words


def share(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score; it grows with tf. ``tf`` above 0."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


def bounds(block: Block, item: int, lengths: np.ndarray, bits: int, slices: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of a chunk's documents for an item."""
    n, norm = len(lengths), block.norm(lengths)
    total = np.zeros(n, np.int64)
    for a in range(0, len(block.terms[item]), SLICE):
        terms, factor = block.terms[item][a:a + SLICE], block.factors[item][a:a + SLICE]
        hashes = block.hashes[terms]
        most = np.zeros((len(terms), n), np.int64)
        level, alive = 0, np.arange(len(terms))
        while len(alive):
            held = np.bitwise_and.reduce(slices[bit_places(hashes[alive], level, bits)], axis=0)
            held = np.unpackbits(held, axis=1, count=n).astype(bool)
            if level:
                held &= most[alive] == (1 << level) - 1  # the level below was held
            most[alive] = np.where(held, (2 << level) - 1, most[alive])
            alive = alive[held.any(axis=1)]
            level += 1
        at_term, at_doc = np.nonzero(most)
        tf = np.minimum(most[at_term, at_doc], lengths[at_doc])
        total += np.bincount(at_doc, factor[at_term] * share(tf, norm[at_doc]), n).astype(np.int64)
    return total


def exact_scores(block: Block, numbers: dict[bytes, int], words: list[bytes], items: Sequence[int]) -> list[int]:
    """A document's scores for some items; ``numbers`` are those of the block's vocabulary."""
    counts = Counter(w for w in words if w in numbers)
    if not counts:
        return [0] * len(items)
    terms = np.array([numbers[w] for w in counts], np.int64)
    shares = np.zeros(len(block.vocabulary), np.int64)
    shares[terms] = share(np.array(list(counts.values()), np.int64), block.norm(np.array(len(words), np.int64)))
    return [int(block.factors[i] @ shares[block.terms[i]]) for i in items]


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        bits = batch['bits'][i].as_py()
        ids, owns = batch['ids'][i].values, batch['owns'][i].values
        slices = np.frombuffer(batch['slices'][i].as_buffer(), np.uint8).reshape(bits, -1)
        yield ids, owns, batch['lengths'][i].values.to_numpy(), bits, slices


PAIRS = pa.schema([('item', pa.int32()), ('id', pa.int64()), ('own', pa.int64()), ('bound', pa.int64())])
PAIRS_DDL = 'item int, id long, own long, bound long'


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    item = np.concatenate([np.full(len(b), i, np.int32) for i, _, _, b in found]) if found else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(item), pa.concat_arrays([x[1] for x in found]) if found else pa.array([], pa.int64()),
         pa.concat_arrays([x[2] for x in found]) if found else pa.array([], pa.int64()),
         pa.array(np.concatenate([x[3] for x in found]) if found else np.zeros(0, np.int64))], schema=PAIRS)


def best_bounds(index: DataFrame, block: Block, top: int = TOP) -> DataFrame:
    """(item, id, own, bound): the ``top`` documents of the highest bounds above 0 of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = [None] * len(block.ids)
        for batch in batches:
            for ids, owns, lengths, bits, slices in _rows_of(batch):
                for item in range(len(block.ids)):
                    bound = bounds(block, item, lengths, bits, slices)
                    pick = np.argpartition(-bound, min(top, len(bound)) - 1)[:top]
                    pick = pick[bound[pick] > 0]
                    new = (item, ids.take(pa.array(pick)), owns.take(pa.array(pick)), bound[pick])
                    if best[item] is not None:
                        old = best[item]
                        new = (item, pa.concat_arrays([old[1], new[1]]), pa.concat_arrays([old[2], new[2]]), np.concatenate((old[3], new[3])))
                        pick = np.argsort(-new[3], kind='stable')[:top]
                        new = (item, new[1].take(pa.array(pick)), new[2].take(pa.array(pick)), new[3][pick])
                    best[item] = new
        yield _pairs([b for b in best if b is not None])

    return _top(index.mapInArrow(run, PAIRS_DDL), [F.desc('bound'), 'id', 'own'], top)


def _top(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The first rows of every item; Spark limits each task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy('item').orderBy(*order))
    return rows.withColumn('rank', place).where(F.col('rank') <= top)


def not_excluded(index: DataFrame, block: Block, least: Sequence[int]) -> DataFrame:
    """(item, id, own, bound) of every document whose bound is not below the item's least score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, owns, lengths, bits, slices in _rows_of(batch):
                found = []
                for item in range(len(block.ids)):
                    bound = bounds(block, item, lengths, bits, slices)
                    pick = np.flatnonzero(bound >= least[item])
                    if len(pick):
                        found.append((item, ids.take(pa.array(pick)), owns.take(pa.array(pick)), bound[pick]))
                if found:
                    yield _pairs(found)

    return index.mapInArrow(run, PAIRS_DDL)


def rescore(documents: DataFrame, pairs: DataFrame, block: Block, small: bool, chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, id, score) of the pairs' documents, scored by their whole texts; ``small``: at most ITEMS * top pairs."""
    schema = pa.schema([('item', pa.int32()), ('id', pa.int64()), ('score', pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {w: i for i, w in enumerate(block.vocabulary)}
        for keys, texts in _keyed_blocks(batches, chars):
            columns: list[list] = [[], [], []]
            for key, text in zip(keys, texts):
                columns[0] += key['items']
                columns[1] += [key['id']] * len(key['items'])
                columns[2] += exact_scores(block, numbers, split_terms(text), key['items'])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    wanted = pairs.groupBy(F.col('id').alias('id2'), F.col('own').alias('own2')).agg(F.collect_set('item').alias('items'))
    wanted = F.broadcast(wanted) if small else wanted
    joined = documents.join(wanted, documents['id'].eqNullSafe(wanted['id2']) & (documents['own'] == wanted['own2']))
    return joined.select('id', 'own', 'items', 'text').mapInArrow(run, 'item int, id long, score long')


def read_block(items: list[tuple], docs: DataFrame, text_col: str, documents: int, words: int) -> Block:
    """Number the items' terms and weigh them by the documents that hold them."""
    counts = [Counter(split_terms(text or '')) for _, text in items]
    vocabulary = sorted(set().union(*counts))
    numbers = {w: i for i, w in enumerate(vocabulary)}
    df = document_counts(docs, vocabulary, text_col)
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df]
    terms = [np.array([numbers[w] for w in c], np.int64) for c in counts]
    factors = [np.array([weight[numbers[w]] * n for w, n in c.items()], np.int64) for c in counts]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
    return Block([i for i, _ in items], terms, factors, vocabulary, hashes, documents, words)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = 'doc_id', text_col: str = 'text',
           item_col: str = 'item_id', item_text: str = 'text', at_a_time: int = ITEMS) -> DataFrame:
    """The ``top`` best documents of every item: item_id (as in ``items``), rank, doc_id, score.

    ``items`` may be larger than a block; each block is one pass over the index.
    """
    spark = docs.sparkSession
    index = materialise(build_index(docs, id_col, text_col))
    totals = index.agg(F.sum(F.size('ids')).alias('documents'),
                       F.sum(F.aggregate('lengths', F.lit(0).cast('long'), lambda a, x: a + x)).alias('words')).first()
    kind = f'`{item_col}` {items.schema[item_col].dataType.simpleString()}'
    found = spark.createDataFrame([], f'{kind}, rank int, `{id_col}` long, score long')
    n = items.count()
    if not n or not totals['documents']:
        return found
    blocks = -(-n // at_a_time)
    asked = items.select(F.col(f'`{item_col}`').alias('id'), F.col(f'`{item_text}`').alias('text'))
    asked = materialise(asked.withColumn('block', F.pmod(F.xxhash64('id', 'text'), F.lit(blocks))))
    documents = _documents(docs, id_col, text_col)
    for number in range(blocks):
        some = [(r['id'], r['text']) for r in asked.where(F.col('block') == number).collect()]  # about at_a_time items
        if not some:
            continue
        block = read_block(some, docs, text_col, totals['documents'], totals['words'])
        seeds = materialise(best_bounds(index, block, top))
        sure: list[list[int]] = [[] for _ in some]
        for r in rescore(documents, seeds, block, small=True).collect():  # at most at_a_time * top distinct documents
            sure[r['item']].append(r['score'])
        least = [max(1, sorted(s)[-top] if len(s) >= top else 1) for s in sure]
        pairs = materialise(not_excluded(index, block, least))
        scored = rescore(documents, pairs, block, small=False).where('score > 0')
        ranked = _top(scored, [F.desc('score'), F.asc_nulls_last('id')], top)
        names = spark.createDataFrame([(r, i) for i, r in enumerate(block.ids)], f'{kind}, item int')
        found = found.unionByName(ranked.join(F.broadcast(names), 'item').select(
            F.col(f'`{item_col}`'), F.col('rank').cast('int'), F.col('id').alias(id_col), 'score'))
    return found


ORACLE = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
asked as (
  select item_id, term, count(*) as k from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
lengths as (select doc_id, count(*) as n from terms group by doc_id),
corpus as (select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
tf as (select doc_id, term, count(*) as tf from terms where term in (select term from asked) group by all),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, corpus group by term),
scores as (
  select a.item_id, tf.doc_id,
         sum(a.k * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * l.n * c.n_docs) // c.n_terms))))::bigint as score
  from asked a join tf using (term) join weights w using (term) join lengths l using (doc_id), corpus c group by all)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 20
"""
