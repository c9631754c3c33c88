"""SimHash near-duplicates, linked through pigeonring candidate chains.

A fingerprint is cut into ``distance + 1`` segments on a ring. If two
fingerprints differ in at most ``distance`` bits, some segment starts a chain
of consecutive segments whose differences stay within proportional budgets at
every length l: at most floor(l * distance / segments) = l - 1 bits. The first
two budgets become an equi-join key: the starting segment equal, and it and
the next one differing in at most one bit. Rows are dealt by that key, longer
chains are tested where rows meet, and the full Hamming distance comes last.

Only distinct fingerprints are compared, a key's rows give edges that span its
links rather than all pairs, and keys with very many fingerprints are dealt in
blocks, each pair of blocks in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import materialise, plain_names, text_blocks
from sitescope.llm.components import connected_components

BITS = 64
#: Fingerprints of one key that a task compares at a time; more are dealt in blocks.
BLOCK = 16_384
#: Rows of a key up to which all pairs are tried at once; longer ones are walked link by link.
SMALL = 48
CHUNK = 65_536


def fingerprint(text: str, shingle: int) -> int:
    """Fingerprint of one text: bits set in over half of its shingles' hashes."""
    ws = text.encode().lower().split()  # bytes: A-Z, and ASCII white space
    if not ws:
        return 0
    joined = b' '.join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(ws))
    n = len(ws) - width + 1
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        a, b = starts[at:min(at + CHUNK, n)].tolist(), ends[width - 1 + at:width - 1 + min(at + CHUNK, n)].tolist()
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(a, b)], '<u8')
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder='little').sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder='little').view('<u8')[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = 'doc_id', text_col: str = 'text') -> DataFrame:
    """(doc_id, fp long) of every row; a text without words, or null, has fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ['doc_id', 'fp'])

    docs, (id_, text_) = plain_names(docs, id_col, text_col)
    return docs.select(F.col(id_).cast('long').alias('doc_id'), text_).mapInArrow(run, 'doc_id long, fp long')


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of distance + 1 segments that cover the fingerprint."""
    count = distance + 1
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_keys(fps: np.ndarray, distance: int, flips: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (key, variant, place in ``fps``) of chains of two segments.

    Every start gives the exact key. With ``flips`` each zero bit of the second
    segment gives a key with that bit set: of two fingerprints a bit apart
    there, one reaches the other's exact key, so each pair meets once.
    """
    ring = segments(distance)
    keys, variant, places = [], [], []
    every = np.arange(len(fps))
    for i, (shift, width) in enumerate(ring):
        shift2, width2 = ring[(i + 1) % len(ring)]
        first = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        second = (fps >> np.uint64(shift2)) & np.uint64((1 << width2) - 1)
        head = (np.uint64(i) << np.uint64(width + width2)) | (first << np.uint64(width2))
        keys.append(head | second)
        variant.append(np.zeros(len(fps), bool))
        places.append(every)
        for bit in range(width2) if flips and distance else ():
            own = np.flatnonzero((second >> np.uint64(bit)) & np.uint64(1) == 0)
            keys.append((head | second | np.uint64(1 << bit))[own])
            variant.append(np.ones(len(own), bool))
            places.append(own)
    return np.concatenate(keys).view(np.int64), np.concatenate(variant), np.concatenate(places)


def within_chain(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Pairs with a start whose whole chain keeps every prefix budget; the last budget is ``distance`` in all.

    ``y`` may be one fingerprint. Pairs leave a chain at its first prefix over budget.
    """
    ring = segments(distance)
    differ = x ^ y
    alive = np.zeros(len(differ), bool)
    for start in range(len(ring)):
        places, rest, total = None, differ, np.uint8(0)
        for step in range(len(ring)):
            shift, width = ring[(start + step) % len(ring)]
            total = total + np.bitwise_count(rest >> np.uint64(shift) & np.uint64((1 << width) - 1))
            fits = np.flatnonzero(total <= (step + 1) * distance // len(ring))
            places = fits if places is None else places[fits]
            rest, total = rest[fits], total[fits]
            if not len(places):
                break
        alive[places] = True
    return alive


def spanning_links(fps: np.ndarray, distance: int) -> tuple[list, list]:
    """Edges that connect whatever is linked among ``fps``: a walk that drops what it has reached."""
    left, right, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = within_chain(rest, at, distance)
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    return left, right


def _links_of_runs(key: np.ndarray, fps: np.ndarray, exact: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among the rows of each run of equal keys (exact rows first in a run)."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    exacts = np.add.reduceat(exact.astype(np.int64), start)
    live = (exacts > 0) & (size > 1)
    left, right = [], []
    few = live & (size <= SMALL)
    # Every exact row with all rows after it in its run.
    row_start, row_end = np.repeat(start, size), np.repeat(start + size, size)
    use = np.repeat(few, size) & exact
    rows = np.flatnonzero(use)
    count = (row_end - np.arange(len(key)) - 1)[rows]
    for lo in range(0, len(rows), CHUNK):
        r, c = rows[lo:lo + CHUNK], count[lo:lo + CHUNK]
        x = np.repeat(r, c)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
        good = within_chain(fps[x], fps[y], distance)
        left.append(fps[x[good]])
        right.append(fps[y[good]])
    for s, n in zip(start[live & ~few], size[live & ~few]):
        a, b = spanning_links(np.unique(fps[s:s + n]), distance)
        left += a
        right += b
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(distinct: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``fp`` within ``distance`` bits."""
    def explode(flips: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                key, variant, place = chain_keys(fps, distance, flips)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(variant), pa.array(fps[place].view(np.int64))],
                                                 ['key', 'variant', 'fp'])
        return run

    schema = 'key long, variant boolean, fp long'
    exact = distinct.select('fp').mapInArrow(explode(False), schema)
    hot = materialise(exact.groupBy('key').count().where(F.col('count') > block)
                      .select('key', F.ceil(F.col('count') / block).cast('int').alias('blocks')))
    rows = distinct.select('fp').mapInArrow(explode(True), schema).join(hot, 'key', 'left')
    own = F.pmod(F.xxhash64('fp'), F.coalesce('blocks', F.lit(1))).cast('int')
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce('blocks', F.lit(1)) - 1),
                        lambda j: F.greatest(own, j).cast('long') * (1 << 32) + F.least(own, j))
    dealt = (rows.select('key', 'variant', 'fp', F.explode(pairs).alias('pair'))
             .repartition('key', 'pair').sortWithinPartitions('key', 'pair', 'variant'))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ('key', 'pair', 'fp', 'variant')
        held = None

        def emit(key, pair, fps, variant):
            run = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
            a, b = _links_of_runs(run, fps.view(np.uint64), ~variant, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ['a', 'b'])

        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if not len(new[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield emit(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held:
            yield emit(*held)

    return dealt.mapInArrow(meet, 'a long, b long')


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = 'doc_id', text_col: str = 'text',
                    block: int = BLOCK) -> DataFrame:
    """Near-duplicate class of every row: (doc_id, fingerprint, component_id).

    ``fingerprint`` is 16 lower-case hex digits; rows whose fingerprints differ
    in at most ``distance`` bits are linked, and ``component_id`` is the
    smallest id reachable. Null and empty texts have fingerprint zero and link
    like any other. Rows with a null id take part but give no id; a class of
    such rows alone has a null ``component_id``. Repeated rows stay.
    """
    marked = materialise(fingerprints(docs, shingle, id_col, text_col))
    distinct = materialise(marked.groupBy('fp').agg(F.min('doc_id').alias('least')))
    roots = connected_components(links(distinct, distance, block)).select(F.col('node').alias('fp'), 'root')
    labelled = distinct.join(roots, 'fp', 'left').select('fp', 'least', F.coalesce('root', 'fp').alias('root'))
    smallest = labelled.groupBy('root').agg(F.min('least').alias('component_id'))
    classes = labelled.join(smallest, 'root').select('fp', 'component_id')
    return marked.join(classes, 'fp').select('doc_id', F.lower(F.lpad(F.hex('fp'), 16, '0')).alias('fingerprint'), 'component_id')


def keep_first(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = 'doc_id', text_col: str = 'text') -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id. Rows with null ids stay."""
    classes = near_duplicates(docs, shingle, distance, id_col, text_col)
    drop = classes.where('doc_id <> component_id').select('doc_id').distinct()
    names = docs.columns
    docs, (id_,) = plain_names(docs, id_col)
    return docs.join(drop, docs[id_] == drop['doc_id'], 'left_anti').toDF(*names)
