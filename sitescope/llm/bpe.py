"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The texts of a block are cut into pieces by the vocabulary's pattern, and the
block's *distinct* pieces form the corpus that merges are replayed on: an
inverted index from merge rank (a pair of neighbouring tokens whose joined
bytes have that rank) to word positions is popped in rank order, all its
positions are merged at once, and only the touched neighbours are looked up
and indexed anew. Merges never cross a piece, so cutting the corpus into blocks
changes nothing, needs no shuffle and bounds memory.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sitescope.llm.common import BLOCK_CHARS, gather_ragged, number_words, offsets, plain_names, text_blocks

NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Ranks of a byte-level vocabulary, as arrays for vectorised merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = dict(zip(ranks.values(), ranks))
        self.base = max(ranks.values(), default=0) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int32)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, NONE where the vocabulary has no such token."""
        if not len(self.pair_keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode_piece(self, piece: bytes) -> list[int]:
        """One piece, one merge at a time: lowest rank first, leftmost among equals."""
        ids = [int(self.byte_id[b]) for b in piece]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        span = [1] * len(ids)

        def rank(i: int) -> int | None:
            j = nxt[i]
            return self.ranks.get(piece[i:i + span[i] + span[j]]) if j < len(ids) else None

        heap = [(r, i, 1, 1) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = nxt[i]
            if span[i] != left or j >= len(ids) or span[j] != right:
                continue
            span[i], span[j], ids[i], nxt[i] = left + right, 0, r, nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k, span[k], span[nxt[k]]))
        return [t for t, n in zip(ids, span) if n]

    def encode_corpus(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each piece."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        rest = np.flatnonzero(whole < 0)
        flat, sizes = self._replay([pieces[i] for i in rest])
        counts = np.ones(len(pieces), np.int64)
        counts[rest] = sizes
        out = np.empty(int(counts.sum()), np.int32)
        start = offsets(counts)[:-1]
        known = whole >= 0
        out[start[known]] = whole[known]
        if len(flat):
            own = np.repeat(np.isin(np.arange(len(pieces)), rest), counts)
            out[own] = flat
        return out, counts

    def _replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pieces], np.int64)
        n = int(lengths.sum())
        if not n:
            return np.zeros(0, np.int32), lengths
        token = self.byte_id[np.frombuffer(b''.join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), lengths)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        starts = offsets(lengths)[:-1][lengths > 0]
        prv[starts] = -1
        nxt[starts[1:] - 1] = -1
        nxt[n - 1] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: set[int] = set()

        def enter(at: np.ndarray) -> np.ndarray:
            """Look up the pairs that begin at these positions and index them."""
            right = nxt[at]
            found = np.full(len(at), NONE, np.int32)
            has = right >= 0
            found[has] = self.pair_rank(token[at[has]], token[right[has]])
            rank[at] = found
            at, found = at[found != NONE], found[found != NONE]
            order = np.argsort(found, kind='stable')
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for chunk in np.split(at, cuts) if len(at) else ():
                r = int(rank[chunk[0]])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(chunk)
            return at

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            chunks = index.pop(r)
            at = np.concatenate(chunks) if len(chunks) > 1 else chunks[0]
            at = at[rank[at] == r]
            if len(chunks) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            chained = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
            if chained.any():  # overlapping pairs: leftmost first, so every second of a chain
                place = np.arange(len(at))
                head = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - head) % 2 == 0]
            right = nxt[at]
            after = nxt[right]
            token[at], alive[right], rank[right] = r, False, NONE
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            touched = enter(np.unique(np.concatenate((before[before >= 0], at))))
            # A new pair of lower rank comes before this rank's later positions in
            # the same word, which are merged already: such a word is done singly.
            if len(lower := touched[rank[touched] < r]):
                several = word[at][1:][word[at][1:] == word[at][:-1]]
                odd.update(np.intersect1d(word[lower], several).tolist())
        sizes = np.bincount(word[alive], minlength=len(pieces))
        flat = token[alive]
        if odd:
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for w in odd:
                parts[w] = np.array(self.encode_piece(pieces[w]), np.int32)
                sizes[w] = len(parts[w])
            flat = np.concatenate(parts)
        return flat, sizes

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        numbers, pieces_per_text, pieces = number_words(map(self.split, texts))
        flat, sizes = self.encode_corpus([p.encode() for p in pieces])
        ids = gather_ragged(flat, offsets(sizes)[:-1], sizes, numbers)
        ends = offsets(sizes[numbers])[offsets(pieces_per_text)]
        return ids, np.diff(ends)

    def decode(self, ids) -> bytes:
        return b''.join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file (base64 token, rank per line); once per worker."""
    with open(path, 'rb') as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return Vocabulary(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = 'doc_id', text_col: str = 'text',
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Token ids of every whole text: (``id_col``, ``ids`` array<int>).

    ``path`` names a rank file that every executor has, ``pattern`` cuts texts
    into pieces. Null and empty texts have no ids; repeated rows and null ids
    stay as they are, one row out for each row in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path, pattern)
        for keys, texts in text_blocks(batches, block_chars):
            ids, sizes = vocabulary.encode_block(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema_id), lists], [id_col, 'ids'])

    schema_id = arrow_type(docs, id_col)
    plain, columns = plain_names(docs, id_col, text_col)
    source = plain.select(*columns)
    return source.mapInArrow(run, f'`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>')


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = 'doc_id', ids_col: str = 'ids') -> DataFrame:
    """Bytes of every row's ids: (``id_col``, ``decoded`` binary); null ids decode to nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path, pattern)
        for batch in batches:
            parts = [vocabulary.decode(row or ()) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], [id_col, 'decoded'])

    source = encoded.select(id_col, ids_col)
    return source.mapInArrow(run, f'`{id_col}` {source.schema[0].dataType.simpleString()}, decoded binary')


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = 'doc_id', text_col: str = 'text',
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode and decode in one pass, and return digests instead of the ids.

    Columns: ``id_col``, n_tokens, ids_sha256 (little-endian unsigned 32-bit
    ids), decoded_sha256 (the decoded bytes). Rows as in :func:`encode`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path, pattern)
        for keys, texts in text_blocks(batches, block_chars):
            ids, sizes = vocabulary.encode_block(texts)
            rows = np.split(ids, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, schema_id), pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(row.astype('<u4')).hexdigest() for row in rows]),
                pa.array([hashlib.sha256(vocabulary.decode(row.tolist())).hexdigest() for row in rows]),
            ], [id_col, 'n_tokens', 'ids_sha256', 'decoded_sha256'])

    schema_id = arrow_type(docs, id_col)
    plain, columns = plain_names(docs, id_col, text_col)
    source = plain.select(*columns)
    return source.mapInArrow(run, f'`{id_col}` {source.schema[0].dataType.simpleString()}, n_tokens long, '
                                  'ids_sha256 string, decoded_sha256 string')


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[column].dataType)
