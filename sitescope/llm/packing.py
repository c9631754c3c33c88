"""Packing of tokenised documents into sequences by a swap-based local search.

Documents are cut into pieces of at most one sequence. Pieces are dealt at
random into blocks of bounded size; each block is packed best-fit first, and a
local search then works on its underfull bins, the emptiest first: pieces
move to fuller bins, and are exchanged one for one, two for one and one for
two, whenever that raises the sum of squared fills, until bins run empty and
no exchange helps.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import gather_ragged, materialise, number_words, offsets, plain_names, text_blocks

CAPACITY = 2048
#: Pieces that one block packs, on average.
BLOCK_PIECES = 20_000
#: Characters that are tokenised together: the more, the fewer distinct words are encoded twice.
BLOCK_TEXT = 16_000_000

# The vocabulary file's own pattern, and the texts for which lower-casing and
# splitting by it are the same in the file's library and here (Latin letters up to U+017F).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sA-Za-z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ]+")
PLAIN = re.compile(r'[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]*')
SPECIAL = '<|'


class Tokenizer:
    """Token ids of whole texts by a vocabulary of the ``tokenizers`` library.

    A block's distinct words are encoded once; texts whose normalising could
    differ from Python's, or that may hold special tokens, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault('TOKENIZERS_PARALLELISM', 'false')  # a task is one thread
        import tokenizers
        self.library = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith('</w>')]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def words(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has; every word ends in one closing id."""
        joined = [' '.join(distinct[i:i + 500]) for i in range(0, len(distinct), 500)]
        coded = self.library.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in coded)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(distinct):
            raise ValueError('the vocabulary does not close each word with one id')
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if SPECIAL not in t and PLAIN.fullmatch(t)]
        # Words never cross white space: text -> chunks -> words -> ids, each distinct one once.
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([texts[i] for i in plain], pa.large_string())))
        coded = split.flatten().dictionary_encode()
        numbers, per_text = coded.indices.to_numpy(), np.diff(split.offsets.to_numpy())
        ids, sizes = self.chunks(coded.dictionary.to_pylist())
        flat = gather_ragged(ids, offsets(sizes)[:-1], sizes, numbers)
        ends = offsets(sizes[numbers])[offsets(per_text)]
        out: list = [None] * len(texts)
        for place, i in enumerate(plain):
            out[i] = flat[ends[place]:ends[place + 1]]
        return [self.whole(t) if x is None else x for t, x in zip(texts, out)]

    def chunks(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers, per_chunk, words = number_words(map(PIECES.findall, distinct))
        ids, sizes = self.words(words)
        ends = offsets(sizes[numbers])[offsets(per_chunk)]
        return gather_ragged(ids, offsets(sizes)[:-1], sizes, numbers), np.diff(ends)


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = 'doc_id',
               text_col: str = 'text', with_ids: bool = False) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is its ids and ``end_id``; only one longer than ``capacity`` is
    cut, into full pieces and a rest. Null and empty texts are ``end_id`` alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        for keys, texts in text_blocks(batches, BLOCK_TEXT):
            rows = []
            for key, ids in zip(keys, tokenizer.encode(texts)):
                ids = np.append(ids, end_id).astype('<u4')
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    rows.append((key, piece, start, len(part), zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows))[:len(schema)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    fields = [('doc_id', pa.int64()), ('piece', pa.int32()), ('start', pa.int64()), ('length', pa.int64()), ('ids_crc32', pa.int64())]
    schema = pa.schema(fields + [('ids', pa.list_(pa.int64()))] * with_ids)
    docs, (id_, text_) = plain_names(docs, id_col, text_col)
    return docs.select(F.col(id_).cast('long'), text_).mapInArrow(
        run, 'doc_id long, piece int, start long, length long, ids_crc32 long' + ', ids array<long>' * with_ids)


class Bins:
    """Bins of one block: piece numbers by bin, and the search over them."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.size, self.capacity = lengths.tolist(), capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that holds it."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r is set while a bin has r places left
        for item in sorted(range(len(self.size)), key=lambda i: (-self.size[i], i)):
            length = self.size[item]
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                self.items[at].append(item)
                self.fill[at] += length
            else:
                at, room = len(self.items), self.capacity
                self.items.append([item])
                self.fill.append(length)
            room -= length
            by_room[room].append(at)
            rooms |= 1 << room

    def choices(self, b: int) -> tuple[dict[int, tuple], dict[int, tuple]]:
        """What bin ``b`` can give: one piece of every length, and two of every sum of lengths.

        Pieces of one length are alike, and a bin has fewer than
        sqrt(2 * capacity) lengths, so these are all exchanges there are.
        """
        by_length: dict[int, list[int]] = {}
        for item in self.items[b]:
            by_length.setdefault(self.size[item], []).append(item)
        twos: dict[int, tuple] = {}
        for i, (x, these) in enumerate(alike := list(by_length.items())):
            if len(these) > 1:
                twos.setdefault(2 * x, tuple(these[:2]))
            for y, those in alike[i + 1:]:
                twos.setdefault(x + y, (these[0], those[0]))
        return {x: (these[0],) for x, these in by_length.items()}, twos

    def improve(self) -> None:
        """Sweep the underfull bins, the emptiest first, until a sweep changes nothing."""
        changed = True
        while changed:
            changed = False
            under = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity), key=lambda b: self.fill[b])
            table = Exchanges(self, under)
            for bin_ in under:
                while self.items[bin_] and table.step(bin_):
                    changed = True


class Exchanges:
    """What underfull bins could give for a piece they take: nothing, one piece or two.

    An offer of bin b frees ``out`` tokens there; taking a piece of length x
    then fits if out < x <= out + room of b. Offers are held in arrays that
    are searched at once; an offer changed since it was made is dead.
    """

    def __init__(self, bins: Bins, under: list[int]):
        self.bins = bins
        self.stamp = dict.fromkeys(under, 0)
        self.rows: list[tuple] = []
        for b in under:
            self._offer(b)
        self._freeze()

    def _offer(self, b: int) -> None:
        bins, stamp = self.bins, self.stamp[b]
        if not bins.items[b] or bins.fill[b] >= bins.capacity:
            return
        room = bins.capacity - bins.fill[b]
        ones, twos = bins.choices(b)
        self.rows.append((0, room, b, stamp, ()))
        self.rows += [(out, out + room, b, stamp, give) for found in (ones, twos) for out, give in found.items()]

    def _freeze(self) -> None:
        self.rows = [r for r in self.rows if self.stamp[r[2]] == r[3]]
        self.out = np.array([r[0] for r in self.rows], np.int64)
        self.most = np.array([r[1] for r in self.rows], np.int64)
        self.bin = np.array([r[2] for r in self.rows], np.int64)
        self.two = np.array([len(r[4]) == 2 for r in self.rows], bool)
        self.alive = np.ones(len(self.rows), bool)

    def step(self, b: int) -> bool:
        """The exchange of ``b`` that raises the squared fills most, if any does."""
        bins = self.bins
        own, fill = bins.items[b], bins.fill[b]
        ones, twos = bins.choices(b)
        best = (0, None, None)
        fills = np.array([bins.fill[k] for k in self.bin.tolist()], np.int64) if not hasattr(self, 'fills') else self.fills
        self.fills = fills
        for total, pieces in [*ones.items(), *twos.items()]:
            shift = total - self.out
            fits = self.alive & (shift > 0) & (total <= self.most) & (self.bin != b)
            if len(pieces) == 2:
                fits &= ~self.two
            at = np.flatnonzero(fits)
            if len(at):
                gain = shift[at] * (fills[at] - fill + shift[at])
                top = int(np.argmax(gain))
                if gain[top] > best[0]:
                    best = (int(gain[top]), pieces, int(at[top]))
        if best[1] is None:
            return False
        _, give, row = best
        other, take = int(self.bin[row]), self.rows[row][4]
        moved = sum(bins.size[x] for x in give) - sum(bins.size[x] for x in take)
        bins.items[other] = [x for x in bins.items[other] if x not in take] + list(give)
        bins.items[b] = [x for x in own if x not in give] + list(take)
        bins.fill[other] += moved
        bins.fill[b] -= moved
        self._renew(other)
        self._renew(b)
        return True

    def _renew(self, b: int) -> None:
        """Drop the bin's offers and append its new ones."""
        self.alive[self.bin == b] = False
        self.stamp[b] += 1
        old = len(self.rows)
        self._offer(b)
        new = self.rows[old:]
        self.out = np.append(self.out, [r[0] for r in new]).astype(np.int64)
        self.most = np.append(self.most, [r[1] for r in new]).astype(np.int64)
        self.bin = np.append(self.bin, [r[2] for r in new]).astype(np.int64)
        self.two = np.append(self.two, [len(r[4]) == 2 for r in new]).astype(bool)
        self.alive = np.append(self.alive, np.ones(len(new), bool))
        self.fills = np.append(self.fills, [self.bins.fill[b]] * len(new)).astype(np.int64)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece of one block."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, items in enumerate(x for x in bins.items if x):
        at = 0
        for item in items:
            bin_of[item], offset[item] = number, at
            at += bins.size[item]
    return bin_of, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless from 0 in every sequence.

    The pieces are written once with a block drawn for each row, so repeated
    rows and ids spread like any other and a lost task is redone alike. Blocks
    have about ``block_pieces`` pieces whatever the input's size; a sequence
    never crosses blocks, which leaves at most a few underfull bins in each.
    """
    total = materialise(pieces.withColumn('row', F.monotonically_increasing_id()))
    blocks = max(1, -(-total.count() // block_pieces))
    dealt = total.withColumn('block', F.pmod(F.xxhash64('doc_id', 'piece', 'row'), F.lit(blocks)))
    schema = total.drop('row').schema.add('sequence_id', 'long').add('offset', 'long')

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(['doc_id', 'piece', 'row'], kind='stable').reset_index(drop=True)
        bin_of, offset = pack_lengths(group['length'].to_numpy(), capacity)
        out = group.drop(columns=['row', 'block'])
        return out.assign(sequence_id=group['block'].to_numpy() * (1 << 32) + bin_of, offset=offset)

    return dealt.groupBy('block').applyInPandas(run, schema)
