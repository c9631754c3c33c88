"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitescope.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r'[^\x20\x09-\x0D]+'

#: Characters of text that one block of a Python task holds at a time.
BLOCK_CHARS = 12_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; every query starts here, on any Hadoop path."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark.read.parquet(f'{sf_dir}/{name}.parquet')


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    return cut_lineage(df)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until no column of ``taken`` has them in any case of letters."""
    used = {c.lower() for c in taken}
    found = []
    for name in wanted:
        while name.lower() in used:
            name += '_'
        used.add(name.lower())
        found.append(name)
    return found


def plain_names(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... and the new names of the wanted ones.

    Whatever the columns are called (dotted, differing in case only, like a
    column that an operator adds), none can be mistaken for another.
    """
    names = [f'c{i}' for i in range(len(df.columns))]
    lower = [c.lower() for c in df.columns]
    at = [df.columns.index(c) if c in df.columns else lower.index(c.lower()) for c in wanted]
    return df.toDF(*names), [names[i] for i in at]


def text_blocks(batches: Iterable[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Regroup (id, text) batches into blocks of about ``chars`` characters.

    A null text counts as empty. A text longer than ``chars`` is a block of its
    own, so memory is bounded by the block or the longest text.
    """
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ''
            if texts and size + len(text) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


class Numbering(dict):
    """Maps each new key to the next number: ``list(map(d.__getitem__, keys))``."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def number_words(lists: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Numbers of all words in a row, words per list, and the distinct words in order of number."""
    seen, parts, sizes = Numbering(), [], []
    for words in lists:
        parts.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
        sizes.append(len(words))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.array(sizes, np.int64), list(seen)


def gather_ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[starts[i]:starts[i]+lengths[i]]`` for each i of ``order``."""
    n = lengths[order]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    step = np.ones(total, np.int64)
    if total:
        some = n > 0
        first, at = starts[order][some], np.concatenate(([0], ends[some][:-1]))
        step[at] = first
        step[at[1:]] -= first[:-1] + n[some][:-1] - 1
    return flat[np.cumsum(step)] if total else flat[:0]


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
