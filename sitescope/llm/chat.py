"""Chat formatting: conversations to one marked string, by columnar byte assembly.

Template of one turn::

    ### <role>: <text></turn>

A backslash marks an escaped character: in texts every backslash, ``###`` and
``</turn>`` get one in front, in roles every ``:`` as well. Unescaped marks are
therefore the template's own, and removing the backslashes gives texts back.

Rows are ranged over tasks by (conversation, turn) and formatted batch by
batch: segment lengths, cumulative offsets and scatter indices are numpy
arrays, and all headers, contents and ends are copied into one preallocated
buffer that Arrow takes as it is. A conversation of any length is thus spread
over tasks; it comes back as consecutive pieces in order of turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import gather_ragged, offsets

# The template's marks.
HEAD, COLON, END = '### ', ': ', '</turn>\n'
LOSS_ROLE = 'assistant'

#: Turns that are assembled at a time, and bytes that their texts may have.
BATCH_TURNS, BATCH_BYTES = 4096, 32_000_000

TURN = re.compile(r'### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n', re.S)
ESCAPED = re.compile(r'\\(.)', re.S)


def escape(texts: pa.Array, role: bool = False) -> pa.Array:
    """Escape every control string of the texts (nulls become empty)."""
    out = pc.fill_null(texts.cast(pa.string()), '')
    for mark in ('\\', '###', '</turn>', *([':'] if role else [])):
        out = pc.replace_substring(out, mark, '\\' + mark)
    return out


def unescape(text: str) -> str:
    return ESCAPED.sub(r'\1', text)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes in a row, and its offsets."""
    column = pa.concat_arrays([column])  # drops a slice's offset
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, ends


def assemble(groups: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Format consecutive turns, one string per group.

    ``groups`` numbers each turn's group from 0 in runs. Returns the strings,
    and per turn the place and length in bytes of its escaped text in its
    group's string, and whether the loss mask covers it.
    """
    n = len(groups)
    columns = [escape(roles, role=True), escape(texts)]
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (HEAD, COLON, END)]
    (role_raw, role_at), (text_raw, text_at) = map(_bytes, columns)
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    # Five segments a turn; their places follow from one running sum.
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = map(len, fixed)
    lengths[:, 1], lengths[:, 3] = role_len, text_len
    place = offsets(lengths.ravel())
    starts = place[:-1].reshape(n, 5)
    buffer = np.empty(int(place[-1]), np.uint8)
    for column, part in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        buffer[(starts[:, column, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
    span = np.arange(len(buffer))  # ragged segments: scatter indices are runs of consecutive places
    turns = np.arange(n)
    for column, raw, at, size in ((1, role_raw, role_at, role_len), (3, text_raw, text_at, text_len)):
        buffer[gather_ragged(span, starts[:, column], size, turns)] = raw[at[0]:at[-1]]
    first = np.flatnonzero(np.diff(groups, prepend=-1)) if n else np.zeros(0, np.int64)
    bounds = np.append(starts[first, 0], len(buffer)) if n else np.zeros(1, np.int64)
    strings = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(buffer)])
    in_group = starts[:, 3] - bounds[groups] if n else np.zeros(0, np.int64)
    loss = np.asarray(pc.fill_null(pc.equal(roles.cast(pa.string()), LOSS_ROLE), False), bool)
    return strings, in_group, text_len, loss


def format_chats(turns: DataFrame, conv_col: str = 'conv_id', turn_col: str = 'turn', role_col: str = 'role',
                 text_col: str = 'text') -> DataFrame:
    """Format conversations given as one row per turn.

    Columns: conv_id, part (the range of rows that a piece comes from), piece
    (its place there), formatted, n_turns, loss_starts and loss_lengths (byte
    spans of ``formatted`` that the loss mask covers: each assistant text). A
    conversation's pieces in order of (part, piece) are its whole text.

    Turns are put in order of (turn, role, text), nulls first, so ties are in
    a defined order; repeated rows are repeated turns. A null role or text
    counts as empty, a null conversation id is a conversation of its own.
    """
    source = turns.select(F.col(conv_col).cast('long').alias('conv_id'), F.col(turn_col).cast('long').alias('turn'),
                          F.col(role_col).alias('role'), F.col(text_col).alias('text'))
    order = ['conv_id', 'turn', 'role', 'text']
    ranged = source.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for batch in _bounded(batches):
            keys = batch.column('conv_id').to_pylist()
            change = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            groups = np.zeros(len(keys), np.int64)
            groups[change] = 1
            groups = np.cumsum(groups) - 1
            strings, place, length, loss = assemble(groups, batch.column('role'), batch.column('text'))
            masked = offsets(np.bincount(groups[loss], minlength=len(change))).astype(np.int32)
            spans = [pa.ListArray.from_arrays(pa.array(masked), pa.array(x[loss], pa.int64())) for x in (place, length)]
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i in change], pa.int64()),
                pa.array(np.arange(piece, piece + len(change)), pa.int64()), strings,
                pa.array(np.bincount(groups, minlength=len(change)), pa.int64()), *spans,
            ], ['conv_id', 'piece', 'formatted', 'n_turns', 'loss_starts', 'loss_lengths'])
            piece += len(change)

    formatted = ranged.mapInArrow(run, 'conv_id long, piece long, formatted string, n_turns long, '
                                       'loss_starts array<long>, loss_lengths array<long>')
    return formatted.withColumn('part', F.spark_partition_id())


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_TURNS turns and about BATCH_BYTES bytes of text (one longer text alone)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column('text')), 0), np.int64)
        ends, start = offsets(sizes), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + BATCH_BYTES, 'right')) - 1
            stop = min(max(stop, start + 1), start + BATCH_TURNS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string; raises if anything is left over."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f'no turn at {at}')
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the strings and masks of :func:`format_chats`.

    Columns: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed
    of each turn), loss_chars, loss_sha256 (texts under the loss mask,
    unescaped), formatted_chars. A conversation's pieces are hashed one after
    another as they stream by in order, so a task holds one piece at a time
    however long the conversation is.
    """
    ordered = (formatted.repartition('conv_id').sortWithinPartitions('conv_id', 'part', 'piece')
               .select('conv_id', 'formatted', 'loss_starts', 'loss_lengths'))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ['conv_id', 'n_turns', 'turns_sha256', 'loss_chars', 'loss_sha256', 'formatted_chars']
        state = None
        for batch in batches:
            done = []
            for conv, text, starts, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(_close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f'{role}\n{said}\n'.encode())
                raw = text.encode()
                for start, length in zip(starts, lengths):
                    said = unescape(raw[start:start + length].decode())
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in done], schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, _close(state)))], schema)

    schema = pa.schema([('conv_id', pa.int64()), ('n_turns', pa.int64()), ('turns_sha256', pa.string()),
                        ('loss_chars', pa.int64()), ('loss_sha256', pa.string()), ('formatted_chars', pa.int64())])
    return ordered.mapInArrow(run, 'conv_id long, n_turns long, turns_sha256 string, loss_chars long, '
                                   'loss_sha256 string, formatted_chars long')


def _close(state: list) -> list:
    return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]


#: A conversation that quotes the template's own marks.
PROBE = r'\### Assistant: </turn> ok'

ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked as (
  select *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') as etext,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') as erole
  from turns)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('### ' || erole || ': ' || etext || '</turn>') + 1)::bigint as formatted_chars
from marked group by conv_id
"""
