"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are rotated by one fixed random rotation and dealt to the lists of
their nearest centroids. A query probes its nearest lists. Inside a list,
candidates are held as column blocks of the rotated dimensions: after each
block a hypothesis test abandons every candidate whose partial distance,
scaled up to all dimensions, lies significantly beyond the query's current
k-th distance. Survivors are measured exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import materialise, plain_names

#: Bounds of what is fitted: vectors that train centroids, lists, and queries that recall is measured with.
SAMPLE_ROWS, MOST_LISTS, RECALL_QUERIES = 20_000, 1024, 128
#: Probes are raised until measured recall reaches this.
RECALL = 0.95
COLUMNS, SIGNIFICANCE, SEED = 16, 2.1, 17
#: Candidates of a list, and queries of a list, that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of vectors that are not null, zero, empty or holding null or non-finite parts."""
    v = F.col(vector_col).cast('array<double>')
    finite = F.forall('v', lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float('inf')))
    rows = vectors.select(F.col(id_col).cast('long').alias('vec_id'), v.alias('v')).where('vec_id is not null and v is not null')
    return rows.where(finite & F.exists('v', lambda x: x != 0))


@dataclass
class Index:
    """Rotation (d x d), centroids (lists x d, rotated) and the number of lists to probe."""
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    recall: float

    def nearest_lists(self, rotated: np.ndarray, n: int) -> np.ndarray:
        d2 = (self.centroids ** 2).sum(axis=1) - 2 * rotated @ self.centroids.T
        if n == 1:
            return d2.argmin(axis=1)[:, None]
        return np.argpartition(d2, min(n, d2.shape[1]) - 1, axis=1)[:, :n]


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        own = np.concatenate([((c ** 2).sum(axis=1) - 2 * part @ c.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(vectors: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> Index:
    """Fit rotation, centroids and the number of probes on at most about ``sample_rows`` vectors.

    ``vectors`` has (vec_id, v). Recall is measured by brute force within the
    sample, and probes are raised by a sixth at a time until it reaches ``recall``
    or every list is probed.
    """
    total = vectors.count()
    drawn = vectors.sample(fraction=min(1.0, sample_rows / max(1, total)), seed=SEED).orderBy('vec_id').toPandas()
    x = np.stack(drawn['v'].to_numpy()) if len(drawn) else np.zeros((0, 1))
    d = x.shape[1]
    rotation, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    rotation = rotation * np.sign(np.diag(r))
    x = x @ rotation
    if not len(x):
        return Index(rotation, np.zeros((1, d)), 1, 1.0)
    lists = int(np.clip(np.sqrt(total), 1, min(MOST_LISTS, len(x))))
    index = Index(rotation, _kmeans(x, lists), 1, 0.0)
    queries = x[np.linspace(0, len(x) - 1, min(RECALL_QUERIES, len(x))).astype(int)]
    apart = (x ** 2).sum(axis=1) - 2 * queries @ x.T
    near = np.argsort(apart, axis=1, kind='stable')[:, 1:k + 1]  # the first is the query itself
    near = near if near.shape[1] else np.zeros((len(queries), 1), int)
    own = index.nearest_lists(x, 1)[:, 0]
    while True:
        probed = index.nearest_lists(queries, index.probes)
        index.recall = float(np.mean([np.isin(own[near[i]], probed[i]).mean() for i in range(len(queries))]))
        if index.recall >= recall or index.probes >= lists:
            return index
        index.probes = min(lists, index.probes + max(1, index.probes // 6))


def scan(queries: np.ndarray, rows: np.ndarray, rotated: np.ndarray, own_rows: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the places of candidates that may be among its k nearest; its own row is none.

    ``rotated`` is cut into column blocks. The k-th distance starts from the
    first candidates, measured in full; the others drop out after each block
    by the test, and the survivors tighten the threshold batch by batch.
    """
    d = rotated.shape[1]
    blocks = [np.ascontiguousarray(rotated[:, a:a + COLUMNS]) for a in range(0, d, COLUMNS)]
    found = []
    for q, own in zip(queries, own_rows):
        order = np.flatnonzero(rows != own)
        kept_place, kept_dist = np.zeros(0, np.int64), np.zeros(0)
        size = max(4 * k, 64)
        while len(order):
            part, order = order[:size], order[size:]
            size *= 4
            limit = kept_dist[k - 1] if len(kept_dist) >= k else np.inf
            partial = np.zeros(len(part))
            for i, block in enumerate(blocks):
                at = i * COLUMNS
                partial += ((block[part] - q[at:at + block.shape[1]]) ** 2).sum(axis=1)
                seen = at + block.shape[1]
                if seen < d and limit < np.inf:
                    # Reject "within the limit" when the scaled partial distance is significantly above it.
                    stay = partial <= limit * (seen / d) * (1 + SIGNIFICANCE / np.sqrt(seen)) ** 2
                    part, partial = part[stay], partial[stay]
                    if not len(part):
                        break
            kept_place, kept_dist = np.concatenate((kept_place, part)), np.concatenate((kept_dist, partial))
            if len(kept_dist) > k:
                # Ties at the k-th place stay in, up to rounding, for the exact measure and the ids to settle.
                edge = np.partition(kept_dist, k - 1)[k - 1]
                stay = kept_dist <= edge * (1 + 1e-9) + 1e-12
                kept_place, kept_dist = kept_place[stay], kept_dist[stay]
            rank = np.argsort(kept_dist, kind='stable')
            kept_place, kept_dist = kept_place[rank], kept_dist[rank]
        found.append(kept_place)
    return found


def search(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = 'vec_id', vector_col: str = 'embedding',
           index: Index | None = None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` nearest rows found of every row whose id is divisible by ``every``.

    Columns: query_id, rank (from 1), vec_id, score (Euclidean distance on the
    original vectors, in double precision), nearest first and ties to the
    smaller id. A query's own row is no candidate. Vectors that are null, zero
    or hold null or non-finite parts take no part, nor do rows without an id.
    All others do: rows that repeat an id are queries and candidates of their
    own, and vectors of another length are searched among their like, since a
    distance needs two of one length (one search for each length there is). A
    query whose probed lists hold fewer than ``k`` candidates probes them all.
    An ``index`` serves vectors of its own length. An empty table has no result.
    """
    plain, (id_, v_) = plain_names(vectors, id_col, vector_col)
    rows = materialise(usable(plain, id_, v_).withColumn('row', F.monotonically_increasing_id()))
    lengths = sorted(r.d for r in rows.select(F.size('v').alias('d')).distinct().collect())
    found = rows.sparkSession.createDataFrame([], 'query_id long, rank int, vec_id long, score double')
    for d in lengths:
        alike = rows.where(F.size('v') == d) if len(lengths) > 1 else rows
        own = index if index and index.rotation.shape[0] == d else fit(alike, k)
        hits = _search_alike(alike, own, every, k, block_rows, block_queries)
        found = hits if d == lengths[0] else found.unionByName(hits)
    return found


def _search_alike(rows: DataFrame, index: Index, every: int, k: int, block_rows: int, block_queries: int) -> DataFrame:
    """``search`` among (vec_id, v, row) with vectors of one length."""
    sent = rows.sparkSession.sparkContext.broadcast(index)  # bounded by MOST_LISTS centroids

    def deal(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) @ ix.rotation
                lists = ix.nearest_lists(x, probes)
                of = pa.array(np.repeat(np.arange(len(x)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns), pa.array(lists.ravel().astype(np.int32))],
                                                 ['vec_id', 'v', 'row', 'list'])
        return run

    schema = 'vec_id long, v array<double>, row long, list int'
    listed = materialise(rows.mapInArrow(deal(1), schema))

    def nearest(queries: DataFrame, probes: int) -> DataFrame:
        """(row, query_id, best): the nearest of every query in its ``probes`` nearest lists."""
        asked = materialise(queries.mapInArrow(deal(probes), schema))
        # A list's candidates and queries are cut into blocks, so a list with a third of all rows is many tasks.
        counts = (listed.groupBy('list').agg(F.ceil(F.count('*') / block_rows).cast('int').alias('row_blocks'))
                  .join(asked.groupBy('list').agg(F.ceil(F.count('*') / block_queries).cast('int').alias('query_blocks')), 'list'))
        counts = materialise(counts)  # at most MOST_LISTS rows

        def cut(side: DataFrame, own: str, other: str) -> DataFrame:
            mine = F.pmod(F.xxhash64('row'), F.col(own)).cast('int').alias(own[:-1])
            return (side.join(F.broadcast(counts), 'list')
                    .select('list', 'vec_id', 'v', 'row', mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1])))

        keys = ['list', 'row_block', 'query_block']

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = {'row': [], 'query_id': [], 'vec_id': [], 'score': []}
            if len(left) and len(right):
                ids, at, x = left['vec_id'].to_numpy(), left['row'].to_numpy(), np.stack(left['v'].to_numpy())
                q_ids, q_at, q = right['vec_id'].to_numpy(), right['row'].to_numpy(), np.stack(right['v'].to_numpy())
                for i, places in enumerate(scan(q @ sent.value.rotation, at, x @ sent.value.rotation, q_at, k)):
                    score = np.sqrt(((x[places] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[places], score))[:k]
                    out['row'] += [q_at[i]] * len(best)
                    out['query_id'] += [q_ids[i]] * len(best)
                    out['vec_id'] += ids[places][best].tolist()
                    out['score'] += score[best].tolist()
            return pd.DataFrame(out).astype({'row': 'int64', 'query_id': 'int64', 'vec_id': 'int64', 'score': 'float64'})

        met = (cut(listed, 'row_blocks', 'query_blocks').groupBy(*keys).cogroup(cut(asked, 'query_blocks', 'row_blocks').groupBy(*keys))
               .applyInPandas(meet, 'row long, query_id long, vec_id long, score double'))
        # Partial results keep k rows a block; a query's are few, and merge by one aggregate.
        return met.groupBy('row', 'query_id').agg(
            F.slice(F.array_sort(F.collect_list(F.struct('score', 'vec_id'))), 1, k).alias('best'))

    queries, lists = rows.where(F.col('vec_id') % every == 0), len(index.centroids)
    best = nearest(queries, min(index.probes, lists))
    if index.probes < lists:
        best = materialise(best)
        enough = best.where(F.size('best') == k)
        short = materialise(queries.join(enough.select('row'), 'row', 'left_anti').select('vec_id', 'v', 'row'))
        best = enough.unionByName(nearest(short, lists))
    return best.select('query_id', F.posexplode('best').alias('place', 'hit')).select(
        'query_id', (F.col('place') + 1).cast('int').alias('rank'), F.col('hit.vec_id').alias('vec_id'), F.col('hit.score').alias('score'))
