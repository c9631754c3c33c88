"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    Each round points a node's larger neighbours, then its smaller ones, at the
    smallest node it sees; rounds go on until the edges no longer change. All
    steps are joins and aggregates on nodes, each round is written to the
    shared folder, and nothing is collected but one checksum a round.
    """
    current = materialise(edges.where('a <> b').select(F.greatest('a', 'b').alias('a'), F.least('a', 'b').alias('b')).distinct())
    before = _checksum(current)
    while True:
        both = current.union(current.select('b', 'a'))
        smallest = both.groupBy('a').agg(F.least('a', F.min('b')).alias('m'))
        large = both.where('b > a').join(smallest, 'a').select(F.col('b').alias('a'), F.col('m').alias('b')).where('a <> b')
        large = large.distinct()
        lowest = large.groupBy('a').agg(F.min('b').alias('m'))
        small = (large.join(lowest, 'a').where('b <> m').select(F.col('b').alias('a'), F.col('m').alias('b'))
                 .union(lowest.select('a', 'm')).distinct())
        current = materialise(small)
        after = _checksum(current)
        if after == before:
            break
        before = after
    return current.select(F.col('a').alias('node'), F.col('b').alias('root')).union(
        current.select(F.col('b').alias('node'), F.col('b').alias('root')).distinct())


def _checksum(edges: DataFrame) -> tuple:
    mixed = F.xxhash64('a', 'b').cast('decimal(38,0)')
    return tuple(edges.agg(F.count('*'), F.sum(mixed), F.sum(F.xxhash64('b', 'a').cast('decimal(38,0)'))).first())
