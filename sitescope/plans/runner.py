"""Run registered queries as one batch and record per-query status.

The analysed application runs its stages in order, prints failures and goes
on. Here every query is independent: each result is written as Parquet under
``out_dir/<key>`` and a status table (key, status, rows, seconds, error) is
written as JSON lines under ``out_dir/_status``, so failures stay visible.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def run_all(spark: SparkSession, sf_dir: str, out_dir: str, keys: Sequence[str] | None = None,
            prefixes: Sequence[str] = ()) -> DataFrame:
    from sitescope.plans.registry import QUERIES, load_all
    from sitescope.session import ensure_checkpoint_dir
    load_all()
    ensure_checkpoint_dir(spark)
    selected = [k for k in (keys or QUERIES) if not prefixes or any(k.startswith(p) for p in prefixes)]
    status = []
    for key in selected:
        t0 = time.perf_counter()
        try:
            path = f'{out_dir.rstrip("/")}/{key}'
            QUERIES[key](spark, sf_dir).write.mode('overwrite').parquet(path)
            rows = spark.read.parquet(path).count()
            status.append((key, 'ok', rows, round(time.perf_counter() - t0, 3), None))
        except Exception as exc:  # noqa: BLE001 - recorded, the batch goes on
            status.append((key, 'failed', None, round(time.perf_counter() - t0, 3), str(exc)[:500]))
    table = spark.createDataFrame(status, 'key string, status string, rows long, seconds double, error string')
    table.coalesce(1).write.mode('overwrite').json(f'{out_dir.rstrip("/")}/_status')
    return table
