"""A lookup table that many writers append to, one row a key.

Every append is a folder of new rows and a numbered commit that names it. A
commit number can be taken once (the file system creates a file exclusively),
so of two writers that saw the same commits one has to look again, and finds
the other's keys. A write that fails, or is repeated, leaves no row behind.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds to wait for a writer that has taken a commit number to name its folder.
PATIENCE = 30.0


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders committed so far, in order."""
    at, fs = _store(spark, f'{path}/commits')
    if not fs.exists(at):
        return []
    names = []
    for number in sorted(f.getPath().getName() for f in fs.listStatus(at)):
        until = time.monotonic() + PATIENCE
        while not (name := _content(spark, f'{path}/commits/{number}')):
            if time.monotonic() > until:
                raise RuntimeError(f'commit {number} of {path} names no folder')
            time.sleep(0.05)
        names.append(name)
    return names


def _content(spark: SparkSession, path: str) -> str:
    at, fs = _store(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _take(spark: SparkSession, path: str, number: int, folder: str) -> bool:
    """Commit ``folder`` under the number; False if another writer has it."""
    at, fs = _store(spark, f'{path}/commits/{number:010d}')
    fs.mkdirs(at.getParent())
    try:
        stream = fs.create(at, False)
    except Exception as taken:  # noqa: BLE001 - the store's own exception type comes through the gateway
        if fs.exists(at):
            return False
        raise taken
    stream.write(folder.encode())
    stream.close()
    return True


def read_lookup(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows; None before the first append."""
    folders = _committed(spark, path)
    return spark.read.parquet(*[f'{path}/rows/{f}' for f in folders]) if folders else None


def append_new(spark: SparkSession, new: DataFrame, path: str, key: str) -> DataFrame:
    """Add the rows of ``new`` whose key the table at ``path`` lacks; return the table's rows of all keys of ``new``.

    Misses are cached like hits (rows carry a flag), so a key that is there
    keeps its row. Of rows that share a key in ``new`` one is added. Safe for
    several writers and for repeated runs.
    """
    while True:
        folders = _committed(spark, path)
        fresh = new.dropDuplicates([key])
        if folders:
            known = spark.read.parquet(*[f'{path}/rows/{f}' for f in folders])
            fresh = fresh.join(known.select(key), key, 'left_anti')
        folder = uuid.uuid4().hex
        fresh.write.parquet(f'{path}/rows/{folder}')
        if _take(spark, path, len(folders), folder):
            break
        at, fs = _store(spark, f'{path}/rows/{folder}')
        fs.delete(at, True)
    return read_lookup(spark, path).join(new.select(key), key, 'left_semi')
