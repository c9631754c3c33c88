"""Session construction and lineage helpers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sitescope") -> SparkSession:
    """Return (or create) a session configured for the library's plans.

    AQE is switched on with skew-join splitting and partition coalescing so the
    equi-joins on grid cells / names re-plan at runtime (broadcast when a side
    turns out small, split when one key holds a large share of the rows).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sitescope`` importable in Python workers (pandas UDFs, mapInPandas).

    The package is zipped once per driver process and added with
    ``addPyFile``, which distributes it to every executor; nothing depends on
    the driver's working directory or a shared file system.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, zpath = tempfile.mkstemp(prefix='sitescope-', suffix='.zip')
    os.close(fd)
    with zipfile.ZipFile(zpath, 'w', zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith('.py'):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder only for local runs where it is unset.

    Executors on other machines do not see the driver's folders, so without
    the setting a cluster run raises instead of writing to one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != 'local' and not sc.master.startswith('local['):
            raise RuntimeError('set spark.checkpoint.dir to a folder that all executors share')
        configured = tempfile.mkdtemp(prefix="sitescope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _tables_folder(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark).rstrip('/')
    return f'{base}/sitescope-tables/{spark.sparkContext.applicationId}'


_CLEANED: set[str] = set()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table under the shared checkpoint folder.

    One job writes it (a reliable RDD checkpoint would compute the plan twice),
    the re-read has file statistics for AQE's join planning, and the files
    live in ``spark.checkpoint.dir`` so they survive executor loss. Never a
    local checkpoint. An application's tables share one folder, which goes when
    :func:`drop_tables` is called, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.mode('overwrite').parquet(path)
    return spark.read.parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it once their results are read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_tables_folder(spark))
    path.getFileSystem(conf).delete(path, True)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, gone with the application's tables."""
    folder = _tables_folder(spark)
    if folder not in _CLEANED:
        _CLEANED.add(folder)
        atexit.register(_drop_quietly, spark)
    return f'{folder}/{uuid.uuid4().hex}'


def drop_table(df: DataFrame) -> None:
    """Delete one table of :func:`cut_lineage`, once every result of it is written."""
    spark, folder = df.sparkSession, _tables_folder(df.sparkSession)
    name = next((f.split(folder + '/', 1)[1].split('/')[0] for f in df.inputFiles() if folder + '/' in f), None)
    if name:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f'{folder}/{name}')
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    Spark finds them when the driver collects its garbage, which may be after
    the job's end; an operator of several large shuffles, each written out as
    a table, asks for it between them, so that disks hold one at a time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop_quietly(spark: SparkSession) -> None:
    try:
        drop_tables(spark)
    except Exception:  # noqa: BLE001 - the session may have ended before the driver
        pass


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to ``spark.sitescope.textPartitions`` tasks where that setting is given.

    For texts stored as a few big row groups, which Spark cannot split. Unset
    (the default) nothing is shuffled; the plan never depends on the data.
    """
    n = int(df.sparkSession.conf.get('spark.sitescope.textPartitions', '0'))
    return df.repartition(n) if n else df
