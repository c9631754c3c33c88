import os
import sys
import tempfile

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = '/root/testdata/sf0.001'
SF_ORACLE = '/root/testdata/sf0.01'


@pytest.fixture(scope='session')
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master('local[*]')
         .config('spark.sql.shuffle.partitions', '8')
         .config('spark.ui.enabled', 'false')
         .config('spark.ui.showConsoleProgress', 'false')
         .config('spark.sql.session.timeZone', 'UTC')
         .config('spark.sql.adaptive.enabled', 'true')
         .getOrCreate())
    s.sparkContext.setLogLevel('ERROR')
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix='sitescope-test-ckpt-'))
    yield s


@pytest.fixture(scope='session', autouse=True)
def benchmark_view():
    """The SQL of op11 and op13 reads ``benchmark`` beside the tables that the tests of the operators name."""
    duckdb.sql(f"create or replace view benchmark as select * from '{SF_ORACLE}/benchmark.parquet'")
