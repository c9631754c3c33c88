"""Query registry: one callable per operator id, (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through ``plans.bindings`` and runs the
library operators over the whole tables. Double columns are rounded to six
decimals at the very end (``finish``) so that engine-level last-bit
differences do not hide real agreement with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(key: str, sql: str | None = None):
    """Decorator: register a query under ``key`` with its oracle SQL (or none)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (each registers its queries on import)."""
    from sitescope.plans import q_leads, q_survey, q_text, q_geo, q_match, q_misc, q_reports, q_sheets  # noqa: F401
