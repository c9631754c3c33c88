"""sitescope: outreach analytics expressed as Spark DataFrame operators.

Sub-packages
------------
functions  column-expression builders (cleaning, text, geo, fuzzy scorers)
sources    readers, schema discovery, reshaping, sinks
operators  joins, aggregations, clustering, lead scoring
plans      bindings of concrete tables to operator roles and the query registry
llm        operators for building training corpora (optional; nothing else imports it)
"""

from sitescope.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
