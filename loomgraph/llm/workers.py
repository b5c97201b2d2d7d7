"""Python workers of this subpackage: the package's sources, and batches of bounded size."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomgraph import workers

#: Rows of a batch that goes to a Python worker; texts are long, so the default of 10,000 is much memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Sends the package's sources to the executors and lowers the session's rows of an
    Arrow batch to BATCH_ROWS."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    workers.ready(spark)
