"""How much of a table Python holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch. As Python objects its rows take some twenty times that.
MOST = 8 << 20
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit(spark: SparkSession | None = None) -> None:
    """Limit the session's Arrow batches, whose default of 64 MB a worker holds several times; a smaller limit stays."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        now = str(spark.conf.get(KEY)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= MOST:
            spark.conf.set(KEY, str(MOST))
