"""Bounds of what goes to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of a batch of whole files or frames, each of which can hold many points.
BATCH_ROWS = 256
#: Bytes of such a batch; a longer row stands alone.
BATCH_BYTES = 8 << 20
#: Points of a batch that Python gives back, but for those of one file or frame.
POINTS = 1 << 16


def bounded(spark: SparkSession) -> None:
    """The bounds stay in the session, as frames run later; they are only ever lowered."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        have = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not 0 < have <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
