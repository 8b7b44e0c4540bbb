"""Live ingest: a stream of points written in micro-batches by the batch function.

Each micro-batch is one commit that rewrites only the buckets of its keys, so a restart
replays at most the batch that was not finished.  Late points re-roll the intervals they touch; points older
than every tier are dropped, as in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import tables
from tidemark.operators.stores import settled
from tidemark.sources import lines


def line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of the lines of new text files, with the time each was read."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path).withColumn("read_at", F.unix_seconds(F.current_timestamp()))


def points_of(stream: DataFrame, now: int | None = None) -> DataFrame:
    return lines.parse_lines(stream, now if now is not None else F.col("read_at"))


def start(points: DataFrame, path: str, checkpoint: str, rules=(), now: int | None = None, available_now: bool = True):
    """Start writing a stream of key, ts, value into the store under ``path``; the query."""
    spark = points.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        at = now if now is not None else int(batch.agg(F.max(F.unix_seconds(F.current_timestamp()))).first()[0])
        # the batch is read twice (its buckets, then its rows) and must number its rows alike
        rows = settled(batch.select("key", "ts", "value").withColumn("arrival", F.monotonically_increasing_id()))
        tables.commit(batch.sparkSession, path, rows, at, rules)

    w = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed(points: DataFrame, step: int, delay: str = "1 hour", key: str = "key") -> DataFrame:
    """Running sums of fixed windows over a stream of key, ts, value; windows close after ``delay``."""
    timed = points.withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", delay)
    g = timed.groupBy(F.window("time", f"{step} seconds"), F.col(key)).agg(F.sum("value").alias("value"), F.count("*").alias("known"))
    return g.select(key, F.unix_seconds("window.start").alias("ts"), "value", "known")
