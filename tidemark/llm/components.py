"""Connected components of a distributed edge list by alternating star contractions.

Each round hangs every node on the smallest node it can see: first larger neighbours
(large star), then smaller ones (small star).  Rounds grow with the logarithm of the
longest path.  Every round is written to the shared folder, so a lost executor costs
one round at most; nothing but two numbers a round reaches the driver, which drops a
round's plans before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node it is connected with) of every node that has an edge.

    ``edges``: two columns of integers; loops, repeats and both directions may occur,
    rows with a null are ignored.
    """
    a, b = edges.columns
    e = textkit.written(edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    before = None
    while True:
        nxt = textkit.written(_small(_large(e)), "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        textkit.drop_written(e)
        textkit.free(edges.sparkSession)
        e = nxt
        if state == before:
            break
        before = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
