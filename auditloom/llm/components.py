"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node of an edge table.

    Each round links, by joins, the larger neighbours of a node to its smallest one, then the smaller ones, until the
    edges no longer change and each node points to its component's smallest: a number of rounds that grows with the
    logarithm of the longest path. Rounds are cut by written tables. Loops and repeated edges do no harm.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            break
        before = sums
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
        large = both.join(least, F.col("u") == F.col("_u")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        small = large.join(least, F.col("u") == F.col("_u")).select(F.explode(F.array(F.struct("u", F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("e"))
        after = written(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        drop_written(now)
        now = after
    out = written(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    drop_written(now)
    return out
