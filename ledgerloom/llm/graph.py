"""Connected components by alternating large and small stars, on DataFrames.

No edge or component reaches the driver; between rounds only whether any is left to merge does.
Each round's edges are checkpointed in the shared folder, which cuts lineage.
"""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder; without one, a local session gets one and a cluster an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects garbage, which on a small heap of a long job may be half an hour away
    (spark.cleaner.periodicGC.interval); by then a job of many steps holds many times its input on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` without a known partitioning on ``key``, so that a join deals it out itself and may split hot keys."""
    return df.withColumn(key, F.col(key) + F.lit(0))


def _stars(links: DataFrame) -> bool:
    """Whether every u has one v and no v is a u, which means that components are done."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("child")).union(links.select(F.col("v"), F.lit(0)))
    odd = ends.groupBy("x").agg(F.sum("child").alias("children"), F.min("child").alias("low"))
    return odd.where("children > 1 or (children = 1 and low = 0)").agg(F.count("*")).head()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every long id in an edge; null ends and loops are ignored."""
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = checkpointed(links)
    while not _stars(links):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = spread(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(spread(low, "u"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        release(links.sparkSession)
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
