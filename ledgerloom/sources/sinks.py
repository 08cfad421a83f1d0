"""Sinks: change sets, exports with a manifest, content-addressed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_set(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ from ``before`` in one of the columns."""
    old = before.select(key, F.struct(*columns).alias("_old"))
    joined = after.join(old, key, "left")
    return joined.where(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old")


def apply_changes(before: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``before`` with changed rows overwritten."""
    new = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = before.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*before.columns)


def export(tables: dict[str, DataFrame], path: str, key: str = "user_id") -> DataFrame:
    """JSON files of every table, a folder a user, and the manifest of row counts."""
    manifest = None
    for name, df in tables.items():
        df.repartition(key).write.mode("overwrite").partitionBy(key).option("compression", "gzip").json(f"{path}/{name}")
        part = df.groupBy(key).agg(F.count("*").alias("rows")).withColumn("entity", F.lit(name))
        manifest = part if manifest is None else manifest.unionByName(part)
    return manifest


def content_addresses(files: DataFrame, content: str = "content") -> DataFrame:
    """Distinct contents by SHA-256 with the number of files and their length."""
    return files.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("address")).agg(F.count("*").alias("files"), F.max(F.octet_length(content)).alias("bytes"))
