"""Checks on sorted output: order, conservation, repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions that are compared in one window.
BUCKET = 100_000


def order_violations(df: DataFrame, pos: str = "pos", key: str = "key") -> DataFrame:
    """(violations): neighbours in position whose keys fall. Within buckets, then between them."""
    placed = df.select(F.floor(F.col(pos) / BUCKET).alias("bucket"), F.col(pos).alias("pos"), F.col(key).alias("key"))
    inside = placed.withColumn("ahead", F.lag("key").over(Window.partitionBy("bucket").orderBy("pos")))
    ends = inside.groupBy("bucket").agg(
        F.count(F.when(F.col("ahead") > F.col("key"), 1)).alias("bad"),
        F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"),
    )
    between = ends.withColumn("ahead", F.lag("last").over(Window.orderBy("bucket")))
    return between.agg(F.coalesce(F.sum(F.col("bad") + F.when(F.col("ahead") > F.col("first"), 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"))


def conservation_checksum(df: DataFrame, data: str) -> DataFrame:
    """(rows, checksum): equal for two tables of the same rows in any order."""
    part = F.conv(F.substring(F.md5(F.coalesce(F.col(data), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).alias("checksum"))


def duplicate_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, n) of the keys that come more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables are permutations of each other."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
