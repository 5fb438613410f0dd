"""Range partitions by explicit pivots: a key equal to a pivot goes right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardsort.functions.records import RECORD_LEN


def partition_id(key: str | Column, pivots: Sequence) -> Column:
    """The number of pivots that are not above the key, found by bisection.

    Partition i holds the keys from pivot i - 1 (included) to pivot i (excluded); repeated pivots
    leave the partitions between them empty.
    """
    key = F.col(key) if isinstance(key, str) else key
    if not pivots:
        return F.lit(0).cast("long")
    cuts = F.array(*(F.lit(bytearray(p) if isinstance(p, bytes) else p) for p in sorted(pivots)))
    steps = [1 << k for k in range(len(pivots).bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when((at + step <= len(pivots)) & (F.get(cuts, F.least(at + step, F.lit(len(pivots))) - 1) <= key), at + step).otherwise(at),
    )
    return found.cast("long")


def assign(df: DataFrame, key: str, pivots: Sequence, name: str = "pid") -> DataFrame:
    return df.withColumn(name, partition_id(key, pivots))


def partition_by_pivots(df: DataFrame, key: str, pivots: Sequence, *ties: str) -> DataFrame:
    """Exactly len(pivots) + 1 partitions, partition p holding the keys of range p, sorted.

    One exchange, and no sampling pass of Spark's own. Empty ranges are empty partitions.
    """
    placed = assign(df, key, pivots, "__pid")
    return placed.repartitionById(len(pivots) + 1, F.col("__pid").cast("int")).sortWithinPartitions(key, *ties).drop("__pid")


def partition_offsets(df: DataFrame, key: str, pivots: Sequence, record_len: int = RECORD_LEN) -> DataFrame:
    """(pivot_no, byte_offset): where each pivot's partition begins in the sorted file.

    One pass: rows are counted by partition, and the counts (one for each) summed from the front.
    """
    spark = df.sparkSession
    cuts = spark.range(1, len(pivots) + 1).select(F.col("id").alias("pivot_no"))
    counts = assign(df, key, pivots).groupBy("pid").agg(F.count("*").alias("rows")).select((F.col("pid") + 1).alias("pivot_no"), "rows")
    before = Window.orderBy("pivot_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cuts.join(counts, "pivot_no", "left").select("pivot_no", (F.coalesce(F.sum("rows").over(before), F.lit(0)) * record_len).cast("long").alias("byte_offset"))


def partition_sizes(df: DataFrame, key: str, pivots: Sequence, record_len: int = RECORD_LEN) -> DataFrame:
    """(pid, rows, bytes) of the partitions that have rows."""
    return assign(df, key, pivots).groupBy("pid").agg(F.count("*").alias("rows"), (F.count("*") * record_len).cast("long").alias("bytes"))
