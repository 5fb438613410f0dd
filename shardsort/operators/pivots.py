"""Pivot keys: the cuts between partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.operators.sorting import global_position


def choose_pivots(keys: Sequence, partitions: int) -> list:
    """N - 1 pivots of sampled keys: of the sorted keys those at int(i * (n / N)), i from 1.

    One partition or no keys need none. Repeated pivots stay; they give empty partitions.
    """
    if partitions < 1:
        raise ValueError("at least one partition")
    ordered = sorted(keys)
    step = len(ordered) / partitions
    return [ordered[int(i * step)] for i in range(1, partitions)] if ordered else []


def select_pivots(df: DataFrame, key: str, order: Sequence[str], partitions: int) -> DataFrame:
    """(pivot_no, pivot) of a table of keys of any size, by the same rule."""
    ranked = global_position(df, [key, *[c for c in order if c != key]], "__at", base=0)
    numbers = df.agg(F.count("*").alias("__n")).select("__n", F.explode(F.sequence(F.lit(1), F.lit(max(1, partitions - 1)))).alias("pivot_no")).filter(F.lit(partitions > 1))
    wanted = numbers.select(F.col("pivot_no").cast("long"), F.floor(F.col("pivot_no") * (F.col("__n") / F.lit(float(partitions)))).cast("long").alias("__want"))
    return ranked.join(F.broadcast(wanted), F.col("__at") == F.col("__want")).select("pivot_no", F.col(key).alias("pivot"))


def pivot_list(pivots: DataFrame) -> list:
    """The pivots in order, on the driver: one for each partition but the last."""
    return [r["pivot"] for r in pivots.orderBy("pivot_no").collect()]
