"""Sorted runs, their merge, the total order and positions within it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardsort.functions.durable import durable
from shardsort.operators.joins import dealt_join

#: Rows of one sorted run: fixed value.
RUN_ROWS = 100_000


def global_sort(df: DataFrame, *order: str | Column) -> DataFrame:
    """The total order. Spark samples, deals by range and sorts out of memory."""
    return df.orderBy(*order)


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos", base: int = 1) -> DataFrame:
    """Add each row's position in the total order, without any single-task window.

    Rows are dealt by range and sorted; a row's number within its partition is in the low bits of
    its generated id, and partitions' row counts (one row each) are summed up to give offsets. The
    sorted rows are checkpointed so that both passes see the same ranges. Orders with ties give
    each tied row some position of its own; give a unique order for repeatable ones.
    """
    local = f"__{name}_id"
    ranged = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(local, F.monotonically_increasing_id()))
    part = F.shiftright(local, 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    position = F.col("__offset") + F.col(local).bitwiseAND(F.lit((1 << 33) - 1)) + base
    return ranged.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, position.cast("long")).drop("__part", "__offset", local)


def group_position(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "pos", base: int = 1) -> DataFrame:
    """Add each row's position within its group, which may hold any share of the rows.

    Positions in the order of group, then ``order``, less the group's first one.
    """
    at, whole = f"__{name}_at", f"__{name}_group"
    key = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.base64(F.encode(F.col(g).cast("string"), "UTF-8"))), F.lit("-")) for g in group))
    placed = global_position(df, [*group, *[c for c in order if c not in group]], at, base=0).withColumn(whole, key)
    firsts = placed.groupBy(whole).agg(F.min(at).alias("__first"), F.count("*").alias("__rows"))
    numbered = dealt_join(placed, firsts, whole, "__rows").withColumn(name, (F.col(at) - F.col("__first") + base).cast("long"))
    return numbered.drop(at, whole, "__first", "__rows")


def chunk_assign(df: DataFrame, order: Sequence[str | Column], rows: int = RUN_ROWS, name: str = "chunk") -> DataFrame:
    """Add the number (from 0) of the run that each row falls into, in reading order."""
    return global_position(df, order, name, base=0).withColumn(name, F.floor(F.col(name) / rows).cast("long"))


def sort_chunks(df: DataFrame, chunk: str, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Add each row's rank (from 1) within its run; a run is of bounded size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(chunk).orderBy(*order)).cast("long"))


def merge_runs(runs: Sequence[DataFrame], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """The rows of all runs in one order, with their positions; any number of runs at once."""
    return global_position(reduce(DataFrame.unionByName, runs), order, name)
