"""Views of the exchange: who sends what to whom, and in which pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.operators.sorting import group_position

#: Rows of one page: fixed value.
PAGE_ROWS = 10_000


def shuffle_matrix(df: DataFrame, src: str = "src", pid: str = "pid") -> DataFrame:
    """(src, pid, rows) of every pair that exchanges rows."""
    return df.groupBy(src, pid).agg(F.count("*").alias("rows"))


def shuffle_pages(df: DataFrame, src: str = "src", pid: str = "pid", page_rows: int = PAGE_ROWS) -> DataFrame:
    """(src, pid, page, rows, has_more) of every page that a pull asks for.

    A page says that more follows if it is full; so rows that fill their pages exactly are followed
    by an empty last page. Pages follow from the counts alone.
    """
    counts = shuffle_matrix(df, src, pid).withColumnRenamed("rows", "all_rows")
    pages = counts.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("all_rows") / page_rows).cast("long"))))
    rows = F.least(F.lit(page_rows), F.col("all_rows") - F.col("page") * page_rows).cast("long")
    return pages.withColumn("rows", rows).select(src, pid, "page", "rows", (F.col("rows") == page_rows).alias("has_more"))


def page_of(df: DataFrame, group: Sequence[str], order: Sequence[str], page_rows: int = PAGE_ROWS, name: str = "page") -> DataFrame:
    """Add the page (from 0) that each row of a group is sent in."""
    return group_position(df, group, order, name, base=0).withColumn(name, F.floor(F.col(name) / page_rows).cast("long"))


def local_rows(df: DataFrame, src: str = "src", pid: str = "pid") -> DataFrame:
    """The rows that stay where they are."""
    return df.filter(F.col(src) == F.col(pid))
