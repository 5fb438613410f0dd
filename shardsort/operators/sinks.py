"""Output in an exact number of sorted ranges, a file each: fixed-width text, or binary records."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shardsort.functions import records
from shardsort.operators.partitioning import partition_by_pivots
from shardsort.sources.binary import write_records


def write_partitions(df: DataFrame, out: str, pivots: Sequence, line: str = "line", key: str = "key", mode: str = "compat") -> dict[str, int]:
    """Write the lines, a file for each range that has rows, and say how many rows and bytes went out.

    In the order of their names the files are the total order. What stood in `out` is replaced, so
    a rerun gives the same. In compat mode lines are normalized; in lossless mode they are not, but
    for the line feed after each (binary records have `write_record_partitions`).
    """
    if mode not in ("compat", "lossless"):
        raise ValueError(f"mode must be 'compat' or 'lossless', not {mode!r}")
    body = records.normalize(line) if mode == "compat" else F.col(line)
    if dict(df.dtypes)[line] == "binary":
        body = body.cast("string")  # the text sink writes the bytes as they are
    seen = Observation()
    lines = partition_by_pivots(df, key, pivots, line).select(body.alias("value"))
    lines = lines.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))
    lines.write.mode("overwrite").text(out)
    return dict(seen.get)


def write_record_partitions(df: DataFrame, out: str, pivots: Sequence, width: int = records.RECORD_LEN) -> None:
    """Write binary (key, value) records byte for byte, a file for each range that has rows, sorted by key and value."""
    write_records(partition_by_pivots(df, "key", pivots, "value"), out, width)


def written_files(spark: SparkSession, out: str) -> list[tuple[int, int]]:
    """(range, bytes) of the files of an output folder: one for each range that has rows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(out)
    found = []
    for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
        if part := re.match(r"part-(\d+)", status.getPath().getName()):
            found.append((int(part[1]), status.getLen()))
    return sorted(found)
