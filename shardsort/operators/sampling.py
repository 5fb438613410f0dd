"""Sampling with an equal budget for every file, whatever its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.functions.records import RECORD_LEN, draw_index
from shardsort.operators.sorting import group_position

#: Bytes of samples that one worker takes from all its files together: fixed value.
SAMPLE_BYTES = 1 << 20


def sample_budget(files: DataFrame, budget: int = SAMPLE_BYTES, record_len: int = RECORD_LEN) -> DataFrame:
    """(file, size, n_samples): the budget is shared equally, and a file gives no more than it has.

    A file (or a share) of less than one record gives none.
    """
    share = budget // max(1, files.count())
    return files.select("file", "size", F.floor(F.least(F.lit(share), F.col("size")) / record_len).cast("long").alias("n_samples"))


def sample_keys(df: DataFrame, group: str, key: str, order: list[str], budget: int = SAMPLE_BYTES, seed: int = 0) -> DataFrame:
    """(group, key): seeded draws with replacement, as many from each group as the budget says.

    Groups stand for files; a group's size is its rows times the record length.
    """
    counted = df.groupBy(group).agg(F.count("*").alias("rows"))
    sizes = counted.select(F.col(group).alias("file"), (F.col("rows") * RECORD_LEN).alias("size"), "rows")
    draws = sample_budget(sizes.select("file", "size"), budget).join(sizes.select("file", "rows"), "file").filter("n_samples > 0")
    draws = draws.select(F.col("file").alias(group), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_samples"))).alias("draw"), "rows")
    draws = draws.withColumn("index", draw_index("rows", seed, group, "draw"))
    numbered = group_position(df.select(*dict.fromkeys([group, key, *order])), [group], order, "index", base=0)
    return draws.select(group, "index").join(numbered.select(group, key, "index"), [group, "index"]).select(group, key)


def digest_sample(df: DataFrame, key: str, identity: str, rows: int) -> DataFrame:
    """(key) of the rows whose identity has the least digests: a bounded uniform sample that repeats anywhere.

    Each task keeps its own `rows` least ones, so nothing is shuffled but these.
    """
    digest = F.md5(F.col(identity).cast("string").cast("binary"))
    return df.select(key, digest.alias("__digest")).orderBy("__digest").limit(rows).select(key)
