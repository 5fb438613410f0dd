"""The whole sort: list, draw keys, choose pivots, read, deal by range, sort, write, check."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shardsort.functions import records
from shardsort.functions.records import RECORD_LEN
from shardsort.operators.partitioning import partition_by_pivots
from shardsort.operators.pivots import choose_pivots
from shardsort.operators.sampling import SAMPLE_BYTES, sample_keys
from shardsort.operators.sinks import write_partitions, write_record_partitions, written_files
from shardsort.sources import seek
from shardsort.sources.binary import read_records, record_files
from shardsort.sources.text import list_files, present, read_lines

#: Keys drawn for each range, at least.
KEYS_PER_RANGE = 100


@dataclass
class SortReport:
    """What a sort read and wrote. ``rows`` went in and came out; ``sizes`` are the bytes of each range that has rows."""

    files: int
    input_bytes: int
    partitions: int
    pivots: list
    rows: int
    bytes: int
    sizes: dict[int, int] = field(default_factory=dict)


def budget_for(partitions: int) -> int:
    """Bytes of records to draw: those of one worker at least, and enough keys for every range."""
    return max(SAMPLE_BYTES, KEYS_PER_RANGE * partitions * RECORD_LEN)


def sampled_pivots(df: DataFrame, key: str, partitions: int, budget: int | None = None, seed: int = 0) -> list:
    """Pivots of a sample of any table's keys: those of the rows with the least seeded draws.

    It repeats for the same input files. Only the key column is read, but of all rows; where files
    are at hand, `seek_pivots` reads the drawn places alone.
    """
    if partitions < 2:
        return []
    drawn = df.select(key, F.rand(seed).alias("__draw")).orderBy("__draw").limit(max(1, (budget or budget_for(partitions)) // RECORD_LEN))
    return choose_pivots([r[0] for r in drawn.select(key).collect()], partitions)


def equal_pivots(lines: DataFrame, partitions: int, budget: int | None = None, seed: int = 0) -> list:
    """Pivots of draws with the same budget for every source file, whatever its size."""
    if partitions < 2:
        return []
    drawn = sample_keys(lines, "source", "key", ["key"], budget or budget_for(partitions), seed)
    return choose_pivots([r["key"] for r in drawn.select("key").collect()], partitions)


def seek_pivots(spark: SparkSession, files: Sequence[tuple[str, int]], partitions: int, binary: bool, sampling: str = "weighted", budget: int | None = None, seed: int = 0) -> list:
    """Pivots of keys drawn by seeking: of all the files only the drawn places are read."""
    if partitions < 2:
        return []
    files = sorted(files)
    sizes, budget = [size for _, size in files], budget or budget_for(partitions)
    counts = seek.equal_counts(sizes, budget) if sampling == "equal" else seek.weighted_counts(sizes, budget // RECORD_LEN, seed)
    drawn = [r["key"] for r in seek.read_keys(spark, files, counts, seed, binary).collect()]
    return choose_pivots([bytes(k) for k in drawn] if binary else drawn, partitions)


def _checked(sampling: str) -> None:
    if sampling not in ("weighted", "equal"):
        raise ValueError(f"sampling must be 'weighted' or 'equal', not {sampling!r}")


def sort_lines(
    spark: SparkSession, inputs: Sequence[str], output: str, partitions: int, missing: str = "error", sampling: str = "weighted", seed: int = 0, budget: int | None = None
) -> SortReport:
    """Sort the lines of directories into fixed-width files; no line is lost or added, but over 99
    characters a line is cut.

    Pivots come from keys drawn by seeking, "weighted" by size or with an "equal" budget for every
    file; the lines are then read once. (Compressed files, and stores that only Spark can open, are
    sampled by a scan of the keys.) The rows that were read and written are counted; if they differ
    the sort raises.
    """
    _checked(sampling)
    listed = [(r["file"], r["size"]) for r in list_files(spark, inputs, missing).collect()]
    lines = read_lines(spark, inputs, missing)
    if seek.seekable([path for path, _ in listed]):
        pivots = seek_pivots(spark, listed, partitions, False, sampling, budget, seed)
    else:
        pivots = (equal_pivots if sampling == "equal" else lambda df, *rest: sampled_pivots(df, "key", *rest))(lines, partitions, budget, seed)
    seen = Observation()
    done = write_partitions(lines.select("line", "key").observe(seen, F.count("*").alias("rows")), output, pivots)
    sizes = dict(written_files(spark, output))
    rows = sum(sizes.values()) // RECORD_LEN if not _wide(sizes, done) else done["rows"]
    if seen.get["rows"] != rows and (read := lines.count()) != rows:  # counts of tasks that ran twice may be too large
        raise RuntimeError(f"{read} rows were read and {rows} written")
    return SortReport(len(listed), sum(size for _, size in listed), len(pivots) + 1, pivots, rows, sum(sizes.values()), sizes)


def _wide(sizes: dict[int, int], done: dict[str, int]) -> bool:
    """Whether characters of several bytes make records longer than RECORD_LEN."""
    return sum(sizes.values()) != done["rows"] * RECORD_LEN


def sort_records(
    spark: SparkSession, inputs: Sequence[str], output: str, partitions: int, missing: str = "error", sampling: str = "weighted", seed: int = 0, budget: int | None = None
) -> SortReport:
    """Sort binary records of 100 bytes by their first ten, as unsigned bytes; not a byte is changed.

    Keys are drawn by seeking, the records read once. Bytes in and out are compared file by file; if
    they differ the sort raises. Records with equal keys are ordered by the rest.
    """
    _checked(sampling)
    found = present(spark, inputs, missing)
    files = record_files(found)
    pivots = seek_pivots(spark, files, partitions, True, sampling, budget, seed)
    frame = read_records(spark, found) if found else spark.createDataFrame([], "key binary, value binary")
    write_record_partitions(frame, output, pivots)
    sizes, read = dict(written_files(spark, output)), sum(size for _, size in files)
    if sum(sizes.values()) != read:
        raise RuntimeError(f"{read} bytes were read and {sum(sizes.values())} written")
    return SortReport(len(files), read, len(pivots) + 1, pivots, read // RECORD_LEN, read, sizes)


def sort_frame(df: DataFrame, line: str, partitions: int, *ties: str, seed: int = 0) -> DataFrame:
    """The same over a DataFrame: exact partitions, sorted by the key of `line`."""
    keyed = df.withColumn("key", records.key(line))
    return partition_by_pivots(keyed, "key", sampled_pivots(keyed, "key", partitions, seed=seed), *ties)
