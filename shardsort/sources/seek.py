"""Keys drawn by seeking: only the drawn places of the files are read."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardsort.functions import records
from shardsort.functions.records import KEY_LEN, RECORD_LEN
from shardsort.functions.workers import ship_package

#: Names of files that are not plain bytes.
_PACKED = re.compile(r"\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|xz)$", re.I)
_LINE_END = re.compile(rb"\r\n|\n|\r")
#: Bytes read at once when a line is looked for, and of a line that are kept (its key has ten characters).
WINDOW, HEAD = 4096, 64
#: Draws that one task reads.
TASK_DRAWS = 20_000


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and local name of a path or URI (a bare path is a local one)."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", path) if re.match(r"\w+:/", path) else f"file://{path}")


def seekable(paths: Sequence[str]) -> bool:
    """Whether all files are plain bytes in stores that can be opened here."""
    if any(_PACKED.search(p) for p in paths):
        return False
    try:
        for path in {re.match(r"(\w+:/+[^/]*)?", p)[0]: p for p in paths}.values():
            opened(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def weighted_counts(sizes: Sequence[int], draws: int, seed: int) -> np.ndarray:
    """How many of the draws fall to each file: every byte is as likely as any other."""
    sizes = np.asarray(sizes, np.float64)
    if not sizes.sum():
        return np.zeros(len(sizes), np.int64)
    return np.random.default_rng(seed).multinomial(draws, sizes / sizes.sum())


def equal_counts(sizes: Sequence[int], budget: int, record_len: int = RECORD_LEN) -> np.ndarray:
    """The same budget of bytes for every file, of which it gives no more than it has."""
    share = budget // max(1, len(sizes))
    return np.minimum(share, np.asarray(sizes, np.int64)) // record_len


def offsets(sizes: Sequence[int], counts: np.ndarray, seed: int, record_len: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(file number, byte offset) of every draw, with replacement, at whole records."""
    rng = np.random.default_rng([seed, 1])
    number = np.repeat(np.arange(len(sizes)), counts)
    places = np.asarray(sizes, np.int64)[number] // record_len
    return number[places > 0], (rng.random(len(number)) * places).astype(np.int64)[places > 0] * record_len


def _line_at(file: pa.NativeFile, size: int, offset: int) -> bytes:
    """The head of the first line that begins at the offset or after it; past the last one, of the first."""
    at, rest, begins = max(0, offset - 1), b"", offset == 0
    while not begins:
        data = file.read_at(WINDOW, at + len(rest))
        rest += data
        end = _LINE_END.search(rest)
        if end and (end.end() < len(rest) or not data):  # else a line feed may still follow
            at, begins = at + end.end(), True
        elif not data:
            at, begins = 0, True
    return _LINE_END.split(file.read_at(HEAD, at if at < size else 0), 1)[0]


def read_keys(spark: SparkSession, files: Sequence[tuple[str, int]], counts: np.ndarray, seed: int, binary: bool, record_len: int = RECORD_LEN, key_len: int = KEY_LEN) -> DataFrame:
    """(key) of each draw. Of binary files the key of a whole record; of text files that of the line
    after a random place, so a line is as likely as the line before it is long."""
    ship_package(spark)
    sizes = [size for _, size in files]
    number, places = offsets(sizes, counts, seed, record_len if binary else 1)
    order = np.lexsort((places, number))
    names = np.array([path for path, _ in files], object)
    drawn = pa.table({"path": pa.array(names[number[order]] if len(files) else [], pa.string()), "size": pa.array(np.asarray(sizes, np.int64)[number[order]] if len(files) else [], pa.int64()), "place": pa.array(places[order], pa.int64())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, path, file = [], None, None
            for own, size, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != path:
                    fs, local = opened(own)
                    path, file = own, fs.open_input_file(local)
                keys.append(file.read_at(key_len, place) if binary else _line_at(file, size, place))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["data"])

    rows = spark.createDataFrame(drawn) if len(drawn) else spark.createDataFrame([], "path string, size long, place long")
    read = rows.repartitionByRange(max(1, -(-len(drawn) // TASK_DRAWS)), "path", "place").mapInArrow(run, "data binary")
    return read.select((F.col("data") if binary else records.key(F.col("data").cast("string"))).alias("key"))
