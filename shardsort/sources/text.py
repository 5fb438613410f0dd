"""Text directories and files as lines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardsort.functions import records


#: Bytes read at a time of a file that Spark's own listing passes over.
CHUNK_BYTES = 4 << 20


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def present(spark: SparkSession, dirs: Sequence[str], missing: str = "error") -> list[str]:
    """The directories to read. An absent one raises, or is passed over with missing="skip"."""
    if missing not in ("error", "skip"):
        raise ValueError(f"missing must be 'error' or 'skip', not {missing!r}")
    found = [d for d in dirs if _exists(spark, d)]
    if missing == "error" and len(found) < len(dirs):
        raise FileNotFoundError(f"no such input: {', '.join(sorted(set(dirs) - set(found)))}")
    return found


def _passed_over(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """(file, size) of the regular files in the directories that Spark's listing skips for their names."""
    jvm, rows = spark._jvm, []
    for path in dirs:
        where = jvm.org.apache.hadoop.fs.Path(path)
        for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
            if status.isFile() and jvm.org.apache.spark.util.HadoopFSUtils.shouldFilterOutPathName(status.getPath().getName()):
                rows.append((re.sub(r"^(\w+):/(?!/)", r"\1:///", status.getPath().toUri().toString()), status.getLen()))
    files = spark.createDataFrame(rows, "file string, size long")
    return files.repartition(len(rows), "file") if rows else files


def _lines_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, source) of every line, by the rules of Spark's reader."""
    for batch in batches:
        for source in batch.column(0).to_pylist():
            fs, local = pa.fs.FileSystem.from_uri(source)
            with fs.open_input_stream(local, compression="detect") as file:
                rest, first, data = b"", True, b"\n"
                while data:
                    data = file.read(CHUNK_BYTES)
                    rest += data.removeprefix(b"\xef\xbb\xbf") if first else data
                    first = False
                    held = b"\r" if data and rest.endswith(b"\r") else b""  # half a line end, perhaps
                    lines = re.split(rb"\r\n|\n|\r", rest[: len(rest) - len(held)])
                    rest = lines.pop() + held
                    if not data and rest:
                        lines.append(rest)
                    columns = [pa.array(lines, pa.binary()), pa.array([source] * len(lines), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["value", "source"])


def read_lines(spark: SparkSession, dirs: Sequence[str], missing: str = "error") -> DataFrame:
    """(line, key, source) of every line of every file in the directories, not their subfolders.

    Lines end at \\r\\n, \\n or \\r and keep their bytes. Files whose names begin with `_` or `.`
    are read too, each in one task. No directory left or no file gives no rows.
    """
    found = present(spark, dirs, missing)
    if not found:
        return spark.createDataFrame([], "line string, key string, source string")
    lines = spark.read.text(found).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"))
    others = _passed_over(spark, found)
    if not others.isEmpty():
        read = others.select("file").mapInArrow(_lines_of, "value binary, source string")
        lines = lines.unionByName(read.select(F.col("value").cast("string").alias("line"), "source"))
    return lines.select("line", records.key("line").alias("key"), "source")


def list_files(spark: SparkSession, dirs: Sequence[str], missing: str = "error") -> DataFrame:
    """(file, size) of the regular files in the directories; contents are not read."""
    found = present(spark, dirs, missing)
    if not found:
        return spark.createDataFrame([], "file string, size long")
    files = spark.read.format("binaryFile").load(found).select(F.col("path").alias("file"), F.col("length").alias("size"))
    return files.unionByName(_passed_over(spark, found))
