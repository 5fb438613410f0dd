"""Fixed-width binary records: a splittable source, a sink, and records by their numbers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from shardsort.functions.records import KEY_LEN, RECORD_LEN
from shardsort.functions.workers import ship_package
from shardsort.sources.seek import opened

#: Bytes of one split, and of one batch within it; both are rounded down to whole records.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SCHEMA = "key binary, value binary, source string, index long"


class _Split(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def record_files(paths: Sequence[str], width: int = RECORD_LEN, partial: str = "error") -> list[tuple[str, int]]:
    """(URI, bytes of whole records) of the files of paths and folders; contents are not read."""
    found = []
    for path in paths:
        fs, local = opened(path)
        info = fs.get_file_info(local)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.is_file else sorted((f for f in fs.get_file_info(pa.fs.FileSelector(local)) if f.is_file), key=lambda f: f.path)
        root = path.partition("://")[0] + "://" if "://" in path else "file://"
        for file in files:
            if file.size % width and partial != "drop":
                raise ValueError(f"{file.path} holds {file.size} bytes, not whole records of {width}")
            found.append((root + file.path, file.size - file.size % width))
    return found


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split("\n") if p]
        self.width = int(options.get("recordlength", RECORD_LEN))
        self.key = int(options.get("keylength", KEY_LEN))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.partial = options.get("partial", "error")

    def partitions(self) -> list[_Split]:
        step = max(self.width, self.split - self.split % self.width)
        files = record_files(self.paths, self.width, self.partial)
        splits = [_Split(uri, at, min(at + step, size)) for uri, size in files for at in range(0, size, step)]
        return splits or [_Split("", 0, 0)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        if split.begin == split.end:
            return
        fs, local = opened(split.path)
        step = max(self.width, BATCH_BYTES - BATCH_BYTES % self.width)
        with fs.open_input_file(local) as file:
            for at in range(split.begin, split.end, step):
                data = file.read_at(min(step, split.end - at), at)
                starts = range(0, len(data), self.width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([data[s : s + self.key] for s in starts], pa.binary()),
                        pa.array([data[s + self.key : s + self.width] for s in starts], pa.binary()),
                        pa.array([split.path] * len(starts), pa.string()),
                        pa.array(range(at // self.width, at // self.width + len(starts)), pa.int64()),
                    ],
                    names=["key", "value", "source", "index"],
                )


@dataclass
class _Staged(WriterCommitMessage):
    """The file that a task wrote, and its final name; none for a task without rows."""

    path: str | None
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Every partition that has rows becomes a file, staged by the tasks and put in place at the commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.out = options["path"].rstrip("/")
        self.width = int(options.get("recordlength", RECORD_LEN))
        self.overwrite = overwrite
        self.stage = f"{self.out}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}"
        fs, stage = opened(self.stage)
        path, file = f"{stage}/{name}-{context.taskAttemptId()}", None
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                if file is None:
                    fs.create_dir(stage, recursive=True)
                    file = fs.open_output_stream(path)
                key, value = (batch.column(batch.schema.get_field_index(c)) for c in ("key", "value"))
                whole = pa.compute.binary_join_element_wise(key.cast(pa.binary()), value.cast(pa.binary()), b"")
                if whole.null_count or pa.compute.any(pa.compute.not_equal(pa.compute.binary_length(whole), self.width)).as_py():
                    raise ValueError(f"a record is null or has not {self.width} bytes")
                file.write(b"".join(whole.to_pylist()))
        finally:
            if file is not None:
                file.close()
        return _Staged(path if file is not None else None, name)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, out = opened(self.out)
        fs.create_dir(out, recursive=True)
        stage = opened(self.stage)[1]
        if self.overwrite:
            for info in fs.get_file_info(pa.fs.FileSelector(out)):
                if info.path != stage:
                    (fs.delete_file if info.is_file else fs.delete_dir)(info.path)
        for message in messages:
            if message is not None and message.path is not None:
                fs.move(message.path, f"{out}/{message.name}")
        self._clear(fs, stage)

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear(*opened(self.stage))

    @staticmethod
    def _clear(fs: pa.fs.FileSystem, stage: str) -> None:
        if fs.get_file_info(stage).type == pa.fs.FileType.Directory:
            fs.delete_dir(stage)


class FixedRecords(DataSource):
    """Format `fixed_records`: files (or folders of files) of records of one width."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def read_records(spark: SparkSession, paths: Sequence[str], partial: str = "error", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(key, value, source, index) of every record, byte for byte; splits fall on record boundaries.

    A file that ends within a record raises; partial="drop" leaves such an end out.
    """
    ship_package(spark)
    spark.dataSource.register(FixedRecords)
    return spark.read.format("fixed_records").options(path="\n".join(paths), partial=partial, splitBytes=split_bytes).load()


def write_records(df: DataFrame, out: str, width: int = RECORD_LEN) -> None:
    """Write (key, value) byte for byte, a file for each partition that has rows, in its order; `out` is replaced.

    A null, or a record of another width, raises and leaves what stood in `out`.
    """
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(FixedRecords)
    plain = df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    plain.write.format("fixed_records").mode("overwrite").options(path=out, recordLength=width).save()


def records_at(wanted: DataFrame, width: int = RECORD_LEN, key_len: int = KEY_LEN) -> DataFrame:
    """(key, value, source, index): random access to the records of `wanted` (source, index), each as often as wanted.

    Only these records are read, each at its offset. An index outside its file raises.
    """
    ship_package(wanted.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, file, keys, values = None, None, [], []
            for source, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if source != path:
                    fs, local = opened(source)
                    path, file = source, fs.open_input_file(local)
                data = file.read_at(width, index * width) if index >= 0 else b""
                if len(data) != width:
                    raise IndexError(f"{source} has no record {index}")
                keys.append(data[:key_len])
                values.append(data[key_len:])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary()), *batch.columns], names=["key", "value", "source", "index"])

    ordered = wanted.select("source", F.col("index").cast("long").alias("index")).sortWithinPartitions("source", "index")
    return ordered.mapInArrow(run, SCHEMA)


def line_of(record_key: str = "key", value: str = "value") -> F.Column:
    """A record's bytes again."""
    return F.concat(F.col(record_key), F.col(value))
