"""What the training-data operators share: table access, durable cuts, key filters.

Every input is read through Spark (paths may live in a store that only Spark can open) and every
intermediate cut goes to the folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardsort.functions.durable import durable, written
from shardsort.functions.workers import ship_package
from shardsort.operators.joins import dealt_join, fresh, salted_join

#: Arrow batches handed to Python hold at most this many rows and bytes.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20

__all__ = [
    "BATCH_BYTES", "BATCH_ROWS", "KeyFilter", "arrow_rows", "bounded_batches", "dealt_join", "durable", "fresh", "lower_ascii", "salted_join", "table", "table_of_at_most", "widened", "written",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Prepare a session for Python workers: bounded Arrow batches, so that very long texts cannot
    fill a worker, and this package sent along."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z (and nothing else) lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def widened(df: DataFrame, added: str) -> T.StructType:
    """The schema of df with further columns, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def arrow_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


#: Bits of a filter, at most: 64 MB.
MAX_BITS = 1 << 29


class KeyFilter:
    """A Bloom filter over 128-bit (or longer) digests, sized by their number.

    It only ever spares work: a key that was added is always reported, so what passes it is a
    superset and the exact step that follows decides. It has some 16 bits a key (a false answer in
    1,000), and never more than ``max_bits`` in all, so it may be sent to every task: 64 MB, which
    is 8 bits for each of 67 million keys (one in 40 false). With 200 million keys every third
    answer is false, and what passes needlessly is shuffled and dropped.
    """

    PROBES = 5

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(bits >> 6, np.uint64) if words is None else words

    @staticmethod
    def sized(keys: int, max_bits: int = MAX_BITS) -> int:
        """A power of two of about 16 bits a key, within the bound."""
        return int(min(max_bits, max(1 << 12, 1 << int(16 * max(1, keys) - 1).bit_length())))

    def places(self, digests: list[bytes]) -> np.ndarray:
        """Bit positions of each digest, from its first sixteen bytes (double hashing)."""
        pairs = np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in digests), "<u8").reshape(-1, 2)
        steps = np.arange(self.PROBES, dtype=np.uint64)
        with np.errstate(over="ignore"):
            mixed = pairs[:, :1] + steps[None, :] * (pairs[:, 1:] | np.uint64(1))
        return mixed & np.uint64(self.bits - 1)

    def add(self, digests: list[bytes]) -> None:
        if digests:
            at = self.places(digests).ravel()
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, bool)
        at = self.places(digests)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    @classmethod
    def over(cls, keys: DataFrame, column: str, max_bits: int = MAX_BITS) -> KeyFilter:
        """Filter of all digests of a binary column: built per partition, ORed word by word.

        Only non-zero words travel; the driver receives at most ``max_bits`` / 64 of them.
        """
        bits = cls.sized(keys.count(), max_bits)

        def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = cls(bits)
            for batch in batches:
                part.add([k for (k,) in arrow_rows(batch, column) if k is not None])
            at = np.flatnonzero(part.words)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(part.words[at].view(np.int64), pa.int64())], names=["word", "bits"])

        merged = keys.select(column).mapInArrow(build, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(bits >> 6, np.uint64)
        words[merged["word"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
        return cls(bits, words)


def table_of_at_most(df: DataFrame, rows: int) -> DataFrame:
    """Hint that df be sent to every task, but only if it is counted to be within the bound."""
    counted = durable(df)
    return F.broadcast(counted) if counted.count() <= rows else counted
