"""Exact dedup with a log-structured merge index of text digests.

Map side, each task puts (digest, identifier) pairs into a memtable that holds one entry per digest;
a full memtable is flushed as a run sorted by digest, so however many copies a text has, a run
carries it once. Compaction merges the runs of all tasks, and those of an earlier index, into the
runs of the next level: one for each range of digests, sorted, with the smallest identifier of each
digest, how often it came and how often in all (Spark's sort does this out of memory). Every run of
that level is written with a filter of the digests that came more than once, sized by their number;
a digest is looked up in the filter of its own range alone. The second scan passes every text by the
filters. Hits are compared byte by byte: each task keeps one copy of a hit text, folds those equal
to it, and only one copy of a text leaves a task; copies of all tasks are then grouped by digest and
bytes. Texts that share a digest without being equal are told apart exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.llm.common import MAX_BITS, KeyFilter, arrow_rows, bounded_batches, dealt_join, durable, fresh, lower_ascii, table_of_at_most, widened

#: Entries of a memtable before it is flushed.
MEMTABLE = 100_000
#: Runs of a compacted level, each over a range of digests.
RANGES = 64
#: Bytes of hit texts that a task keeps for comparison; then it hands on what it has and starts afresh.
HELD_BYTES = 32 << 20
#: Rows of a table of identifiers and 16-byte digests that may be sent to every task (some 30 MB).
BROADCAST_ROWS = 500_000
_RUN = "digest binary, key long, key_rows long, n_rows long"
_LEVEL = _RUN + ", number int, filter binary"


class Memtable:
    """Digest -> [smallest key, rows with that key, rows in all]."""

    def __init__(self, room: int = MEMTABLE):
        self.room, self.entries = room, {}

    def put(self, digest: bytes, key: int, key_rows: int = 1, n_rows: int = 1) -> bool:
        """Add rows; true if the table is now full and must be flushed."""
        entry = self.entries.get(digest)
        if entry is None:
            self.entries[digest] = [key, key_rows, n_rows]
        else:
            merge(entry, key, key_rows, n_rows)
        return len(self.entries) >= self.room

    def flush(self) -> pa.RecordBatch:
        """The sorted run of all entries; the memtable is empty afterwards."""
        rows = sorted((d, *e) for d, e in self.entries.items())
        self.entries = {}
        return run_of(rows)


def merge(entry: list[int], key: int, key_rows: int, n_rows: int) -> None:
    """Fold rows of the same digest into an entry: the smallest key stays."""
    if key < entry[0]:
        entry[0], entry[1] = key, key_rows
    elif key == entry[0]:
        entry[1] += key_rows
    entry[2] += n_rows


def run_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["digest", "key", "key_rows", "n_rows"])


def signatures(df: DataFrame, doc_id: str, text: str, digest_bytes: int) -> DataFrame:
    """(id, key, sha, digest) of every row; the key orders identifiers, the smallest stays."""
    source = df.select(F.col(doc_id).cast("long").alias("id"), key_of(doc_id).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(lower_ascii(t)).digest() for (t,) in arrow_rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.binary())], names=["id", "key", "sha"])

    return source.mapInArrow(run, "id long, key long, sha binary").withColumn("digest", F.substring("sha", 1, digest_bytes))


def key_of(doc_id: str) -> F.Column:
    """Larger identifiers come first, null last: the bitwise complement reverses the order."""
    return F.coalesce(F.bitwise_not(F.col(doc_id).cast("long")), F.lit((1 << 63) - 1))


def flushed_runs(signed: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs of all tasks' memtables."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Memtable(memtable)
        for batch in batches:
            for digest, key in arrow_rows(batch, "digest", "key"):
                if table.put(digest, key):
                    yield table.flush()
        yield table.flush()

    return signed.select("digest", "key").mapInArrow(run, _RUN)


def range_of(digests: list[bytes], ranges: int) -> np.ndarray:
    """The range that each digest lies in: the first four bytes as a share of all."""
    head = np.frombuffer(b"".join(d[:4].ljust(4, b"\0") for d in digests), ">u4").astype(np.uint64)
    return (head * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


@dataclass
class Level:
    """A compacted level: its entries (one per digest), and the filter of each run, by range."""

    entries: DataFrame
    filters: dict[int, tuple[int, np.ndarray]]
    ranges: int

    def may_repeat(self):
        """A function of a list of digests: whether each may have come more than once."""
        filters, ranges = {r: KeyFilter(*f) for r, f in self.filters.items()}, self.ranges

        def probe(digests: list[bytes]) -> np.ndarray:
            out = np.zeros(len(digests), bool)
            if digests:
                number = range_of(digests, ranges)
                for r in np.unique(number).tolist():
                    if r in filters:
                        at = np.flatnonzero(number == r)
                        out[at] = filters[r].may_hold([digests[k] for k in at])
            return out

        return probe


def compact(*runs: DataFrame, ranges: int = RANGES) -> Level:
    """One level of all runs (the entries of an earlier level are runs too): one row per digest, smallest key kept.

    A run's filter has some 16 bits for each digest that came more than once, within the run's share
    of ``MAX_BITS``.
    """
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    room = max(1 << 12, MAX_BITS // ranges)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, entry, number, repeated = None, [0, 0, 0], None, []

        def filtered() -> pa.RecordBatch:
            """The filter row of the run that ends here."""
            made = KeyFilter(KeyFilter.sized(len(repeated), room))
            made.add(repeated)
            return level_of([], [(number, made.words.tobytes())] if repeated else [])

        for batch in batches:
            rows = []
            for d, key, key_rows, n_rows, r in arrow_rows(batch, "digest", "key", "key_rows", "n_rows", "number"):
                if d == digest:
                    merge(entry, key, key_rows, n_rows)
                    continue
                if digest is not None:
                    rows.append((digest, *entry))
                    if entry[2] > 1:
                        repeated.append(digest)
                if r != number:
                    yield filtered()
                    repeated = []
                digest, entry, number = d, [key, key_rows, n_rows], r
            yield level_of(rows, [])
        if digest is not None:
            if entry[2] > 1:
                repeated.append(digest)
            yield level_of([(digest, *entry)], [])
        yield filtered()

    head = F.conv(F.hex(F.rpad(F.substring("digest", 1, 4), 4, F.unhex(F.lit("00")))), 16, 10).cast("long")
    placed = every.withColumn("number", F.shiftright(head * ranges, 32).cast("int"))
    ordered = placed.repartitionById(ranges, F.col("number")).sortWithinPartitions("number", "digest", "key")
    level = durable(ordered.mapInArrow(run, _LEVEL))
    filters = {r["number"]: (8 * len(r["filter"]), np.frombuffer(r["filter"], np.uint64)) for r in level.filter("filter is not null").select("number", "filter").collect()}
    return Level(level.filter("digest is not null").drop("number", "filter"), filters, ranges)


def level_of(rows: list[tuple], filters: list[tuple]) -> pa.RecordBatch:
    """Entries and filter rows of a level."""
    entries, none = run_of(rows), [None] * len(rows)
    columns = [pa.array([*entries.column(k).to_pylist(), *[None] * len(filters)], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
    columns += [pa.array([*none, *(f[k] for f in filters)], kind) for k, kind in enumerate((pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["digest", "key", "key_rows", "n_rows", "number", "filter"])


def _hit_texts(df: DataFrame, text: str, digest_bytes: int, level: Level) -> DataFrame:
    """(digest, sha, bytes) of texts whose digest the filters admit: one row for each in a task, or a few."""
    sent = df.sparkSession.sparkContext.broadcast((level.filters, level.ranges))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admits = Level(None, *sent.value).may_repeat()
        held: dict[bytes, bytes] = {}  # digest -> the text that copies are compared with
        size = 0
        for batch in batches:
            texts = [lower_ascii(t) for (t,) in arrow_rows(batch, "text")]
            sha = [hashlib.sha256(t).digest() for t in texts]
            out = []
            for k in admits([s[:digest_bytes] for s in sha]).nonzero()[0].tolist():
                digest, own = sha[k][:digest_bytes], texts[k]
                if digest in held and held[digest] == own:
                    continue
                out.append((digest, sha[k], own))
                if size + len(own) > HELD_BYTES:
                    held, size = {}, 0
                size += len(own) - len(held.get(digest, b""))
                held[digest] = own
            columns = [pa.array([o[k] for o in out], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "sha", "bytes"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "digest binary, sha binary, bytes binary")


def mark_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 32, memtable: int = MEMTABLE, ranges: int = RANGES) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256, keep_rows.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts
    the row with the largest doc_id stays; a null doc_id comes last. Rows that repeat an identifier
    and its text all count, are all returned, and are all marked alike; ``keep_rows`` says how many
    rows carry the identifier that stays. ``digest_bytes`` shortens the index's digests (equal
    texts are then still told apart by their bytes). Other columns are not read. An empty table
    gives no rows. A digest of any number of rows is dealt over as many tasks as its rows need.
    """
    bounded_batches(df.sparkSession)
    signed = durable(signatures(df, doc_id, text, digest_bytes))
    level = compact(flushed_runs(signed, memtable), ranges=ranges)
    texts = durable(_hit_texts(df, text, digest_bytes, level).groupBy("digest", "bytes").agg(F.min("sha").alias("sha")).select("digest", "sha"))
    clashing = durable(texts.groupBy("digest").agg(F.count("*").alias("n"), F.count_distinct("sha").alias("n_sha")).filter("n > 1"))
    chosen = level.entries.select("digest", F.col("key").alias("keep_key"), F.col("key_rows").alias("keep_rows"), F.col("n_rows").alias("group_size"))
    if clashing.isEmpty():
        marked = dealt_join(signed, chosen, "digest", "group_size")
    else:
        if not clashing.filter("n_sha < n").isEmpty():
            raise ValueError("texts that differ share a whole SHA-256")
        marked = _told_apart(signed, chosen, clashing.select("digest"))
    keep_id = F.when(F.col("keep_key") != (1 << 63) - 1, F.bitwise_not("keep_key"))
    return marked.select(
        F.col("id").alias("doc_id"), keep_id.alias("keep_id"), "group_size", (F.col("key") == F.col("keep_key")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "keep_rows",
    )


def _told_apart(signed: DataFrame, chosen: DataFrame, clashing: DataFrame) -> DataFrame:
    """Verdicts where texts that differ share a digest: each text is a group of its own."""
    plain = dealt_join(signed, chosen.join(clashing, "digest", "left_anti"), "digest", "group_size")
    rows = durable(signed.join(clashing, "digest", "left_semi"))
    of_key = rows.groupBy("digest", "sha", "key").agg(F.count("*").alias("rows"))
    groups = of_key.groupBy("digest", "sha").agg(F.min(F.struct("key", "rows")).alias("first"), F.sum("rows").alias("group_size"))
    groups = groups.select("sha", F.col("first.key").alias("keep_key"), F.col("first.rows").alias("keep_rows"), "group_size")
    return plain.unionByName(dealt_join(rows, groups, "sha", "group_size"))


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat a document one stays.

    Null texts count as empty and a null doc_id comes last; an empty table stays empty.

    Rows are matched by identifier and digest. Only what is dropped is joined, and it is sent to
    every task where its row count is within BROADCAST_ROWS; beyond that the join is shuffled.
    """
    verdict = durable(mark_copies(df, doc_id, text))
    sha, of_id, of_sha = (fresh(df, name) for name in ("text_sha256", "of_id", "of_sha"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = [hashlib.sha256(lower_ascii(t)).digest()[:16] for (t,) in arrow_rows(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(halves, pa.binary())], names=[*batch.schema.names, sha])

    rows = df.mapInArrow(run, widened(df, f"`{sha}` binary"))

    def among(some: DataFrame, how: str) -> DataFrame:
        keys = some.select(F.col("doc_id").alias(of_id), F.unhex(F.substring("text_sha256", 1, 32)).alias(of_sha)).distinct()
        return rows.join(table_of_at_most(keys, BROADCAST_ROWS), rows[doc_id].cast("long").eqNullSafe(F.col(of_id)) & (rows[sha] == F.col(of_sha)), how)

    repeated = verdict.filter("kept and keep_rows > 1")
    if repeated.isEmpty():
        return among(verdict.filter("not kept"), "left_anti").drop(sha)
    single = among(verdict.filter("not kept or keep_rows > 1"), "left_anti")
    return single.unionByName(among(repeated, "left_semi").dropDuplicates([doc_id, sha])).drop(sha)


ORACLE = """
    WITH n AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ), g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""
