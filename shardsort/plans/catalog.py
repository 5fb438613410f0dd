"""Registered record-sort queries, and the DuckDB SQL that each must equal.

Documents stand for lines, `doc_id % 4` for the worker that holds one, and every order ends in a
unique column. Positions, ranks and counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardsort import cli
from shardsort.functions import records
from shardsort.functions.durable import own_path
from shardsort.operators import exchange, partitioning, pivots, sampling, sinks, sorting, validate
from shardsort.plans import job
from shardsort.sources import binary, text

#: Ranges, rows of a run, rows of a page and bytes of samples in these queries.
PARTITIONS, CHUNK, PAGE, BUDGET = 4, 1000, 10, 100_000
#: Keys that pivots are chosen from: those of a worker's sample.
SAMPLE_KEYS = sampling.SAMPLE_BYTES // records.RECORD_LEN
#: Seed of the draws with replacement.
SEED = 1


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, src, k) of the documents; the text is not carried further."""
    return _documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % PARTITIONS).alias("src"), records.key("text").alias("k"))


def _cuts(keyed: DataFrame, key: str = "k", identity: str = "doc_id") -> list:
    """Pivots of a bounded sample that SQL can repeat."""
    drawn = sampling.digest_sample(keyed, key, identity, SAMPLE_KEYS)
    return pivots.choose_pivots([r[0] for r in drawn.collect()], PARTITIONS)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, sf_dir)
    return partitioning.assign(keyed, "k", _cuts(keyed))


def scan_lines(spark, sf_dir):
    return records.split_lines(_documents(spark, sf_dir), "text", "doc_id")


def key_extract(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", records.key("text").alias("k"))


def byte_key_extract(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.hex(records.byte_key("text")).alias("k_hex"))


def record_normalize(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", records.normalize("text").alias("rec"))


def chunk_assign(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return sorting.chunk_assign(orders, ["o_orderkey"], CHUNK)


def chunk_sort(spark, sf_dir):
    chunks = sorting.chunk_assign(_keyed(spark, sf_dir).select("doc_id", "k"), ["doc_id"], CHUNK // 10)
    return sorting.sort_chunks(chunks, "chunk", ["k", "doc_id"]).select("doc_id", "chunk", "rank")


def total_order_position(spark, sf_dir):
    return sorting.global_position(_keyed(spark, sf_dir).select("doc_id", "k"), ["k", "doc_id"]).select("doc_id", "pos")


def kway_merge(spark, sf_dir):
    keyed = _keyed(spark, sf_dir).select("doc_id", "k", (F.col("doc_id") % 3).alias("run"))
    runs = [keyed.filter(F.col("run") == r) for r in range(3)]
    return sorting.merge_runs(runs, ["k", "doc_id"]).select("doc_id", "run", "pos")


def sample_budget(spark, sf_dir):
    sizes = _keyed(spark, sf_dir).groupBy("src").agg((F.count("*") * records.RECORD_LEN).alias("size"))
    return sampling.sample_budget(sizes.select(F.col("src").alias("file"), "size"), BUDGET).select(F.col("file").alias("src"), "n_samples")


def sample_keys(spark, sf_dir):
    return sampling.sample_keys(_keyed(spark, sf_dir), "src", "k", ["k", "doc_id"], BUDGET, seed=SEED)


def pivot_select(spark, sf_dir):
    return pivots.select_pivots(_keyed(spark, sf_dir), "k", ["k", "doc_id"], PARTITIONS)


def partition_assign(spark, sf_dir):
    return _placed(spark, sf_dir).select("doc_id", "pid")


def partition_offsets(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return partitioning.partition_offsets(keyed, "k", _cuts(keyed))


def partition_sizes(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return partitioning.partition_sizes(keyed, "k", _cuts(keyed))


def shuffle_matrix(spark, sf_dir):
    return exchange.shuffle_matrix(_placed(spark, sf_dir))


def shuffle_pages(spark, sf_dir):
    return exchange.shuffle_pages(_placed(spark, sf_dir), page_rows=PAGE)


def shuffle_page_rows(spark, sf_dir):
    paged = exchange.page_of(_placed(spark, sf_dir), ["src", "pid"], ["k", "doc_id"], PAGE)
    return paged.select("doc_id", "src", "pid", "page")


def local_rows(spark, sf_dir):
    return exchange.local_rows(_placed(spark, sf_dir)).select("doc_id", "pid")


def final_merge(spark, sf_dir):
    """The physical form: exact partitions, sorted; a row's number within its partition."""
    keyed = _keyed(spark, sf_dir)
    sorted_parts = partitioning.partition_by_pivots(keyed, "k", _cuts(keyed), "doc_id")
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return sorted_parts.select("doc_id", F.spark_partition_id().cast("long").alias("pid"), local.alias("local_pos"))


def order_violations(spark, sf_dir):
    return validate.order_violations(sorting.global_position(_keyed(spark, sf_dir).select("doc_id", "k"), ["doc_id"]), "pos", "k")


def conservation_checksum(spark, sf_dir):
    return validate.conservation_checksum(_documents(spark, sf_dir), "text")


def duplicate_keys(spark, sf_dir):
    return validate.duplicate_keys(_keyed(spark, sf_dir), "k")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, key): the documents as single lines."""
    flat = _documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[\r\n]", " ").alias("line"))
    return flat.withColumn("key", records.key("line"))


def sink_roundtrip(spark, sf_dir):
    """Write normalized records into exact ranges in the shared folder, read them again, count them."""
    flat = _flat(spark, sf_dir)
    sinks.write_partitions(flat, out := own_path(spark, "sink"), _cuts(flat, "key"))
    return spark.read.text(out).groupBy(F.col("value").alias("rec")).agg(F.count("*").alias("n"))


def sink_files(spark, sf_dir):
    """The files of the same output, as listed without reading them: (pid, bytes)."""
    flat = _flat(spark, sf_dir)
    sinks.write_partitions(flat, out := own_path(spark, "sink"), _cuts(flat, "key"))
    number = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1)
    parts = text.list_files(spark, [out]).filter((F.col("size") > 0) & (number != ""))
    return parts.select(number.try_cast("long").alias("pid"), F.col("size").alias("bytes"))


def _folders(spark: SparkSession, sf_dir: str) -> list[str]:
    """The single lines in three folders, by doc_id."""
    flat, base = _flat(spark, sf_dir), own_path(spark, "lines")
    for k in range(3):
        flat.filter(F.col("doc_id") % 3 == k).select("line").write.text(f"{base}/{k}")
    return [f"{base}/{k}" for k in range(3)]


def scan_folders(spark, sf_dir):
    """Every line of several folders, one of which is absent and passed over."""
    folders = _folders(spark, sf_dir)
    lines = text.read_lines(spark, [folders[0], folders[0] + "-none", *folders[1:]], missing="skip")
    return lines.groupBy("line", "key").agg(F.count("*").alias("n"))


def merge_files(spark, sf_dir):
    """Runs in files of their own, merged: every line with its position."""
    runs = [text.read_lines(spark, [folder]).select("line", "key") for folder in _folders(spark, sf_dir)]
    return sorting.merge_runs(runs, ["key", "line"]).select("pos", "line")


def sort_job(spark, sf_dir):
    """The whole job over folders: its files one after the other, every record with its position."""
    job.sort_lines(spark, _folders(spark, sf_dir), out := own_path(spark, "sorted"), PARTITIONS)
    read = spark.read.text(out).select(F.col("value").alias("rec"), records.key("value").alias("key"))
    number = F.regexp_extract(F.input_file_name(), r"/part-(\d+)", 1).cast("int")
    within = read.withColumn("file", number).withColumn("at", F.monotonically_increasing_id())
    return sorting.global_position(within, ["file", "at"]).select("pos", "key")


def map_side(spark, sf_dir):
    """What a worker does before the exchange: runs of its rows, sorted, and cut by range."""
    keyed = _keyed(spark, sf_dir)
    chunks = sorting.sort_chunks(sorting.chunk_assign(keyed, ["doc_id"], CHUNK // 10), "chunk", ["k", "doc_id"])
    return partitioning.assign(chunks, "k", _cuts(keyed)).select("doc_id", "chunk", "rank", "pid")


def _record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, key, value): a binary record of 100 bytes for each document, unique by its key."""
    whole = F.rpad(F.concat_ws("|", F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")), records.RECORD_LEN, ".").cast("binary")
    return _documents(spark, sf_dir).select("doc_id", records.byte_key(whole).alias("key"), F.substring(whole, records.KEY_LEN + 1, records.RECORD_LEN).alias("value"))


def _record_files(spark: SparkSession, sf_dir: str) -> str:
    recs = _record(spark, sf_dir)
    cuts = pivots.choose_pivots([bytes(r["key"]) for r in sampling.digest_sample(recs, "key", "doc_id", SAMPLE_KEYS).collect()], PARTITIONS)
    sinks.write_record_partitions(recs, out := own_path(spark, "records"), cuts)
    return out


def _pid_of(source: str) -> F.Column:
    return F.regexp_extract(source, r"/part-(\d+)$", 1).cast("long")


def binary_roundtrip(spark, sf_dir):
    """Binary records written into exact ranges and read back: file, number within it, bytes."""
    read = binary.read_records(spark, [_record_files(spark, sf_dir)])
    return read.select(_pid_of("source").alias("pid"), "index", F.hex(binary.line_of()).alias("rec_hex"))


def record_by_index(spark, sf_dir):
    """Random access by seeking: the first, the last and the middle record of every file, twice the first."""
    files = binary.record_files([_record_files(spark, sf_dir)])
    rows = [(path, index) for path, size in files for index in (0, 0, size // 100 - 1, size // 200)]
    found = binary.records_at(spark.createDataFrame(rows, "source string, index long"))
    return found.select(_pid_of("source").alias("pid"), "index", F.hex("key").alias("key_hex"))


def record_sort(spark, sf_dir):
    """The whole binary job: its files one after the other, every record with its position."""
    out = own_path(spark, "sorted")
    job.sort_records(spark, [_record_files(spark, sf_dir)], out, PARTITIONS)
    read = binary.read_records(spark, [out]).withColumn("file", _pid_of("source"))
    return sorting.global_position(read, ["file", "index"]).select("pos", F.hex("key").alias("key_hex"))


def command_line(spark, sf_dir):
    """The same by the command line, with as many draws from every file."""
    out = own_path(spark, "sorted")
    cli.main(["-I", _record_files(spark, sf_dir), "-O", out, "--partitions", str(PARTITIONS), "--binary", "--sampling", "equal", "--seed", str(SEED)])
    read = binary.read_records(spark, [out]).withColumn("file", _pid_of("source"))
    return sorting.global_position(read, ["file", "index"]).select("pos", F.hex("key").alias("key_hex"))


def record_offsets(spark, sf_dir):
    """Whole records in the bytes of each text, and where the record of the document's number begins."""
    size = F.octet_length("text")
    return _documents(spark, sf_dir).select("doc_id", records.record_count(size).alias("n_records"), records.byte_offset("doc_id").alias("byte_offset"))


def random_offsets(spark, sf_dir):
    """A drawn, record-aligned offset within the whole records of each text that has any."""
    sized = _documents(spark, sf_dir).select("doc_id", records.record_count(F.octet_length("text")).alias("n")).filter("n > 0")
    return sized.select("doc_id", records.random_record_offset("n", SEED, "doc_id").alias("byte_offset"))


def sample_budget_none(spark, sf_dir):
    """A budget whose share is less than a record draws nothing from any file."""
    sizes = _keyed(spark, sf_dir).groupBy("src").agg((F.count("*") * records.RECORD_LEN).alias("size"))
    return sampling.sample_budget(sizes.select(F.col("src").alias("file"), "size"), 99 * PARTITIONS).select(F.col("file").alias("src"), "n_samples")


def samples_sorted(spark, sf_dir):
    """The drawn keys of all files together, in order."""
    return sorting.global_position(sample_keys(spark, sf_dir).select("k"), ["k"]).select("pos", "k")


def sample_pivots(spark, sf_dir):
    """The cuts that the bounded sample gives, by the pivot rule."""
    cuts = _cuts(_keyed(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(cuts, 1)), "pivot_no long, cut string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        scan_lines, key_extract, byte_key_extract, record_normalize, chunk_assign, chunk_sort, total_order_position, kway_merge,
        sample_budget, sample_keys, pivot_select, partition_assign, partition_offsets, partition_sizes, shuffle_matrix, shuffle_pages,
        shuffle_page_rows, local_rows, final_merge, order_violations, conservation_checksum, duplicate_keys, sink_roundtrip, sink_files,
        scan_folders, merge_files, sort_job, map_side, binary_roundtrip, record_by_index, record_sort, command_line, record_offsets, random_offsets,
        sample_budget_none, samples_sorted, sample_pivots,
    )
    return {f.__name__: f for f in listed}


_K = "rpad(substring(text, 1, 10), 10, ' ')"
_BASE = f"""
    keyed AS (SELECT doc_id, doc_id % {PARTITIONS} AS src, {_K} AS k FROM documents),
    ranked AS (SELECT *, row_number() OVER (ORDER BY k, doc_id) - 1 AS idx, count(*) OVER () AS n FROM keyed),
    drawn AS (SELECT k FROM keyed ORDER BY md5(doc_id::VARCHAR) LIMIT {SAMPLE_KEYS}),
    drawn_ranked AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM drawn),
    cuts AS (
        SELECT i::BIGINT AS pivot_no, k AS cut FROM range(1, {PARTITIONS}) AS r(i)
        JOIN drawn_ranked ON idx = floor(i * (n / {PARTITIONS}::DOUBLE))::BIGINT
    ),
    placed AS (SELECT doc_id, src, k, (SELECT count(*) FROM cuts WHERE cut <= k)::BIGINT AS pid FROM keyed)"""
#: Draws with replacement of every source.
_DRAWN = f"""
    sized AS (SELECT doc_id % {PARTITIONS} AS src, count(*) AS n FROM documents GROUP BY 1),
    budget AS (SELECT src, n, (least({BUDGET} // (SELECT count(*) FROM sized), n * 100) // 100)::BIGINT AS n_samples FROM sized),
    draw AS (SELECT src, n, unnest(range(1, n_samples + 1)) AS draw FROM budget),
    placed_draw AS (SELECT src, ('0x' || substr(md5('{SEED}|' || src || '|' || draw), 1, 15))::BIGINT % n AS idx FROM draw),
    numbered AS (SELECT doc_id % {PARTITIONS} AS src, {_K} AS k, row_number() OVER (PARTITION BY doc_id % {PARTITIONS} ORDER BY {_K}, doc_id) - 1 AS idx FROM documents),
    samples AS (SELECT src, k FROM placed_draw JOIN numbered USING (src, idx))"""
#: The documents as single lines, and their ranges.
_FLAT = f"""
    flat AS (SELECT doc_id, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS line, rpad(substring(regexp_replace(text, '[\\r\\n]', ' ', 'g'), 1, 10), 10, ' ') AS key FROM documents),
    flat_drawn AS (SELECT key FROM flat ORDER BY md5(doc_id::VARCHAR) LIMIT {SAMPLE_KEYS}),
    flat_ranked AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM flat_drawn),
    flat_cuts AS (SELECT key AS cut FROM range(1, {PARTITIONS}) AS r(i) JOIN flat_ranked ON idx = floor(i * (n / {PARTITIONS}::DOUBLE))::BIGINT)"""
#: Binary records and their places in the files.
_RECORDS = f"""
    rec AS (SELECT doc_id, rpad(md5(doc_id::VARCHAR) || '|' || doc_id, 100, '.') AS r FROM documents),
    rec_drawn AS (SELECT substr(r, 1, 10) AS k FROM rec ORDER BY md5(doc_id::VARCHAR) LIMIT {SAMPLE_KEYS}),
    rec_ranked AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM rec_drawn),
    rec_cuts AS (SELECT k AS cut FROM range(1, {PARTITIONS}) AS t(i) JOIN rec_ranked ON idx = floor(i * (n / {PARTITIONS}::DOUBLE))::BIGINT),
    rec_placed AS (SELECT r, (SELECT count(*) FROM rec_cuts WHERE cut <= substr(r, 1, 10))::BIGINT AS pid FROM rec),
    stored AS (SELECT r, pid, row_number() OVER (PARTITION BY pid ORDER BY r) - 1 AS idx, count(*) OVER (PARTITION BY pid) AS n FROM rec_placed)"""


def oracle_sql() -> dict[str, str]:
    return {
        "scan_lines": r"""
            WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') AS lines FROM documents WHERE length(text) > 0)
            SELECT doc_id, unnest(range(len(lines)))::BIGINT AS ln, unnest(lines) AS line FROM s""",
        "key_extract": f"SELECT doc_id, {_K} AS k FROM documents",
        "byte_key_extract": "SELECT doc_id, substr(hex(encode(text)), 1, 20) AS k_hex FROM documents",
        "record_normalize": "SELECT doc_id, rpad(text, 99, ' ') AS rec FROM documents",
        "chunk_assign": f"SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // {CHUNK})::BIGINT AS chunk FROM orders",
        "chunk_sort": f"""
            WITH c AS (SELECT doc_id, {_K} AS k, ((row_number() OVER (ORDER BY doc_id) - 1) // {CHUNK // 10})::BIGINT AS chunk FROM documents)
            SELECT doc_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY k, doc_id) AS rank FROM c""",
        "total_order_position": f"SELECT doc_id, row_number() OVER (ORDER BY {_K}, doc_id) AS pos FROM documents",
        "kway_merge": f"SELECT doc_id, doc_id % 3 AS run, row_number() OVER (ORDER BY {_K}, doc_id) AS pos FROM documents",
        "sample_budget": f"""
            WITH f AS (SELECT doc_id % {PARTITIONS} AS src, count(*) * 100 AS size FROM documents GROUP BY 1)
            SELECT src, (least({BUDGET} // (SELECT count(*) FROM f), size) // 100)::BIGINT AS n_samples FROM f""",
        "sample_keys": f"WITH {_DRAWN} SELECT src, k FROM samples",
        "samples_sorted": f"WITH {_DRAWN} SELECT row_number() OVER (ORDER BY k) AS pos, k FROM samples",
        "sample_budget_none": f"SELECT doc_id % {PARTITIONS} AS src, 0::BIGINT AS n_samples FROM documents GROUP BY 1",
        "sample_pivots": f"WITH {_BASE} SELECT pivot_no, cut FROM cuts",
        "pivot_select": f"""
            WITH {_BASE} SELECT i::BIGINT AS pivot_no, k AS "pivot" FROM range(1, {PARTITIONS}) AS r(i) JOIN ranked ON idx = floor(i * (n / {PARTITIONS}::DOUBLE))::BIGINT""",
        "sink_files": f"""
            WITH {_FLAT}, p AS (SELECT (SELECT count(*) FROM flat_cuts WHERE cut <= key)::BIGINT AS pid, strlen(rpad(line, 99, ' ')) + 1 AS size FROM flat)
            SELECT pid, sum(size)::BIGINT AS bytes FROM p GROUP BY pid""",
        "scan_folders": f"WITH {_FLAT} SELECT line, key, count(*) AS n FROM flat GROUP BY line, key",
        "merge_files": f"WITH {_FLAT} SELECT row_number() OVER (ORDER BY key, line) AS pos, line FROM flat",
        "sort_job": f"WITH {_FLAT} SELECT row_number() OVER (ORDER BY key) AS pos, key FROM flat",
        "map_side": f"""
            WITH {_BASE}, c AS (SELECT doc_id, k, pid, ((row_number() OVER (ORDER BY doc_id) - 1) // {CHUNK // 10})::BIGINT AS chunk FROM placed)
            SELECT doc_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY k, doc_id) AS rank, pid FROM c""",
        "binary_roundtrip": f"WITH {_RECORDS} SELECT pid, idx AS index, hex(r) AS rec_hex FROM stored",
        "record_by_index": f"""
            WITH {_RECORDS}, w AS (SELECT pid, unnest([0, 0, n - 1, n // 2]) AS index FROM (SELECT DISTINCT pid, n FROM stored))
            SELECT w.pid, w.index, hex(substr(r, 1, 10)) AS key_hex FROM w JOIN stored ON stored.pid = w.pid AND stored.idx = w.index""",
        "record_sort": f"WITH {_RECORDS} SELECT row_number() OVER (ORDER BY r) AS pos, hex(substr(r, 1, 10)) AS key_hex FROM rec",
        "command_line": f"WITH {_RECORDS} SELECT row_number() OVER (ORDER BY r) AS pos, hex(substr(r, 1, 10)) AS key_hex FROM rec",
        "record_offsets": "SELECT doc_id, (strlen(text) // 100)::BIGINT AS n_records, doc_id * 100 AS byte_offset FROM documents",
        "random_offsets": f"""
            SELECT doc_id, ('0x' || substr(md5('{SEED}|' || doc_id), 1, 15))::BIGINT % (strlen(text) // 100)::BIGINT * 100 AS byte_offset FROM documents WHERE strlen(text) >= 100""",
        "partition_assign": f"WITH {_BASE} SELECT doc_id, pid FROM placed",
        "partition_offsets": f"WITH {_BASE} SELECT pivot_no, (100 * (SELECT count(*) FROM keyed WHERE k < cut))::BIGINT AS byte_offset FROM cuts",
        "partition_sizes": f"WITH {_BASE} SELECT pid, count(*) AS rows, (100 * count(*))::BIGINT AS bytes FROM placed GROUP BY pid",
        "shuffle_matrix": f"WITH {_BASE} SELECT src, pid, count(*) AS rows FROM placed GROUP BY src, pid",
        "shuffle_pages": f"""
            WITH {_BASE}, m AS (SELECT src, pid, count(*) AS n FROM placed GROUP BY src, pid),
            p AS (SELECT src, pid, n, unnest(range(0, n // {PAGE} + 1)) AS page FROM m)
            SELECT src, pid, page, least({PAGE}, n - page * {PAGE})::BIGINT AS rows, n - page * {PAGE} >= {PAGE} AS has_more FROM p""",
        "shuffle_page_rows": f"""
            WITH {_BASE} SELECT doc_id, src, pid, ((row_number() OVER (PARTITION BY src, pid ORDER BY k, doc_id) - 1) // {PAGE})::BIGINT AS page FROM placed""",
        "local_rows": f"WITH {_BASE} SELECT doc_id, pid FROM placed WHERE src = pid",
        "final_merge": f"WITH {_BASE} SELECT doc_id, pid, row_number() OVER (PARTITION BY pid ORDER BY k, doc_id) AS local_pos FROM placed",
        "order_violations": f"""
            WITH l AS (SELECT {_K} AS k, lag({_K}) OVER (ORDER BY doc_id) AS ahead FROM documents)
            SELECT count(*) FILTER (ahead > k) AS violations FROM l""",
        "conservation_checksum": "SELECT count(*) AS rows, sum(('0x' || substr(md5(text), 1, 8))::BIGINT)::BIGINT AS checksum FROM documents",
        "duplicate_keys": f"SELECT {_K} AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
        "sink_roundtrip": r"""
            SELECT rpad(regexp_replace(text, '[\r\n]', ' ', 'g'), 99, ' ') AS rec, count(*) AS n FROM documents GROUP BY 1""",
    }
