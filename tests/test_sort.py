"""Contract of the sort: permutation, order, ranges; and the cases that used to lose rows."""

import random
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardsort import cli
from shardsort.functions import records
from shardsort.operators import exchange, partitioning, pivots, sampling, sinks, sorting, validate
from shardsort.plans import job
from shardsort.sources import binary, seek, text


def line_frame(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "line string").withColumn("key", records.key("line"))


def padded(line, n=10):
    return line[:n].ljust(n)


def files_of(out):
    return sorted(Path(out).glob("part-*"))


def written(out):
    return [f.read_bytes().decode().split("\n")[:-1] for f in files_of(out)]


def test_known_pivots():
    assert pivots.choose_pivots(list("abcdef"), 3) == ["c", "e"]
    assert pivots.choose_pivots([], 3) == [] and pivots.choose_pivots(["a"], 1) == []
    with pytest.raises(ValueError):
        pivots.choose_pivots(["a"], 0)


def test_equal_to_a_pivot_goes_right(spark):
    df = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    got = {r["key"]: r["pid"] for r in partitioning.assign(df, "key", ["c", "e"]).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2, "f": 2}
    offsets = {r["pivot_no"]: r["byte_offset"] for r in partitioning.partition_offsets(df, "key", ["c", "e"]).collect()}
    assert offsets == {1: 200, 2: 400}


@pytest.mark.parametrize("cuts", [[], ["m"], ["m", "m", "m"], [c for c in "bdfhjlnprtv"]])
def test_bisection_counts_pivots(spark, cuts):
    keys = list("abcdefghijklmnopqrstuvwxyz") + [""]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r["pid"] for r in partitioning.assign(df, "key", cuts).collect()}
    assert got == {k: sum(c <= k for c in cuts) for k in keys}


def test_all_equal_keys_stay_together(spark):
    df = line_frame(spark, ["same key here"] * 300)
    parts = partitioning.partition_by_pivots(df, "key", ["same key h"] * 3)
    sizes = parts.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert parts.rdd.getNumPartitions() == 4 and [(r["p"], r["count"]) for r in sizes] == [(3, 300)]


def test_short_keys_order(spark):
    df = line_frame(spark, ["abd", "abc ", "abc", "abc\tx", ""])
    assert [r["line"] for r in sorting.global_sort(df, "key", F.length("line")).collect()] == ["", "abc\tx", "abc", "abc ", "abd"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x2FF), max_size=14), max_size=40), st.integers(1, 8), st.integers(1, 9))
def test_like_sorted(spark, lines, partitions, chunk):
    df = line_frame(spark, lines).withColumn("n", F.monotonically_increasing_id())
    by = sorted(lines, key=lambda x: (padded(x).encode(), x.encode()))
    whole = sorting.global_position(df, ["key", "line", "n"])
    assert [r["line"] for r in whole.orderBy("pos").collect()] == by
    assert sorted(r["pos"] for r in whole.collect()) == list(range(1, len(lines) + 1))
    cuts = pivots.choose_pivots([padded(x) for x in lines], partitions)
    parts = partitioning.partition_by_pivots(df, "key", cuts, "line")
    assert [r["line"] for r in parts.collect()] == by
    runs = sorting.sort_chunks(sorting.chunk_assign(df, ["n"], chunk), "chunk", ["key", "line", "n"])
    assert runs.agg(F.coalesce(F.max("rank"), F.lit(0))).head()[0] == min(chunk, len(lines))


def test_many_runs_merge_without_loss(spark):
    frames = [line_frame(spark, [f"{(7 * k + j) % 50:04d}"]) for k in range(40) for j in (0,)]
    merged = sorting.merge_runs(frames, ["key", "line"])
    assert merged.count() == 40 and validate.order_violations(merged).head()[0] == 0


def test_validation_sees_faults(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "c")], "pos long, key string")
    assert validate.order_violations(df).head()[0] == 1
    assert [tuple(r) for r in validate.duplicate_keys(df).collect()] == [("c", 2)]
    assert validate.same_rows(df, df.orderBy("key")) and not validate.same_rows(df, df.limit(3))
    assert validate.conservation_checksum(df, "key").head() == validate.conservation_checksum(df.orderBy("key"), "key").head()


def test_pages_with_an_exact_multiple(spark):
    df = spark.createDataFrame([(0, 0)] * 20 + [(0, 1)] * 3, "src long, pid long")
    pages = sorted((r["pid"], r["page"], r["rows"], r["has_more"]) for r in exchange.shuffle_pages(df, page_rows=10).collect())
    assert pages == [(0, 0, 10, True), (0, 1, 10, True), (0, 2, 0, False), (1, 0, 3, False)]


def test_group_positions(spark):
    df = spark.createDataFrame([(g, v) for g in (None, "a", "b") for v in range(5)], "g string, v long").repartition(3)
    got = sorted(((r["g"] or "", r["v"], r["pos"]) for r in sorting.group_position(df, ["g"], ["v"]).collect()))
    assert got == [(g, v, v + 1) for g in ("", "a", "b") for v in range(5)]


def test_budget_is_equal_for_all_files(spark):
    files = spark.createDataFrame([("a", 99), ("b", 1000), ("c", 10**6)], "file string, size long")
    got = {r["file"]: r["n_samples"] for r in sampling.sample_budget(files, 30_000).collect()}
    assert got == {"a": 0, "b": 10, "c": 100}
    assert all(r["n_samples"] == 0 for r in sampling.sample_budget(files, 200).collect())


@pytest.fixture
def inputs(tmp_path):
    rng = random.Random(3)
    rows = []
    for name, n in (("one", 300), ("two", 5), ("three", 0)):
        (tmp_path / name).mkdir()
        own = ["".join(chr(rng.randrange(33, 127)) for _ in range(rng.choice((4, 40, 99, 120)))) for _ in range(n)]
        if own:
            (tmp_path / name / "x.txt").write_text("".join(x + "\n" for x in own))
        rows += own
    return tmp_path, rows


@pytest.mark.parametrize("partitions,how", [(1, "weighted"), (4, "weighted"), (4, "equal")])
def test_job_conserves_and_orders(spark, inputs, partitions, how):
    base, rows = inputs
    out = str(base / "out")
    for _ in range(2):  # a rerun replaces
        done = job.sort_lines(spark, [str(base / d) for d in ("one", "two", "three")], out, partitions, sampling=how)
        lines = [x for part in written(out) for x in part]
        assert done.files == 2 and done.input_bytes == sum(len(x) + 1 for x in rows)
        assert done.rows == len(rows) and done.bytes == 100 * len(rows)
        assert sorted(lines) == sorted(x[:99].ljust(99) for x in rows)
        assert [x[:10] for x in lines] == sorted(x[:10] for x in lines)
        assert all(len(x) == 99 for x in lines)


def test_missing_inputs(spark, inputs):
    base, _ = inputs
    with pytest.raises(FileNotFoundError):
        text.read_lines(spark, [str(base / "none")])
    assert text.read_lines(spark, [str(base / "none")], "skip").count() == 0
    assert text.read_lines(spark, [str(base / "none"), str(base / "two")], "skip").count() == 5
    assert {Path(r["file"]).parent.name for r in text.list_files(spark, [str(base / "one"), str(base / "two")]).collect()} == {"one", "two"}


def test_carriage_returns_become_a_space(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_bytes(b"b" * 98 + b"\r\n" + b"a" * 98 + b"\r\n")
    job.sort_lines(spark, [str(tmp_path / "in")], str(tmp_path / "out"), 1)
    assert written(tmp_path / "out") == [["a" * 98 + " ", "b" * 98 + " "]]


def test_split_lines(spark):
    df = spark.createDataFrame([(1, "a\rb\r\nc\n\nd"), (2, ""), (3, None), (4, "x\n"), (5, "\n")], "id long, text string")
    got = sorted((r["id"], r["ln"], r["line"]) for r in records.split_lines(df, "text", "id").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, ""), (1, 4, "d"), (4, 0, "x"), (5, 0, "")]


@pytest.mark.parametrize("split", [100, 700, 1 << 20])
def test_binary_records_are_lossless(spark, tmp_path, split):
    rng = random.Random(5)
    data = [bytes(rng.choice((0, 10, 13, 255, rng.randrange(256))) for _ in range(100)) for _ in range(200)]
    (tmp_path / "r.bin").write_bytes(b"".join(data))
    recs = binary.read_records(spark, [str(tmp_path / "r.bin")], split_bytes=split)
    got = recs.select(binary.line_of().alias("b"), "index").collect()
    assert sorted((r["index"], bytes(r["b"])) for r in got) == list(enumerate(data))
    ordered = [bytes(r["key"]) for r in sorting.global_sort(recs, "key").collect()]
    assert ordered == sorted(d[:10] for d in data)
    cuts = pivots.choose_pivots([d[:10] for d in data], 4)
    parts = partitioning.partition_by_pivots(recs, "key", cuts, "value")
    assert [bytes(r["key"]) + bytes(r["value"]) for r in parts.collect()] == sorted(data)
    source = recs.select("source").head()[0]
    wanted = spark.createDataFrame([(source, 3), (source, 3), (source, 199)], "source string, index long")
    assert sorted(bytes(r["value"]) for r in binary.records_at(wanted).collect()) == sorted(data[i][10:] for i in (3, 3, 199))


def test_torn_binary_files(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(b"x" * 150)
    assert binary.read_records(spark, [str(tmp_path / "t.bin")], partial="drop").count() == 1
    with pytest.raises(Exception, match="whole records"):
        binary.read_records(spark, [str(tmp_path / "t.bin")]).count()


def test_sink_modes(spark, tmp_path):
    df = line_frame(spark, ["b", "a" * 120])
    assert sinks.write_partitions(df, str(tmp_path / "o"), ["b"], mode="lossless") == {"rows": 2, "bytes": 123}
    assert written(tmp_path / "o") == [["a" * 120], ["b"]]
    with pytest.raises(ValueError):
        sinks.write_partitions(df, str(tmp_path / "o"), [], mode="other")


def test_command_line(spark, inputs, capsys):
    base, rows = inputs
    assert cli.main(["-I", str(base / "one"), str(base / "two"), "-O", str(base / "cli"), "--partitions", "3"]) == 0
    assert sum(map(len, written(base / "cli"))) == len(rows) and f"{len(rows)} rows" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["-O", "x"])


def test_one_exchange_for_exact_ranges(spark):
    df = line_frame(spark, ["a", "b"])
    plan = partitioning.partition_by_pivots(df, "key", ["b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan


def test_files_that_spark_passes_over_are_sorted_too(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a", b"plain\n"), ("_b", b"under\r\nscore\r\xff\n\nlast"), (".c", b"dot\n"), ("_SUCCESS", b"")):
        (tmp_path / "in" / name).write_bytes(data)
    from shardsort.plans.job import sort_lines as job
    from shardsort.sources import text

    lines = text.read_lines(spark, [str(tmp_path / "in")]).selectExpr("cast(line as binary) AS b").collect()
    assert sorted(bytes(r["b"]) for r in lines) == sorted([b"plain", b"under", b"score", b"\xff", b"", b"last", b"dot"])
    done = job(spark, [str(tmp_path / "in")], str(tmp_path / "out"), 2)
    assert (done.files, done.input_bytes, done.rows) == (4, 30, 7)


RECORDS = [bytes(random.Random(k).choices((0, 9, 10, 13, 32, 127, 128, 255, k % 256), k=100)) for k in range(1000)]


@pytest.mark.parametrize("partitions,how", [(1, "weighted"), (4, "weighted"), (7, "equal")])
def test_binary_records_are_sorted_end_to_end(spark, tmp_path, partitions, how):
    """The fixture binary_100: an identical multiset in unsigned order, and no byte more."""
    for name, rows in (("a", RECORDS[:700]), ("b", RECORDS[700:]), ("c", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.bin").write_bytes(b"".join(rows))
    ins, out = [str(tmp_path / d) for d in "abc"], tmp_path / "out"
    for _ in range(2):  # a rerun replaces
        done = job.sort_records(spark, ins, str(out), partitions, sampling=how)
        data = b"".join(f.read_bytes() for f in files_of(out))
        got = [data[at : at + 100] for at in range(0, len(data), 100)]
        assert got == sorted(RECORDS) and (done.rows, done.bytes, done.partitions) == (1000, 100_000, partitions)
        assert len(list(out.iterdir())) == len(done.sizes) <= partitions and sum(done.sizes.values()) == 100_000
    assert job.sort_records(spark, [str(tmp_path / "none")], str(out), 2, missing="skip").rows == 0


def test_binary_sink_refuses_other_widths(spark, tmp_path):
    good = spark.createDataFrame([(b"k" * 10, b"v" * 90)], "key binary, value binary").coalesce(1)
    binary.write_records(good, str(tmp_path / "o"))
    for bad in ([(b"k" * 10, b"v" * 89)], [(b"k" * 10, None)]):
        with pytest.raises(Exception, match="100 bytes"):
            binary.write_records(spark.createDataFrame(bad, "key binary, value binary"), str(tmp_path / "o"))
    assert [f.name for f in (tmp_path / "o").iterdir()] == ["part-00000"] and (tmp_path / "o" / "part-00000").read_bytes() == b"k" * 10 + b"v" * 90
    binary.write_records(good.limit(0), str(tmp_path / "o"))
    assert not list((tmp_path / "o").iterdir())


def test_records_outside_a_file(spark, tmp_path):
    (tmp_path / "r").write_bytes(b"x" * 300)
    for index in (3, -1):
        with pytest.raises(Exception, match="no record"):
            binary.records_at(spark.createDataFrame([(str(tmp_path / "r"), index)], "source string, index long")).collect()


def test_only_drawn_places_are_read(spark, tmp_path, monkeypatch):
    """Text keys by seeking: each is the key of a whole line, and all lines can come."""
    lines = [b"%05d-%s" % (k, b"x" * (k % 90)) for k in range(400)] + [b"", b"\xc3\xa9\xc3\xa9", b"last without an end"]
    (tmp_path / "t").write_bytes(b"\r\n".join(lines))
    files = [(str(tmp_path / "t"), (tmp_path / "t").stat().st_size)]
    keys = {line.decode()[:10].ljust(10) for line in lines}
    for window in (4096, 7):
        monkeypatch.setattr(seek, "WINDOW", window)
        got = [r["key"] for r in seek.read_keys(spark, files, seek.weighted_counts([files[0][1]], 6000, 1), 1, False).collect()]
        assert len(got) == 6000 and set(got) <= keys and len(set(got)) > 0.9 * len(keys)
    again = [r["key"] for r in seek.read_keys(spark, files, seek.weighted_counts([files[0][1]], 6000, 1), 1, False).collect()]
    assert sorted(got) == sorted(again)


def test_the_budget_grows_with_the_ranges(spark, tmp_path):
    assert job.budget_for(2) == sampling.SAMPLE_BYTES and job.budget_for(1000) == 100 * 1000 * 100
    assert seek.equal_counts([99, 1000, 10**6], 30_000).tolist() == [0, 10, 100] and seek.equal_counts([10**6] * 3, 200).tolist() == [0, 0, 0]
    (tmp_path / "r").write_bytes(b"".join(b"%010d" % (k * 7919 % 200_003) + b"v" * 90 for k in range(40_000)))
    cuts = job.seek_pivots(spark, [(str(tmp_path / "r"), 4_000_000)], 1000, True)
    assert len(set(cuts)) == 999 and cuts == sorted(cuts)
    assert job.seek_pivots(spark, [], 4, True) == [] and job.seek_pivots(spark, [(str(tmp_path / "r"), 0)], 4, False) == []


def test_compressed_lines_are_sampled_by_a_scan(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.gz").write_bytes(gzip.compress(b"".join(b"%04d\n" % (k * 37 % 500) for k in range(500))))
    assert not seek.seekable([str(tmp_path / "in" / "x.gz")])
    for how in ("weighted", "equal"):
        done = job.sort_lines(spark, [str(tmp_path / "in")], str(tmp_path / "out"), 4, sampling=how)
        assert done.rows == 500 and len(done.sizes) == 4


def test_lost_rows_raise(spark, inputs, monkeypatch):
    base, _ = inputs
    real = job.write_partitions
    monkeypatch.setattr(job, "write_partitions", lambda lines, *rest: real(lines.filter("line > 'M'"), *rest))
    with pytest.raises(RuntimeError, match="were read"):
        job.sort_lines(spark, [str(base / "one")], str(base / "out"), 2)


def test_wide_characters_are_counted_too(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("é\nü\n😀 and more\n")
    done = job.sort_lines(spark, [str(tmp_path / "in")], str(tmp_path / "out"), 2)
    assert done.rows == 3 and done.bytes == 300 + 1 + 1 + 3


def test_binary_text_lines_without_a_change(spark, tmp_path):
    df = spark.createDataFrame([(b"b\xff",), (b"a\x80",)], "line binary").withColumn("key", records.byte_key("line"))
    sinks.write_partitions(df, str(tmp_path / "o"), [b"b"], mode="lossless")
    assert [f.read_bytes() for f in files_of(tmp_path / "o")] == [b"a\x80\n", b"b\xff\n"]


def test_command_line_for_records(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r").write_bytes(b"".join(RECORDS))
    args = ["-I", str(tmp_path / "in"), "-O", str(tmp_path / "out"), "--partitions", "3", "--binary", "--sampling", "equal", "--seed", "5", "--budget", "50000"]
    assert cli.main(args) == 0
    said = capsys.readouterr().out
    assert "wrote 1000 rows, 100000 bytes, 3 ranges" in said and said.count("range ") == 3
    with pytest.raises(SystemExit):
        cli.main(["-I", "x", "-O", "y", "--budget", "0"])


def test_hot_groups_are_dealt(spark, monkeypatch):
    from shardsort.operators import joins

    monkeypatch.setattr(joins.dealt_join, "__defaults__", ("inner", 3))
    df = spark.createDataFrame([(g, v) for g in (None, "a", "b") for v in range(40)], "g string, v long").repartition(3)
    got = sorted(((r["g"] or "", r["v"], r["pos"]) for r in sorting.group_position(df, ["g"], ["v"]).collect()))
    assert got == [(g, v, v + 1) for g in ("", "a", "b") for v in range(40)]


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_salted_joins(spark, broadcast_rows):
    from shardsort.operators.joins import salted_join

    many = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(60)], "k long, salt long")
    few = spark.createDataFrame([(0, "zero"), (1, "one"), (9, "nine")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, many.join(few, ["k"], how).collect()))
        assert sorted(map(str, salted_join(many, few, ["k"], how, broadcast_rows, 4).collect())) == want


def test_the_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from shardsort.functions.durable import shared_folder

    held = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_frames_are_sorted_into_exact_partitions(spark):
    rows = [(k, f"{k * 7919 % 1000:04d} line") for k in range(500)] + [(500, None)]
    parts = job.sort_frame(spark.createDataFrame(rows, "id long, line string"), "line", 5, "id")
    assert parts.rdd.getNumPartitions() == 5
    assert [r["id"] for r in parts.collect()] == [k for k, _ in sorted(rows, key=lambda r: ((r[1] or "")[:10].ljust(10), r[0]))]


def test_own_folders_are_deleted_at_the_end(tmp_path):
    """In a process of its own, with a shared folder that belongs to somebody else."""
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from shardsort.functions.durable import durable, written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert durable(written(spark.range(5))).count() == 5
import pathlib
print("held", len(list(pathlib.Path({str(tmp_path)!r}).iterdir())))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, cwd=Path(__file__).resolve().parent.parent)
    left = [p.name for p in tmp_path.iterdir()]
    assert "held" in done.stdout and "held 0" not in done.stdout, done.stderr[-2000:]
    assert not [name for name in left if name.startswith(("table-", "checkpoint-"))]
