import hashlib
from collections import Counter, defaultdict

import pytest

from shardsort.llm import exact_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(UPPER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha, sum(j == keep for j in ids)) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("digest_bytes,memtable", [(32, 100_000), (32, 3), (1, 5)])
def test_like_brute_force(docs, rows, digest_bytes, memtable):
    """One-byte digests collide: then the bytes tell texts apart."""
    got = exact_dedup.mark_copies(docs, digest_bytes=digest_bytes, memtable=memtable)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_many_collisions(spark):
    rows = [(k, f"text {k % 40}") for k in range(120)] + [(7, "text 7"), (None, "text 9")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, exact_dedup.mark_copies(df, digest_bytes=0).collect())) == brute(rows)


def test_memtable_flushes_sorted_runs():
    table = exact_dedup.Memtable(room=3)
    assert [table.put(d, k) for d, k in ((b"b", 5), (b"a", 9), (b"b", 2), (b"b", 2), (b"c", 1))] == [False, False, False, False, True]
    assert list(zip(*table.flush().to_pydict().values())) == [(b"a", 9, 1, 1), (b"b", 2, 2, 3), (b"c", 1, 1, 1)]
    assert not table.entries and table.flush().num_rows == 0


def test_compaction_of_an_index_and_later_runs(spark, docs):
    first, later = docs.filter("doc_id < 10"), docs.filter("doc_id >= 10 or doc_id is null")
    sign = lambda df: exact_dedup.signatures(df, "doc_id", "text", 32)
    step = exact_dedup.compact(exact_dedup.compact(exact_dedup.flushed_runs(sign(first))).entries, exact_dedup.flushed_runs(sign(later)))
    whole = exact_dedup.compact(exact_dedup.flushed_runs(sign(docs)))
    assert sorted(map(tuple, step.entries.collect())) == sorted(map(tuple, whole.entries.collect()))


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_every_run_has_a_filter_of_its_repeated_digests(spark, ranges):
    rows = [(k, f"text {k % 400}") for k in range(600)]
    signed = exact_dedup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 32)
    level = exact_dedup.compact(exact_dedup.flushed_runs(signed, 50), ranges=ranges)
    counts = {bytes(r["digest"]): r["n_rows"] for r in level.entries.collect()}
    assert len(counts) == 400 and set(level.filters) <= set(range(ranges)) and len(level.filters) > ranges // 2
    said = dict(zip(counts, level.may_repeat()(list(counts)), strict=True))
    assert all(said[d] for d, n in counts.items() if n > 1) and sum(said[d] for d, n in counts.items() if n == 1) < 10
    assert all(not level.filters[r][1].any() or level.filters[r][0] >= 1 << 12 for r in level.filters)


def test_a_task_hands_on_one_copy_of_a_text(spark):
    rows = [(k, "the same text" if k % 3 else f"text {k % 9}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    level = exact_dedup.compact(exact_dedup.flushed_runs(exact_dedup.signatures(df, "doc_id", "text", 32)))
    assert exact_dedup._hit_texts(df, "text", 32, level).count() <= 4 * 4


def test_hot_digests_are_dealt(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup.dealt_join, "__defaults__", ("inner", 1))
    assert Counter(map(tuple, exact_dedup.mark_copies(docs).collect())) == brute(rows)


def test_drop_keeps_one_of_each_with_all_columns(docs, rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    texts = [(r["text"] or "").translate(UPPER) for r in got.collect()]
    assert Counter(texts) == Counter({(t or "").translate(UPPER): 1 for _, t, *_ in rows})
    keep = {t: r for (t, r) in (((r["text"] or "").translate(UPPER), r["doc_id"]) for r in got.collect())}
    assert all(keep[(t or "").translate(UPPER)] is not None for i, t, *_ in rows if i is not None)


def test_empty(no_docs):
    assert exact_dedup.mark_copies(no_docs).count() == 0 and exact_dedup.drop_copies(no_docs).count() == 0
