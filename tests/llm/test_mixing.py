import re
from collections import Counter, defaultdict

import pytest

from shardsort.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes):
    """The rule as it is told: deal by weight, stop at the cap, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    cap = {s: 2 * sizes[s] for s in order}
    budget, fixed = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in fixed]
        left = budget - sum(cap[s] for s in fixed)
        aim = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if aim[s] > cap[s]]
        if not over:
            return aim | {s: float(cap[s]) for s in fixed}
        fixed |= set(over)


def sizes_by_source(rows):
    out = defaultdict(int)
    for _, text, _, source, *_ in rows:
        out[source] += size_of(text)
    return dict(out)


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_targets_and_budgets(docs, rows, bucket_rows):
    got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    sizes, aims = sizes_by_source(rows), water_fill(sizes_by_source(rows))
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size_of(t)) for i, t, _, s, *_ in rows)
    for source, size in sizes.items():
        own = [r for r in got if r["source"] == source]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(aims[source]) for r in own)
        assert sum(r["taken"] for r in own) == int(aims[source] + 1e-9)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        # Whole epochs come first, then the front of the order, with one document that fits partly.
        rest = [r["taken"] - r["epochs"] * r["size"] for r in sorted(own, key=lambda r: (r["draw"], r["doc_id"] is not None, r["doc_id"], r["size"])) if r["size"]]
        full = [r["size"] for r in sorted(own, key=lambda r: (r["draw"], r["doc_id"] is not None, r["doc_id"], r["size"])) if r["size"]]
        partial = [k for k, (a, b) in enumerate(zip(rest, full)) if 0 < a < b]
        assert len(partial) <= 1 and all(a == b for a, b in zip(rest[: partial[0] if partial else 0], full))


def test_buckets_change_nothing_and_reruns_agree(docs):
    a, b, c = (Counter(map(tuple, mixing.mix(docs, bucket_rows=n).collect())) for n in (4096, 1, 4096))
    assert a == b == c


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3}, {"a": 0, "b": 5}, {"a": 7}, {None: 9, "z": 100, "é": 50, "A": 1, "zz": 0}, {f"s{k:04d}": 10**15 + 10**12 * (k % 7) for k in range(800)}])
def test_water_level(spark, sizes):
    rows = [(source, f"={source}" if source is not None else "", size, 1, False) for source, size in sizes.items()]
    got = {r["of"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, of string, size long, equal long, low boolean")).collect()}
    assert got == pytest.approx({f"={s}" if s is not None else "": v for s, v in water_fill(sizes).items()})


def test_heavier_documents_come_earlier(spark):
    rows = [(k, "abcde " * 10 if k % 2 else "a " * 10, None, "s") for k in range(2000)] + [(-1, "abcde " * 20000, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    draws = mixing.mix(df).filter("source = 's'").collect()
    mean = {odd: sum(r["draw"] for r in draws if r["doc_id"] % 2 == odd) / 1000 for odd in (0, 1)}
    assert mean[1] == pytest.approx(1.0, rel=0.15) and mean[0] == pytest.approx(4.0, rel=0.15)


def test_rows_are_repeated(docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], size_of(r["text"])) for r in out.collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


def test_main_path_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.repeat_rows(no_docs).count() == 0


@pytest.mark.parametrize("unfold", [4096, 7])
def test_equal_rows_are_taken_one_by_one(spark, monkeypatch, unfold):
    """100 equal rows without a number and 40 repeated rows: the mix takes one and a half times as many."""
    monkeypatch.setattr(mixing, "UNFOLD", unfold)
    for rows in ([(None, "five words are in here", None, "s")] * 100, [(3, "five words are in here", None, None)] * 40):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
        taken = [r["taken"] for r in mixing.mix(df).collect()]
        assert len(taken) == len(rows) and sum(taken) == 5 * len(rows) * 3 // 2 and set(taken) == {5, 10}
        assert mixing.repeat_rows(df).count() == len(rows) * 3 // 2


def test_documents_without_a_number_have_draws_of_their_own(spark):
    rows = [(None, f"text number {k}", None, "s") for k in range(300)]
    draws = {r["draw"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(draws) == 300


def test_buckets_are_even_whatever_the_weights(spark):
    rows = [(k, "abcde " * 5 if k % 3 else "a " * 5, None, "s") for k in range(4000)]
    placed = mixing._placed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id", "text", "source", 100)
    counts = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert len(counts) == 40 and max(counts) < 160
