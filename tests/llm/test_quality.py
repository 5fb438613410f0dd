import zlib

import numpy as np

from shardsort.llm import quality
from shardsort.llm.common import table


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=quality.SLOTS), rng.normal(size=(quality.SLOTS, 4)) * 0.1)
    slots, values = np.array([1, 5, 9, 40]), np.array([0.5, -1.0, 2.0, 0.1])
    pairs = sum(machine.factors[i] @ machine.factors[j] * x * y for a, (i, x) in enumerate(zip(slots, values)) for j, y in list(zip(slots, values))[a + 1 :])
    margin = machine.bias + values @ machine.linear[slots] + pairs
    assert np.isclose(machine.score(slots, values), 1 / (1 + np.exp(-margin)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.95
    assert ((held.quality == 1) & (held.predicted == 1)).sum() / (held.quality == 1).sum() >= 0.97


def test_awkward_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality.scored(no_docs, labels).count() == 0
    unlabelled = quality.scored(docs, labels.limit(0)).collect()
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in unlabelled)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_labels_are_no_inputs(spark, small):
    """Other labels, languages, sources and numbers of the same texts change no score."""
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    machine = quality.fit(docs, labels)
    moved = docs.selectExpr("doc_id + 1000 doc_id", "text", "'xx' lang", "'none' source", "n_chars")
    a = sorted(r["score"] for r in quality.score(docs, machine).collect())
    assert a == sorted(r["score"] for r in quality.score(moved, machine).collect())


def test_fit_repeats_and_takes_a_bounded_sample(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    a, b = (quality.fit(docs.repartition(n), labels, sample_rows=20) for n in (1, 5))
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_the_fit_is_bounded_in_rows_and_features(spark, small, monkeypatch):
    """A number of many rows is one row, and features count towards a bound of their own."""
    given = []
    monkeypatch.setattr(quality, "train", lambda rows: given.append(rows))
    rows = [(2, f"row number {k} of two", "en", "s", None) for k in range(300)] + [(k, f"text {k}", "en", "s", None) for k in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2, 40)], "doc_id long, quality int")
    quality.fit(docs, labels, sample_rows=1)
    quality.fit(docs, labels)
    quality.fit(docs, labels, sample_features=100)
    allowed = [k for k in range(2, 40) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert len(given[0]) == 1 and len(given[1]) == len(allowed)
    assert 0 < len(given[2]) < len(allowed) and sum(len(x[1]) for x in given[2]) <= 100


def test_scores_like_brute_force(spark, small):
    """Every score is the machine's formula over all pairs of features."""
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    machine = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    for r in docs.orderBy("n_chars").limit(40).collect():
        slots, x = quality.features(r["text"], r["n_chars"], quality._Slots())
        v = machine.factors[slots] * x[:, None]
        pairs = np.triu(v @ v.T, 1).sum()
        assert np.isclose(got[r["doc_id"]], 1 / (1 + np.exp(-(machine.bias + x @ machine.linear[slots] + pairs))), atol=1e-4)
