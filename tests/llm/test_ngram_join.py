import random
import re
from collections import Counter

import numpy as np
import pytest

from shardsort.llm import common, components, ngram_join


def grams(text):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def brute(rows):
    """(doc_id, class_id, n_links) of every row."""
    links, group, least = grouped(rows)
    return Counter((rows[i][0], rows[least[group[i]]][0], len(links[i])) for i in range(len(rows)))


def grouped(rows):
    """Links and class of every row, and the row with the least number (null first) of every class."""
    sets = [grams(t) for _, t in rows]
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = [[j for j, b in enumerate(sets) if j != i and near(a, b)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        for i, others in enumerate(links):
            group[i] = min([group[i], *(group[j] for j in others)])
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    least = {g: min((i for i in range(len(rows)) if group[i] == g), key=key) for g in set(group)}
    return links, group, least


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_awkward_documents(spark, docs, rows):
    got = ngram_join.classes(docs)
    assert Counter(map(tuple, got.collect())) == brute([r[:2] for r in rows])


def test_tables_like_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, ngram_join.classes(frame(spark, rows)).collect())) == brute(rows)


def test_similarity_just_at_the_threshold(spark):
    """Sets of 9 and 9 n-grams with 8 common ones (8 of 10), and with 7 (7 of 11)."""
    words = [f"a{k}" for k in range(13)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1:] + ["z"])), (3, " ".join(words[2:] + ["y", "x"]))]
    assert Counter(map(tuple, ngram_join.classes(frame(spark, rows)).collect())) == brute(rows)


def test_crowded_buckets_are_dealt_in_blocks(spark, monkeypatch):
    """A large group of near copies: pairs in one block, in two, and copies of some."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(80)] = f"x{rng.randrange(99999)}"
        rows.append((k, " ".join(words)))
    rows += rows[:9] + [(100 + k, " ".join(f"q{rng.randrange(99999)}" for _ in range(30))) for k in range(20)]
    assert Counter(map(tuple, ngram_join.classes(frame(spark, rows)).collect())) == brute(rows)


def test_blocks_may_be_empty(spark, monkeypatch):
    """Few nodes with long sets are dealt over more blocks than there are nodes."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 100)
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(words[:50] + [f"x{k}"] + words[51:])) for k in range(12)] + [(99, " ".join(words))]
    assert Counter(map(tuple, ngram_join.classes(frame(spark, rows)).collect())) == brute(rows)


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.9999), (0.8, 0.99), (0.5, 0.9)):
        bands, rows = ngram_join.bands_for(similarity, recall)
        assert bands * rows <= ngram_join.USUAL_HASHES and 1 - (1 - similarity**rows) ** bands >= recall
    bands, rows = ngram_join.bands_for(0.02, 0.9999)  # more hashes than usual
    assert rows == 1 and 1 - 0.98**bands >= 0.9999
    for similarity, recall in ((0, 0.9), (1.1, 0.9), (0.5, 1), (1e-13, 0.9)):
        with pytest.raises(ValueError):
            ngram_join.bands_for(similarity, recall)


def test_band_collisions_match_theory():
    rng = np.random.default_rng(8)
    bands, rows = ngram_join.bands_for()
    signer, met, wanted = ngram_join.Signer(bands, rows), 0, 0.0
    for _ in range(300):
        shared, own = rng.integers(0, 1 << 63, 100, np.uint64), rng.integers(0, 1 << 63, (2, 60), np.uint64)
        a, b = (np.unique(np.concatenate([shared, o])) for o in own)
        s = 100 / 220
        met += bool((signer.keys(a) == signer.keys(b)).any())
        wanted += 1 - (1 - s**rows) ** bands
    assert abs(met - wanted) < 40


def test_shared_counts():
    rng = random.Random(1)
    for n in (2, 3, 9):
        sets = [np.unique(np.array([rng.randrange(30) for _ in range(rng.randrange(1, 20))], np.uint64)) for _ in range(n)]
        want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
        assert ngram_join.shared_counts(sets).tolist() == want


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 130)]
    edges = chain + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {v: v for e in edges for v in e if None not in e and e[0] != e[1]}
    for _ in range(200):
        for u, v in edges:
            if u in root and v in root and (u, v) != (5, 5):
                root[u] = root[v] = min(root[u], root[v])
    assert got == root
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_class_stays(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    plain = [r[:2] for r in rows]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(plain[i][0] for i in grouped(plain)[2].values())


def edited(rng, base, edits):
    """The words with so many of them replaced by words of no other text."""
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.randrange(1 << 40)}"
    return words


def kept_ids(spark, rows):
    return Counter(r["doc_id"] for r in ngram_join.keep_one(frame(spark, rows)).collect())


def least_ids(rows):
    return Counter(rows[i][0] for i in grouped(rows)[2].values())


def test_rows_to_verify_grow_with_the_group_not_its_square(spark, monkeypatch):
    """Near copies of one text that only link it, and others that are too far from all."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 8)
    seen, plain = [], ngram_join._with_pairs
    monkeypatch.setattr(ngram_join, "_with_pairs", lambda placed, similarity: seen.append(placed.count()) or plain(placed, similarity))
    for size in (60, 240):
        rng = random.Random(size)
        base = [f"w{k}" for k in range(60)]
        texts = [base, *(edited(rng, base, 1) for _ in range(size)), *(edited(rng, base, 4) for _ in range(size // 4))]
        rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
        assert kept_ids(spark, rows) == least_ids(rows)
    assert seen[1] <= 6 * seen[0] + 400


@pytest.mark.parametrize("nodes, grams, turns", [(5, 400_000, 6), (9, 400, 6), (5, 400_000, 1), (1, 60, 6)])
def test_classes_of_crowded_buckets(spark, monkeypatch, nodes, grams, turns):
    """Groups near each other, a chain that no hub reaches in one step, copies, and texts at the edge of a link."""
    for name, value in (("BLOCK_NODES", nodes), ("BLOCK_GRAMS", grams), ("HUB_TURNS", turns), ("CHUNK_GRAMS", 300)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(nodes + turns)
    base = [f"w{k}" for k in range(60)]
    other = edited(rng, base, 3)
    texts = [edited(rng, start, rng.choice([0, 1, 1, 2, 2, 3])) for start in (base, other) for _ in range(25)]
    chain = [base]
    for k in range(14):
        chain.append([*chain[-1][: 4 * k], f"c{k}", *chain[-1][4 * k + 1 :]])
    texts += chain + [base[k:] for k in range(0, 30, 3)] + [[f"q{rng.randrange(99)}" for _ in range(30)] for _ in range(10)]
    rng.shuffle(texts)
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    assert kept_ids(spark, rows + rows[:5]) == least_ids(rows + rows[:5])


def test_common_grams(spark):
    """Those of two components or more, whatever the number of nodes and tasks."""
    rng = random.Random(4)
    gram = [rng.randrange(1 << 64) for _ in range(40)]
    rows = [(bytes([k]) * 16, bytes([k % 3]) * 16, sorted(rng.sample(gram, 6))) for k in range(12)]
    sets = spark.createDataFrame([(n, c, len(g), np.array(g, np.uint64).tobytes()) for n, c, g in rows], "node binary, component binary, n_grams long, grams binary")
    for chunk in (7, 1000):
        ngram_join.CHUNK_GRAMS, before = chunk, ngram_join.CHUNK_GRAMS
        admits = ngram_join._common_grams(sets.repartition(5))
        ngram_join.CHUNK_GRAMS = before
        passing = admits.may_hold(ngram_join._gram_digests(np.array(gram, np.uint64)))
        wanted = np.array([len({c for _, c, g in rows if x in g}) > 1 for x in gram])
        assert (passing | ~wanted).all() and (passing & ~wanted).sum() <= 1


def test_of_repeated_rows_one_stays(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])
    rows = [(5, " ".join(words))] * 3 + [(5, near), (5, near.upper()), (None, "the same"), (None, "the same"), (None, "another one"), (6, None), (6, None)]
    df = frame(spark, rows)
    for _ in range(2):
        kept = Counter(map(tuple, ngram_join.keep_one(df).collect()))
        assert sum(kept.values()) == 5 and kept[(None, "the same")] == kept[(None, "another one")] == 1 and kept[(6, None)] == 2
        assert sum(n for (i, _), n in kept.items() if i == 5) == 1
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)


def test_hot_keys_are_dealt(spark, docs, rows, monkeypatch):
    """Every key of more than one row is hot."""
    monkeypatch.setattr(common.dealt_join, "__defaults__", ("inner", 1))
    assert Counter(map(tuple, ngram_join.classes(docs).collect())) == brute([r[:2] for r in rows])


def test_a_repeated_number_goes_only_with_the_near_copy(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])
    rows = [(3, " ".join(words)), (5, near), (5, "a text of its own"), (5, None), (7, near), (None, "no number")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[2], rows[3], rows[5]])


def test_empty(no_docs):
    assert ngram_join.classes(no_docs).count() == 0 and ngram_join.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("text", [None, "", "...", "one", "One two", "a b c d e", "a b c d e f"])
def test_gram_set_sizes(text):
    assert len(ngram_join.gram_set(text, ngram_join._WordHashes())) == len(grams(text))
