import random

import numpy as np
import pytest

from shardsort.llm import ann
from shardsort.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int, part int, routes string"


def exact(rows, every=20, k=20):
    """Sequential sums in double precision, ties to the smaller id."""
    valid = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in valid:
        if q % every == 0:
            scored = []
            for i, b in valid:
                if i != q:
                    total = 0.0
                    for x, y in zip(a, b):
                        total += float(x) * float(y)
                    scored.append((-total, i))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = table(spark, f"/root/testdata/{sf}", "embeddings")
    ids, vectors = zip(*((r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()))
    ids, vectors = np.array(ids), np.array(vectors, np.float64)
    got = answers(ann.search(df))
    asked = ids % 20 == 0
    score = vectors[asked] @ vectors.T
    score[np.arange(asked.sum()), np.flatnonzero(asked)] = -np.inf
    near = ids[np.argsort(-score, axis=1)[:, :20]]
    recall = np.mean([len({i for _, i, _ in got[q]} & set(n.tolist())) / 20 for q, n in zip(ids[asked].tolist(), near)])
    assert set(got) == set(ids[asked].tolist()) and recall >= 0.9
    assert all(len(a) == 20 and [r for r, _, _ in a] == list(range(1, 21)) for a in got.values())


def test_scores_are_exact_and_ties_go_to_the_smaller_id(spark):
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, [float(np.float32(x)) for x in base[k % 6]]) for k in range(120)]
    got, want = answers(ann.search(spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], VECTORS), every=20)), exact(rows)
    for q, found in got.items():
        score = {i: s for _, i, s in exact(rows, k=len(rows))[q]}
        assert all(score[i] == s for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    assert set(got) == set(want)


def test_what_takes_no_part(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (140, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in bad + good], VECTORS)
    assert answers(ann.search(df)) == {0: [(1, 2, 2.0), (2, 2, 2.0), (3, 1, 0.5)]}
    assert ann.search(df.limit(0)).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    whole = answers(ann.search(df))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 9)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    assert answers(ann.search(df)) == whole


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16)) * 4
    vectors = centres[np.arange(800) % 8] + rng.normal(size=(800, 16)) * 0.3
    graph = ann.neighbour_graph(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), 10)
    label = ann.balanced_parts(graph, 8)
    assert np.bincount(label, minlength=8).max() <= 111
    assert (label[graph] == label[:, None]).mean() > 0.8
    routing = ann.Routing(ann._learned(vectors[~ann.is_held_out(800)], 8))
    score = vectors @ vectors.T
    np.fill_diagonal(score, -np.inf)
    parts = routing.home(vectors)[np.argsort(-score, axis=1)[:, :20]]
    assert ann.visits_for(routing, vectors, parts) <= 3 and ann.visits_for(routing, vectors[:0], parts[:0]) == 8


def test_the_parts_of_the_nearest_rows_are_brute_force(spark):
    vectors = clustered(500)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, vector array<double>").repartition(3)
    routing = ann.Routing(ann._learned(vectors, 6))
    ids = np.array([3, 77, 499])
    score = vectors[ids] @ vectors.T
    score[np.arange(3), ids] = -np.inf
    want = routing.home(vectors)[np.argsort(-score, axis=1)[:, :20]]
    assert (ann._parts_of_nearest(df, routing, ids, vectors[ids], 20) == want).all()


def clustered(n, clusters=60, dims=24, seed=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    vectors = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * 0.15
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.mark.parametrize("levels", [1, 2])
def test_queries_visit_few_rows_where_vectors_cluster(spark, monkeypatch, levels):
    """Recall against all pairs of at least 0.9, and no query scores over a third of the rows."""
    if levels == 2:
        monkeypatch.setattr(ann, "FAN", 5)
        monkeypatch.setattr(ann, "ROWS_PER_PART", 200)
    vectors = clustered(4000)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    built = ann.index(df, "vec_id", "embedding", 20, 20, 1500)
    assert built.routing.parts == (16 if levels == 1 else 20) and bool(built.routing.second) == (levels == 2)
    held = {r["part"]: r["count"] for r in built.placed.groupBy("part").count().collect()}
    scored = [sum(held[p] for p in r["routes"]) for r in built.queries.collect()]
    assert len(scored) == 200 and max(scored) <= 4000 / 3
    got = answers(ann.search(df, sample_rows=1500))
    score = vectors[::20] @ vectors.T
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    near = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len({i for _, i, _ in got[20 * q]} & set(n.tolist())) / 20 for q, n in enumerate(near)]) >= 0.9


def test_all_candidates_where_there_are_few(spark):
    df = spark.createDataFrame([(k, [float(k % 7 + 1), 1.0]) for k in range(21)], "vec_id long, embedding array<double>")
    got = answers(ann.search(df))
    assert {q: len(a) for q, a in got.items()} == {0: 20, 20: 20}
