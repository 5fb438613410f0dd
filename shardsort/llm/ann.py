"""Approximate nearest neighbours by learned partitions.

On a bounded sample of vectors the exact neighbour graph is built and cut into balanced parts; a
small classifier then learns, from a vector, in which parts its neighbours lie. Parts grow in number
with the rows: where one classifier would need more than FAN parts, each of its parts is cut again
in the same way, on a bounded sample of its own rows, by tasks of their own. Every row is stored in
its most probable part; a query goes to its several most probable parts, where the inner products
are taken exactly, in double precision and always in the same order of components. How many parts a
query visits is set on held-out vectors of the sample, whose true neighbours among all rows one pass
finds, so that their recall reaches a target: few where vectors cluster, nearly all where they have
no structure to learn. Parts and the queries sent
to them are dealt in blocks of bounded size, so a crowded part is many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardsort.llm.common import bounded_batches, durable

#: Vectors that the graph and the classifier are fitted on, at most (chosen by a hash of vec_id).
SAMPLE_ROWS = 4000
#: Neighbours of a sampled vector in the graph, and the number that recall is measured on.
GRAPH_NEIGHBOURS, RECALL_AT = 12, 20
#: Rows of one part; the fewest parts; the most parts of one classifier. Two levels of classifiers
#: make FAN * FAN parts, 819 million rows at this size; beyond that parts grow longer.
ROWS_PER_PART, LEAST_PARTS, FAN = 50_000, 16, 128
#: Mean recall that so many held-out vectors must reach with the parts visited, among their nearest of all rows.
TARGET_RECALL, TEST_QUERIES = 0.96, 256
#: Rows and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Hidden units of the classifier.
HIDDEN = 64


def scores_of(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, component after component, the same for equal vectors."""
    columns = np.ascontiguousarray(rows.T)
    total, product = np.zeros((len(queries), len(rows))), np.empty((len(queries), len(rows)))
    for d in range(queries.shape[1]):
        np.multiply(queries[:, d, None], columns[d][None, :], out=product)
        total += product
    return total


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and places in `rows` with scores of its k nearest (ties: smaller id)."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    for begin in range(0, len(queries), 64):
        some = scores_of(queries[begin : begin + 64], rows)
        for i, score in enumerate(some):
            score[np.searchsorted(row_ids, query_ids[begin + i], "left") : np.searchsorted(row_ids, query_ids[begin + i], "right")] = -np.inf
            least = np.partition(score, -k)[-k] if len(score) > k else -np.inf
            above = np.flatnonzero(score > least)
            level = np.flatnonzero(score == least)[: k - len(above)] if least > -np.inf else np.zeros(0, np.int64)
            best = np.concatenate([above, level])
            best = best[np.lexsort((row_ids[best], -score[best]))][:k]
            yield begin + i, order[best], score[best]


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of every vector, nearest first."""
    k = min(k, len(vectors) - 1)
    out = np.zeros((len(vectors), k), np.int64)
    for begin in range(0, len(vectors), 512):
        score = vectors[begin : begin + 512] @ vectors.T
        score[np.arange(len(score)), np.arange(begin, begin + len(score))] = -np.inf
        out[begin : begin + 512] = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Cut the graph into parts of nearly equal size with few edges between them.

    Parts are grown breadth first, then vertices move to the part that most of their neighbours
    are in, while no part exceeds its room.
    """
    n = len(graph)
    rng = np.random.default_rng(seed)
    room = int(np.ceil(n / parts))
    label = np.full(n, -1)
    near: list[list[int]] = [list(row) for row in graph]
    for v, row in enumerate(graph):
        for u in row:
            near[u].append(v)
    part, held, queue = 0, 0, []
    for seed_vertex in rng.permutation(n):
        queue.append(int(seed_vertex))
        while queue and part < parts:
            v = queue.pop(0)
            if label[v] >= 0:
                continue
            label[v], held = part, held + 1
            if held >= room:
                part, held, queue = part + 1, 0, []
            else:
                queue.extend(u for u in near[v] if label[u] < 0)
    label[label < 0] = parts - 1
    size = np.bincount(label, minlength=parts)
    most = int(np.ceil(room * 1.1))
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(label[near[v]], minlength=parts)
            here = label[v]
            votes = np.where((size < most) | (np.arange(parts) == here), votes, -1)
            best = int(votes.argmax())
            if votes[best] > votes[here]:
                label[v] = best
                size[here] -= 1
                size[best] += 1
                moved += 1
        if moved < n / 200:
            break
    return label


@dataclass
class Router:
    """The classifier: one hidden layer; gives the parts of a vector in order of probability."""

    into: np.ndarray
    into_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        hidden = np.maximum((vectors / norms) @ self.into + self.into_bias, 0)
        return hidden @ self.out + self.out_bias

    def order(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")


def train_router(vectors: np.ndarray, aims: np.ndarray, epochs: int = 60, seed: int = 3) -> Router:
    """Adam on the cross entropy with the shares of the parts among a vector's neighbours."""
    rng = np.random.default_rng(seed)
    dims, parts = vectors.shape[1], aims.shape[1]
    p = [rng.normal(0, np.sqrt(2 / dims) * np.sqrt(dims) / 4, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, parts)), np.zeros(parts)]
    m, s, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(unit)), max(1, len(unit) // 128)):
            x, aim = unit[rows], aims[rows]
            raw = x @ p[0] + p[1]
            hidden = np.maximum(raw, 0)
            z = hidden @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            slope = (z / z.sum(axis=1, keepdims=True) - aim) / len(rows)
            back = (slope @ p[2].T) * (raw > 0)
            step += 1
            for k, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0))):
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def _learned(sample: np.ndarray, parts: int) -> Router:
    """Graph, parts and classifier of a sample; a single part for a sample too small to cut."""
    parts = max(1, min(parts, len(sample) // 8))
    if parts < 2:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(sample, GRAPH_NEIGHBOURS)
    label = balanced_parts(graph, parts)
    votes = np.zeros((len(sample), parts))
    np.add.at(votes, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph].ravel()), 1 / graph.shape[1])
    votes[np.arange(len(sample)), label] += 1
    return train_router(sample, votes / votes.sum(axis=1, keepdims=True))


@dataclass
class Routing:
    """One classifier, or one and a second for each of its parts; the parts at the bottom are numbered through."""

    first: Router
    second: list[Router] | None = None

    def __post_init__(self) -> None:
        widths = [len(r.out_bias) for r in self.second] if self.second else [1] * len(self.first.out_bias)
        self.begins = np.concatenate([[0], np.cumsum(widths)])
        self.parts = int(self.begins[-1])

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The part that each row is stored in."""
        top = self.first.logits(vectors).argmax(axis=1)
        if not self.second:
            return top
        out = np.zeros(len(vectors), np.int64)
        for k in np.unique(top):
            at = np.flatnonzero(top == k)
            out[at] = self.begins[k] + self.second[k].logits(vectors[at]).argmax(axis=1)
        return out

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """All parts by probability, most probable first."""
        chance = _log_softmax(self.first.logits(vectors))
        if self.second:
            chance = np.concatenate([chance[:, k, None] + _log_softmax(r.logits(vectors)) for k, r in enumerate(self.second)], axis=1)
        return np.argsort(-chance, axis=1, kind="stable")


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def is_held_out(n: int) -> np.ndarray:
    """Vectors of a sample of n that nothing is learned from: every fifth."""
    return np.arange(n) % 5 == 4


def visits_for(routing: Routing, queries: np.ndarray, parts: np.ndarray, target: float = TARGET_RECALL) -> int:
    """How many parts queries have to visit for the target recall, from the parts of each one's nearest rows (-1: none)."""
    there = parts >= 0
    if routing.parts < 2 or not there.any():
        return routing.parts
    visit = np.take_along_axis(np.argsort(routing.order(queries), axis=1), np.maximum(parts, 0), axis=1)
    recall = np.array([(visit[there] < t).mean() for t in range(1, routing.parts + 1)])
    return 1 + int(np.argmax(recall >= target))


def _parts_of_nearest(valid: DataFrame, routing: Routing, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For some held-out queries the parts of their k nearest of all rows, by brute force: one pass over the rows."""
    sent = valid.sparkSession.sparkContext.broadcast((routing, ids, queries))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routing, own, asked = sent.value
        best, part = np.full((len(asked), 0), -np.inf), np.zeros((len(asked), 0), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            row_ids, vectors = _packed(batch)
            score = asked @ vectors.T
            score[own[:, None] == row_ids.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
            best = np.concatenate([best, score], axis=1)
            part = np.concatenate([part, np.broadcast_to(routing.home(vectors), score.shape)], axis=1)
            if best.shape[1] > k:
                at = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, part = np.take_along_axis(best, at, axis=1), np.take_along_axis(part, at, axis=1)
        query, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(best[query, at]), pa.array(part[query, at], pa.int32())], names=["query", "score", "part"])

    nearest = Window.partitionBy("query").orderBy(F.col("score").desc())
    found = valid.mapInArrow(run, "query int, score double, part int").withColumn("at", F.row_number().over(nearest)).filter(F.col("at") <= k)
    out = np.full((len(queries), k), -1, np.int64)
    for r in found.collect():
        out[r["query"], r["at"] - 1] = r["part"]
    return out


def _cut_again(valid: DataFrame, first: Router, parts: int, dims: int, sample_rows: int) -> list[Router]:
    """A second classifier for each part of the first, on at most ``sample_rows`` of the part's rows."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, vectors = _packed(batch)
                top = pa.array(first.logits(vectors).argmax(axis=1), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in vectors], pa.binary()), top], names=["vec_id", "vector", "part"])

    def learn(table: pa.Table) -> pa.Table:
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, dims)
        router = _learned(vectors, parts)
        out = {"part": table.column("part").slice(0, 1), "width": [len(router.out_bias)]}
        return pa.table(out | {name: [getattr(router, name).astype(np.float64).tobytes()] for name in ("into", "into_bias", "out", "out_bias")})

    placed = valid.mapInArrow(place, "vec_id long, vector binary, part int")
    drawn = Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id", "vector")
    sampled = placed.withColumn("at", F.row_number().over(drawn)).filter(F.col("at") <= sample_rows).drop("at")
    schema = "part int, width long, into binary, into_bias binary, out binary, out_bias binary"
    second = [Router(np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)) for _ in first.out_bias]
    for r in sampled.groupBy("part").applyInArrow(learn, schema).collect():
        into, into_bias, out, out_bias = (np.frombuffer(r[name], np.float64) for name in ("into", "into_bias", "out", "out_bias"))
        second[r["part"]] = Router(into.reshape(dims, -1), into_bias, out.reshape(-1, r["width"]), out_bias)
    return second


def _valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    v = F.col("vector")
    plain = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null and size(vector) > 0")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return plain.filter(~bad & F.exists(v, lambda x: x != 0))


def _packed(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index("vector"))
    return batch.column(batch.schema.get_field_index("vec_id")), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


@dataclass
class Index:
    """All rows with their parts, and the queries with the parts that each visits (``routes``).

    These are the ``visits`` most probable parts that hold rows, and further ones until they hold
    more than k rows.
    """

    placed: DataFrame
    queries: DataFrame
    routing: Routing
    visits: int
    dims: int


def index(df: DataFrame, vec_id: str, vector: str, every: int, k: int, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """Fit the parts on bounded samples and place every row; none without vectors."""
    valid = _valid(df, vec_id, vector)
    drawn = valid.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample_rows).collect()
    if not drawn:
        return None
    dims = int(np.bincount([len(r["vector"]) for r in drawn]).argmax())
    valid = valid.filter(F.size("vector") == dims)
    drawn = [r for r in drawn if len(r["vector"]) == dims]
    sample = np.array([r["vector"] for r in drawn], np.float64)
    wanted = max(LEAST_PARTS, -(-valid.count() // ROWS_PER_PART))
    first = _learned(sample[~is_held_out(len(sample))], min(wanted, FAN))
    routing = Routing(first, _cut_again(valid, first, min(FAN, -(-wanted // FAN)), dims, sample_rows) if wanted > FAN else None)
    tests = np.flatnonzero(is_held_out(len(sample)))[:TEST_QUERIES]
    ids = np.array([r["vec_id"] for r in drawn], np.int64)[tests]
    visits = visits_for(routing, sample[tests], _parts_of_nearest(valid, routing, ids, sample[tests], RECALL_AT))
    sent = df.sparkSession.sparkContext.broadcast(routing)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, vectors = _packed(batch)
                packed = pa.array([v.tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, packed, pa.array(sent.value.home(vectors), pa.int32())], names=["vec_id", "vector", "part"])

    placed = durable(valid.mapInArrow(place, "vec_id long, vector binary, part int"))
    held = np.zeros(routing.parts, np.int64)
    for r in placed.groupBy("part").count().collect():
        held[r["part"]] = r["count"]

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dims)
            routes = []
            for order in sent.value.order(vectors):
                order = order[held[order] > 0]
                enough = int(np.searchsorted(np.cumsum(held[order]), k, "right")) + 1  # parts that hold more than k rows
                routes.append(order[: max(visits, enough)].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(routes, pa.list_(pa.int32()))], names=["vec_id", "vector", "routes"])

    queries = placed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"]).select("vec_id", "vector")
    return Index(placed, durable(queries.mapInArrow(route, "vec_id long, vector binary, routes array<int>")), routing, visits, dims)


def search(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each query's k nearest found: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with
    the query's own id. Nearness is the inner product in double precision, ties go to the smaller
    id. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do null ids and vectors of another length than the most frequent one of the sample. Fewer
    candidates than k are all returned. Rows that repeat an id and vector are one query, but each is
    a candidate. Other columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    built = index(df, vec_id, vector, every, k, sample_rows)
    if built is None:
        return spark.createDataFrame([], schema)
    placed, dims = built.placed, built.dims
    queries = built.queries.select("vec_id", "vector", F.explode("routes").alias("part"))
    held = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = queries.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("chunks"))
    dealt = F.broadcast(durable(held.join(asked, "part")))  # a row for each part at most
    number, every_block = F.xxhash64("vec_id", "vector"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    every_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = placed.join(dealt, "part").select("vec_id", "vector", "part", F.pmod(number, "blocks").cast("int").alias("block"), every_chunk.alias("chunk"))
    right = queries.join(dealt, "part").select("vec_id", "vector", "part", every_block.alias("block"), F.pmod(number, "chunks").cast("int").alias("chunk"))

    def rank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            vectors = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, dims)
            return t.column("vec_id").to_numpy(), vectors

        (row_ids, vectors), (query_ids, wanted) = read(rows), read(asked)
        found = [(q, at, score) for q, at, score in nearest(wanted, query_ids, vectors, row_ids, k)] if len(row_ids) else []
        tags = [hash_of(v) for v in wanted]
        return pa.table({
            "query_id": pa.array(np.repeat(query_ids[[q for q, _, _ in found]], [len(at) for _, at, _ in found]) if found else [], pa.int64()),
            "tag": pa.array([tags[q] for q, at, _ in found for _ in at], pa.int64()),
            "vec_id": pa.array(np.concatenate([row_ids[at] for _, at, _ in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([s for _, _, s in found]) if found else [], pa.float64()),
        })

    keys = ["part", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id long, tag long, vec_id long, score double")
    best = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_of(vector: np.ndarray) -> int:
    """Tells apart queries that share an id but not a vector."""
    return int.from_bytes(hashlib.blake2b(vector.tobytes(), digest_size=8).digest(), "little", signed=True)
