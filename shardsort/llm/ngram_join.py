"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

Documents with the same set of n-grams are one node. The nodes' MinHash signatures are cut into
bands whose number and height follow from the wanted recall, and nodes that share a band's hash meet
in its bucket. Buckets with one member never travel beyond a count; of buckets with the same members
one is worked on. Only the nodes of shared buckets have their n-gram sets fetched, once, and each
pair is verified in the first bucket that it shares; a set is sent only where its node has such a
pair. A crowded bucket is dealt in pairs of blocks, a
task each; tasks hand on a count of links and one edge for each node, never pairs.

Where classes alone are asked for, the nodes of crowded buckets are first compared with a hub each, and
those that can have no link in another component are taken out by bounds; only pairs of different
components are verified after that.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.llm.common import KeyFilter, arrow_rows, bounded_batches, dealt_join, durable, fresh, salted_join, widened, written
from shardsort.llm.components import components

#: Words of an n-gram, least similarity of a link, and the probability to find a link just there.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: MinHash values of a signature, unless even bands of one value need more.
USUAL_HASHES = 128
#: Nodes and n-grams in one block of a bucket.
BLOCK_NODES, BLOCK_GRAMS = 256, 400_000
#: N-grams that are counted together, turns of comparing with hubs at most, and the share of nodes that must link for another turn.
CHUNK_GRAMS, HUB_TURNS, HUB_SHARE = 10_000, 6, 0.1
#: So many pairs are intersected one by one, more all together.
FEW_PAIRS = 10
#: Dropped identifiers that may be sent to every task.
BROADCAST_ROWS = 2_000_000
#: Distinct words whose hash a worker remembers before it starts afresh.
MEMO_ENTRIES = 200_000
_WORD = re.compile(r"\w+")
_NO_ID = -(1 << 63)


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = USUAL_HASHES) -> tuple[int, int]:
    """(bands, rows): the tallest bands of `hashes` values that find a pair at `similarity` with probability `recall`.

    Where none do, bands of one value, as many as the recall takes.
    """
    if not (0 < similarity <= 1 and 0 < recall < 1):
        raise ValueError("similarity must be above 0 and at most 1, recall between 0 and 1")
    best = None
    for rows in range(1, hashes + 1):
        chance = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-chance)) if 1e-12 < chance < 1 else 1 if chance == 1 else math.inf
        if best is None or bands * rows <= hashes:
            best = (bands, rows)
    if best[0] == math.inf:
        raise ValueError(f"no number of bands finds pairs at similarity {similarity}")
    return best


class _WordHashes(dict):
    """64-bit hash of each word, bounded in number."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def gram_set(text: str | None, hashes: dict, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams of lower-cased words (runs of \\w).

    A text of fewer than n words has one n-gram, all its words; one without words has none.
    """
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    value = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out ^ value[k : len(words) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


class Signer:
    """MinHash signatures cut into bands; one 64-bit key for each band."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Band keys of a non-empty set."""
        least = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        small = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(small), 2048):
                mixed = self.factor[:, None] * small[None, at : at + 2048]
                mixed += self.shift[:, None]
                mixed ^= mixed >> np.uint32(15)
                np.minimum(least, mixed.min(axis=1), out=least)
            key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for k in range(self.rows):
                key = (key ^ least.reshape(self.bands, self.rows)[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
        return key.view(np.int64)


def _node(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _id_digest(doc_id: int | None) -> bytes:
    return hashlib.blake2b(b"%d" % (_NO_ID if doc_id is None else doc_id), digest_size=16).digest()


def signatures(df: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, node, n_grams, keys) of every row of (id, text); the last three null without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer = _WordHashes(), Signer(bands, rows)
        for batch in batches:
            out = []
            for (text,) in arrow_rows(batch, "text"):
                grams = gram_set(text, hashes, n)
                out.append((_node(grams), len(grams), signer.keys(grams).tolist()) if len(grams) else (None, None, None))
            columns = [batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "n_grams", "keys"])

    return df.mapInArrow(run, "id long, node binary, n_grams long, keys array<long>")


def _crowded(nodes: DataFrame) -> DataFrame:
    """(key, node) of the buckets with two members or more, one bucket for each set of members."""
    several = durable(nodes.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1").select("key"))
    several = several.withColumn("digest", F.unhex(F.md5(F.col("key").cast("string"))))
    admits = KeyFilter.over(several, "digest")
    sent = nodes.sparkSession.sparkContext.broadcast((admits.bits, admits.words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = KeyFilter(*sent.value)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("keys"))
            flat = keys.flatten().to_numpy()
            owner = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
            at = np.flatnonzero(passing.may_hold([hashlib.md5(b"%d" % k).digest() for k in flat.tolist()]))
            node = batch.column(batch.schema.get_field_index("node"))
            yield pa.RecordBatch.from_arrays([pa.array(flat[at]), node.take(pa.array(owner[at]))], names=["key", "node"])

    members = durable(nodes.select("node", "keys").mapInArrow(run, "key long, node binary"))
    buckets = members.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = buckets.filter("members > 1").groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members")
    return durable(dealt_join(members, chosen, "key", "members").select("key", "node"))


def _sets(df: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, id, grams) of the rows whose identifier is among the wanted ones (and a few others)."""
    hashed = wanted.select(F.col("id")).mapInArrow(_hash_ids, "digest binary")
    admits = KeyFilter.over(durable(hashed), "digest")
    sent = df.sparkSession.sparkContext.broadcast((admits.bits, admits.words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, passing = _WordHashes(), KeyFilter(*sent.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = np.flatnonzero(passing.may_hold([_id_digest(i) for i in ids]))
            texts = batch.column(1).take(pa.array(at)).to_pylist()
            sets = [gram_set(t, hashes, n) for t in texts]
            columns = [pa.array([_node(g) for g in sets], pa.binary()), batch.column(0).take(pa.array(at)), pa.array([g.tobytes() for g in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "id", "grams"])

    return df.mapInArrow(run, "node binary, id long, grams binary")


def _hash_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_id_digest(i) for i in batch.column(0).to_pylist()], pa.binary())], names=["digest"])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sets of hashes."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often[gram] > 1
    owner, gram = owner[common], np.unique(gram[common], return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    grams = int(gram[-1]) + 1 if len(gram) else 0
    step = max(1, min(grams, (1 << 21) // len(sets)))
    for begin in range(0, grams, step):
        low, high = np.searchsorted(gram, [begin, begin + step])
        held = np.zeros((len(sets), step), np.float32)
        held[owner[low:high], gram[low:high] - begin] = 1
        shared += held @ held.T
    shared = shared.astype(np.int64)
    np.fill_diagonal(shared, [len(s) for s in sets])
    return shared


def own_pairs(key: int, across: bool, block: list[int], keys: list[list[int]], size: np.ndarray, similarity: float, component: list[bytes | None]) -> np.ndarray:
    """Which pairs of a bucket's nodes are to be intersected here, as a matrix.

    Here is where `key` is the smallest bucket that both are in and, in a task across two blocks,
    where they lie in different ones. Pairs that belong elsewhere, whose sizes differ too much for the
    similarity, or that are known to be of one component (null: unknown) are not intersected.
    """
    wanted = np.minimum.outer(size, size) >= similarity * np.maximum.outer(size, size) - 1e-9
    np.fill_diagonal(wanted, False)
    if across:  # one of the blocks may be empty
        number = np.array(block)
        wanted &= number[:, None] != number[None, :]
    if component[0] is not None:
        number = np.unique(np.array(component, object), return_inverse=True)[1]
        wanted &= number[:, None] != number[None, :]
    earlier: dict[int, list[int]] = {}
    for k, own in enumerate(keys):
        for other in own:
            if other < key:
                earlier.setdefault(other, []).append(k)
    for rows in earlier.values():
        if len(rows) > 1:
            wanted[np.ix_(rows, rows)] = False
    return wanted


def links_within(wanted: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the wanted pairs of sets are links, as a matrix."""
    size = np.array([len(s) for s in sets], np.int64)
    one, two = np.nonzero(np.triu(wanted))
    linked = np.zeros_like(wanted)
    if len(one) <= FEW_PAIRS:
        for a, b in zip(one, two, strict=True):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            linked[a, b] = linked[b, a] = both >= similarity * (size[a] + size[b] - both) - 1e-9
        return linked
    rows = np.flatnonzero(wanted.any(axis=1))
    shared = shared_counts([sets[k] for k in rows])
    near = shared >= similarity * (size[rows][:, None] + size[rows][None, :] - shared) - 1e-9
    linked[np.ix_(rows, rows)] = near & wanted[np.ix_(rows, rows)]
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first node of each node's component."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] < 0:
            root[k], reached = k, [k]
            while reached:
                further = np.flatnonzero(linked[reached.pop()] & (root < 0))
                root[further] = k
                reached.extend(further.tolist())
    return root


_TASK = ("key", "one", "two")


def _by_task(dealt: DataFrame, columns: tuple[str, ...], schema: str, answer) -> DataFrame:
    """What `answer` makes of the rows of each bucket, or pair of its blocks, if these are two or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            out = []
            for row in arrow_rows(batch, *_TASK, *columns):
                if row[:3] != group:
                    if len(rows) > 1:
                        out.extend(answer(group, rows))
                    group, rows = row[:3], []
                rows.append(row[3:])
            yield as_batch(out)
        yield as_batch(answer(group, rows) if len(rows) > 1 else [])

    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

    ordered = dealt.select(*_TASK, *columns).repartition(*_TASK).sortWithinPartitions(*_TASK)
    return ordered.mapInArrow(run, schema)


def _with_pairs(placed: DataFrame, similarity: float) -> DataFrame:
    """The rows of (key, one, two, block, node, component, keys, n_grams) that have a pair to be intersected there.

    Only the nodes' keys and sizes are shuffled for this; sets are then sent to these places alone.
    """

    def answer(group: tuple, rows: list[tuple]) -> list[tuple]:
        wanted = own_pairs(group[0], group[1] != group[2], [r[0] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows], np.int64), similarity, [r[4] for r in rows])
        return [(*group, rows[k][0], rows[k][1], rows[k][4]) for k in np.flatnonzero(wanted.any(axis=1))]

    return _by_task(placed, ("block", "node", "keys", "n_grams", "component"), "key long, one int, two int, block int, node binary, component binary", answer)


def _verified(dealt: DataFrame, similarity: float) -> DataFrame:
    """(node, n_links, root) of the nodes with links in a task's bucket or pair of blocks."""

    def answer(group: tuple, rows: list[tuple]) -> list[tuple]:
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        wanted = own_pairs(group[0], group[1] != group[2], [r[0] for r in rows], [r[2] for r in rows], np.array([len(s) for s in sets], np.int64), similarity, [r[5] for r in rows])
        linked = links_within(wanted, sets, similarity)
        counts, root = linked @ np.array([r[4] for r in rows], np.int64), _roots(linked)
        return [(rows[k][1], int(counts[k]), rows[root[k]][1]) for k in np.flatnonzero(linked.any(axis=1))]

    return _by_task(dealt, ("block", "node", "keys", "grams", "documents", "component"), "node binary, n_links long, root binary", answer)


def _gram_digests(grams: np.ndarray) -> list[bytes]:
    """Sixteen bytes of each n-gram, for a KeyFilter."""
    with np.errstate(over="ignore"):
        mixed = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    held = np.stack([grams, mixed ^ (mixed >> np.uint64(29))], axis=1).tobytes()
    return [held[k : k + 16] for k in range(0, len(held), 16)]


def _extremes(grams: np.ndarray, halves: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct n-grams, and of each the least or greatest of every column of `halves` (least and greatest take turns)."""
    order = np.argsort(grams, kind="stable")
    distinct, first = np.unique(grams[order], return_index=True)
    return distinct, [(np.maximum if k % 2 else np.minimum).reduceat(h[order], first) for k, h in enumerate(halves)]


def _common_grams(sets: DataFrame) -> KeyFilter:
    """Filter of the n-grams that nodes of two components or more hold; sets have node, component and grams.

    A task hands on its distinct n-grams with the least and greatest component, packed by ranges of n-grams.
    """
    occurrences = sets.agg(F.sum("n_grams")).head()[0] or 0
    chunks = max(1, -(-occurrences // CHUNK_GRAMS))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, of, held = [], [], 0

        def flush() -> pa.RecordBatch:
            half = np.frombuffer(b"".join(of), np.uint64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            one, two = half[owner, 0], half[owner, 1]
            distinct, columns = _extremes(np.concatenate(grams), [one, one, two, two])
            table, chunk = np.stack([distinct, *columns], axis=1), (distinct % np.uint64(chunks)).astype(np.int64)
            there = np.unique(chunk)
            return pa.RecordBatch.from_arrays([pa.array(there), pa.array([table[chunk == c].tobytes() for c in there], pa.binary())], names=["chunk", "packed"])

        for batch in batches:
            for component, gram in arrow_rows(batch, "component", "grams"):
                grams.append(np.frombuffer(gram, np.uint64))
                of.append(component)
                held += len(grams[-1])
                if held >= 1 << 20:
                    yield flush()
                    grams, of, held = [], [], 0
        if grams:
            yield flush()

    def common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, []

        def merged() -> pa.RecordBatch:
            table = np.concatenate([np.frombuffer(t, np.uint64).reshape(-1, 5) for t in tables]) if tables else np.zeros((0, 5), np.uint64)
            if not len(table):
                return pa.RecordBatch.from_arrays([pa.array([], pa.binary())], names=["digest"])
            distinct, (a, b, c, d) = _extremes(table[:, 0], [table[:, k] for k in range(1, 5)])
            return pa.RecordBatch.from_arrays([pa.array(_gram_digests(distinct[(a < b) | (c < d)]), pa.binary())], names=["digest"])

        for batch in batches:
            for chunk, table in arrow_rows(batch, "chunk", "packed"):
                if chunk != now:
                    yield merged()
                    now, tables = chunk, []
                tables.append(table)
        yield merged()

    chunked = sets.select("component", "grams").mapInArrow(packed, "chunk long, packed binary")
    return KeyFilter.over(durable(chunked.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(common, "digest binary")), "digest")


def _with_component(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of their node, which is the node itself where no edge is known."""
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    named = rows.join(labels.select("node", "root"), "node", "left")
    return named.withColumn("component", F.coalesce("root", "node")).drop("root")


def _hub_links(crowded: DataFrame, held: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What comparing the nodes of crowded buckets with hubs tells: links, components, and the rows left.

    In each turn every bucket names a hub, of its component with most nodes there: first a node whose
    n-grams are mostly common, later any. A node of another component is compared with one hub, so a
    turn takes a row for each node, however large the buckets are. Before that, nodes that can have no link to
    another component of the bucket are taken out of it: an n-gram that no other component holds cannot
    be shared, which bounds the intersection (with a false answer of the filter it is only bounded less).
    What (key, node) rows are left have to be verified, where their components still differ.
    """
    sets = durable(held.select("node", "n_grams", "grams").join(crowded.select("node").distinct(), "node"))
    rows, links, labels = crowded.select("key", "node"), None, None
    for turn in range(HUB_TURNS):
        state = rows.groupBy("node").agg(F.collect_list("key").alias("keys")).join(sets, "node")
        state = durable(_with_component(state, labels))
        admits = _common_grams(state)
        sent = crowded.sparkSession.sparkContext.broadcast((admits.bits, admits.words))

        def held_in_common(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            passing = KeyFilter(*sent.value)
            for batch in batches:
                common = [int(passing.may_hold(_gram_digests(np.frombuffer(g, np.uint64))).sum()) for (g,) in arrow_rows(batch, "grams")]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("node", "component", "n_grams", "keys")), pa.array(common, pa.int64())], names=["node", "component", "n_grams", "keys", "common"])

        bounded = state.select("node", "component", "n_grams", "keys", "grams").mapInArrow(held_in_common, "node binary, component binary, n_grams long, keys array<long>, common long")
        rows = durable(bounded.withColumn("places", F.size("keys")).withColumn("key", F.explode("keys")).drop("keys"))
        score = (F.col("common") / F.col("n_grams"), F.col("places")) if not turn else (F.xxhash64("node", F.lit(turn)),)
        parts = rows.groupBy("key", "component").agg(F.count("*").alias("nodes"), F.min("n_grams").alias("least"), F.max("n_grams").alias("most"), F.max("common").alias("common"), F.max(F.struct(*(c.alias(f"s{k}") for k, c in enumerate(score)), "node")).alias("best"))
        buckets = parts.groupBy("key").agg(F.sum("nodes").alias("members"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("common").alias("most_common"), F.max(F.struct("nodes", "best", "component")).alias("main"), F.count("*").alias("components"))
        rows = dealt_join(rows, buckets.filter("components > 1"), "key", "members")
        # The largest possible similarity to a set of that bucket: with one of as many n-grams as can be shared, or the next there is.
        both = F.least("common", "most_common")
        other = F.least(F.greatest(both, "least"), "most")
        both = F.least(both, other)
        rows = written(rows.filter(both >= similarity * (F.col("n_grams") + other - both) - 1e-9))
        asked = rows.filter("component != main.component").groupBy("node").agg(F.max("main.best").alias("best")).select("node", F.col("best.node").alias("hub"))
        asked = durable(asked.join(sets.select("node", "grams"), "node"))
        hubs = asked.groupBy("hub").agg(F.count("*").alias("asked")).join(sets.select(F.col("node").alias("hub"), F.col("grams").alias("of_hub")), "hub")

        def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = []
                for node, hub, one, two in arrow_rows(batch, "node", "hub", "grams", "of_hub"):
                    one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both >= similarity * (len(one) + len(two) - both) - 1e-9:
                        near.append((node, hub))
                yield pa.RecordBatch.from_arrays([pa.array([n[k] for n in near], pa.binary()) for k in (0, 1)], names=["node", "root"])

        # A table, as checkpoints hand on constraints, and these multiply from turn to turn.
        found = written(dealt_join(asked, hubs, "hub", "asked", hot=BLOCK_NODES).select("node", "hub", "grams", "of_hub").mapInArrow(compared, "node binary, root binary"))
        linked = found.count()
        if linked or links is None:
            links = found if links is None else links.unionByName(found)
            labels = written(components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        if linked <= HUB_SHARE * asked.count():
            break
    return links, labels, rows.select("key", "node", "n_grams")


def _class_links(members: DataFrame, wanted: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(node, root): links enough to make the classes.

    Of a crowded bucket, the component with most nodes there meets the others, and these each other; it does not meet itself.
    """
    rows = durable(members.join(wanted.select("node", "n_grams"), "node"))
    crowd = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum("n_grams").alias("all_grams"))
    marked = durable(dealt_join(rows, crowd.filter((F.col("members") > BLOCK_NODES) | (F.col("all_grams") > BLOCK_GRAMS)).select("key", "members"), "key", "members", "left"))
    crowded = marked.filter("members is not null")
    attributes = wanted.select("node", "keys", "n_grams")
    links = None
    if crowded.isEmpty():
        zero = F.lit(0)
        placed = rows.select("key", "node", F.lit(None).cast("binary").alias("component"), zero.alias("block"), zero.alias("one"), zero.alias("two"))
    else:
        links, labels, left = _hub_links(crowded, held, similarity)
        rows = written(_with_component(marked.filter("members is null").select("key", "node", "n_grams").unionByName(left), labels))
        parts = rows.groupBy("key", "component").agg(F.count("*").alias("nodes"), F.sum("n_grams").alias("grams"))
        buckets = parts.groupBy("key").agg(F.sum("nodes").alias("members"), F.sum("grams").alias("all_grams"), F.max(F.struct("nodes", "grams", "component")).alias("main"), F.count("*").alias("components")).filter("components > 1")
        count = lambda nodes, grams: F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(grams / BLOCK_GRAMS)).cast("int")
        alone = count(F.col("members"), F.col("all_grams")) <= 1
        others = F.when(alone, 1).otherwise(count(F.col("members") - F.col("main.nodes"), F.col("all_grams") - F.col("main.grams")))
        mains = F.when(alone, 0).otherwise(count(F.col("main.nodes"), F.col("main.grams")))
        placed = dealt_join(rows, buckets.select("key", "members", F.col("main.component").alias("main"), others.alias("others"), mains.alias("mains")), "key", "members")
        in_main = (F.col("mains") > 0) & (F.col("component") == F.col("main"))
        spread = F.xxhash64("node")
        placed = placed.withColumn("block", F.when(in_main, F.col("others") + F.pmod(spread, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(spread, F.col("others"))).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
        placed = placed.select("key", "node", "component", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    own = _with_pairs(placed.join(attributes, "node"), similarity)
    verified = _verified(own.join(held, "node"), similarity).select("node", "root")
    return written(verified if links is None else links.unionByName(verified))


def _counted_links(members: DataFrame, wanted: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(node, n_links, root) of the nodes with links, from every pair of every bucket."""
    sizes = members.join(wanted.select("node", "n_grams"), "node").groupBy("key").agg(F.count("*").alias("members"), F.sum("n_grams").alias("all_grams"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("all_grams") / BLOCK_GRAMS)).cast("int")
    placed = dealt_join(members, sizes.select("key", "members", blocks.alias("blocks")), "key", "members").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "node", F.lit(None).cast("binary").alias("component"), "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    own = _with_pairs(placed.join(wanted.select("node", "keys", "n_grams"), "node"), similarity)
    return durable(_verified(own.join(held, "node"), similarity))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams is at least
    ``similarity``; ``n_links`` counts the documents linked to this one (copies included), and
    ``class_id`` is the smallest doc_id of all that links connect. Words are runs of letters, digits
    and underscores, lower-cased; fewer than n words form one n-gram. Null, empty and wordless texts
    have no n-gram and no link, and are classes of their own. Texts are read whole. Rows that repeat
    an identifier are documents of their own, linked as their texts are. A null doc_id sorts before
    all others, as a class_id it is null. Other columns are not read; an empty table gives no rows.
    """
    return _classed(df, doc_id, text, n, similarity, recall).select("doc_id", "class_id", "n_links")


def _classed(df: DataFrame, doc_id: str, text: str, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, counting: bool = True) -> DataFrame:
    """The same with the node of each row, null without words, and the node of its class that stays.

    Without counting n_links is not there.
    """
    bounded_batches(df.sparkSession)
    bands, rows = bands_for(similarity, recall)
    source = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = durable(signatures(source, n, bands, rows))
    ids = F.coalesce("id", F.lit(_NO_ID))
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min(ids).alias("least"), F.count("*").alias("documents"), F.max("n_grams").alias("n_grams"), F.first("keys").alias("keys"))
    nodes = durable(nodes)
    members = _crowded(nodes)
    of_node = members.groupBy("node").agg(F.collect_list("key").alias("keys"))  # one for each band at most
    wanted = durable(of_node.join(nodes.select("node", "least", "documents", "n_grams"), "node"))
    sets = _sets(source, wanted.select(F.col("least").alias("id")), n).withColumn("least", F.coalesce("id", F.lit(_NO_ID)))
    held = wanted.join(sets.select("node", "least", "grams"), ["node", "least"]).dropDuplicates(["node"])
    held = durable(held)
    links = (_counted_links if counting else _class_links)(members, wanted, held, similarity)
    linked = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    within = durable(linked.join(nodes.select("node", "least"), "node"))
    of_root = within.groupBy("root").agg(F.min(F.struct("least", "node")).alias("first"), F.count("*").alias("members"))
    named = dealt_join(within.select("root", "node"), of_root, "root", "members").select("node", F.col("first.least").alias("class"), F.col("first.node").alias("stays"))
    found = nodes.select("node", "least", "documents").join(named, "node", "left")
    if counting:
        found = found.join(links.groupBy("node").agg(F.sum("n_links").alias("found")), "node", "left")
    joined = dealt_join(signed.select("id", "node"), found, "node", "documents", "left")
    least = F.coalesce("class", "least")
    n_links = F.coalesce(F.col("documents") - 1 + F.coalesce("found", F.lit(0)), F.lit(0)).alias("n_links") if counting else None
    return joined.select(
        F.col("id").alias("doc_id"),
        "node",
        F.coalesce("stays", "node").alias("stays"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.when(least != _NO_ID, least)).alias("class_id"),
        *([n_links] if counting else []),
    )


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that with the smallest doc_id (null first).

    Rows are told apart by identifier and node (the set of n-grams): where an identifier stands for
    several nodes of a class the least node stays, and of rows that repeat both one stays. Null,
    empty and wordless texts are classes of their own and all stay; an empty table stays empty.
    Lists of identifiers are sent to every task where they are counted to be within BROADCAST_ROWS;
    beyond that the joins are shuffled.
    """
    key, node, state = (fresh(df, name) for name in ("id_key", "node", "state"))
    found = durable(_classed(df, doc_id, text, counting=False))
    stays = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("stays")))
    told = found.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(key), "node", stays.alias("stays"))
    ids = told.groupBy(key).agg(F.count("*").alias("rows"), F.count_if("stays").alias("staying"))
    # An identifier of one row that stays needs no join; of the others either no row stays, or rows are looked at.
    some = ids.filter("rows > 1 or staying = 0").select(key, (F.col("staying") > 0).alias(state))
    rows = salted_join(df.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))), some, [key], "left", BROADCAST_ROWS)
    clear = rows.filter(F.col(state).isNull()).drop(key, state)
    mixed = ids.filter("rows > 1 and staying > 0").select(key)
    if mixed.isEmpty():
        return clear

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [gram_set(t, hashes, WORDS) for (t,) in arrow_rows(batch, text)]
            nodes = pa.array([_node(g) if len(g) else None for g in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, node])

    looked = rows.filter(F.col(state)).drop(state)
    looked = durable(looked.mapInArrow(run, widened(looked, f"`{node}` binary")))
    kept = told.filter("stays and node is not null").join(F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed, key, "left_semi")
    kept = kept.select(key, F.col("node").alias(node)).distinct()
    one = looked.filter(F.col(node).isNotNull()).join(kept, [key, node], "left_semi").dropDuplicates([key, node])
    return clear.unionByName(one.drop(key, node)).unionByName(looked.filter(F.col(node).isNull()).drop(key, node))


#: Exact, over all pairs that share an n-gram; banding misses less than one link in 10,000 of these.
ORACLE = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(lower(coalesce("text", '')), '[\p{L}\p{N}_]+') AS words FROM documents
    ), u AS (
        SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram FROM w
    ), g AS (SELECT DISTINCT doc_id, gram FROM u
    ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
    ), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
    ), l AS (
        SELECT p.x, p.y FROM p JOIN n AS nx ON nx.doc_id = p.x JOIN n AS ny ON ny.doc_id = p.y
        WHERE both_have >= 0.8::DOUBLE * (nx.n + ny.n - both_have) - 1e-9
    ), r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
    ), c AS (SELECT x, min(y) AS smallest FROM r GROUP BY x
    ), k AS (SELECT x, count(*) AS links FROM l GROUP BY x)
    SELECT d.doc_id, least(d.doc_id, coalesce(c.smallest, d.doc_id)) AS class_id, coalesce(k.links, 0)::BIGINT AS n_links
    FROM documents AS d LEFT JOIN c ON c.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id"""
