"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is taken in
time linear in the features as half of |sum x_i v_i|^2 - sum x_i^2 |v_i|^2. The machine is fitted on
the driver on a sample of labelled rows whose size is bounded by a parameter; every document is then
scored in one scan of its whole text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.llm.common import arrow_rows, bounded_batches, durable, fresh, widened

#: Labelled rows that the machine is fitted on, at most (chosen by a hash of doc_id).
SAMPLE_ROWS = 5000
#: Features (slots with their values) of all these rows together, at most.
SAMPLE_FEATURES = 4_000_000
#: Slots of hashed words; the features of a document are never more than these and the statistics.
WORD_SLOTS = 1 << 14
FACTORS = 8
EPOCHS = 6
#: Distinct words whose slot a worker remembers before it starts afresh.
MEMO_ENTRIES = 200_000

#: Byte classes whose shares are features.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n", b".,;:?'\"()-", b"!", b"|", b"*#%$&@^~_=+<>{}[]\\/`", bytes(range(128, 256)))
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _k
STATISTICS = len(_CLASSES) + 1 + 8
SLOTS = STATISTICS + WORD_SLOTS


class _Slots(dict):
    """Slot of each word, bounded in number."""

    def __missing__(self, word: str) -> int:
        slot = STATISTICS + crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = slot
        return slot


def features(text: str | None, n_chars: int | None, slots: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slots (ascending, distinct) and values of a document; null text counts as empty."""
    text = text or ""
    values = np.zeros(STATISTICS, np.float64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at = len(_CLASSES) + 1
    if len(raw):
        values[:at] = np.bincount(_CLASS_OF, np.bincount(raw, minlength=256), at) / len(raw)
    counts = Counter(text.split())
    total = counts.total()
    lines = Counter(text.split("\n"))
    number = np.array(list(counts.values()), np.float64)
    if total:
        values[at] = len(counts) / total
        values[at + 1] = number.max() / total
        values[at + 2] = min(len(text) / total / 12, 4)
        values[at + 3] = 1 - len(lines) / lines.total()
        values[at + 4] = min(lines.total() / total, 1)
        values[at + 5] = np.log1p(total) / 12
        values[at + 6] = np.sqrt((number * number).sum()) / total
    values[at + 7] = np.log1p(max(0, len(text) if n_chars is None else n_chars)) / 12
    if not total:
        return np.arange(STATISTICS), values
    word_slots = np.fromiter(map(slots.__getitem__, counts), np.int64, len(counts))
    word_slots, inverse = np.unique(word_slots, return_inverse=True)
    weight = np.bincount(inverse, np.sqrt(number))
    weight /= np.sqrt((weight * weight).sum())
    return np.concatenate([np.arange(STATISTICS), word_slots]), np.concatenate([values, weight])


@dataclass
class Machine:
    """The fitted parameters."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        self.squares = (self.factors * self.factors).sum(axis=1)

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        sums = values @ self.factors[slots]
        pairs = 0.5 * (sums @ sums - (values * values) @ self.squares[slots])
        margin = self.bias + values @ self.linear[slots] + pairs
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Adagrad on the log loss, row by row in a seeded order. Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    bias, linear = 0.0, np.zeros(SLOTS)
    factors = rng.normal(0, 0.02, (SLOTS, FACTORS))
    if not rows:
        return Machine(0.0, linear, np.zeros_like(factors))
    bias_seen, linear_seen, factors_seen = 1e-2, np.full(SLOTS, 1e-2), np.full((SLOTS, FACTORS), 1e-2)
    rate, shrink = 0.1, 1e-5
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            label, at, x = rows[r]
            v, w = factors[at], linear[at]
            sums = x @ v
            margin = bias + x @ w + 0.5 * (sums @ sums - ((x * x) @ (v * v)).sum())
            slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label
            bias_seen += slope * slope
            bias -= rate * slope / np.sqrt(bias_seen)
            step = slope * x + shrink * w
            linear_seen[at] += step * step
            linear[at] = w - rate * step / np.sqrt(linear_seen[at])
            step = slope * (x[:, None] * sums[None, :] - v * (x * x)[:, None]) + shrink * v
            factors_seen[at] += step * step
            factors[at] = v - rate * step / np.sqrt(factors_seen[at])
    return Machine(float(bias), linear, factors)


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the identifier as text (null: empty) is 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Machine:
    """Fit on at most `sample_rows` labelled documents that are not held out, with at most `sample_features` features.

    Rows without a label or without a document are passed over; of several labels of a document
    the largest counts; of rows that repeat an identifier the one whose text has the least digest.
    Documents are taken in the order of a hash of doc_id until either bound is met. The chosen
    identifiers (a bounded table) are sent to the scan of the documents, every task hands on one row
    for each, and only the features of the rows within the bounds reach the driver. An empty
    table of either kind gives a machine that scores 0.5.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = chosen.select(F.col("doc_id").alias("__id"), "label")
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = rows.select("doc_id", F.col("label").cast("int").alias("label"), "text", F.col("n_chars").cast("long").alias("n_chars"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, least = _Slots(), {}
        for batch in batches:
            for doc_id, label, text, n_chars in arrow_rows(batch, "doc_id", "label", "text", "n_chars"):
                digest = hashlib.sha256(f"{n_chars} {text}".encode("utf-8", "surrogatepass")).digest()
                if doc_id not in least or digest < least[doc_id][0]:
                    at, x = features(text, n_chars, slots)
                    least[doc_id] = digest, label, at.astype("<u2").tobytes(), x.astype("<f4").tobytes()
        kinds = {"doc_id": pa.int64(), "digest": pa.binary(), "label": pa.int32(), "slots": pa.binary(), "values": pa.binary()}
        columns = [pa.array([r[k] for r in [(i, *held) for i, held in least.items()]], kind) for k, kind in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    every = rows.mapInArrow(run, "doc_id long, digest binary, label int, slots binary, values binary")
    one = durable(every.groupBy("doc_id").agg(F.min(F.struct("digest", "label", "slots", "values")).alias("row")).select("doc_id", "row.*"))
    sizes = one.select("doc_id", F.xxhash64("doc_id").alias("place"), (F.octet_length("slots") / 2).cast("long").alias("n")).collect()
    within, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
        total += r["n"]
        if total > sample_features:
            break
        within.append(r["doc_id"])
    found = one if len(within) == len(sizes) else one.filter(F.col("doc_id").isin(within))
    found = sorted(found.collect(), key=lambda r: r["doc_id"])
    return train([(int(r["label"] > 0), np.frombuffer(r["slots"], "<u2").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(np.float64)) for r in found])


def score(df: DataFrame, machine: Machine, text: str = "text", n_chars: str = "n_chars", out: str = "score") -> DataFrame:
    """Add the score (0 to 1, higher: label 1 likelier) of every row's whole text.

    Nulls in either input column and empty texts are scored like any other; repeated rows are
    scored alike; a column already named `out` is replaced, others pass through.
    """
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))
    kept = df.drop(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Machine(*sent.value)
        slots = _Slots()
        for batch in batches:
            scores = [fitted.score(*features(t, n, slots)) for t, n in arrow_rows(batch, text, n_chars)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, widened(kept, f"`{out}` double"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 where the score is 0.5 or more).

    Null and empty texts are scored like any other; a null doc_id counts as empty text for
    ``held_out``; repeated rows and ids each get a row; other columns are not read; an empty table
    gives no rows, and without labels every score is 0.5.
    """
    machine = fit(docs, labels)
    result = score(docs.select("doc_id", "text", "n_chars"), machine)
    return result.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject (score 0.5 or more), with all their columns.

    Nulls, empty texts and repeated rows are scored as in `score`; no labels reject nothing; an
    empty table stays empty.
    """
    name = fresh(docs, "quality_score")
    return score(docs, fit(docs, labels), out=name).filter(F.col(name) >= 0.5).drop(name)
