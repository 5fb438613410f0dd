"""Every stage against brute force, written here, on its own input: the driver's table and awkward rows."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from shardsort.llm import bpe, quality
from shardsort.llm.common import table
from test_mixing import size_of, sizes_by_source, water_fill
from test_ngram_join import grouped

UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module", params=["table", "awkward"])
def stages(request, spark, small, docs, rows):
    """The rows before the first stage and after each, as tuples."""
    frame = table(spark, small, "documents") if request.param == "table" else docs
    if request.param == "awkward":  # more equal rows, with and without a number
        more = [(None, "six words that are all equal", "en", "s1", 4)] * 9 + [(77, "seven words that are all quite equal", "en", "s2", 4)] * 7
        frame = spark.createDataFrame([*rows, *((*r, None, None, None, None) for r in more)], docs.schema).repartition(3)
    schema, seen = frame.schema, [list(map(tuple, frame.collect()))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.createDataFrame(seen[-1], schema).repartition(3), small)
        assert k == 4 or out.columns == schema.names
        seen.append(list(map(tuple, out.collect())))
    return seen


def test_stages_are_listed():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_classifier(spark, small, stages):
    """The machine's formula over all pairs of features, for every row."""
    before, after = stages[:2]
    labels = table(spark, small, "labels")
    frame = spark.createDataFrame([r[:5] for r in before], "doc_id long, text string, lang string, source string, n_chars long")
    machine = quality.fit(frame, labels)
    kept, unclear = Counter(), Counter()
    for r in before:
        slots, x = quality.features(r[1], r[4], quality._Slots())
        v = machine.factors[slots] * x[:, None]
        pairs = ((v.sum(axis=0) ** 2).sum() - (v * v).sum()) / 2 if len(x) > 800 else np.triu(v @ v.T, 1).sum()
        margin = machine.bias + x @ machine.linear[slots] + pairs
        (unclear if abs(margin) < 1e-4 else kept if margin > 0 else Counter())[r] += 1
    got = Counter(after)
    assert kept <= got and got <= kept + unclear
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()} & {r[0] for r in before}
    if len(before) >= 200:
        assert len(good & {r[0] for r in after}) >= 0.97 * len(good)


def test_exact_dedup(stages):
    before, after = stages[1:3]
    last = {}
    for r in before:
        key = (r[1] or "").translate(UPPER)
        last[key] = max(last.get(key, (False, 0)), (r[0] is not None, r[0] or 0))
    assert Counter(((r[1] or "").translate(UPPER), (r[0] is not None, r[0] or 0)) for r in after) == Counter(last.items())
    assert Counter(after) <= Counter(before)


def test_near_copies(stages):
    before, after = stages[2:4]
    _, group, least = grouped([r[:2] for r in before])
    of = defaultdict(set)
    for i, r in enumerate(before):
        of[r[0]].add(group[i])
    assert Counter(r[0] for r in after) == Counter(before[i][0] for i in least.values())
    assert Counter(after) <= Counter(before) and {r for r in after if len(of[r[0]]) == 1} <= set(before)


def test_mixing(stages):
    """The rule from the start: draws by digest, whole epochs, then the front of each source's order."""
    before, after = stages[3:5]
    aims, sizes, want = water_fill(sizes_by_source(before)), sizes_by_source(before), Counter()

    def place(r):
        text = r[1] or ""
        digest = hashlib.md5(f"{'' if r[0] is None else r[0]}:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        per_word = len(text) / max(1, size_of(text))
        return -math.log((int(digest[:12], 16) + 1) / ((1 << 48) + 1)) / (1 if 3 <= per_word <= 12 else 0.25), r[0] is not None, r[0] or 0, size_of(text)

    for source, aim in aims.items():
        epochs = math.floor(aim / sizes[source]) if sizes[source] else 0
        room = math.floor(aim + 1e-9) - epochs * sizes[source]
        for r in sorted((r for r in before if r[3] == source), key=place):
            part = max(0, min(room, size_of(r[1])))
            room -= size_of(r[1])
            want[r[0], r[3], r[1]] += epochs + (part > 0 and 2 * part >= size_of(r[1]))
    assert Counter((r[0], r[3], r[1]) for r in after) == +want
    words = lambda some: sum(size_of(r[1]) for r in some)
    assert set(after) <= set(before)
    if len(before) > 100:  # among few rows one long one that fits only partly weighs much
        assert words(after) == pytest.approx(1.5 * words(before), rel=0.1)


def test_encoding(stages):
    before, after = stages[4:6]
    with open(corpus_pipeline.RANKS, "rb") as lines:
        ranks = bpe.read_ranks(lines)
    encode = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for r in before:
        ids = encode(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter(after) == want


def test_run(spark, small, stages):
    got = Counter(map(tuple, corpus_pipeline.run(spark, small).collect()))
    assert len(stages[0]) < 200 or got == Counter(stages[5])


def test_no_documents(spark, small, no_docs):
    rows = no_docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, small)
        assert out.count() == 0 and (k == 4 or out.columns == no_docs.columns)


def test_plain_words():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b\x1cc") == ["a", "b\x1cc"] and size_of("a b\x1cc") == 2
