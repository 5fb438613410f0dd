"""A small table of documents with the awkward cases."""

import random

import pytest

WORDS = [f"w{k}" for k in range(400)]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node string, __id string, token_ids string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def document_rows():
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(12)]
    texts = list(base)
    texts += [base[0]] * 7 + [base[1].upper(), base[1]]  # copies, some in capitals
    for k in range(6):  # near copies of one text
        words = base[2].split()
        words[5 + 9 * k] = f"other{k}"
        texts.append(" ".join(words))
    texts += [None, None, "", " \n\t ", "one", "two words", "Two  words", "é" * 5, "😀 ß İ", "a" * 5000, prose(rng, 3000), "\x1c\x85　x"]
    rows = [(k, t, "en", rng.choice(["s1", "s2", "S3", None, "é"]), None if k % 5 == 0 else len(t or ""), "clash", "clash", "clash", "clash") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[4], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(5, "a text of its own under a repeated number", "en", "s1", 3, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
