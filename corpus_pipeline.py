"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before it kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. In every stage null texts count as empty, texts of any length
are read whole, further columns of docs are carried along, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shardsort.llm import bpe, exact_dedup, mixing, ngram_join, quality
from shardsort.llm.common import table, written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go.

    Empty texts are scored like any other and repeated rows alike; without labels nothing goes.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest doc_id stays.

    A null doc_id counts as the smallest; of rows that repeat a document one stays; all empty texts
    are equal.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest doc_id (null first) stays.

    Of rows that repeat it, or stand under its number in the same class, one stays. Texts without
    words have no links and all stay.
    """
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, so some not at all and others twice.

    Null sources are one source; of equal rows exactly as many are taken as fit; empty texts take
    nothing and stay as often as their source's whole epochs say.
    """
    return mixing.repeat_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens and the digests of its token ids and of their bytes.

    Null and repeated doc_ids each get a row.
    """
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_texts),
]

#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; between stages, tables in the shared folder.

    Per row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256. Nulls, empty texts, ties and
    repeated rows as the stages say; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
