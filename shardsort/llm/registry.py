"""The registered queries of the training-data operators, over whole tables, and their SQL.

Each applies its operator with production parameters. Nulls, empty texts, ties, repeated rows and
empty tables give what the operator's docstring says; other columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shardsort.llm import ann, bpe, chat, exact_dedup, html_extract, licenses, mixing, ngram_join, quality, url_filter
from shardsort.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, dropped ones too, with its group of equal texts (see `exact_dedup.mark_copies`)."""
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents")).drop("keep_rows")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document (see `mixing.mix`)."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, encoded and decoded (see `bpe.digests`)."""
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of conversation -7, read back from its formatted text (see `chat.digests`)."""
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.events_of(turns))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document (see `quality.scored`)."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page (see `html_extract.extract`)."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document (see `ngram_join.classes`)."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector (see `ann.search`)."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and a score of every document (see `licenses.labelled`)."""
    return licenses.labelled(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page (see `url_filter.url_verdicts`)."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_mixing": op2_mixing,
        "op3_bpe": op3_bpe,
        "op4_chat": op4_chat,
        "op5_quality": op5_quality,
        "op6_html_extract": op6_html_extract,
        "op7_ngram_join": op7_ngram_join,
        "op8_ann": op8_ann,
        "op9_licenses": op9_licenses,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_mixing": mixing.ORACLE,
        "op4_chat": chat.ORACLE,
        "op7_ngram_join": ngram_join.ORACLE,
        "op10_url_filter": url_filter.ORACLE,
    }
