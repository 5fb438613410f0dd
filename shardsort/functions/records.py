"""Records and keys as column expressions.

Two modes. Compatible (text): the key is a line's first ten characters, padded with spaces, and a
record is exactly 99 characters plus the line feed. Lossless (binary): the key is the first ten
bytes and nothing is padded or cut. Both compare from the front, as unsigned bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of a key, of a record, and of a line without its line feed.
KEY_LEN = 10
RECORD_LEN = 100
LINE_LEN = RECORD_LEN - 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(line: Column | str, length: int = KEY_LEN) -> Column:
    """The padded key of a text line; null counts as an empty line."""
    return F.rpad(F.substring(F.coalesce(_col(line), F.lit("")), 1, length), length, " ")


def byte_key(data: Column | str, length: int = KEY_LEN) -> Column:
    """The key of binary (or of a text's UTF-8): its first bytes."""
    return F.substring(_col(data).cast("binary"), 1, length)


def normalize(line: Column | str, length: int = LINE_LEN) -> Column:
    """A line cut or padded with spaces to the fixed width, without its line feed."""
    return F.rpad(F.coalesce(_col(line), F.lit("")), length, " ")


def split_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line of a text column: the kept columns, ln (from 0), line.

    Lines end at \\r\\n, \\n or \\r; a last terminator starts no further line and an empty text has
    no lines.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(\r\n|\n|\r)\z", "")
    lines = df.filter(F.length(text) > 0).select(*keep, F.posexplode(F.split(body, r"\r\n|\n|\r")).alias("ln", "line"))
    return lines.withColumn("ln", F.col("ln").cast("long"))


def record_count(size: Column | str) -> Column:
    """Whole records in so many bytes."""
    return F.floor(_col(size) / RECORD_LEN).cast("long")


def byte_offset(index: Column | str) -> Column:
    """Where the record of a number (from 0) begins."""
    return _col(index).cast("long") * RECORD_LEN


def draw_index(rows: Column | str, seed: int, *parts: Column | str) -> Column:
    """A record number below `rows`, drawn from a digest of the seed and the parts, so it repeats anywhere."""
    named = F.concat_ws("|", F.lit(str(seed)), *(_col(p).cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long"), _col(rows)).cast("long")


def random_record_offset(records: Column | str, seed: int, *parts: Column | str) -> Column:
    """The record-aligned byte offset of such a draw."""
    return byte_offset(draw_index(records, seed, *parts))
