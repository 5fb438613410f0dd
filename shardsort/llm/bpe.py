"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The symbols of the pre-tokens to be encoded form a linked list over their joined bytes, with edges
between pre-tokens that no pair crosses. Every adjacent pair whose bytes have a rank waits in the
bucket of that rank, by its left position. Two levels of 256-bit words say which buckets hold
anything, so the next rank is two find-first-set steps away; entries whose pair has changed since
they were queued are skipped when they come up. n bytes cost O(n log n) whatever the length of a
pre-token, so very long ones (a run of one character, say) need no cap. One queue serves many short
pre-tokens at once, which spreads the cost of its bitmaps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardsort.llm.common import arrow_rows, bounded_batches, widened

#: Distinct pre-tokens in one generation of the ids that a worker remembers; it has two.
MEMO_ENTRIES = 150_000
#: Longer pre-tokens are encoded each time, so that the memory of the memo is bounded.
MEMO_CHARS = 64
#: Texts are split in lots of about so many characters, and so many short pre-tokens share a queue.
SPLIT_CHARS, QUEUE_PIECES = 2_000_000, 3000
#: Stands for a byte that has no rank of its own; a text that needs it is refused.
NO_BYTE = 1 << 40


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """The rank table of a file of `base64 rank` lines."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes texts by a rank table; one for each worker process.

    The queue is empty again when a call is done. ``buckets[r]`` lists the left positions that wait
    at rank r; bit r & 255 of ``low[r >> 8]`` is set while there are any, and ``top`` has a bit for
    each non-zero word of ``low``. The ids of pre-tokens are remembered in two generations: what a
    full one holds stays while it is met.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        size = max(ranks.values(), default=0) + 1
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.buckets: list[list[int] | None] = [None] * size
        self.low = [0] * ((size >> 8) + 1)
        self.one_byte = np.array([ranks[bytes((x,))] if bytes((x,)) in ranks else NO_BYTE for x in range(256)], np.int64)
        self.two_bytes = np.array([ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)], np.int64)
        self.packed_id = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids (little-endian 32-bit) of each pre-token, none of them empty."""
        joined = b"".join(pieces)
        n = len(joined)
        raw = np.frombuffer(joined, np.uint8).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        pair = np.append(self.two_bytes[raw[:-1] << 8 | raw[1:]], -1)
        pair[ends - 1] = -1
        edge = bytearray(n + 1)
        for end in ends.tolist():
            edge[end] = 1
        edge[0] = 1
        waiting, symbol = pair.tolist(), self.one_byte[raw].tolist()
        waiting.append(-1)
        rank_of, buckets, low, top = self.ranks.get, self.buckets, self.low, 0
        after, before = list(range(1, n + 2)), list(range(-1, n))
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        cuts = np.flatnonzero(np.diff(pair[order], prepend=-1)).tolist()
        places = order.tolist()
        for rank, begin, end in zip(pair[order][cuts].tolist(), cuts, [*cuts[1:], len(places)]):
            buckets[rank] = places[begin:end]
            top |= 1 << (rank >> 8)
            low[rank >> 8] |= 1 << (rank & 255)
        while top:
            word = (top & -top).bit_length() - 1  # find the first set bit, level by level
            bits = low[word]
            rank = (word << 8) + (bits & -bits).bit_length() - 1
            places = buckets[rank]
            places.sort()
            buckets[rank] = None
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            for k, at in enumerate(places):  # leftmost first
                if waiting[at] != rank:
                    continue  # stale
                gone = after[at]
                end = after[gone]
                waiting[gone] = waiting[at] = symbol[gone] = -1
                symbol[at] = rank
                after[at] = end
                before[end] = at
                sooner = False
                if not edge[end]:
                    new = rank_of(joined[at : after[end]])
                    if new is not None:
                        waiting[at] = new
                        if buckets[new] is None:
                            buckets[new] = [at]
                            top |= 1 << (new >> 8)
                            low[new >> 8] |= 1 << (new & 255)
                        else:
                            buckets[new].append(at)
                        sooner = new < rank
                if not edge[at]:
                    left = before[at]
                    new = rank_of(joined[left:end])
                    if new is None:
                        waiting[left] = -1
                    else:
                        waiting[left] = new
                        if buckets[new] is None:
                            buckets[new] = [left]
                            top |= 1 << (new >> 8)
                            low[new >> 8] |= 1 << (new & 255)
                        else:
                            buckets[new].append(left)
                        sooner = sooner or new < rank
                if sooner and k + 1 < len(places):  # a lower rank goes before the rest of this one
                    buckets[rank] = places[k + 1 :]
                    top |= 1 << word
                    low[word] |= 1 << (rank & 255)
                    break
        ids = np.array(symbol, np.int64)
        live = ids >= 0
        if len(ids) and ids.max() >= NO_BYTE:
            raise ValueError(f"the rank table has no token for the byte {joined[int(ids.argmax())]:#04x}")
        packed = ids[live].astype("<u4").tobytes()
        stops = (np.cumsum(live)[ends - 1] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, tokens: set[str]) -> dict[str, bytes]:
        """Remember the ids of tokens that the memo lacks; those that are too long are returned."""
        memo, older = self.memo, self.older
        seen = older.keys() & tokens
        memo.update((token, older[token]) for token in seen)
        short = [token for token in tokens - seen if len(token) <= MEMO_CHARS]
        passing = {token: self.packed_id.get(piece) or self.pieces([piece])[0] for token in tokens - seen if len(token) > MEMO_CHARS for piece in (token.encode("utf-8"),)}
        whole = list(map(self.packed_id.get, map(str.encode, short)))
        memo.update((token, ids) for token, ids in zip(short, whole, strict=True) if ids is not None)
        rest = [token for token, ids in zip(short, whole, strict=True) if ids is None]
        for begin in range(0, len(rest), QUEUE_PIECES):
            some = rest[begin : begin + QUEUE_PIECES]
            memo.update(zip(some, self.pieces(list(map(str.encode, some))), strict=True))
        return passing

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts; null counts as empty."""
        out: list[bytes] = []
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size <= SPLIT_CHARS):
                size += len(texts[end] or "")
                end += 1
            split = [self.split(t) if t else [] for t in texts[begin:end]]
            tokens = set().union(*split)
            if len(self.memo) >= MEMO_ENTRIES:
                self.older, self.memo = self.memo, {}
            passing = self._learn(tokens.difference(self.memo))
            known = self.memo if not passing else self.memo | passing
            out.extend(b"".join(map(known.__getitem__, t)) for t in split)
            begin = end
        return out


class Decoder:
    """Bytes of packed ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token_of = {rank: token for token, rank in ranks.items()}.__getitem__

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.token_of, np.frombuffer(packed or b"", "<u4").tolist()))


@lru_cache(maxsize=2)
def _table(file: bytes) -> dict[bytes, int]:
    return read_ranks(file.splitlines())


@lru_cache(maxsize=2)
def _encoder(file: bytes, pattern: str) -> Encoder:
    return Encoder(_table(file), pattern)


@lru_cache(maxsize=2)
def _decoder(file: bytes) -> Decoder:
    return Decoder(_table(file))


def _sent(df: DataFrame, ranks_path: str):
    """The rank file (about a megabyte), read here and sent to every worker."""
    bounded_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the packed ids (little-endian unsigned 32-bit, one after another) of every text.

    ``ranks_path`` is a rank file that the driver has (its place is a parameter). Each match of
    ``pattern`` is encoded by itself, without special tokens; a text with a byte that the table has
    no token for raises. Null and empty texts give no ids; texts and pre-tokens of any length are
    encoded whole; repeated rows each get their own result; of pairs of equal rank the leftmost is
    merged first; an empty table gives no rows. A column already named ``ids`` is replaced; other
    columns pass through.
    """
    sent = _sent(df, ranks_path)
    kept = df.drop(ids)
    schema = widened(kept, f"`{ids}` binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, pattern)
        for batch in batches:
            packed = pa.array(encoder.encode([t for (t,) in arrow_rows(batch, text)]), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; null ids count as none, unknown ids raise.

    Repeated rows are decoded alike; a column already named ``out`` is replaced, others pass
    through; an empty table gives no rows.
    """
    sent = _sent(df, ranks_path)
    kept = df.drop(out)
    schema = widened(kept, f"`{out}` binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(sent.value)
        for batch in batches:
            texts = [decoder.decode(p) for (p,) in arrow_rows(batch, ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def roundtrip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`encode`, then `decode` of what it gave, in one pass over the rows (half the Python workers)."""
    sent = _sent(df, ranks_path)
    kept = df.drop(ids, out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(sent.value, pattern), _decoder(sent.value)
        for batch in batches:
            packed = encoder.encode([t for (t,) in arrow_rows(batch, text)])
            columns = [*batch.columns, pa.array(packed, pa.binary()), pa.array(map(decoder.decode, packed), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, ids, out])

    return kept.mapInArrow(run, widened(kept, f"`{ids}` binary, `{out}` binary"))


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, after encoding and decoding its whole text.

    Null text counts as empty: no tokens and the digests of nothing. Null and repeated doc_ids each
    get a row; other columns are not read; an empty table gives no rows.
    """
    coded = roundtrip(df.select("doc_id", "text"), ranks_path, pattern)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
