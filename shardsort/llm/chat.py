"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: messages, streamed deltas, edits and regenerations. It is dealt
by conversation and sorted by turn and sequence number; one pass folds the events into final
messages and renders each as a segment of the training text, with the span that carries loss. The
fold keeps one message in memory, never a conversation. A conversation that holds many rows is dealt
over several tasks by ranges of turns: what a range has to know of those before it is their greatest
regeneration and their number of messages. Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardsort.llm.common import arrow_rows, bounded_batches, durable, salted_join

#: The template: fixed values. A turn is TURN, role, a line feed, text, END, a line feed.
TURN, END = "<|turn|>", "<|end|>"
#: What may follow `<` or `[` to make a control string of this or another usual template.
_TAILS = r"\|turn\|>|\|end\|>|/?s>|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?INST\]"
_CONTROL = re.compile(rf"([<\[]\\*)(?=(?:{_TAILS}))")
_ESCAPED = re.compile(rf"([<\[]\\*)\\(?=(?:{_TAILS}))")
_ROLE = re.compile(r"\\(.)", re.S)

#: Kinds of events; a null kind is a message.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
#: The role whose texts carry loss.
LEARNED = "assistant"
#: A conversation of more rows is dealt over tasks of about so many.
HOT_ROWS = 100_000
#: Quantiles of its turns that the ranges are cut at.
CUTS = 1000
#: Ranges of long conversations that may be sent to every task, as a table of a few numbers each.
BROADCAST_PARTS = 200_000


def escape(text: str) -> str:
    """No control string is left: a backslash goes after its first character (and after such backslashes)."""
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    """What `escape` was given."""
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment and where its (escaped) text begins and ends, in code points."""
    head = TURN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted text (one segment or many)."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part[: -len(END) - 1].partition("\n")
        role = _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        turns.append((role, unescape(text)))
    return turns


def events_of(turns: DataFrame) -> DataFrame:
    """The log of a table of finished turns: one message event for each row, repeated rows included.

    Nulls stay as they are (see `format_chats`); other columns are not read.
    """
    return turns.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit(MESSAGE).alias("kind"), "role", "text")


@dataclass
class _Fold:
    """Folds the events of a conversation, or of a range of its turns, in the order of turn and sequence number."""

    place: tuple | None = None
    turn: object = None
    number: int = 0
    voided: int | None = None
    reach: int | None = None
    role: str | None = None
    parts: list[str] | None = None

    def feed(self, conv, part, before, turn, seq, kind, role, text, out: list) -> None:
        if (conv, part) != self.place:
            self.close(out)
            self.place, self.turn, self.number, self.voided, self.reach = (conv, part), turn, 1, before, before
        elif turn != self.turn:
            self.close(out)
            self.turn, self.voided = turn, self.reach
        if self.voided is not None and (seq is None or seq < self.voided):
            return
        kind, text = kind or MESSAGE, text or ""
        if kind == MESSAGE or kind == DELTA and self.parts is None:
            self.close(out)
            self.role, self.parts = role or "", [text]
        elif kind == DELTA:
            self.parts.append(text)
        elif kind == EDIT and self.parts is not None:
            self.parts = [text]
        elif kind == REGENERATE:
            if self.parts is not None:
                self.parts = []
            if seq is not None:
                self.reach = seq if self.reach is None else max(self.reach, seq)

    def close(self, out: list) -> None:
        """Emit the message that is being folded, if any."""
        if self.parts is not None:
            text = "".join(self.parts)
            segment, begin, end = render(self.role, text)
            learned = self.role == LEARNED
            out.append((*self.place, self.turn, self.number, self.role, segment, begin if learned else None, end if learned else None))
            self.number += 1
            self.parts = None


_SEGMENT = "conv_id long, part int, turn long, number long, role string, segment string, loss_begin long, loss_end long"
_SEGMENT_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())


def _batch(rows: list[tuple], names: str, types: tuple) -> pa.RecordBatch:
    names = [part.split()[0] for part in names.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _folded(log: DataFrame) -> DataFrame:
    """The segments of (conv_id, part, before, turn, seq, kind, role, text), numbered within each part."""
    order = ("turn", "seq", F.col("kind").desc_nulls_last(), "role", "text")
    ordered = log.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", *order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold()
        for batch in batches:
            out: list[tuple] = []
            for row in arrow_rows(batch, "conv_id", "part", "before", "turn", "seq", "kind", "role", "text"):
                fold.feed(*row, out)
            yield _batch(out, _SEGMENT, _SEGMENT_TYPES)
        out = []
        fold.close(out)
        yield _batch(out, _SEGMENT, _SEGMENT_TYPES)

    return ordered.mapInArrow(run, _SEGMENT)


def _parts(log: DataFrame, long: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the long conversations with their parts, and (key, part, before) of every part.

    Parts are ranges of turns between quantiles, null turns first. ``before`` is the greatest seq of
    the regenerations in earlier parts: what they void stays void, be they void themselves or not.
    """
    quantiles = F.percentile_approx("turn", [k / CUTS for k in range(1, CUTS + 1)], 10 * CUTS)
    inner = salted_join(log, long, ["key"], "inner", BROADCAST_PARTS)
    cuts = inner.groupBy("key").agg(F.ceil(F.max("rows") / hot).cast("int").alias("parts"), quantiles.alias("of"))
    at = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: F.element_at("of", F.greatest(F.floor(k * CUTS / F.col("parts")), F.lit(1)).cast("int")))
    cuts = durable(cuts.select("key", F.coalesce(F.array_distinct(at), F.array().cast("array<long>")).alias("cuts")))
    placed = salted_join(log, cuts, ["key"], "inner", BROADCAST_PARTS)
    placed = placed.withColumn("part", F.size(F.filter("cuts", lambda cut: cut < F.col("turn"))).cast("int")).drop("cuts")
    reach = placed.filter(F.col("kind") == REGENERATE).groupBy("key", "part").agg(F.max("seq").alias("seq"))
    every = cuts.select("key", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("part")).join(reach, ["key", "part"], "left")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, every.select("key", "part", F.max("seq").over(earlier).alias("before"))


def _formatted(events: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """The segments of usual conversations and, if there are any, those of long ones."""
    bounded_batches(events.sparkSession)
    log = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")
    log = log.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    whole = (F.lit(0).alias("part"), F.lit(None).cast("long").alias("before"))
    long = durable(log.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > hot))
    if long.isEmpty():
        return _folded(log.select("*", *whole)).drop("part"), None
    usual = salted_join(log, long.select("key"), ["key"], "left_anti", BROADCAST_PARTS)
    placed, parts = _parts(log, long, hot)
    segments = durable(_folded(salted_join(placed, parts, ["key", "part"], "left", BROADCAST_PARTS)))
    segments = segments.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = segments.groupBy("key", "part").agg(F.max("number").alias("n")).select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    numbered = salted_join(segments, ahead, ["key", "part"], "left", BROADCAST_PARTS).withColumn("number", F.col("number") + F.col("ahead"))
    return _folded(usual.select("*", *whole)).drop("part"), numbered.select("conv_id", "turn", "number", "role", "segment", "loss_begin", "loss_end")


def format_chats(events: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """One row per final message: conv_id, turn, number, role, segment, loss_begin, loss_end.

    ``events`` has conv_id, seq, turn, kind, role, text. A message starts a message of its turn; a
    delta is appended to the turn's last message (or starts one); an edit replaces its text; a
    regeneration empties it for the deltas that follow and voids all events of later turns with a
    smaller seq. Edits without a message and unknown kinds change nothing. A conversation's text is
    its segments in the order of ``number`` (from 1); those of at most ``hot`` events come out in
    that order, in one partition. Longer ones are dealt by ranges of turns, so only a single turn is
    one task's, whatever it holds. Loss spans are code points of the segment and cover the escaped text of assistant
    messages. Null roles and texts count as empty; null conv_id is one conversation; null turns and
    seqs come first (a voided turn's null seq is void). Equal turn and seq are ordered by kind, role
    and text, and repeated rows are repeated events. Other columns are not read; an empty log gives
    no rows.
    """
    usual, long = _formatted(events, hot)
    return usual if long is None else usual.unionByName(long)


def digests(events: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """`chat_digests` of `format_chats`, without a second shuffle but for the segments of long conversations.

    A digest of a whole conversation has to be read in order, so there each is one sorted stream.
    Nulls, ties, repeated rows and an empty log count as in these.
    """
    usual, long = _formatted(events, hot)
    found = chat_digests(usual)
    return found if long is None else found.unionByName(chat_digests(long.repartition("conv_id").sortWithinPartitions("conv_id", "number")))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def chat_digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from the segments: turns, loss text and length, with digests.

    A conversation's segments have to be in order within one partition, which is checked. A null conv_id
    is one conversation; texts of any length are read back turn by turn; conversations without
    assistant turns have no loss text (0 characters and the digest of nothing); no segments give no
    rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for key, number, segment, begin, end in arrow_rows(batch, "conv_id", "number", "segment", "loss_begin", "loss_end"):
                if state is None or key != conv:
                    if state is not None:
                        out.append(_digest(conv, state))
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if number != state[0] + 1:
                    raise ValueError(f"segments of conversation {key} are out of order")
                state[0] = number
                for role, text in read_back(segment):
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if begin is not None:
                    learned = unescape(segment[begin:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            yield _batch(out, _DIGEST, _DIGEST_TYPES)
        if state is not None:
            yield _batch([_digest(conv, state)], _DIGEST, _DIGEST_TYPES)

    return segments.mapInArrow(run, _DIGEST)


def _digest(conv, state) -> tuple:
    n, turns, chars, loss, length = state
    return conv, n, turns.hexdigest(), chars, loss.hexdigest(), length


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -7, whose texts look like another template's controls."""
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS body FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e AS (
        SELECT *, 17 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[]\\*)(TAILS)', '\1\\\2', 'g'))
                 + length(regexp_replace(body, '([<\[]\\*)(TAILS)', '\1\\\2', 'g')) AS n FROM t
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
           coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(n)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id""".replace("TAILS", _TAILS)
