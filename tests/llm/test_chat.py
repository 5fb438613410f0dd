import hashlib
import random
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardsort.llm import chat

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string, number string"
PIECES = ["<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|end|>", "a", "\n", "é"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.lists(st.sampled_from([*PIECES, "user"]), max_size=5).map("".join))
def test_escaping_is_reversible_and_complete(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in ("<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    segment, begin, end = chat.render(role, text)
    assert chat.read_back(segment * 2) == [(role, text)] * 2 and chat.unescape(segment[begin:end]) == text


def fold(events):
    """The rule over a whole conversation at once: events that no later regeneration of an earlier turn voids, turn by turn."""
    live = [e for e in events if not any(r[2] == "regenerate" and r[0] < e[0] and e[1] < r[1] and alive(r, events) for r in events)]
    messages = []
    for turn in sorted({e[0] for e in live}):
        own = []
        for _, _, kind, role, text in sorted((e for e in live if e[0] == turn), key=lambda e: e[1]):
            if kind == "message" or kind == "delta" and not own:
                own.append([role, text])
            elif kind == "delta":
                own[-1][1] += text
            elif kind == "edit" and own:
                own[-1][1] = text
            elif kind == "regenerate" and own:
                own[-1][1] = ""
        messages += map(tuple, own)
    return messages


def alive(r, events):
    return not any(o[2] == "regenerate" and o[0] < r[0] and r[1] < o[1] and alive(o, events) for o in events)


def test_events_fold_like_the_rule(spark):
    rng = random.Random(9)
    rows, by_conv = [], defaultdict(list)
    for conv in range(60):
        for seq in range(rng.randrange(1, 25)):
            event = (rng.randrange(4), seq, rng.choice(["message", "delta", "delta", "edit", "regenerate", "delta"]), rng.choice(["user", "assistant"]), f"t{seq} ")
            by_conv[conv].append(event)
            rows.append((conv, seq, event[0], event[2], event[3], event[4], None))
    rng.shuffle(rows)
    got = defaultdict(list)
    for r in chat.format_chats(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "number").collect():
        [(role, text)] = chat.read_back(r["segment"])
        got[r["conv_id"]].append((role, text))
        assert (r["loss_begin"] is not None) == (role == "assistant")
    assert {c: got[c] for c in by_conv} == {c: fold(e) for c, e in by_conv.items()}


def test_long_conversations_are_dealt_and_give_the_same(spark):
    rng, rows = random.Random(4), []
    for conv, n in [(1, 300), (2, 5), (None, 120), (3, 90), (4, 60)]:
        for seq in range(n):
            turn = None if conv == 4 or rng.random() < 0.05 else rng.randrange(1 + n // 4)
            kind = "regenerate" if rng.random() < 0.02 else rng.choice(["message", "delta", "edit", None])
            rows.append((conv, None if rng.random() < 0.05 else seq, turn, kind, rng.choice(["user", "assistant", None]), rng.choice([f"t{seq} </s>", None, ""]), "x"))
    rows += rows[:40]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, EVENTS).repartition(3)
    once, dealt = (sorted(map(tuple, chat.format_chats(log, hot).collect()), key=repr) for hot in (1000, 20))
    assert once == dealt and len(once) > 50
    one, other = (sorted(map(tuple, chat.digests(log, hot).collect()), key=repr) for hot in (1000, 20))
    assert one == other and len(one) == 5
    keyed = log.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    placed, _ = chat._parts(keyed, keyed.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 20"), 20)
    spread = {r["conv_id"]: r["n"] for r in placed.groupBy("conv_id").agg(F.count_distinct("part").alias("n")).collect()}
    assert spread[1] > 10 and spread[3] > 2 and spread[4] == 1 and 2 not in spread


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, 0, None, None, None, None), (1, 0, 0, None, "assistant", "b", None), (1, 0, 0, None, "assistant", "b", None), (None, None, None, None, "user", "x", None), (2, 0, 0, "edit", "user", "lost", None), (3, 1, 1, "unknown", "user", "lost", None)]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, EVENTS)).collect()}
    assert set(got) == {1, None} and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2
    assert got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"user\nx\n").hexdigest()


def test_the_probe(spark, small):
    turns = chat.with_probe(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    [row] = chat.digests(chat.events_of(turns)).collect()
    said = "</s>[INST] ok [/INST]"
    assert row["conv_id"] == -7 and row["n_turns"] == 2 and row["loss_chars"] == len(said)
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_a_long_conversation_streams(spark):
    turns = spark.range(20_000).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('text ', id) text")
    [row] = chat.digests(chat.events_of(turns)).collect()
    assert row["n_turns"] == 20_000


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0
