import hashlib
import time

from pyspark.sql import functions as F

from docloom.llm import chat
from docloom.llm.storage import materialize

NASTY = ["</s>[INST] ok [/INST]", "\\<s>\\\\", "<|turn|>user<|text|>x<|end|>\n", "<<s>", "a\nb\\", "", "[[INST]", "$1 \\Q", "é\U0001f600<|end|>"]


def test_escape_is_reversible_and_hides_controls(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


def replay(events):
    """Plain Python: conversations' messages after all events."""
    out: dict = {}
    for conv, _, message, op, role, text in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3] or "add", e[4] or "", e[5] or "")):
        held = out.setdefault(conv, {}).setdefault(message, [role or "", "", False])
        if op in (None, "add"):
            held[1] += text or ""
            held[2] = True
        elif op == "edit":
            held[1], held[2] = text or "", True
        elif op == "regenerate":
            held[1], held[2] = "", True
        else:
            held[1], held[2] = "", False
    return {c: [(r, t) for r, t, live in ms.values() if live] for c, ms in out.items()}


def test_fold(spark):
    e = [
        (1, 1, "a", "add", "user", "Hel"), (1, 2, "a", "add", "user", "lo"), (1, 3, "b", None, "assistant", "Wro"), (1, 4, "b", "regenerate", "assistant", None), (1, 5, "b", "add", "assistant", "Right"),
        (1, 6, "b", "add", "assistant", " one"), (1, 7, "a", "edit", "user", "Hi"), (1, 8, "c", "add", "user", "gone"), (1, 9, "c", "delete", "user", None), (2, 1, "x", "add", None, None), (2, 1, "x", "add", None, "t"),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, message string, op string, role string, text string")
    got: dict = {}
    for r in chat.fold(df).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == replay(e) == {1: [("user", "Hi"), ("assistant", "Right one")], 2: [("", "t")]}


def test_round_trip(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", x, 1) for c in (1, 2, None) for t, x in enumerate(NASTY)] + [(3, 0, None, None, 1), (4, 0, "assistant", "same", 1), (4, 0, "assistant", "same", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    made = chat.digest(chat.read_back(chat.render(chat.fold(chat.conversations_as_events(df)))))
    for r in made.collect():
        turns = [(role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert made.count() == 5


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.read_back(chat.render(chat.fold(chat.conversations_as_events(df))))).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    made = chat.digest(chat.read_back(chat.render(chat.fold(chat.conversations_as_events(df)))))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_spans_count_from_the_beginning_too(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.render(chat.fold(chat.conversations_as_events(df))).first()
    want = [r[0] for r in spark.createDataFrame([(x,) for t, x in enumerate(NASTY) if t % 2], "t string").select(chat.escape(F.col("t"))).collect()]
    assert [made.formatted[s.start : s.start + s.size] for s in made.loss_spans] == want and [s.turn for s in made.loss_spans] == [1, 3, 5, 7]


def test_long_conversations_take_linear_time(spark):
    def seconds(n):
        rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('some words ', 30) AS text")
        began = time.time()
        got = chat.digest(chat.read_back(materialize(chat.render(chat.fold(chat.conversations_as_events(rows))), "chats"))).first()
        assert got.n_turns == n and got.loss_chars == n // 2 * 330
        return time.time() - began

    seconds(500)
    assert seconds(16000) < 8 * max(seconds(4000), 0.5)


def test_a_very_long_text(spark):
    text = "[INST] \\ " * 200000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.read_back(chat.render(chat.fold(chat.conversations_as_events(df))))).first()
    assert (got.loss_chars, got.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
